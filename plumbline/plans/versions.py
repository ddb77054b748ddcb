"""Versions of a table folder behind a pointer that changes in one rename.

A version is a folder of its own, written whole and never touched again. The pointer is the
newest file in `_pointers`: a file named by the next number, which holds the version's name, is
written under another name and then renamed to a name that doesn't exist yet. So a reader finds
either the version before or the new one, wherever a publisher stops, and of two publishers one
fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

POINTERS = "_pointers"


def _fs(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, folder: str) -> list[str]:
    path, fs = _fs(spark, folder)
    at = path(f"{folder}/{POINTERS}")
    return sorted(n for p in (fs.listStatus(at) if fs.exists(at) else []) if (n := p.getPath().getName()).isdigit())


def _read(spark: SparkSession, file: str) -> str:
    return spark.read.text(file).first().value


def current(spark: SparkSession, folder: str) -> str | None:
    """The path of the version that counts; None before the first."""
    numbers = _numbers(spark, folder)
    return f"{folder}/{_read(spark, f'{folder}/{POINTERS}/{numbers[-1]}')}" if numbers else None


def point(spark: SparkSession, folder: str, name: str) -> None:
    """Makes the version `name` count."""
    path, fs = _fs(spark, folder)
    numbers = _numbers(spark, folder)
    number = f"{int(numbers[-1]) + 1 if numbers else 1:09d}"
    new = path(f"{folder}/{POINTERS}/_{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(name.encode())
    out.close()
    if not fs.rename(new, path(f"{folder}/{POINTERS}/{number}")):
        fs.delete(new, False)
        raise RuntimeError(f"another publisher has just changed {folder}")


def prune(spark: SparkSession, folder: str, keep: int) -> None:
    """Removes all but the last `keep` versions that counted, and what a publisher that stopped has left."""
    path, fs = _fs(spark, folder)
    numbers = _numbers(spark, folder)
    stays = {_read(spark, f"{folder}/{POINTERS}/{n}") for n in numbers[-keep:]}
    for p in fs.listStatus(path(folder)):
        name = p.getPath().getName()
        if p.isDirectory() and name != POINTERS and name not in stays:
            fs.delete(p.getPath(), True)
    for n in numbers[:-keep]:
        fs.delete(path(f"{folder}/{POINTERS}/{n}"), False)


def publish(spark: SparkSession, folder: str, name: str, write: Callable[[str], None], keep: int = 3) -> str:
    """write(path) makes the version; then it counts; then old ones go. Returns its path."""
    version = f"{name}-{uuid.uuid4().hex[:8]}"
    write(f"{folder}/{version}")
    point(spark, folder, version)
    prune(spark, folder, keep)
    return f"{folder}/{version}"
