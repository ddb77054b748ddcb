"""Small helpers that the training-data operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources import scratch

#: Stands for a null doc_id inside an operator: below every real id.
NO_ID = -(2**63)

#: ASCII white space as the contracts have it: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    return scratch.settled(df, label)


def drop_written(df: DataFrame) -> None:
    scratch.drop(df)


def doc_key(col: str | Column = "doc_id") -> Column:
    """doc_id as a long that is never null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("long"), F.lit(NO_ID))


def null_id(col: str | Column) -> Column:
    """doc_key() undone."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c != NO_ID, c)


def text_bytes(col: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes, null as empty, without decoding them."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def slices(batches, most_bytes: int = 12 << 20, most_rows: int = 4096):
    """Record batches cut so that each holds a bounded number of rows and about most_bytes."""
    for batch in batches:
        rows = max(1, min(most_rows, int(batch.num_rows * most_bytes / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_kept: list = []


def kept(source, make):
    """make(source), kept in a Python worker from task to task; one thing at a time, so that stages don't add up."""
    if not _kept or _kept[0] is not source:
        _kept.clear()
        _kept.extend([source, make(source)])
    return _kept[1]
