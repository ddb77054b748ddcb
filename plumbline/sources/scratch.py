"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []

#: The folder of a session that names none, by application.
_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one of our own only where none is named and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        own = tempfile.mkdtemp(prefix="spark-plumbline-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own[app] = f"file://{own}"
    return _own[app]


def place(spark: SparkSession, label: str = "table") -> str:
    """A path in the shared folder for a table that is removed when the process ends."""
    path = f"{folder(spark)}/plumbline-{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(remove_all)
    _made.append((spark, path))
    return path


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt over tasks by keys, ahead of work that takes long for each row: a small file is one task, however many rows it holds."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def settled(df: DataFrame, label: str = "table") -> DataFrame:
    """df as a Parquet table: cuts lineage, survives lost executors. Removed when the process ends."""
    path = place(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Removes a table that settled() made and that no later step reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def remove_all() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; its folder is then cleared with it
            return
