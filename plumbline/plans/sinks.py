"""What jobs leave behind: results, staging tables, reports, audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_staging(folder: str, run: str, **tables: DataFrame) -> dict[str, str]:
    """Writes each table under the run's folder; gives their paths."""
    paths = {name: f"{folder}/{run}/{name}" for name in tables}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def report(spark: SparkSession, run: str, counts: dict[str, DataFrame], **facts: str) -> DataFrame:
    """One row with a JSON text: the facts and the number of rows of each table, counted in one job."""
    sizes = spark.createDataFrame([], "name string, n long")
    for name, df in counts.items():
        sizes = sizes.unionByName(df.agg(F.lit(name).alias("name"), F.count("*").alias("n")))
    rows = sizes.agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("rows"))
    return rows.select(F.to_json(F.struct(F.lit(run).alias("run"), *[F.lit(v).alias(k) for k, v in facts.items()], "rows")).alias("report"))


def normalization_audit(guarded: DataFrame, row: str, raw: str) -> DataFrame:
    """Rows whose normalization was refused."""
    return guarded.where("kept_original").select(row, F.col(raw).alias("raw"), F.lit("normalization_refused").alias("reason"))


def append_addresses(new: DataFrame, target: str, column: str = "address") -> None:
    """Adds what is new to the table at target, after its last row: row_idx goes on, and what is there already stays out."""
    from plumbline.functions.text import building_key
    from plumbline.operators.compare import append_new
    from plumbline.sources.cells import numbered

    spark = new.sparkSession
    there = spark.read.parquet(target)
    last = there.where(F.coalesce(F.btrim(column), F.lit("")) != "").agg(F.max("row_idx")).first()[0]
    keyed = lambda df: df.withColumn("key", building_key(column))
    fresh = append_new(keyed(new.select("row_idx", column)), keyed(there))
    out = numbered(fresh.withColumn("_by", F.struct("row_idx", column)), "_by").select((F.col("number") + F.lit(-1 if last is None else last)).cast("long").alias("row_idx"), column)
    out.write.mode("append").parquet(target)


def aligned_layout(result: DataFrame, leading: list[str], aligned: dict[str, list[str]], skipped: list[str]) -> DataFrame:
    """Columns of an aligned sheet: leading ones, each aligned one with its companions, then those that took no part."""
    columns = [*leading, *[c for target, more in aligned.items() for c in (target, *more)], *skipped]
    return result.select(*dict.fromkeys(columns))
