"""Comparing two tables by building key, moving columns, appending what is new, measuring a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATCHED, ONLY_A, ONLY_B, NOT_FOUND = "сопоставлено", "только A", "только B", "не найдено"


def compare_tables(a: DataFrame, b: DataFrame, key: str = "key", row: str = "row_idx") -> DataFrame:
    """status, key_a, key_b, a_row, b_row: every pair of rows with one key, and the rows of either side alone.

    Blank keys take no part. Rows of B know the status of their key before the join, so the pairs
    meet nothing else and no text is made for each.
    """
    left = a.where(F.col(key) != "").select(F.col(key).alias("key_a"), F.col(row).alias("a_row"))
    right = b.where(F.col(key) != "").select(F.col(key).alias("key_b"), F.col(row).alias("b_row"))
    many = right.groupBy(F.col("key_b").alias("k")).agg(F.count("*").alias("n"))
    told = many.select("k", F.when(F.col("n") == 1, MATCHED).otherwise(F.concat(F.lit(f"{MATCHED}: "), F.col("n").cast("string"), F.lit(" строк B"))).alias("told"))
    both = left.join(right.join(told, F.col("key_b") == F.col("k")), F.col("key_a") == F.col("key_b"), "full")
    status = F.when(F.col("key_b").isNull(), ONLY_A).when(F.col("key_a").isNull(), ONLY_B).otherwise(F.col("told"))
    return both.select(status.alias("status"), "key_a", "key_b", "a_row", "b_row")


def comparison_order(compared: DataFrame) -> DataFrame:
    """Matched pairs, then only A, then only B, each by key and row."""
    group = F.when(F.col("key_b").isNull(), 2).when(F.col("key_a").isNull(), 3).otherwise(1)
    return compared.orderBy(group, F.coalesce("key_a", "key_b"), F.col("a_row").asc_nulls_last(), F.col("b_row").asc_nulls_last())


def merge_distinct(value: Column, order: Column) -> Column:
    """Aggregate: different non-blank values in order of first appearance, a line each."""
    text = F.btrim(value)
    met = F.collect_list(F.when(text != "", F.struct(order.alias("o"), text.alias("v"))))
    return F.array_join(F.array_distinct(F.transform(F.array_sort(met), lambda x: x["v"])), "\n")


def move_columns(primary: DataFrame, source: DataFrame, payload: list[str], key: str = "key", row: str = "row_idx", prefix: str = "src_") -> DataFrame:
    """primary with the payload of the source rows of its key, a status, and no row lost or repeated.

    The source is merged by key before the join. A payload name that primary has already gets the prefix.
    """
    merged = source.where(F.col(key) != "").groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"), *[merge_distinct(F.col(p), F.col(row)).alias(f"_{p}") for p in payload])
    named = [F.col(f"_{p}").alias(prefix + p if p in primary.columns else p) for p in payload]
    status = F.when(F.col("_n").isNull(), NOT_FOUND).when(F.col("_n") == 1, MATCHED).otherwise(F.concat(F.lit(f"{MATCHED}: "), F.col("_n").cast("string"), F.lit(" записи")))
    return primary.where(F.col(key) != "").join(merged, F.col(key) == F.col("_k"), "left").select(*primary.columns, *named, status.alias("status"))


def move_audit(primary: DataFrame, source: DataFrame, raw: str, key: str = "key", row: str = "row_idx") -> DataFrame:
    """reason, key, row, raw: keys with several source rows, and source rows without a primary row."""
    p = primary.where(F.col(key) != "").select(F.col(key).alias("key"), F.col(row).alias("row"))
    s = source.where(F.col(key) != "").select(F.col(key).alias("key"), F.col(row).alias("s_row"), F.col(raw).alias("raw"))
    several = s.groupBy("key").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_row", "raw"))), lambda x: x["raw"]), " | ").alias("raw")).where("n > 1")
    multiple = p.join(several, "key").select(F.lit("multiple_source_rows").alias("reason"), "key", "row", "raw")
    lost = s.join(p.select("key").distinct(), "key", "left_anti").select(F.lit("source_not_found_in_primary").alias("reason"), "key", F.col("s_row").alias("row"), "raw")
    return multiple.unionByName(lost)


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. Spark keeps one row for each task and key before it shuffles."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def append_new(source: DataFrame, target: DataFrame, key: str = "key", row: str = "row_idx") -> DataFrame:
    """Source rows whose key is new to target, the first of each."""
    new = source.where(F.col(key) != "").join(target.select(key).distinct(), key, "left_anti")
    return first_seen(new, [key], [row])


def benchmark(collected: DataFrame, control: DataFrame, key: str = "key") -> DataFrame:
    """One row: matched, missing, extra, coverage and precision (6 places), duplicates of each side."""
    side = lambda df, name: df.where(F.col(key) != "").groupBy(key).agg(F.count("*").alias(name))
    both = side(collected, "c").join(side(control, "k"), key, "full")
    here, there = F.col("c").isNotNull(), F.col("k").isNotNull()
    out = both.agg(F.count_if(here & there).alias("matched"), F.count_if(~here & there).alias("missing"), F.count_if(here & ~there).alias("extra"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("collected_duplicates"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("control_duplicates"))
    share = lambda other: F.round(F.coalesce(F.try_divide(F.col("matched"), F.col("matched") + F.col(other)), F.lit(0.0)), 6)
    return out.withColumns({"coverage": share("missing"), "precision": share("extra")})


def key_sets(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """side (both, only_a, only_b), n_keys: the different keys of two tables, told apart in one pass; a side without any counts 0."""
    side = lambda df, name: df.where(F.col(key) != "").groupBy(key).agg(F.lit(True).alias(name))
    both = side(a, "a").join(side(b, "b"), key, "full")
    here, there = F.col("a").isNotNull(), F.col("b").isNotNull()
    counts = {"both": here & there, "only_a": here & ~there, "only_b": ~here & there}
    one = both.agg(*[F.count_if(c).alias(name) for name, c in counts.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("side"), F.col(name).alias("n_keys")) for name in counts])))
