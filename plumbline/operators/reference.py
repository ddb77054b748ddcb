"""Reference directories: merging rows, status, order, filling and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import clean, natural_key, normalized


def first_filled(column: str, order: Column) -> Column:
    """Aggregate: the first non-blank value in order."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull() & (F.col(column).cast("string") != ""), order)).alias(column)


def merge_rows(rows: DataFrame, key: str, order: str, fields: list[str], example: str, most_examples: int = 5) -> DataFrame:
    """One row for each key: the first value of each field that isn't blank, the row count, up to most_examples examples."""
    first = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("_first", example))), lambda x: x[example]), 1, most_examples)
    # examples are made different and cut before they meet in one group
    shown = rows.where(F.col(example) != "").groupBy(key, example).agg(F.min(order).alias("_first"))
    shown = shown.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_first", example))).where(F.col("_n") <= most_examples).groupBy(key).agg(F.array_join(first, " | ").alias("examples"))
    merged = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[first_filled(f, F.col(order)) for f in fields], F.count("*").alias("source_count"))
    return merged.join(shown, key, "left")


def staged(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with status (ready for the first of a key, duplicate for others) and the group's size."""
    sizes = rows.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("group_size"), F.min(order).alias("_first"))
    return rows.join(sizes, F.col(key) == F.col("_k")).withColumn("status", F.when(F.col(order) == F.col("_first"), "ready").otherwise("duplicate")).drop("_k", "_first")


def natural_order(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """rows by the natural order of columns, blanks last, ties as they came."""
    return rows.orderBy(*[natural_key(c) for c in columns], order)


def fill_summary(rows: DataFrame, slots: list[str]) -> DataFrame:
    """slot, filled, fill_rate (4 places), from one pass over rows."""
    filled = {s: F.count_if(F.coalesce(F.btrim(F.col(s).cast("string")) != "", F.lit(False))) for s in slots}
    one = rows.agg(F.count("*").alias("total"), *[v.alias(s) for s, v in filled.items()])
    return one.select("total", F.inline(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).alias("filled")) for s in slots]))).select("slot", "filled", F.round(F.coalesce(F.try_divide("filled", "total"), F.lit(0.0)), 4).alias("fill_rate"))


def fill_samples(rows: DataFrame, slots: list[str], order: str, most: int = 5) -> DataFrame:
    """slot, samples: the first `most` different values of each slot, in order of rows, cut before they meet."""
    each = rows.select(order, F.inline(F.array(*[F.struct(F.lit(s).alias("slot"), clean(F.col(s).cast("string")).alias("value")) for s in slots]))).where("value is not null")
    first = each.groupBy("slot", "value").agg(F.min(order).alias("_o"))
    # in parts first, so that a slot of very many values is no task of its own
    for part in (["slot", "_part"], ["slot"]):
        first = first.withColumn("_part", F.pmod(F.xxhash64("value"), F.lit(64))).withColumn("_n", F.row_number().over(Window.partitionBy(*part).orderBy("_o", "value"))).where(F.col("_n") <= most)
    return first.groupBy("slot").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "value"))), lambda x: x["value"]), " | ").alias("samples"))


def incomplete_rows(rows: DataFrame, slots: list[str], order: str, most: int = 5) -> DataFrame:
    """order, missing: the first `most` rows that lack some of the slots, with these; the limit is the feature."""
    missing = F.array_compact(F.array(*[F.when(clean(F.col(s).cast("string")).isNull(), s) for s in slots]))
    there = rows.select(order, missing.alias("m")).where((F.size("m") > 0) & (F.size("m") < len(slots)))
    return there.orderBy(order).limit(most).select(order, F.array_join("m", ", ").alias("missing"))


def completeness(rows: DataFrame, slots: list[str]) -> DataFrame:
    """One row: complete, incomplete and empty rows."""
    n = sum((F.coalesce(F.btrim(F.col(s).cast("string")) != "", F.lit(False)).cast("int") for s in slots), F.lit(0))
    return rows.agg(F.count_if(n == len(slots)).alias("complete"), F.count_if((n > 0) & (n < len(slots))).alias("incomplete"), F.count_if(n == 0).alias("empty"))


def issue_summary(rows: DataFrame, issues: str = "issues") -> DataFrame:
    """issue, rows; rows without any count as clean."""
    return rows.select(F.explode(F.when(F.size(issues) == 0, F.array(F.lit("clean"))).otherwise(F.col(issues))).alias("issue")).groupBy("issue").agg(F.count("*").alias("n_rows"))


def construct_address(levels: list[Column]) -> Column:
    """Levels joined by commas, each different one once (by normalized form), blanks left out."""
    kept = F.filter(F.array(*levels), lambda x: x.isNotNull() & (F.btrim(x) != ""))

    def add(acc: Column, x: Column) -> Column:
        return F.when(F.exists(acc, lambda y: normalized(y) == normalized(x)), acc).otherwise(F.concat(acc, F.array(x)))

    return F.array_join(F.aggregate(kept, F.array().cast("array<string>"), add), ", ")


def match_key(levels: list[Column]) -> Column:
    return F.array_join(F.filter(F.transform(F.array(*levels), normalized), lambda x: x != ""), "|")


def updated(existing: DataFrame, new: DataFrame, key: str, fields: list[str], example: str, order: str = "row_idx") -> DataFrame:
    """A reference brought up to date: existing rows come first, so their values win; new ones fill blanks and add keys."""
    both = existing.withColumn("_o", F.struct(F.lit(0).alias("s"), order)).unionByName(new.withColumn("_o", F.struct(F.lit(1).alias("s"), order)), allowMissingColumns=True)
    return merge_rows(both, key, "_o", fields, example)


def cleaned(rows: DataFrame, key: str, issues: Column, order: str = "row_idx") -> DataFrame:
    """Rows of a reference without issues, the first of each key.

    The issues are asked for in the aggregate: as a filter they would move ahead of the shuffle that
    deals rows over tasks.
    """
    first = F.min_by(F.struct(*rows.columns), F.when(F.size(issues) == 0, F.struct(order)))
    return rows.groupBy(F.col(key).alias("_k")).agg(first.alias("_r")).where("_r is not null").select("_r.*")


def by_address(rows: DataFrame, address: str = "normalized_address") -> DataFrame:
    """In order of the lower-cased address, blanks first, as reports have it."""
    return rows.orderBy(F.lower(F.coalesce(address, F.lit(""))))
