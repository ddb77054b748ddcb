"""Whole jobs: align, collect, build and sort a reference, compare, move, append, publish."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import address as A
from plumbline.functions import slots as S
from plumbline.functions import text as T
from plumbline.operators import assembly, collect, compare, matching, profile, reference, registry, sanitize
from plumbline.plans import versions
from plumbline.sources import cells, files
from plumbline.sources.cells import numbered
from plumbline.sources.scratch import settled


def prepared_side(rows: DataFrame, column: str, idx: str, city: str = "", known: DataFrame | None = None, keys: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """idx, text, ter, sw, sn, hb, hm of the addresses in column; with a registry their code, with scope keys their hits."""
    there = rows.where(F.btrim(column) != "").select(F.col("row_idx").alias(idx), F.col(column).alias("raw"), *keep)
    if known is None and keys is None:
        return settled(A.parsed(there, "raw", city).select(idx, T.normalized("raw").alias("text"), "raw", "parsed.*", *keep))
    p = S.normalized_addresses(there, "raw", known, city).select(idx, T.normalized("raw").alias("text"), "raw", "parsed.*", F.coalesce("oktmo_code", F.lit("")).alias("code"), *keep)
    p = settled(p)
    if keys is not None:
        records = p.select(F.col(idx).alias("id"), "text", "code", F.col("raw").rlike(collect.HINTS).alias("has_context"))
        hits = registry.scope_hits(records, keys).select(F.col("id").alias(idx), "hits")
        p = settled(p.join(hits, idx, "left").withColumn("hits", F.coalesce("hits", F.array().cast(matching.NO_HITS))))
    return p


def align(gt: DataFrame, candidates: DataFrame, gt_column: str, candidate_column: str, companions: list[str] | None = None, city: str = "", passes: tuple[str, ...] = matching.PASSES, similarity: str = "token_set", known: DataFrame | None = None, keys: DataFrame | None = None, normalize: bool = False) -> DataFrame:
    """Rows of gt with the candidate that fits, its companions, the pass; then the unmatched tail with a null row_idx.

    Candidates left over whose key a row of gt has are known duplicates and stay out of the tail.
    known (a registry) and keys (scope keys) let territories block pairs and add to their weight.
    With normalize, aligned is the normalized address unless that would lose a part of it; then
    kept_original is true (see sinks.normalization_audit).
    """
    companions = companions or []
    keep = ("source_row",) if "source_row" in candidates.columns else ()
    g = prepared_side(gt, gt_column, "row_idx", city, known, keys)
    c = prepared_side(candidates, candidate_column, "cand_idx", city, known, keys, keep)
    pairs = settled(matching.cascade(g, c, passes, similarity))
    carried = candidates.select(F.col("row_idx").alias("cand_idx"), F.col(candidate_column).alias("aligned"), *companions)
    if normalize:
        carried = S.guarded(carried, "aligned", city).withColumn("aligned", F.col("output")).drop("output")
    matched = gt.select("row_idx", gt_column).join(pairs.select("row_idx", "cand_idx", "pass"), "row_idx", "left").join(carried, "cand_idx", "left")
    tail = matching.unmatched_tail(c, g, pairs, ["ter", "sw", "sn", "hb", "hm"]).where("not known").select("cand_idx").join(carried, "cand_idx")
    return matched.unionByName(tail, allowMissingColumns=True)


def aligned_order(result: DataFrame) -> DataFrame:
    return result.orderBy(F.col("row_idx").asc_nulls_last(), "cand_idx")


def collected(lines: DataFrame, part: list[str], city: str = "", scope: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected candidates of text lines (part, n, line), each with context, parts, score and reason.

    Accepted ones are merged by assembly key: the best one's text and context, slots by vote. scope
    (oktmo_code, municipality, locality) is what the rows are known to belong to.
    """
    context = collect.carry_context(lines, collect.place_line(F.col("line")), "line", part, "n")
    found = context.where(collect.plausible(F.col("line"))).withColumn("address", T.without_tail("line"))
    p = A.parsed(found, "address", city, True)
    slots = {"street": F.col("parsed.sw"), "house": S.house_display(F.col("parsed.hb"), F.col("parsed.hm"), F.col("house_kind")), "territory": F.col("parsed.ter")}
    p = p.withColumns(slots | {"house_base": F.col("parsed.hb")}).drop("parsed", "house_kind")
    row = {k: F.col(k) for k in ("address", "street", "house", "territory", "house_base")} | {"raw": F.col("line"), "normalized": F.col("address")}
    filled = sum((F.when(F.coalesce(F.col(k), F.lit("")) != "", 1.0).otherwise(0.0) for k in slots), F.lit(0.0))
    p = numbered(p.withColumn("_by", F.struct(*part, "n")), "_by").drop("_by")
    p = settled(p.withColumn("reason", sanitize.drop_reason(row)).withColumn("quality", sanitize.quality(row, filled, F.lit("line"))))
    clean = p.where("reason is null")
    merged = assembly.assembled(clean, "address", list(slots), "quality", "number", scope)
    merged = merged.join(clean.select("number", "context"), "number").withColumnsRenamed({"assembly_key": "key", "candidate_count": "source_count"})
    return merged.drop("number"), p.where("reason is not null").select(*part, "n", "address", "reason")


def reference_rows(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, str]:
    """The data rows of a sheet (row_idx and columns) and the column that holds its addresses, as headers and content tell."""
    found = profile.reference_column(cells.cells_of(rows, columns), rows.count()).first()
    if found is None:
        raise ValueError("the sheet has no cells")
    return rows.where(F.col("row_idx") >= found.first_row), columns[found.col_idx]


def build_reference(rows: DataFrame, column: str | None = None, city: str = "") -> tuple[DataFrame, DataFrame]:
    """The reference (one row for each match key) and its staging rows.

    Without a column, rows are a sheet as it was read: the column and its first data row are found.
    """
    if column is None:
        rows, column = reference_rows(rows, [c for c in rows.columns if c != "row_idx"])
    p = A.parsed(rows.select("row_idx", F.col(column).alias("raw")), "raw", city)
    p = p.where((F.col("parsed.sw") != "") | (F.col("parsed.ter") != "")).withColumn("match_key", reference.match_key([F.col(f"parsed.{x}") for x in ("ter", "sw", "hb", "hm")]))
    p = settled(p.select("row_idx", "raw", "match_key", T.postal_index("raw").alias("postal_index"), F.col("parsed.ter").alias("territory"), F.col("parsed.sw").alias("street"), F.concat("parsed.hb", "parsed.hm").alias("house"), A.rendered(F.col("parsed"), F.lit(city)).alias("normalized_address")))
    merged = reference.merge_rows(p, "match_key", "row_idx", ["postal_index", "territory", "street", "house", "normalized_address"], "raw")
    return merged, reference.staged(p, "match_key", "row_idx")


def update_reference(existing: DataFrame, rows: DataFrame, column: str, city: str = "") -> DataFrame:
    """A reference of build_reference() brought up to date with new rows: its own values win, blanks are filled, new keys are added."""
    new, _ = build_reference(rows, column, city)
    fields = ["postal_index", "territory", "street", "house", "normalized_address"]
    numbered_ = lambda df: df.withColumn("row_idx", F.monotonically_increasing_id())  # noqa: E731  keys differ within each side
    return reference.updated(numbered_(existing), numbered_(new), "match_key", fields, "normalized_address")


def clean_reference(existing: DataFrame) -> DataFrame:
    """The rows of a reference that nothing is wrong with."""
    row = {"address": F.col("normalized_address"), "street": F.col("street"), "territory": F.col("territory"), "house_base": F.regexp_extract("house", "^([0-9]+)", 1)}
    return existing.where(F.size(sanitize.issue_codes(row)) == 0)


def sort_reference(rows: DataFrame, slots: list[str]) -> DataFrame:
    """By the natural order of slots, blank addresses last, ties as they came."""
    return reference.natural_order(rows, slots, "row_idx")


def compare_job(a: DataFrame, b: DataFrame, a_columns: list[str], b_columns: list[str]) -> DataFrame:
    """compare_tables() of two sheets by their address columns, in report order."""
    return compare.comparison_order(compare.compare_tables(a.withColumn("key", T.building_key(*a_columns)), b.withColumn("key", T.building_key(*b_columns))))


def move_job(primary: DataFrame, source: DataFrame, primary_columns: list[str], source_columns: list[str], payload: list[str]) -> DataFrame:
    return compare.move_columns(primary.withColumn("key", T.building_key(*primary_columns)), source.withColumn("key", T.building_key(*source_columns)), payload)


def publish_registry(spark: SparkSession, snapshot: str, folder: str, keep: int = 3) -> DataFrame:
    """Checks a snapshot, writes its registry and name index as a version of their own and returns its statistics.

    A version counts when the pointer to it is in place (see versions.py); published() reads it. Of
    versions that counted the last `keep` stay.
    """
    raw = spark.read.format("binaryFile").load(snapshot).select(files.snapshot_problems(F.col("content")).alias("p")).where("p is not null").first()
    if raw:
        raise ValueError(f"not a registry snapshot: {raw.p}")
    built = registry.with_codes(files.registry_csv(spark, snapshot)).withColumn("name", F.coalesce(T.clean("name"), F.lit("")))

    def write(path: str) -> None:
        built.write.parquet(f"{path}/registry")
        whole = spark.read.parquet(f"{path}/registry")
        if whole.isEmpty():
            raise ValueError(f"no registry rows in {snapshot}")
        registry.name_index(whole).write.parquet(f"{path}/names")

    version = versions.publish(spark, folder, snapshot.rsplit("/", 1)[-1].rsplit(".", 1)[0], write, keep)
    return registry.registry_statistics(spark.read.parquet(f"{version}/registry"))


def published(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The registry that counts, and its name index."""
    version = versions.current(spark, folder)
    if version is None:
        raise ValueError(f"nothing is published in {folder}")
    return spark.read.parquet(f"{version}/registry"), spark.read.parquet(f"{version}/names")
