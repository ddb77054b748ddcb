"""Collecting address candidates: carried context, votes, sanitizing, fragments, final dedupe."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import clean, normalized
from plumbline.operators.compare import first_seen
from plumbline.sources.cells import numbered
from plumbline.sources.scratch import settled

#: So many undecided rows are walked in one task at a time.
WALKED_ROWS = 100_000
#: Rows of a part that one task may read as a stream, to carry context.
PART_ROWS = 20_000
#: Rows in a span of carried context, and in the larger spans around it.
CONTEXT_SPANS = (64, 16_384, 4_194_304)
#: Words that hint at an address, and headers that are none.
HINTS = "(?iuU)(?<![0-9a-zа-я])(?:улица|ул|переулок|пер|проспект|пр-кт|проезд|пр-д|бульвар|б-р|шоссе|набережная|площадь|тракт|мкр|микрорайон|город|г|поселок|пос|деревня|село|дом|д)(?![0-9a-zа-я])"
HEADER_WORDS = ("адрес", "улица", "дом", "город", "населенный пункт", "муниципальное образование", "address", "street", "house")


def plausible(text: Column) -> Column:
    """6 to 2500 characters, no header word, not just digits and signs, with a hint or a postal index."""
    t = F.coalesce(F.btrim(text), F.lit(""))
    hint = t.rlike(HINTS) | t.rlike("(?<![0-9])[0-9]{6}(?![0-9])")
    return F.length(t).between(6, 2500) & ~F.lower(t).isin(*HEADER_WORDS) & t.rlike("(?iuU)[a-zа-я]") & hint


#: Words of lines that name places only.
ADMIN_WORDS = "(?iuU)(?<![0-9a-zа-я])(?:федеральн(?:ый|ого)\\s+округ|область|край|республика|автономн\\w+\\s+округ|муниципальн\\w+|городской\\s+округ|район|р-н|г|город|с|село|д|деревня|п|пос|пос[её]лок|пгт|рп)(?![0-9a-zа-я])"


def place_line(text: Column) -> Column:
    """A line that names places, or has a registry code of 11 digits, and neither a street nor a house: context for those below."""
    from plumbline.functions.address import STREET, L
    from plumbline.operators.sanitize import dumped_table

    told = text.rlike(STREET) | text.rlike(f"{L}(?:дом|д|здание|зд|строение|стр)\\.?\\s*[0-9]")
    return F.coalesce((F.length(text) <= 500) & ~dumped_table(text) & (text.rlike(ADMIN_WORDS) | text.rlike("(?<![0-9])[0-9]{11}(?![0-9])")) & ~told, F.lit(False))


def codes_conflict(a: Column, b: Column) -> Column:
    """Of two known codes: neither equal nor with the same first 8 digits."""
    return F.coalesce((a != "") & (b != "") & (a != b) & (F.substring(a, 1, 8) != F.substring(b, 1, 8)), F.lit(False))


def code_conflicts(codes: DataFrame, part: str) -> DataFrame:
    """codes (code, part) with n_conflicts: the number of codes of its part that codes_conflict() with it, from counts, without pairs."""
    known = codes.where("code <> ''").withColumn("_h", F.substring("code", 1, 8))
    heads = known.groupBy(part, "_h").agg(F.count("*").alias("_same"))
    totals = heads.groupBy(part).agg(F.sum("_same").alias("_all"))
    return known.join(heads.join(totals, part), [part, "_h"]).withColumn("n_conflicts", F.col("_all") - F.col("_same")).drop("_h", "_same", "_all")


def streamed_context(lines: DataFrame, is_context: Column, text: str, part: list[str], order: str, keep: int, use: int) -> DataFrame:
    """carry_context() of parts that one task can read: dealt by part, sorted, and passed once with a state of `keep` lines."""
    told = F.when(is_context & F.col(text).isNotNull(), F.col(text).cast("string"))
    dealt = lines.withColumn("_told", told).repartition(*part).sortWithinPartitions(*part, order)

    def run(batches):
        key, last = None, []
        for batch in batches:
            out = []
            keys = zip(*(batch.column(p).to_pylist() for p in part), strict=True)
            for own, line in zip(keys, batch.column("_told").to_pylist(), strict=True):
                if own != key:
                    key, last = own, []
                out.append(" > ".join(last[-use:]))
                if line is not None:
                    last = [*(x for x in last if x != line), line][-keep:]
            names = [n for n in batch.schema.names if n != "_told"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.string())], names=[*names, "context"])

    return dealt.mapInArrow(run, T.StructType([*lines.schema.fields, T.StructField("context", T.StringType())]))


def carry_context(lines: DataFrame, is_context: Column, text: str, part: list[str], order: str, keep: int = 4, use: int = 3, spans: tuple[int, ...] = CONTEXT_SPANS, most: int = PART_ROWS) -> DataFrame:
    """lines with context: the last `use` of the last `keep` different context lines before each line.

    Parts of up to `most` lines are streams of their own, so they take one shuffle. Only the lines
    of longer ones are numbered and cut into spans (see spanned_context). Lines may be in any part
    of null and other columns of any kind.
    """
    same = lambda a, b: reduce(lambda x, y: x & y, [a[p].eqNullSafe(b[f"_p{i}"]) for i, p in enumerate(part)])
    sizes = lines.groupBy(*part).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    long = settled(sizes.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(part)]), "long-parts")
    if long.isEmpty():
        return streamed_context(lines, is_context, text, part, order, keep, use)
    # each of these parts has over `most` lines, so there are few
    few, many = lines.join(long, same(lines, long), "left_anti"), lines.join(long, same(lines, long), "left_semi")
    return streamed_context(few, is_context, text, part, order, keep, use).unionByName(spanned_context(many, is_context, text, part, order, keep, use, spans))


def spanned_context(lines: DataFrame, is_context: Column, text: str, part: list[str], order: str, keep: int, use: int, spans: tuple[int, ...] = CONTEXT_SPANS) -> DataFrame:
    """carry_context() of parts of any length.

    Lines are numbered over all parts and cut into spans by number, small ones inside larger ones.
    A span comes down to its last `keep` different context lines; the state before a span is carried
    within the next larger span only, so no row holds more than a small span's lines or one state a
    span, however long its part is.
    """

    def push(acc: Column, x: Column) -> Column:
        grown = F.concat(F.filter(acc, lambda y: y != x), F.array(x))
        return F.slice(grown, F.greatest(F.lit(1), F.size(grown) - keep + 1), keep)

    def state(lists: Column) -> Column:
        return F.aggregate(F.flatten(lists), F.array().cast("array<string>"), push)

    def before(rows: DataFrame, level: int) -> DataFrame:
        """rows (part, _n, _state) with _before: what stands before each row in its part."""
        if level == len(spans):
            window = Window.partitionBy(*part).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
            return rows.withColumn("_before", state(F.collect_list("_state").over(window)))
        span = f"_span{level}"
        cut = rows.withColumn(span, F.floor(F.col("_n") / spans[level]))
        window = Window.partitionBy(*part, span).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
        own = cut.withColumn("_own", F.collect_list("_state").over(window))
        sums = cut.groupBy(*part, span).agg(state(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_state"))), lambda x: x["_state"])).alias("_state"), F.min("_n").alias("_n"))
        carried = before(sums, level + 1).select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(part)], F.col(span).alias("_s"), F.col("_before").alias("_outer"))
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(part)], F.col(span) == F.col("_s"))
        joined = own.join(carried, same, "left")
        return joined.withColumn("_before", state(F.concat(F.array("_outer"), F.col("_own")))).drop("_own", "_outer", span, "_s", *[f"_p{i}" for i in range(len(part))])

    own = F.when(is_context & F.col(text).isNotNull(), F.array(F.col(text).cast("string"))).otherwise(F.array().cast("array<string>"))
    numbers = settled(numbered(lines.withColumn("_by", F.struct(*part, order)), "_by").drop("_by").withColumnRenamed("number", "_n").withColumn("_state", own))
    last = F.col("_before")
    context = F.array_join(F.slice(last, F.greatest(F.lit(1), F.size(last) - use + 1), use), " > ")
    return before(numbers, 0).select(*lines.columns, context.alias("context"))


def carry_last(lines: DataFrame, value: Column, part: list[str], order: str, name: str = "carried") -> DataFrame:
    """lines with the latest non-null value before each line."""
    before = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(before))


def slot_votes(rows: DataFrame, group: str, slots: list[str], score: str) -> DataFrame:
    """group, slot, value, votes, by count, then best score, then length, then the spelling itself.

    A vote is a normalized value; it shows as its best-scored spelling. Two aggregations, both
    combined before their shuffle, so a slot with one dominant value doesn't gather in a task.
    """
    long = rows.select(group, F.col(score).cast("double").alias("score"), F.inline(F.array(*[F.struct(F.lit(s).alias("slot"), clean(F.col(s).cast("string")).alias("value")) for s in slots]))).where(F.col("value").isNotNull())
    best = F.max(F.struct("score", F.length("value").alias("len"), "value")).alias("b")
    votes = long.withColumn("vote", normalized("value")).where("vote <> ''").groupBy(group, "slot", "vote").agg(F.count("*").alias("votes"), best)
    top = F.max(F.struct("votes", F.col("b.score").alias("score"), F.col("b.len").alias("len"), F.col("b.value").alias("value"))).alias("t")
    return votes.groupBy(group, "slot").agg(top).select(group, "slot", F.col("t.value").alias("value"), F.col("t.votes").alias("votes"))


def dominant_values(rows: DataFrame, part: list[str], value: str, share: float = 0.45) -> DataFrame:
    """part, value, count where one value rules: it is alone, or has 2 votes, twice the second's, and the share."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*part, value).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("n"), value)))
    sums = counts.groupBy(*part).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    top = ranked.where("_r <= 2").groupBy(*part).agg(F.max(F.when(F.col("_r") == 1, F.col("n"))).alias("n"), F.max(F.when(F.col("_r") == 1, F.col(value))).alias(value), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("n"))), F.lit(0)).alias("second"))
    rules = (F.col("kinds") == 1) | ((F.col("n") >= F.greatest(F.lit(2), F.col("second") * 2)) & (F.col("n") / F.col("total") >= share))
    return top.join(sums, part).where(rules).select(*part, value, "n")


def filled_from(rows: DataFrame, dominant: DataFrame, part: list[str], column: str) -> DataFrame:
    """Blanks of column filled from the dominant value of their part."""
    d = dominant.select(*part, F.col(column).alias("_d"))
    return rows.join(d, part, "left").withColumn(column, F.coalesce(clean(F.col(column)), F.col("_d"))).drop("_d")


def numbered_names(columns: DataFrame, part: list[str], name: str, order: str) -> DataFrame:
    """Repeated names get _2, _3, ... in order."""
    n = F.row_number().over(Window.partitionBy(*part, name).orderBy(order))
    return columns.withColumn("numbered", F.when(n == 1, F.col(name)).otherwise(F.concat(name, F.lit("_"), n.cast("string"))))


def key_values(block: Column) -> Column:
    """A map from the `key: value` lines of a block; of a repeated key the first line counts."""
    pairs = F.filter(F.transform(F.split(block, "\n"), lambda line: F.struct(F.btrim(F.regexp_extract(line, "^([^:]{1,60}):", 1)).alias("k"), F.btrim(F.regexp_extract(line, "^[^:]{1,60}:(.*)$", 1)).alias("v"))), lambda p: p["k"] != "")
    first = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == p["i"] + 1)
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["k"], p["v"])))


def address_value(payload: Column) -> Column:
    """The most address-like value of a map: by hints, then length, then text."""
    scored = F.transform(F.map_entries(payload), lambda e: F.struct(F.when(plausible(e["value"]), 2).otherwise(0).alias("s"), F.length(e["value"]).alias("n"), e["value"].alias("v")))
    best = F.array_max(scored)
    return F.when(best["s"] > 0, best["v"])


def fragments(text: Column, pattern: str, most: int = 8) -> Column:
    """The last `most` matches of pattern in text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.slice(found, F.greatest(F.lit(1), F.size(found) - most + 1), most)


def dedupe_candidates(rows: DataFrame, value: str, keys: list[str], order: str) -> DataFrame:
    """The first row of each normalized value and keys."""
    return first_seen(rows.withColumn("_v", normalized(value)), ["_v", *keys], [order]).drop("_v")


def walked(left: DataFrame, order: str, rows: int) -> DataFrame:
    """order, stays: what a plain walk decides for the first `rows` rows of left (order, _k). One task, which holds their keys."""
    first = left.groupBy(order).agg(F.collect_list("_k").alias("_keys")).orderBy(order).limit(rows)

    def run(batches):
        taken: set[str] = set()
        for batch in batches:
            stays = []
            for keys in batch.column("_keys").to_pylist():
                stays.append(taken.isdisjoint(keys))
                if stays[-1]:
                    taken.update(keys)
            yield pa.RecordBatch.from_arrays([batch.column(order), pa.array(stays, pa.bool_())], names=[order, "stays"])

    schema = T.StructType([T.StructField(order, left.schema[order].dataType), T.StructField("stays", T.BooleanType())])
    return first.coalesce(1).sortWithinPartitions(order).mapInArrow(run, schema)


def dedupe_by_any_key(rows: DataFrame, order: str, keys: list[str], block: int = WALKED_ROWS) -> DataFrame:
    """order, kept: a row stays if no earlier row that stays has one of its keys. Null keys don't count.

    In rounds: of each key's undecided rows the first one is safe if it is first for all its keys;
    it stays, and rows that share a key with it go. Where a round decides little (rows linked in a
    chain) or little is left, the first `block` undecided rows are walked one by one instead, so a
    chain of n rows takes n / block steps. It ends when every row is decided.
    """
    long = rows.select(order, F.explode(F.array_compact(F.array(*[F.when(F.col(k) != "", F.concat(F.lit(f"{k}="), F.col(k))) for k in keys]))).alias("_k")).distinct()
    left = settled(long)
    kept = settled(rows.select(order).join(long.select(order).distinct(), order, "left_anti"))
    size, slow = left.count(), False
    while size:
        if slow or size <= block:
            judged = settled(walked(left, order, block))
            safe = judged.where("stays").select(order)
        else:
            first = left.groupBy("_k").agg(F.min(order).alias("_first"))
            judged = left.join(first, "_k").groupBy(order).agg(F.bool_and(F.col(order) == F.col("_first")).alias("safe"))
            judged = safe = settled(judged.where("safe").select(order))
        kept = kept.unionByName(safe)
        taken = left.join(safe, order, "left_semi").select("_k").distinct()
        gone = left.join(taken, "_k", "left_semi").select(order).unionByName(judged.select(order)).distinct()
        left = settled(left.join(gone, order, "left_anti"))
        before, size = size, left.count()
        slow = before - size < before / 8
    return rows.select(order).join(kept.select(order, F.lit(True).alias("_kept")), order, "left").select(order, F.coalesce("_kept", F.lit(False)).alias("kept"))


def vote_summary(rows: DataFrame, group: str, value: str, most: int = 8) -> DataFrame:
    """group, summary: `value [n] | ... | +k` of the most frequent values, cut before they meet in one group."""
    counts = rows.where(clean(F.col(value)).isNotNull()).groupBy(group, clean(F.col(value)).alias("v")).agg(F.count("*").alias("n"))
    kinds = counts.groupBy(group).agg(F.count("*").alias("kinds"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "v"))).where(F.col("_r") <= most)
    shown = ranked.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "v", "n"))), lambda x: F.concat(x["v"], F.lit(" ["), x["n"].cast("string"), F.lit("]"))), " | ").alias("s"))
    more = F.when(F.col("kinds") > most, F.concat(F.lit(" | +"), (F.col("kinds") - most).cast("string"))).otherwise("")
    return shown.join(kinds, group).select(group, F.concat("s", more).alias("summary"))


def conflict_rows(rejected: DataFrame, raw: str, reason: str, order: str, wanted: str = "scope_conflict") -> DataFrame:
    """Rejected rows of one reason for manual review, the first of each normalized text."""
    return first_seen(rejected.where(F.col(reason) == wanted).withColumn("_v", normalized(raw)), ["_v"], [order]).drop("_v")


def scope_summary(hits: DataFrame) -> DataFrame:
    """role, valid, n: scope hits by role and validity."""
    return hits.groupBy("role", "valid").agg(F.count("*").alias("n"))


def dedupe_with_satellites(rows: DataFrame, signature: str, satellites: list[str], order: str) -> DataFrame:
    """The first row of each address signature and the values that travel with it."""
    return first_seen(rows, [signature, *satellites], [order])


def duplicate_guard(rows: DataFrame, key: str, kind: str, existing: str = "existing_reference") -> DataFrame:
    """rows with staged: their group holds a row of an existing reference, so they are not emitted again."""
    known = rows.groupBy(F.col(key).alias("_k")).agg(F.bool_or(F.col(kind) == existing).alias("staged"))
    return rows.join(known, F.col(key) == F.col("_k")).drop("_k")


def row_addresses(cells: DataFrame, part: list[str]) -> DataFrame:
    """part, row_idx, address: the address-like cells of a row, in order, each once."""
    like = F.col("value").rlike(HINTS) | F.col("value").rlike("^[0-9]+[а-яa-zА-ЯA-Z]?$")
    ordered = F.transform(F.array_sort(F.collect_list(F.when(like, F.struct("col_idx", "value")))), lambda x: x["value"])
    return cells.groupBy(*part, "row_idx").agg(F.array_join(F.array_distinct(ordered), ", ").alias("address")).where("address <> ''")


def structured_rows(cells: DataFrame, headers: DataFrame, part: list[str]) -> DataFrame:
    """part, row_idx, payload: each data row as a map from its column's header to its value. headers: part, col_idx, header, first_row."""
    met = cells.join(headers, [*part, "col_idx"]).where(F.col("row_idx") >= F.col("first_row"))
    return met.groupBy(*part, "row_idx").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "header", "value"))), lambda x: F.struct(x["header"], x["value"]))).alias("payload"))


def repeated_header(cells: DataFrame, headers: DataFrame, part: list[str], share: float = 0.6) -> DataFrame:
    """part, row_idx of data rows that repeat their headers."""
    met = cells.join(headers, [*part, "col_idx"]).where(F.col("row_idx") >= F.col("first_row"))
    same = F.avg((normalized("value") == normalized("header")).cast("double"))
    return met.groupBy(*part, "row_idx").agg(same.alias("s")).where(F.col("s") >= share).select(*part, "row_idx")


def union_streams(streams: dict[str, DataFrame], value: str, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """Candidates of several streams with stream, the first of each normalized value (and keys): streams as they are named, then order."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumns({"stream": F.lit(name), "_s": F.lit(i)}) for i, (name, df) in enumerate(streams.items())])
    return first_seen(both.withColumn("_v", normalized(value)), ["_v", *(keys or [])], ["_s", *order]).drop("_v", "_s")
