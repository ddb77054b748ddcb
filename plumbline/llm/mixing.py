"""Operator 2: mixing sources to target weights by entropy balancing. DataFrame functions only.

Each document gets a rate between 0 and 3, as near to 1 as the token constraints let it be in
relative entropy: the rate is the logistic tilt 3 / (1 + 2 exp(-lambda * x)) of its size x, and
each source's lambda solves the convex dual of its constraint "sizes times rates add up to the
target". Newton steps run on the counts of documents by (source, size), which are made before
any shuffle by source, so a source with a third of all rows costs no more than another. (It is
the bounded form of the exponential tilt: plain exponentials have no upper end, and no document
may be taken more than 3 times.) Rates become whole copies by dithering with a hash of the row
and, of rows that are equal, with their number among these; of `OFFSETS` dithers, each source
takes the one whose words come nearest its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import drop_written, table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
MOST_COPIES = 3
OFFSETS = 64
#: The part of the golden ratio that spreads the dithers of equal rows.
GOLDEN = 0.6180339887498949
TOLERANCE = 1e-5
MOST_STEPS = 40


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """source, source_size, moment, weight. Ranks come from ranges and their counts, not from one sorted task."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), (F.sum(F.col("size").cast("double") * F.col("size")) / F.nullif(F.sum("size"), F.lit(0))).alias("scale"))
    dealt = written(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))  # a row for each partition
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    ranked = dealt.join(F.broadcast(offsets), "part").withColumn("weight", F.get(weights, (rank % len(WEIGHTS)).cast("int")))
    return written(ranked.select("source", "source_size", F.coalesce("scale", F.lit(1.0)).alias("scale"), "weight"), "ranked")


def targets(sources: DataFrame) -> DataFrame:
    """sources with target: the total dealt by weight, each at most MOST_COPIES times its size."""
    cap = F.col("source_size") * float(MOST_COPIES)
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        above = cap <= F.col("weight") * F.lit(level) if capped >= 0 else F.lit(False)
        r = sources.agg(F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.sum(above.cast("int"))).first()
        if r[2] is None or r[2] == capped:
            break
        capped = r[2]
        if not r[1]:
            level = float("inf")
            break
        level = (total - r[0]) / r[1]
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def rate(size: Column, lam: Column, scale: Column) -> Column:
    return MOST_COPIES / (1 + (MOST_COPIES - 1) * F.exp(F.greatest(F.lit(-700.0), -lam * size / scale)))


def balanced(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """sources with lam, by Newton steps for all of them at once; full marks a target at its cap."""
    counts = written(sizes.where("size > 0").groupBy("source", "size").count(), "sizes")
    start = sources.withColumns({"full": F.col("target") >= F.col("source_size") * MOST_COPIES * (1 - 1e-9), "lam": F.lit(0.0), "low": F.lit(float("-inf")), "high": F.lit(float("inf")), "off": F.lit(1.0)})
    state = written(start, "dual")
    keep = sources.columns
    r = rate(F.col("size"), F.col("lam"), F.col("scale"))
    moved = F.col("count") * F.col("size")
    for _ in range(MOST_STEPS):
        c, s = counts.alias("c"), state.where("not full").alias("s")
        sums = c.join(s, F.col("c.source").eqNullSafe(F.col("s.source"))).groupBy("s.source").agg(F.sum(moved * r).alias("have"), F.sum(moved * F.col("size") / F.col("scale") * r * (1 - r / MOST_COPIES)).alias("slope"))
        m = sums.alias("m")
        old, lam = state.alias("o"), F.col("lam")
        gap = F.col("have") - F.col("target")
        low = F.when(gap < 0, F.greatest("low", lam)).otherwise(F.col("low"))
        high = F.when(gap > 0, F.least("high", lam)).otherwise(F.col("high"))
        reach = 1 + F.abs(lam)
        step = F.greatest(-reach, F.least(reach, F.coalesce(-gap / F.nullif(F.col("slope"), F.lit(0.0)), -F.signum(gap) * reach)))
        tried = lam + step
        inside = (tried > low) & (tried < high)
        off = F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0))
        known = F.col("have").isNotNull()
        new = {
            "lam": F.when(~known | (off <= TOLERANCE), lam).when(inside, tried).otherwise((low + high) / 2),
            "low": F.when(known, low).otherwise(F.col("low")),
            "high": F.when(known, high).otherwise(F.col("high")),
            "off": F.when(known, off).otherwise(F.lit(0.0)),
        }
        after = written(old.join(m, F.col("o.source").eqNullSafe(F.col("m.source")), "left").select(*[F.col(f"o.{k}") for k in keep], "full", *[v.alias(k) for k, v in new.items()]), "dual")
        drop_written(state)
        state = after
        if (state.agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            break
    return state.select(*keep, "full", "lam")


def row_seed(docs: DataFrame) -> Column:
    """A hash of all of a row, so that rows that share an id, or have none, are told apart."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.to_json(F.struct(*others)) if others else F.lit(0))


def numbered_equals(rows: DataFrame) -> DataFrame:
    """rows with nth: the number of each among rows of its seed, 0 where there is one.

    Only repeated rows are numbered, and those partition by partition before they are added up,
    so a row that is there very often doesn't meet in one task.
    """
    seeds = written(rows.groupBy("seed").count().where("count > 1").select("seed"), "repeated")
    if not seeds.count():
        return rows.withColumn("nth", F.lit(0).cast("long"))
    again = written(rows.join(seeds, "seed", "left_semi").withColumn("_part", F.spark_partition_id()), "equals")
    before = Window.partitionBy("seed").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = again.groupBy("seed", "_part").count().select("seed", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))  # a row a partition
    nth = F.row_number().over(Window.partitionBy("seed", "_part").orderBy(F.lit(0))) - 1 + F.col("_before")
    numbered = again.join(offsets, ["seed", "_part"]).withColumn("nth", nth.cast("long")).select(*rows.columns, "nth")
    return rows.join(seeds, "seed", "left_anti").select(*rows.columns, F.lit(0).cast("long").alias("nth")).unionByName(numbered)


def hashed(seed: Column | str) -> Column:
    """Two numbers from 0 to 1 that depend on the row alone: a dither's start and its stride."""
    return F.struct(*[(F.xxhash64(seed, F.lit(s)).bitwiseAND(F.lit(2**52 - 1)) / float(2**52)).alias(s) for s in ("start", "stride")])


def copies(offset: Column) -> Column:
    """Whole copies of a row with size, lam, scale, full, seed and nth."""
    r = F.when(F.col("full"), F.lit(float(MOST_COPIES))).otherwise(rate(F.col("size"), F.col("lam"), F.col("scale")))
    h = hashed("seed")
    return F.floor(r + F.pmod(h["start"] + offset * h["stride"] + F.col("nth") * F.lit(GOLDEN), F.lit(1.0)))


def plan(sizes: DataFrame) -> DataFrame:
    """What documents need to get their copies, a row for each source, from source, size, seed, nth."""
    solved = written(balanced(sizes, targets(ranked_sources(sizes))), "solved")
    rows = with_plan(sizes, solved)
    tried = rows.groupBy("source").agg(*[F.sum(F.col("size") * copies(F.lit(float(k)))).alias(f"t{k}") for k in range(OFFSETS)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")), F.lit(float(k)).alias("offset")) for k in range(OFFSETS)])).getField("offset")
    return written(with_plan(tried, solved).withColumn("offset", best).select(*solved.columns, "offset"), "plan")


def with_plan(rows: DataFrame, plan_: DataFrame) -> DataFrame:
    """rows with their source's columns. Spark broadcasts the plan only if its files are small; else AQE splits a hot source."""
    right = plan_.withColumnRenamed("source", "_source")
    return rows.join(right, rows["source"].eqNullSafe(right["_source"]), "left").drop("_source")


def measured(docs: DataFrame) -> tuple[Column, Column, Column]:
    """source, size and seed of a row of docs."""
    return F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), row_seed(docs).alias("seed")


def mix_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, weight, rate-made copies, one row per document.

    Size: runs of characters other than ASCII white space; null text has none. Sources by code
    point, null last, weigh 1, 2, 3, repeating; a target is at most 3 times its source's size,
    the excess going to the others by weight. Empty documents and sources of size 0 take no
    words. Rows that repeat, share an id or have none each count and are rounded each for itself.
    The same table always gives the same mix, however it is partitioned. An empty table gives an
    empty table; other columns only tell rows apart.
    """
    sizes = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *measured(docs)), "mix")
    sizes = numbered_equals(sizes)
    rows = with_plan(sizes, plan(sizes)).withColumn("copies", copies(F.col("offset")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "weight", "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as mix_sizes() takes it, 0 to 3 times, with all their columns.

    Documents without words stay out only where the mix takes them 0 times; nulls, repeated rows
    and an empty table are as in mix_sizes().
    """
    source, size, seed = measured(docs)
    sizes = numbered_equals(written(docs.select(source, size, seed), "mix"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), source, size, seed)
    taken = with_plan(numbered_equals(own), plan(sizes)).withColumn("copies", copies(F.col("offset")))
    return taken.where("copies > 0").select("own", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("own.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents"))
