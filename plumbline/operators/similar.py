"""Similarity joins of short texts (streets, names) that meet every pair reaching a cut-off without comparing all pairs.

Two texts of distinct words reach a token-set ratio of 100 t in one of two ways, and each has a
filter that misses nothing:

* The shared words make up at least t / (2 - t) of one side's letters. So what that side has
  besides them is short, and one of its rarest words, up to that length, is shared: an equi-join
  of the rare words of one side with all words of the other.
* The longest common subsequence of both sides is at least t / 2 of their letters together, S.
  Pairs of neighbouring letters (with a blank at both ends of each word, so that the order of
  words doesn't matter) are then shared at least 1 + S (1.5 t - 1) times, which is over 1 for t
  over 2/3. So the rarest pairs of each side, all but that many and two more, share two: an
  equi-join on two pairs at once.

What meets is measured; nothing is cut by count.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import word_jaccard

#: Cut-offs below it leave nothing for the second filter to hold on to.
LEAST_CUTOFF = 70.0


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit of an integer for each letter of a."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    free = every
    for y in b:
        met = free & places.get(y, 0)
        free = ((free + met) | (free - met)) & every
    return len(a) - free.bit_count()


def edit_ratio(a: str, b: str) -> float:
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set(a: str, b: str) -> float:
    """Best edit ratio among the shared words and each side's words put after them; 100 if one side has no others."""
    x, y = set(a.split(" ")), set(b.split(" "))
    shared = " ".join(sorted(x & y))
    sides = [" ".join(filter(None, (shared, " ".join(sorted(s))))) for s in (x - y, y - x)]
    if shared and shared in sides:
        return 100.0
    return max(edit_ratio(*sides), *(edit_ratio(shared, s) for s in sides)) if shared else edit_ratio(*sides)


def sequence(a: str, b: str) -> float:
    """100 times twice the letters of matching blocks over all letters: the longest block, then the same left and right of it.

    Of equally long blocks the one that starts first in a, then in b.
    """
    found, open_ = 0, [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        size, at_a, at_b = 0, a0, b0
        ends: dict[int, int] = {}
        for i in range(a0, a1):
            now: dict[int, int] = {}
            for j in range(b0, b1):
                if a[i] == b[j]:
                    now[j] = k = ends.get(j - 1, 0) + 1
                    if k > size:
                        size, at_a, at_b = k, i - k + 1, j - k + 1
            ends = now
        if size:
            found += size
            open_ += [(a0, at_a, b0, at_b), (at_a + size, a1, at_b + size, b1)]
    return 200.0 * found / (len(a) + len(b)) if a or b else 100.0


def _measured(measure):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else measure(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def token_set_similarity(a: Column, b: Column) -> Column:
    """token_set() of pairs that a filter has left, in Arrow batches: some fifty times less work than letter by letter in an expression."""
    return _measured(token_set)(a, b)


def sequence_similarity(a: Column, b: Column) -> Column:
    return _measured(sequence)(a, b)


def _rarest_first(parts: DataFrame, others: DataFrame, by: list[str], text: str, part: str) -> DataFrame:
    """parts with _rank: the place of each part in its text, rare ones of both sides first."""
    uses = parts.select(part).unionByName(others.select(part)).groupBy(part).agg(F.count("*").alias("_n"))
    return parts.join(uses, part).withColumn("_rank", F.row_number().over(Window.partitionBy(*by, text).orderBy("_n", part)))


def _words(df: DataFrame, by: list[str], text: str) -> DataFrame:
    return df.select(*by, text, F.explode(F.array_distinct(F.split(text, " "))).alias("_w")).where("_w <> ''")


def _covering(ranked: DataFrame, by: list[str], text: str, cutoff: float) -> DataFrame:
    """Words of which one is shared by whatever shares t / (2 - t) of the text's letters."""
    t = cutoff / 100.0
    own, size = Window.partitionBy(*by, text), F.length("_w") + 1
    before = F.sum(size).over(own.orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1))
    rest = (1.0 - t / (2.0 - t)) * (F.sum(size).over(own) - 1) + 1e-9
    return ranked.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_rest", rest).where("_before <= _rest").select(*by, text, "_w")


def _pairs_of_letters(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """Neighbouring letters of each text's distinct words, the k-th of its kind as kind k."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(text, " "), lambda w: w != "")))
    padded = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    each = df.withColumn("_s", padded).select(*by, text, (F.length("_s") - 2).alias("_len"), F.posexplode(F.transform(F.sequence(F.lit(1), F.length("_s") - 1), lambda i: F.substring(F.col("_s"), i, F.lit(2)))).alias("_i", "_g"))
    kth = F.row_number().over(Window.partitionBy(*by, text, "_g").orderBy("_i"))
    return each.select(*by, text, "_len", F.concat("_g", kth.cast("string")).alias("_g"))


def _doubles(ranked: DataFrame, by: list[str], text: str, cutoff: float) -> DataFrame:
    """Keys of two rare pairs of letters, of which texts that reach the cut-off have one in common."""
    t = cutoff / 100.0
    least = F.ceil(1 + (1.5 * t - 1) * (2.0 / (2.0 - t)) * F.col("_len") - 1e-9)
    rare = ranked.where(F.col("_rank") <= F.col("_len") + 1 - least + 2)
    held = rare.groupBy(*by, text, "_len").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_g"))), lambda x: x["_g"]).alias("_gs"))
    both = F.flatten(F.transform("_gs", lambda x, i: F.transform(F.slice("_gs", i + 2, F.size("_gs")), lambda y: F.xxhash64(x, y))))
    return held.select(*by, text, "_len", F.explode(F.array_distinct(both)).alias("_key"))


def similar_texts(left: DataFrame, right: DataFrame, cutoff: float, by: tuple[str, ...] = (), similarity: str = "token_set") -> DataFrame:
    """*by, a, b, similarity: the different pairs of texts (with equal `by`) that reach the cut-off, all of them.

    left has `by` and a, right has `by` and b. similarity: token_set, or jaccard (shared words over
    all words). Null and empty texts and null `by` pair with nothing.
    """
    keys = list(by)
    some = lambda df, c: df.select(*keys, c).where(F.col(c) != "").distinct()
    a, b = some(left, "a"), some(right, "b")
    wa, wb = _words(a, keys, "a"), _words(b, keys, "b")
    ra, rb = _rarest_first(wa, wb, keys, "a", "_w"), _rarest_first(wb, wa, keys, "b", "_w")
    pair = [*keys, "a", "b"]
    if similarity == "jaccard":
        few = lambda df, c: df.withColumn("_m", F.count("*").over(Window.partitionBy(*keys, c))).where(F.col("_rank") <= F.col("_m") - F.ceil(F.col("_m") * (cutoff / 100.0) - 1e-9) + 1).select(*keys, c, "_w")
        met = few(ra, "a").join(few(rb, "b"), [*keys, "_w"]).select(pair).distinct()
        return met.withColumn("similarity", word_jaccard(F.col("a"), F.col("b"))).where(F.col("similarity") >= cutoff)
    if cutoff < LEAST_CUTOFF:
        raise ValueError(f"the filter of the token-set ratio needs a cut-off of {LEAST_CUTOFF} or more")
    by_words = _covering(ra, keys, "a", cutoff).join(wb, [*keys, "_w"]).select(pair).unionByName(wa.join(_covering(rb, keys, "b", cutoff), [*keys, "_w"]).select(pair))
    ga, gb = _pairs_of_letters(a, keys, "a"), _pairs_of_letters(b, keys, "b")
    da = _doubles(_rarest_first(ga, gb, keys, "a", "_g"), keys, "a", cutoff)
    db = _doubles(_rarest_first(gb, ga, keys, "b", "_g"), keys, "b", cutoff).withColumnRenamed("_len", "_len_b")
    reach = cutoff / (200.0 - cutoff)
    near = F.least("_len", "_len_b") >= reach * F.greatest("_len", "_len_b") - 1e-9
    met = by_words.unionByName(da.join(db, [*keys, "_key"]).where(near).select(pair)).distinct()
    return met.withColumn("similarity", F.when(F.col("a") == F.col("b"), 100.0).otherwise(token_set_similarity(F.col("a"), F.col("b")))).where(F.col("similarity") >= cutoff)
