"""One-to-one matching of address rows in ordered passes, from equal text to similar streets.

Each pass sees only the rows that earlier ones left. Exact passes pair occurrences: of one key,
the k-th row takes the k-th candidate from the end. Similar passes are a greedy walk in row
order; what can meet is walked in one task, block by block or component by component (see
assignment.py). Rows with equal parts are one class and candidates with equal parts one queue, so
that the pairs of an address held by very many rows are never written out.

Rows may carry a territory code and scope hits (`code`, `hits`); passes that a scope can block
leave out pairs whose codes don't fit, and similar passes add the scope's bonus to the weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.assignment import LIMIT, assign
from plumbline.operators.similar import similar_texts
from plumbline.sources.scratch import settled

#: Cut-offs and bonuses of the passes.
INTRA_TERRITORY, ACROSS, RELAXED = 75.0, 85.0, 80.0
SAME_HOUSE, SAME_TERRITORY, SAME_MODIFIERS, HOUSE_ONLY = 50.0, 30.0, 20.0, 100.0
BLOCKED = -80.0
NO_HITS = "array<struct<value:string,role:string,weight:double,code:string,valid:boolean>>"
PASSES = ("row", "text", "key", "key_without_modifiers", "street_house", "fuzzy_territory", "fuzzy", "fuzzy_relaxed")


def pair_occurrences(gt: DataFrame, cand: DataFrame, keys: list[str]) -> DataFrame:
    """row_idx, cand_idx: the k-th row of a key in order with the k-th candidate from the end. Null and blank first keys pair with nothing."""
    here = gt.where(F.col(keys[0]) != "").withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("row_idx")))
    there = cand.where(F.col(keys[0]) != "").withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("cand_idx"))))
    return here.select(*keys, "_n", "row_idx").join(there.select(*keys, "_n", "cand_idx"), [*keys, "_n"]).select("row_idx", "cand_idx")


def rest_of(df: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    return df.join(pairs.select(column), column, "left_anti")


def row_core(gt: DataFrame, cand: DataFrame) -> DataFrame:
    """Candidates that came from the same source row with equal street, numbers and house, and codes that fit: the first of each row."""
    c = scoped(cand).select(F.col("source_row").alias("row_idx"), "cand_idx", "sw", "sn", "hb", "hm", F.col("code").alias("code_c"))
    met = scoped(gt).where("sw <> '' and hb <> ''").join(c, ["row_idx", "sw", "sn", "hb", "hm"]).where(compatible_codes(F.col("code"), F.col("code_c")))
    return met.groupBy("row_idx").agg(F.min("cand_idx").alias("cand_idx"))


def scoped(side: DataFrame) -> DataFrame:
    """side with code and hits: blank where it has none."""
    code = F.coalesce(F.col("code"), F.lit("")) if "code" in side.columns else F.lit("")
    hits = F.col("hits") if "hits" in side.columns else F.array().cast(NO_HITS)
    return side.withColumns({"code": code, "hits": hits})


def compatible_codes(a: Column, b: Column) -> Column:
    """Codes match when one is missing, they are equal, or one begins the other."""
    return F.coalesce((a == "") | (b == "") | a.startswith(b) | b.startswith(a), F.lit(True))


def classed(side: DataFrame, idx: str) -> tuple[DataFrame, DataFrame]:
    """Rows (idx, cls) and classes of rows with equal parts: cls and the parts, once each."""
    parts = ["sw", "sn", "hb", "hm", "ter", "code", "hits"]
    own = scoped(side).where("sw <> '' or hb <> ''").select(idx, *parts)
    own = own.withColumn("cls", F.xxhash64("sw", F.array_join("sn", " "), "hb", "hm", "ter", "code", F.to_json("hits")))
    return own.select(idx, "cls"), own.select("cls", *parts).dropDuplicates(["cls"])


def _block(df: DataFrame, within_territory: bool) -> Column:
    """Classes of two blocks never match: street numbers, house, modifiers, and the territory in the first pass."""
    return F.xxhash64(F.array_join("sn", " "), "hb", F.when(F.col("hb") == "", "").otherwise(F.col("hm")), *(["ter"] if within_territory else []))


def scored_links(gt: DataFrame, cand: DataFrame, within_territory: bool, cutoff: float, relaxed: bool = False, similarity: str = "token_set") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (row_idx, cls), links (cls, queue, weight, similarity, grp) and queues (queue, cand_idx) as assign() wants them.

    A match needs equal street numbers and the same house, so these (and the territory in the
    first pass) are the block in which classes meet. Similar streets are found first, among the
    different ones of all blocks (or of each territory), by a join that compares no hopeless pair;
    classes then meet by (block, street). A row without a street takes what has its house: in the
    first pass without a bonus, in the last with that of the territory. It is linked to queues of
    all candidates of its block that have one scope (and territory, where that counts), so such
    rows and candidates don't multiply by their streets.
    """
    from plumbline.operators.registry import pair_score

    by = ["ter"] if within_territory else []
    rows, g = classed(gt, "row_idx")
    cands, c = classed(cand, "cand_idx")
    g, c = (settled(x.withColumn("grp", _block(x, within_territory)), "classes") for x in (g, c))
    there = c.select(*[F.col(k).alias(f"{k}_c") for k in ("cls", "sw", "hm", "ter", "code", "hits")], "grp")
    scope = pair_score(F.col("hits"), F.col("hits_c"), F.col("code"), F.col("code_c"))
    same_ter = (F.col("ter") != "") & (F.col("ter") == F.col("ter_c"))
    same_place = F.lit(0.0) if within_territory else F.when(same_ter, SAME_TERRITORY).otherwise(0.0)
    same_mods = F.when((F.col("hm") != "") & (F.col("hm") == F.col("hm_c")), SAME_MODIFIERS if relaxed else 0.0).otherwise(0.0)
    bonus = F.when(F.col("hb") != "", SAME_HOUSE).otherwise(0.0) + same_place + same_mods + F.col("scope")
    streets = similar_texts(g.select(*by, F.col("sw").alias("a")), c.select(*by, F.col("sw").alias("b")), cutoff, tuple(by), similarity)
    streets = settled(streets.withColumnsRenamed({"a": "sw", "b": "sw_c"}), "streets")
    met = g.join(streets, [*by, "sw"]).join(there.drop(*(f"{k}_c" for k in by)) if by else there, ["grp", "sw_c"]).withColumn("scope", scope).where(F.col("scope") > BLOCKED)
    link = lambda kind, *c: F.xxhash64(F.lit(kind), *c)
    with_street = met.select("cls", link("class", "cls_c").alias("queue"), (F.col("similarity") + bonus).alias("weight"), "similarity", "grp")
    # rows without a street, by the scopes (and, in the last pass, territories) of their block
    kinds = ["grp", "code", "hits", *(["ter"] if relaxed else [])]
    asked = g.where("sw = '' and hb <> ''").select("cls", *kinds)
    gangs = c.join(asked.select("grp").distinct(), "grp", "left_semi").select(*kinds, "cls").withColumn("queue", link("scope", *[F.to_json("hits") if k == "hits" else F.col(k) for k in kinds]))
    kind_of = gangs.select("queue", *[F.col(k).alias(k if k == "grp" else f"{k}_c") for k in kinds]).dropDuplicates(["queue"])
    alone = F.lit(HOUSE_ONLY) + (F.lit(0.0) if within_territory else F.col("scope") + (same_place if relaxed else F.lit(0.0)))
    house_only = asked.join(kind_of, "grp").withColumn("scope", scope).where(F.col("scope") > BLOCKED).select("cls", "queue", alone.alias("weight"), F.lit(0.0).alias("similarity"), "grp")
    queues = cands.select(link("class", "cls").alias("queue"), "cand_idx").unionByName(cands.join(gangs.select("cls", "queue"), "cls").select("queue", "cand_idx"))
    return rows, with_street.unionByName(house_only), queues


def scored_lists(gt: DataFrame, cand: DataFrame, within_territory: bool, cutoff: float, relaxed: bool = False, similarity: str = "token_set") -> tuple[DataFrame, DataFrame]:
    """scored_links() with queues written out: rows (row_idx, cls) and lists (cls, cand_idx, weight, similarity)."""
    rows, links, queues = scored_links(gt, cand, within_territory, cutoff, relaxed, similarity)
    return rows, links.join(queues, "queue").select("cls", "cand_idx", "weight", "similarity")


def greedy_assignment(rows: DataFrame, lists: DataFrame, limit: int = LIMIT) -> DataFrame:
    """row_idx, cand_idx, weight: what a walk in row order gives in which each row takes its best free candidate.

    rows: row_idx, cls; lists: cls, cand_idx, weight, similarity; the best is that of the greatest
    weight, then similarity, then the first.
    """
    links = lists.select("cls", F.col("cand_idx").cast("long").alias("queue"), F.col("weight").cast("double").alias("weight"), F.col("similarity").cast("double").alias("similarity"))
    return assign(rows, links, links.select("queue", F.col("queue").alias("cand_idx")).distinct(), limit)


def unblocked_core(gt: DataFrame, cand: DataFrame) -> DataFrame:
    """row_idx, cand_idx with equal street, numbers and house: each row the last candidate whose code fits."""
    rows, g = classed(gt.where("hb <> '' and sw <> ''"), "row_idx")
    cands, c = classed(cand.where("hb <> '' and sw <> ''"), "cand_idx")
    core = ["sw", "sn", "hb", "hm"]
    c = c.select(*core, F.col("code").alias("code_c"), F.col("cls").alias("queue"))
    met = g.join(c, core).where(compatible_codes(F.col("code"), F.col("code_c")))
    links = met.select("cls", "queue", F.lit(0.0).alias("weight"), F.lit(0.0).alias("similarity"), F.xxhash64("sw", F.array_join("sn", " "), "hb", "hm").alias("grp"))
    # the last candidate is the least when numbers change their sign
    found = assign(rows, links, cands.select(F.col("cls").alias("queue"), F.negative("cand_idx").alias("cand_idx")))
    return found.select("row_idx", F.negative("cand_idx").alias("cand_idx"), "weight")


def cascade(gt: DataFrame, cand: DataFrame, passes: tuple[str, ...] = PASSES, similarity: str = "token_set") -> DataFrame:
    """row_idx, cand_idx, pass, weight. gt: row_idx, text, ter, sw, sn, hb, hm; cand: cand_idx and the same.

    Both may have code and hits; cand may have source_row, without which the pass by row is left
    out. The pass on the key without modifiers asks for equal modifiers again and so finds nothing
    that the pass before it left; it is kept for its count.
    """
    found: DataFrame | None = None
    full, core = ["sw", "ter", "sn", "hb", "hm"], ["sw", "sn", "hb", "hm"]
    for name in passes:
        if name == "row":
            if "source_row" not in cand.columns:
                continue
            now = row_core(gt, cand)
        elif name == "text":
            now = pair_occurrences(gt, cand, ["text"])
        elif name in ("key", "key_without_modifiers"):
            now = pair_occurrences(gt, cand, full)
        elif name == "street_house":
            now = unblocked_core(gt, cand) if "code" in gt.columns and "code" in cand.columns else pair_occurrences(gt.where("hb <> ''"), cand.where("hb <> ''"), core)
        else:
            within, cutoff, relaxed = {"fuzzy_territory": (True, INTRA_TERRITORY, False), "fuzzy": (False, ACROSS, False), "fuzzy_relaxed": (False, RELAXED, True)}[name]
            now = assign(*scored_links(gt, cand, within, cutoff, relaxed, similarity))
        weight = F.col("weight") if "weight" in now.columns and name.startswith("fuzzy") else F.lit(None).cast("double")
        now = settled(now.select("row_idx", "cand_idx", weight.alias("weight"), F.lit(name).alias("pass")))
        gt, cand = rest_of(gt, now, "row_idx"), rest_of(cand, now, "cand_idx")
        found = now if found is None else found.unionByName(now)
    return found


def pass_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("pass").agg(F.count("*").alias("matches"))


def unmatched_tail(cand: DataFrame, gt: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that no pass took, with known: their key is a row's key, so they are not shown."""
    left = rest_of(cand, pairs, "cand_idx")
    keys_there = gt.select(*keys).distinct().withColumn("_known", F.lit(True))
    return left.join(keys_there, keys, "left").withColumn("known", F.coalesce("_known", F.lit(False))).drop("_known")


def with_companions(pairs: DataFrame, cand: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with the columns that travel with their candidate."""
    return pairs.join(cand.select("cand_idx", *columns), "cand_idx")


def top_similar(queries: DataFrame, choices: DataFrame, cutoff: float, k: int) -> DataFrame:
    """query, choice, score: per query its k most similar choices that share a word and reach the cutoff."""
    scored = similar_texts(queries.select(F.col("query").alias("a")), choices.select(F.col("choice").alias("b")), cutoff, similarity="jaccard").select(F.col("a").alias("query"), F.col("b").alias("choice"), F.col("similarity").alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "choice"))).where(F.col("rank") <= k)
