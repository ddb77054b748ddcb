import difflib
import random
from itertools import product

import pytest
from plumbline.operators import matching, similar
from plumbline.operators.assignment import assign
from plumbline.operators.components import components
from pyspark.sql import functions as F
from tests.test_passes import token_set

SYLLABLES = ["ле", "ни", "на", "ми", "ра", "са", "до", "вая", "ка", "ли", "нин", "ская", "о", "б"]


def streets(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
    some = [word() for _ in range(12)]
    out = {"мира", "мира 2", "ленина", "ленин", "ленина мира", "а", "аб", "аа аа", "50 лет октября", "лет октября 60"}
    while len(out) < n:
        words = [r.choice(some) if r.random() < 0.5 else word() for _ in range(r.choice([1, 1, 2, 3, 5]))]
        s = " ".join(sorted(words))
        if r.random() < 0.4:  # a near copy
            at = r.randrange(len(s))
            out.add(" ".join((s[:at] + s[at + 1 :]).split()) or s)
        out.add(s)
    return sorted(out)


def test_measures_are_the_plain_ones():
    some = streets(1, 60)
    for a, b in product(some, some):
        assert similar.token_set(a, b) == pytest.approx(token_set(a, b))
        assert similar.sequence(a, b) == pytest.approx(100 * difflib.SequenceMatcher(None, a, b, autojunk=False).ratio())


@pytest.mark.parametrize("cutoff", [70.0, 75.0, 80.0, 85.0, 100.0])
def test_no_pair_is_missed(spark, cutoff):
    a, b = streets(2, 160), streets(3, 160)
    sides = [spark.createDataFrame([(x, "t" if len(x) % 2 else "u") for x in s], f"{c} string, ter string") for s, c in ((a, "a"), (b, "b"))]
    got = {(r.a, r.b): r.similarity for r in similar.similar_texts(*sides, cutoff).collect()}
    want = {(x, y): token_set(x, y) for x, y in product(a, b) if token_set(x, y) >= cutoff}
    assert got == pytest.approx(want) and len(want) > 20
    within = {(r.a, r.b) for r in similar.similar_texts(*sides, cutoff, ("ter",)).collect()}
    assert within == {(x, y) for x, y in want if len(x) % 2 == len(y) % 2}


def test_jaccard_and_odd_texts(spark):
    a, b = [*streets(4, 120), "", None], [*streets(5, 120), "", None]
    sides = [spark.createDataFrame([(x,) for x in s], f"{c} string") for s, c in ((a, "a"), (b, "b"))]
    got = {(r.a, r.b) for r in similar.similar_texts(*sides, 50.0, similarity="jaccard").collect()}
    assert got == {(x, y) for x, y in product(a, b) if x and y and 2 * len(set(x.split()) & set(y.split())) >= len(set(x.split()) | set(y.split()))}
    with pytest.raises(ValueError, match="cut-off"):
        similar.similar_texts(*sides, 60.0)
    assert similar.similar_texts(sides[0].where("false"), sides[1], 80.0).count() == 0


def test_houseless_streets_do_not_all_meet(spark):
    n = 3000
    words = F.concat(F.hex(F.pmod(F.xxhash64("id"), F.lit(10**9))), F.lit("ова"))
    side = lambda idx: spark.range(n).select(F.col("id").alias(idx), F.lit("").alias("ter"), words.alias("sw"), F.array().cast("array<string>").alias("sn"), F.lit("").alias("hb"), F.lit("").alias("hm"))
    rows, links, queues = matching.scored_links(side("row_idx"), side("cand_idx"), False, 85.0)
    assert n <= links.count() < 20 * n
    got = {r.row_idx: r.cand_idx for r in assign(rows, links, queues).collect()}
    assert got == {i: i for i in range(n)}


def chain(n):
    """Class i wants candidate i, then i + 1; the rows come so that each pushes the next on."""
    lists = [(i, i, 10.0) for i in range(n)] + [(i, i + 1, 5.0) for i in range(n)]
    rows = [(0, 0), *((i, i) for i in range(2, n)), (1, 1)] + [(n, 0)]
    return rows, lists


@pytest.mark.parametrize("limit", [10**6, 500, 3])
def test_components(spark, limit):
    r = random.Random(limit)
    rows, lists = [], []
    for block in range(30):
        n = r.choice([1, 2, 6])
        for c in range(n):
            cls = 100 * block + c
            rows += [cls] * r.randint(1, 4)
            lists += [(cls, 100 * block + x, float(r.randint(1, 3)), float(r.randint(1, 2))) for x in range(8) if r.random() < 0.5]
    r.shuffle(rows)
    held, want = set(), {}
    for i, cls in enumerate(rows):
        free = [(-w, -s, c) for k, c, w, s in lists if k == cls and c not in held]
        if free:
            want[i] = min(free)[2]
            held.add(want[i])
    got = matching.greedy_assignment(spark.createDataFrame(list(enumerate(rows)), "row_idx long, cls long"), spark.createDataFrame(lists, "cls long, cand_idx long, weight double, similarity double"), limit)
    assert {x.row_idx: x.cand_idx for x in got.collect()} == want


def test_a_chain_of_10000_classes_in_few_jobs(spark):
    n = 10_000
    rows = spark.range(n + 1).select(F.col("id").alias("row_idx"), F.when(F.col("id") == 0, 0).otherwise(F.col("id") - 1).cast("long").alias("cls"))
    wants = spark.range(n).select(F.explode(F.array(F.struct(F.col("id").alias("cls"), F.col("id").alias("cand_idx"), F.lit(10.0).alias("weight")), F.struct(F.col("id").alias("cls"), (F.col("id") + 1).alias("cand_idx"), F.lit(5.0).alias("weight")))).alias("x")).select("x.*", F.lit(0.0).alias("similarity"))
    spark.sparkContext.setJobGroup("chain", "chain")
    got = {r.row_idx: r.cand_idx for r in matching.greedy_assignment(rows, wants).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chain")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: i for i in range(n + 1)}
    assert len(jobs) < 60  # most are stages of a few queries that adaptive execution runs one by one


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 400)] + [(5, x) for x in range(1000, 1200)] + [(7, 7), (9, 8), (-4, 8)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(100, 401)} == {100} and {got[i] for i in (5, *range(1000, 1200))} == {5}
    assert got[7] == 7 and {got[9], got[8], got[-4]} == {-4} and len(got) == 301 + 201 + 1 + 3
