from collections import Counter

from plumbline.operators import matching
from plumbline.queries_tables import _parsed_sides
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"


def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return 100.0 if not a and not b else 200.0 * row[-1] / (len(a) + len(b))


def token_set(a, b):
    if a == b:
        return 100.0
    x, y = set(a.split(" ")), set(b.split(" "))
    shared = " ".join(sorted(x & y))
    full = [" ".join(filter(None, [shared, " ".join(sorted(s))])) for s in (x - y, y - x)]
    if shared and shared in full:
        return 100.0
    return max(ratio(*full), *([ratio(shared, f) for f in full] if shared else [0.0]))


def fits(a, b):
    return not a or not b or a.startswith(b) or b.startswith(a)


def plain(gt, cand):
    """The passes as walks over rows in order."""
    found, free, left = {}, dict(cand), dict(gt)

    def put(name, i, j, w=None):
        found[i] = (j, name, w)
        del free[j], left[i]

    def same_house(g, c):
        return (not g.hb and not c.hb) or (g.hb and g.hb == c.hb and g.hm == c.hm)

    for i, g in sorted(left.copy().items()):
        js = [j for j, c in sorted(free.items()) if c.source_row == i and g.sw and g.hb and (g.sw, g.sn, g.hb, g.hm) == (c.sw, c.sn, c.hb, c.hm) and fits(g.code, c.code)]
        if js:
            put("row", i, js[0])
    for name, key in (("text", lambda r: r.text), ("key", lambda r: (r.sw, r.ter, *r.sn, r.hb, r.hm) if r.sw else None)):
        for i, g in sorted(left.copy().items()):
            js = [j for j, c in sorted(free.items()) if key(g) and key(g) == key(c)]
            if js:
                put(name, i, js[-1])
    for i, g in sorted(left.copy().items()):
        js = [j for j, c in sorted(free.items()) if g.sw and g.hb and (g.sw, g.sn, g.hb, g.hm) == (c.sw, c.sn, c.hb, c.hm) and fits(g.code, c.code)]
        if js:
            put("street_house", i, js[-1])
    for name, cutoff in (("fuzzy_territory", 75), ("fuzzy", 85), ("fuzzy_relaxed", 80)):
        near, relaxed = name == "fuzzy_territory", name == "fuzzy_relaxed"
        for i, g in sorted(left.copy().items()):
            best = []
            for j, c in sorted(free.items()):
                if g.sn != c.sn or (near and g.ter != c.ter) or not fits(g.code, c.code) or not (g.sw or g.hb) or not (c.sw or c.hb):
                    continue
                scope = 14.0 if g.code and c.code else 0.0
                ter = 30.0 if not near and g.ter and g.ter == c.ter else 0.0
                if not g.sw:
                    if g.hb == c.hb and g.hm == c.hm:
                        best.append((-(100.0 + (0 if near else scope) + (ter if relaxed else 0)), 0.0, j))
                    continue
                s = token_set(g.sw, c.sw)
                if s >= cutoff and same_house(g, c):
                    w = s + (50 if g.hb else 0) + ter + (20 if relaxed and g.hm and g.hm == c.hm else 0) + scope
                    best.append((-w, -s, j))
            if best:
                w, _, j = min(best)
                put(name, i, j, -w)
    return found


def test_all_passes_are_the_walk(spark):
    gt, cand = _parsed_sides(spark, DATA)
    g, c = {r.row_idx: r for r in gt.collect()}, {r.cand_idx: r for r in cand.collect()}
    want = plain(g, c)
    got = {r.row_idx: (r.cand_idx, r["pass"], None if r.weight is None else round(r.weight, 6)) for r in matching.cascade(gt, cand).collect()}
    assert got == {i: (j, n, None if w is None else round(w, 6)) for i, (j, n, w) in want.items()}
    kinds = Counter(n for _, n, _ in got.values())
    # the pass on the key without modifiers can find nothing that the one before it left
    assert set(kinds) >= set(matching.PASSES) - {"key_without_modifiers", "fuzzy_relaxed"}, kinds


def test_the_relaxed_pass(spark):
    kind = "ter string, sw string, sn array<string>, hb string, hm string, text string"
    gt = spark.createDataFrame([(0, "речной", "мирная", [], "5", "", "a"), (1, "речной", "", [], "6", "к2", "b"), (2, "", "", [], "6", "к2", "c")], f"row_idx long, {kind}")
    cand = spark.createDataFrame([(0, "", "мурная", [], "5", "", "x"), (1, "каменка", "мира", [], "6", "к2", "y")], f"cand_idx long, {kind}")
    got = {(r.row_idx, r.cand_idx, r["pass"], round(r.weight, 1)) for r in matching.cascade(gt, cand).collect()}
    # 200 * 5 / 12 and 50 for the house; a row without a street takes what has its house
    assert got == {(0, 0, "fuzzy_relaxed", 133.3), (1, 1, "fuzzy", 100.0)}


def test_a_thousand_equal_addresses(spark):
    side = lambda idx, n: spark.range(n).select(F.col("id").alias(idx), F.lit("").alias("ter"), F.lit("ленина").alias("sw"), F.array().cast("array<string>").alias("sn"), F.lit("5").alias("hb"), F.lit("").alias("hm"))
    rows, lists = matching.scored_lists(side("row_idx", 1000), side("cand_idx", 900), False, 80.0)
    assert lists.count() == 900
    got = {r.row_idx: r.cand_idx for r in matching.greedy_assignment(rows, lists).collect()}
    assert got == {i: i for i in range(900)}
