import re
from collections import Counter, defaultdict

import pytest
from plumbline.llm import mixing
from pyspark.sql import functions as F

from tests.llm.held import DATA, odd_docs


def want_targets(rows):
    size = Counter()
    for _, text, source in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        rest = sum(weight[s] for s in order if s not in full)
        level = (total - sum(3 * size[s] for s in full)) / rest if rest else 0
        more = {s for s in order if s not in full and weight[s] * level >= 3 * size[s]}
        if not more:
            return size, {s: 3 * size[s] if s in full else weight[s] * level for s in order}
        full |= more


@pytest.mark.parametrize("which", ["sf0.001", "sf0.01", "odd"])
def test_targets_and_takes(spark, which):
    docs = odd_docs(spark) if which == "odd" else spark.read.parquet(f"/root/testdata/{which}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    size, target = want_targets(rows)
    got = mixing.mix_sizes(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0) <= (r.taken == 0)
        taken[r.source] += r.taken
    for s in target:
        biggest = max(x.size for x in got if x.source == s)
        assert abs(taken[s] - target[s]) <= (0.02 * target[s] if which == "sf0.01" else biggest)
    again = mixing.mix_sizes(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)


def test_rows_repeat(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r.doc_id: r.copies for r in mixing.mix_sizes(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in want.items() if v})


def test_empty_table(spark):
    assert mixing.mix_sizes(odd_docs(spark).where("false")).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix_sizes(nothing).collect()] == [0, 0]


@pytest.mark.parametrize("ids", ["null", "equal", "own"])
def test_rows_that_are_equal_are_rounded_each_for_itself(spark, ids):
    rows = [({"null": None, "equal": 7, "own": 100 * i + j}[ids], "two words", s, 1) for i, s in enumerate("abc") for j in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, seed int").repartition(7)
    got = mixing.mix_sizes(docs).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 4 for s in "abc") and target == {"a": 100, "b": 200, "c": 300}
    for other in (docs.repartition(2), docs.orderBy(F.desc("source"))):
        assert Counter(map(tuple, mixing.mix_sizes(other).collect())) == Counter(map(tuple, got))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(r.source for r in out.collect()) == Counter({s: t // 2 for s, t in taken.items()})
