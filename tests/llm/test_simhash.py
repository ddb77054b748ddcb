import random
import re

import numpy as np
import pytest
import xxhash
from plumbline.llm import simhash
from pyspark.sql import functions as F

from tests.llm.held import DATA, odd_docs


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (doc_id, fingerprint)."""
    rows = sorted(rows)
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, f) in enumerate(rows):
        for e, g in rows[:i]:
            if (f ^ g).bit_count() <= 3:
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (f"{f:016x}", find(d)) for d, f in rows}


def held(spark, docs):
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect()}
    assert got == want


def test_table(spark):
    held(spark, spark.read.parquet(f"{DATA}/documents.parquet"))


def test_odd_rows(spark):
    held(spark, odd_docs(spark))
    assert simhash.near_groups(odd_docs(spark).where("false")).count() == 0
    twice = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_groups(twice).collect()] == [4, 4, 4]


@pytest.mark.parametrize("most", [10**6, 25])
def test_trie_and_stars(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "TRIE_MOST", most)
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    monkeypatch.setattr(simhash, "TRIE_ROWS", 300)
    r = random.Random(8)
    fps = {0, 2**64 - 1, 2**63}
    for _ in range(25):
        f = r.getrandbits(64)
        for _ in range(r.randint(1, 30)):
            fps.add(f)
            for _ in range(r.randint(1, 3)):
                f ^= 1 << r.randrange(64)
    signed = np.array(sorted(fps), dtype=np.uint64).view(np.int64).tolist()
    rows = list(enumerate(signed))
    want = plain_components([(i, f % 2**64) for i, f in rows])
    got = {r.fp: r.component_id for r in simhash.components(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    assert got == {f: want[i][1] for i, f in rows}


def test_dense_group():
    r = random.Random(4)
    f = r.getrandbits(64)
    fps = sorted({f ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 2))) for _ in range(20_000)})
    keys = np.array(fps, dtype=np.uint64)
    labels = simhash.trie_components(keys)
    top = {}
    for k, x in zip(fps, labels.tolist(), strict=True):
        top.setdefault(k >> 48, set()).add(x)
    assert len(top[f >> 48]) == 1


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d", "x"), (5, "A b c d", "y"), (5, "other words of their own here", "z"), (5, "other words of their own here", "w"), (None, "", "e"), (None, None, "f"), (7, "x" * 300_000, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string").repartition(4)
    for d in (docs, docs.repartition(1)):
        assert sorted(tuple(r)[0::2] for r in simhash.deduplicate(d).collect() if r.doc_id) == [(1, "x"), (5, "w"), (7, "g")]
        assert [r.own for r in simhash.deduplicate(d).collect() if r.doc_id is None] in (["e"], ["f"])
    assert simhash.deduplicate(docs).columns == docs.columns and simhash.deduplicate(docs.where("false")).count() == 0


def test_crowded_parts_over_several_levels(spark):
    """Fingerprints that share their first bits for long, so that parts stay crowded, against all pairs."""
    r = np.random.default_rng(9)
    base = [0xABCDEF << 40 | int(x) for x in r.integers(0, 1 << 40, 150)]
    keys = {*base} | {x ^ (1 << int(b)) ^ (1 << int(c)) for x, b, c in zip(base, r.integers(0, 64, 150), r.integers(0, 64, 150), strict=True)}
    fps = np.array(sorted(keys), dtype=np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    u = fps.view(np.uint64)
    labels = np.arange(len(u))
    i, j = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= simhash.BITS)
    simhash.smallest_labels(labels, i, j)
    for most in (60, 10**6):
        rooted = {x.v: x.root for x in simhash.stars(simhash.links(df, most)).collect()}
        got = [rooted.get(int(x), int(x)) for x in fps]
        groups = {}
        for k, g in enumerate(got):
            groups.setdefault(g, set()).add(k)
        want = {}
        for k, g in enumerate(labels.tolist()):
            want.setdefault(g, set()).add(k)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    # 15 pairs at the first split, and fewer from then on, as pairs remember what they have spent
    parts = df.select(F.lit(0).alias("block"), F.lit(0).cast("long").alias("part"), F.col("fp").alias("key"), F.lit(0).alias("side"), F.lit(0).alias("err"))
    assert simhash.split_parts(parts, 60).count() < 15 * 11 * len(fps)
