import math
import random

import numpy as np
import pytest
from plumbline.llm import topk

from tests.llm.held import DATA, same_as_sql


def plain(rows, k=5):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in usable:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i)[:k]
            out |= {(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)}
    return out


def test_table(spark):
    same_as_sql(topk.op1_topk(spark, DATA), topk.SQL, {"embeddings": f"{DATA}/embeddings.parquet"})


@pytest.mark.parametrize("values", [topk.PASS_VALUES, 40])
def test_brute_force(spark, monkeypatch, values):
    monkeypatch.setattr(topk, "SHARD", 60)
    monkeypatch.setattr(topk, "BLOCK", 7)
    r = random.Random(6)
    rows = [(i, [r.choice([-1.5, 0.0, 0.25, 3.0, r.gauss(0, 1)]) * (1 + i % 3) for _ in range(8)], 0) for i in range(400)]
    rows += [(1000, None, 0), (1050, [1.0, None], 0), (1100, [1.0, float("nan")], 0), (1150, [float("inf")] * 8, 0), (1200, [2.0], 0), (1201, [], 0), (1250, [0.0] * 8, 0), (None, [1.0] * 8, 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = {tuple(x) for x in topk.top_k(vectors, pass_values=values).collect()}
    assert got == plain([x[:2] for x in rows])


def test_few_and_huge(spark):
    kind = "vec_id long, embedding array<double>"
    assert topk.top_k(spark.createDataFrame([], kind)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], kind)).count() == 0
    rows = [(0, [1e30, 2.0]), (1, [1e30, 5.0]), (2, [-1e30, 0.0]), (3, [0.0, 1.0])]
    got = [(r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, kind)).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (3, 512 * 256), (2, -(2**63))]
    twice = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (7, [2.0]), (7, [2.0])], kind)
    assert [(r.rank, r.vec_id) for r in topk.top_k(twice).orderBy("rank").collect()] == [(1, 7), (2, 7)]


def test_blocks_are_pruned(monkeypatch):
    r = np.random.default_rng(1)
    rows = np.floor(r.normal(size=(4096, 16)) * np.repeat(np.linspace(0.1, 60, 64), 64)[:, None])
    shard = topk.Shard(topk.Shard.pack(np.arange(4096), rows))
    seen = []
    monkeypatch.setattr(topk, "products", lambda q, d, f=topk.products: seen.append(len(q)) or f(q, d))
    shard.search(np.array([-1]), rows[4095:], np.array([topk.LOWEST]), 5)
    assert len(seen) < 48  # of 64
