import zlib
from collections import Counter, defaultdict

import pytest
from plumbline.llm import sharding
from plumbline.llm.sharding import Part
from tests.llm.held import DATA, odd_docs


def check(rows, docs, shards):
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    load, places, later = Counter(), defaultdict(list), Counter()
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards and 0 <= r.next_shard <= shards
        load[r.shard] += r.size
        later[r.next_shard] += r.size
        places[r.shard].append(r.slot)
    for at in places.values():
        assert sorted(at) == list(range(len(at)))
    largest = max(r.size for r in rows)
    for loads, n in ((load, shards), (later, shards + 1)):
        assert max(loads.values()) <= sum(loads.values()) / n + largest
        assert max(loads.values()) - min(loads[s] for s in range(n)) <= max(largest, 0.1 * sum(loads.values()) / n)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = sharding.op13_sharding(spark, DATA).collect()
    check(got, docs, 24)
    assert Counter(map(tuple, sharding.op13_sharding(spark, DATA).collect())) == Counter(map(tuple, got))


def test_hot_ids_are_cut(spark):
    rows = [(None, "same text") for _ in range(4000)] + [(7, f"text {i}") for i in range(4000)] + [(i, "x" * (i % 90)) for i in range(6000)]
    docs = spark.createDataFrame([(i, t, 3, 4) for i, t in rows], "doc_id long, text string, slot int, doc string").repartition(8)
    got = sharding.shard_by_bytes(docs, 5).collect()
    check(got, rows, 5)
    assert max(r.part for r in got if r.doc_id is None) > 3 and len({r.shard for r in got if r.doc_id == 7}) == 5
    assert len({r.vslot for r in got if r.doc_id == 7}) == 1


def test_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    check(sharding.shard_by_bytes(docs, 3).collect(), [(r.doc_id, r.text) for r in docs.collect()], 3)
    assert sharding.shard_by_bytes(docs.where("false")).count() == 0
    one = sharding.shard_by_bytes(docs.where("doc_id = 3"), 24).collect()
    assert [(r.slot, r.size, r.text_crc32) for r in one] == [(0, 8, 0)]


def test_versions(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    parts = sharding.first_map([Part(s, 0, 1, 1 + s % 3, 50 + s * s % 97) for s in range(500)], 6)
    sharding.save_map(spark, parts, path, 1)
    grown = sharding.rebalanced(parts, 7)
    moved = [(a, b) for a, b in zip(parts, grown, strict=True) if a.shard != b.shard]
    assert {b.shard for _, b in moved} == {6} and len(moved) < 500 / 7 * 1.3
    sharding.save_map(spark, grown, path, 2)
    assert {r.version for r in sharding.load_map(spark, path).collect()} == {2}
    assert sharding.load_map(spark, path, 1).count() == 500
    with pytest.raises(Exception, match="exists"):
        sharding.save_map(spark, grown, path, 2)
    fewer = sharding.rebalanced(grown, 4)
    load = Counter()
    for p in fewer:
        load[p.shard] += p.bytes
    assert set(load) == {0, 1, 2, 3} and max(load.values()) - min(load.values()) <= 150
