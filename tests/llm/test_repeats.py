import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from plumbline.llm import repeats, repeats_np

from tests.llm.held import DATA, odd_docs


def plain(rows, least=100):
    """rows: (doc_id, text). A string's first start wins; overlaps count."""
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - least + 1):
            s = data[i : i + least]
            if s in seen:
                gone[i : i + least] = b"\1" * least
            else:
                seen[s] = 1
        left = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def held(docs, least=100, **how):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r[0]: tuple(r[1:]) for r in repeats.remove_repeats(docs, least, digest=True, **how).collect()}
    want = plain(rows, least)
    assert got == want, [(k, got.get(k), want[k]) for k in want if got.get(k) != want[k]][:5]


def test_table(spark):
    held(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_odd_rows(spark):
    docs = odd_docs(spark)
    held(docs)
    assert repeats.remove_repeats(docs.where("false")).count() == 0


@pytest.mark.parametrize("crowd", [10**6, 2])
def test_random_passages(spark, crowd, monkeypatch):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 7)))
    passages = [" ".join(word() for _ in range(r.randint(5, 60))) for _ in range(12)] + ["ab" * 90, "x" * 300]
    rows = []
    for i in range(150):
        parts = [r.choice(passages) if r.random() < 0.5 else " ".join(word() for _ in range(20)) for _ in range(r.randint(0, 6))]
        text = " ".join(parts)
        if r.random() < 0.3 and text:
            k = r.randrange(len(text))
            text = text[:k] + r.choice("abé") + text[k + 1 :]
        rows.append((i * 3 % 151, text if r.random() < 0.95 else None, "h", 1))
    rows += [(1000 + i, rows[i][1], "h", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, place int").repartition(5)
    monkeypatch.setattr(repeats, "SORTED", 2000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "61")
    try:
        held(docs, crowd=crowd)
        held(docs, least=60, crowd=crowd)
        held(docs, least=300, crowd=crowd)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("least", [60, 100, 300, 400])
def test_hot_passage(spark, least, monkeypatch):
    """One passage in every text, each time between other bytes, and a core that a number follows: many regions for one anchor."""
    r = random.Random(least)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, core = noise(520), noise(390)
    rows = [(i, f"{noise(40)}{passage}{noise(40)}{core}{i:07d}{noise(20)}{passage[: r.randint(0, 520)]}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(repeats, "SORTED", 3000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        held(docs, least, crowd=3)
        held(docs, least)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeated_rows(spark):
    r = random.Random(2)
    text = "".join(r.choice("abcdefgh") for _ in range(180))
    alone = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string").repartition(2)
    assert [r.n_removed for r in repeats.remove_repeats(alone).collect()] == [0, 0]
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text[:150])], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in repeats.remove_repeats(docs).collect())
    assert got == [(0, 0), (1, 180), (1, 180), (2, 150)]


def test_nothing_goes_without_factors(spark, monkeypatch):
    """Every removed byte is decided by the arrays: with empty ones all texts stay whole."""
    r = random.Random(5)
    text = "".join(r.choice("abcdefgh") for _ in range(400))
    rows = [(i, text if i % 2 else f"{i:03d}{text[i : i + 200]}{text}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).repartition(4)
    held(docs, crowd=3)
    keyed = repeats._keyed(docs).toPandas()
    none = lambda data, starts, order_of, least: np.zeros(len(starts), np.int64)
    monkeypatch.setattr(repeats_np, "longest_previous_factor", none)
    batch = pa.RecordBatch.from_pandas(keyed)
    alone = [b for b in repeats._anchors(100, 32)([batch])]
    assert alone and all((b.column("place").to_numpy() >= 0).all() for b in alone)
    regions = pa.RecordBatch.from_pydict({"part": [1, 1], "h": [1, 1], "c": [1, 2], "doc": [1, 2], "row": [1, 2], "start": [0, 0], "copied": [True, True], "data": [text.encode(), text[:200].encode()]})
    assert sum(b.num_rows for b in repeats._factors(100)([regions])) == 0
    monkeypatch.undo()
    found = pa.Table.from_batches(repeats._factors(100)([regions])).to_pylist()
    assert sorted((f["kind"], f["c"], f["doc"], f["start"], f["size"]) for f in found) == [(0, 0, 2, 0, 200), (6, 1, 0, 0, 400), (6, 2, 0, 0, 200)]


def test_copied_strings():
    """A start given twice: the second time its factor reaches back to the first, to the end of the bytes."""
    data = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    assert repeats_np.longest_previous_factor(data, np.array([3, 3, 7]), np.array([0, 1, 2]), 16).tolist() == [0, 23, 0]


def test_longest_previous_factor():
    r = random.Random(0)
    for _ in range(200):
        n = r.randint(1, 60)
        data = np.array([r.choice([97, 98]) if r.random() < 0.1 else 97 for _ in range(n)], dtype=np.uint8)
        starts = np.array(sorted(r.sample(range(n), r.randint(1, n))))
        order = np.array([r.randint(0, n) for _ in starts])
        got = repeats_np.longest_previous_factor(data, starts, order, 64)
        text = data.tobytes()
        for x, i in enumerate(starts):
            lengths = [next((k for k in range(n) if i + k >= n or j + k >= n or text[i + k] != text[j + k]), n) for y, j in enumerate(starts) if order[y] < order[x]]
            assert got[x] == max(lengths, default=0)


def test_strings_shorter_than_a_gram(spark):
    docs = spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz" * 2), (2, "xx abcdefghijklmnopqrstuvwxyz")], "doc_id long, text string")
    with pytest.raises(ValueError, match="gram"):
        repeats.remove_repeats(docs, 20)
    assert {r.doc_id: r.n_removed for r in repeats.remove_repeats(docs, 20, 8).collect()} == {1: 26, 2: 26}
