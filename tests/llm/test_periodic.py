import hashlib
import random

import numpy as np
import pytest
from plumbline.llm import periodic
from pyspark.sql import Row


def plain_runs(words, least=24):
    """Every period by itself: maximal stretches whose smallest period it is."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - i + q
            smaller = any(all(words[j] == words[j + d] for j in range(i, i + length - d)) for d in range(1, q))
            if length >= max(least, 3 * q) and not smaller:
                found.append((i, length, q))
            i = end
    return sorted(found)


def numbers(words):
    ids = {}
    return np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)


def texts():
    r = random.Random(12)
    yield []
    yield ["a"] * 23
    yield ["a"] * 24
    yield ["x"] + ["a"] * 30 + ["a", "b"] * 20
    for _ in range(150):
        few = [f"w{i}" for i in range(r.choice([1, 2, 3, 8, 500]))]
        words = []
        while len(words) < r.choice([10, 60, 300]):
            unit = [r.choice(few) for _ in range(r.choice([1, 2, 3, 5, 8, 9, 16, 17, 20, 33, 40, 70]))]
            if r.random() < 0.3:
                unit = unit * r.randint(1, 4) + unit[: r.randint(0, len(unit))]
            words += unit * r.randint(1, 4) + unit[: r.randint(0, len(unit))]
        yield words
    # every run of k words stands at least twice in a period: a cyclic sequence of two blocks with all pairs twice
    x, y = [f"x{i}" for i in range(20)], [f"y{i}" for i in range(20)]
    yield sum([x if c == "X" else y for c in "XXXYXYYY" * 4], [])
    # Fibonacci and Thue-Morse words
    a, b = ["a"], ["a", "b"]
    while len(b) < 400:
        a, b = b, b + a
    yield b
    yield [str(bin(i).count("1") % 2) for i in range(400)]


@pytest.mark.parametrize("least", [3, 7, 24, 40])
def test_same_as_every_period(least):
    for words in texts():
        if least == 24 or len(words) < 200:
            assert periodic.runs(numbers(words), least) == plain_runs(words, least), words


def test_words_in_pieces(monkeypatch):
    text = b" \x0b".join(b"word%d" % (i % 7) for i in range(500)) + b"\xc2\xa0x\x85 \n"
    whole, names = periodic.word_numbers(text)
    monkeypatch.setattr(periodic, "PIECE", 11)
    again, same = periodic.word_numbers(text)
    assert whole.tolist() == again.tolist() and names == same
    assert [names[i] for i in whole.tolist()] == text.split()


def plain_digests(doc_id, text):
    import zlib

    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a, old = g % n, list(words)
            p = 1 + (n - a) // (3 + g % 8)
            words = [old[i] if i < a else old[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    drop = {i for s, ln, q in found for i in range(s + q, s + ln)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    listed = "".join(f"{s},{ln},{q}\n" for s, ln, q in found)
    left = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_query_rows():
    for i, words in enumerate(texts()):
        text = " ".join(words)
        assert periodic.digests(i, text.encode()) == plain_digests(i, text)
    assert periodic.digests(None, b"") == plain_digests(None, None)


def test_tables(spark):
    rows = [(1, "a " * 40 + "b", 7), (None, None, 7), (2, "", 7), (1, "a " * 40 + "b", 7), (3, " \n\t", 7), (4, "word " * 100_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = periodic.periodic_runs(docs).collect()
    assert len(got) == 6
    assert [r.collapsed for r in got if r.doc_id == 1] == ["a b", "a b"]
    assert next(r for r in got if r.doc_id == 4).runs == [Row(start=0, length=100_000, period=1)]
    assert all(r.runs == [] and r.collapsed == "" for r in got if r.doc_id in (None, 2, 3))
    assert periodic.periodic_runs(docs.where("false")).count() == 0


def test_query(spark):
    from tests.llm.held import DATA

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = periodic.op12_periodic_runs(spark, DATA).collect()
    assert len(got) == len(docs) and sum(r.n_runs > 0 for r in got) > 5
    for r in got:
        if len(docs[r.doc_id] or "") < 4000:
            assert tuple(r)[1:] == plain_digests(r.doc_id, docs[r.doc_id])
