"""Operator 12: periodic runs of words, by seed and extend along diagonals.

A run of period q and length max(least, 3 q) or more holds a stretch of at least max(least - q, 2 q)
words that equal the words q further on. So each band of periods has a number k of words, a power
of two, such that the words of one place and of another q further on agree for k words:

* periods up to k0, the largest power of two within 2/3 of `least`: k = k0 (16 for 24);
* periods over k/2 and up to k: k, for k = 2 k0, 4 k0 and so on.

As k is at least q, the next place that holds the same k words is exactly q further on (a nearer
one would give the run a smaller period, by Fine and Wilf), so a seed is a place and its next
occurrence, never a pair of any two. k-grams are named exactly, by sorting pairs of names of
their halves; a place whose k words stand nowhere else in the document is left out of all longer
ones. Seeds extend along their diagonal (one lag), and a table by lag holds how far the last
extension came, so each stretch is walked once. The same argument shows that what a seed grows
into has no smaller period.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import slices, table, text_bytes

#: Fewest words of a run.
LEAST = 24
#: Fewest periods of a run: fixed, as seeds depend on it.
PERIODS = 3
#: Bytes of a text that are split into words at a time, and words that are joined at a time.
PIECE = 1 << 20
WORDS = 1 << 16

SEPARATOR = re.compile(rb"[\x20\x09-\x0D]")


def word_numbers(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of the words of a text, and the word of each number."""
    number: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(text):
        cut = SEPARATOR.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        parts.append(np.array([number.setdefault(w, len(number)) for w in text[at:end].split()], dtype=np.int64))
        at = end
    return (np.concatenate(parts) if parts else np.empty(0, np.int64)), list(number)


def _grouped(at: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places sorted by name and place, which of them have the name of the one before, and new names."""
    order = np.argsort(names, kind="stable")
    at, names = at[order], names[order]
    same = np.empty(len(at), dtype=bool)
    same[:1] = False
    np.equal(names[1:], names[:-1], out=same[1:])
    return at, same, np.cumsum(~same) - 1


def seeds(words: np.ndarray, least: int):
    """k, places, lags: for each band, the places whose k words stand again a lag of the band further on, next time."""
    n, k = len(words), 1
    first_k = 1 << (max(1, 2 * least // 3).bit_length() - 1)
    at, names = np.arange(n), words
    bits = max(1, int(words.max(initial=0)).bit_length())
    while k < first_k and 2 * bits < 64:  # small numbers are put together without sorting
        names = (names[:-k] << bits) | names[k:]
        at, bits, k = at[: len(names)], 2 * bits, 2 * k
    while len(at):
        at, same, names = _grouped(at, names)
        if k >= first_k:
            lags = np.diff(at, prepend=0)
            band = same & (lags <= k) & ((lags > k // 2) | (k == first_k))
            yield k, (at - lags)[band], lags[band]
        again = same.copy()
        again[:-1] |= same[1:]  # those that stand at least twice
        if PERIODS * k > n and k >= first_k:
            return
        of = np.full(n + k, -1, dtype=np.int64)
        of[at[again]] = names[again]
        at = np.flatnonzero(of[:n] >= 0)
        at = at[of[at + k] >= 0]
        names, k = of[at] * (n + 1) + of[at + k], 2 * k


def agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading numbers of a and b are equal, looking no further than about twice that."""
    at, step, end = 0, 64, min(len(a), len(b))
    while at < end:
        differ = np.flatnonzero(a[at : min(end, at + step)] != b[at : min(end, at + step)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return end


def runs(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """start, length, period of all runs, by start, then period."""
    found = []
    for k, places, lags in seeds(words, least):
        covered: dict[int, int] = {}
        order = np.lexsort((places, lags))
        places, lags = places[order], lags[order]
        if len(places):  # of seeds that touch on a diagonal only the first is looked at
            new = np.ones(len(places), dtype=bool)
            new[1:] = (lags[1:] != lags[:-1]) | (places[1:] != places[:-1] + 1)
            places, lags = places[new], lags[new]
        for i, lag in zip(places.tolist(), lags.tolist(), strict=True):
            if i < covered.get(lag, 0):
                continue
            end = i + k + agree(words[i + k :], words[i + k + lag :])
            start = i - agree(words[i - 1 :: -1] if i else words[:0], words[i + lag - 1 :: -1])
            covered[lag] = end
            if end - start + lag >= max(least, PERIODS * lag):
                found.append((start, end - start + lag, lag))
    return sorted((s, n, q) for s, n, q in found)


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """False for a word that some run contains after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def collapsed(words: np.ndarray, keep: np.ndarray, word: list[bytes]):
    """The kept words joined by one space, in pieces."""
    left = words[keep]
    for at in range(0, len(left), WORDS):
        yield (b" " if at else b"") + b" ".join([word[i] for i in left[at : at + WORDS].tolist()])


def tightest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; ties to the smallest start, then period."""
    best = None
    for run in found:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def planted(doc_id: int | None, words: np.ndarray) -> np.ndarray:
    """The query's input: a tenth of the documents, by a hash of their ids, repeat a part of their words to their end."""
    if doc_id is None or not len(words):
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(len(words) - a) % p]])


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _scan(least: int):
    def run(batches):
        for batch in slices(batches):
            lists, texts = [], []
            for text in text_bytes(batch.column("text")):
                words, word = word_numbers(text)
                found = runs(words, least)
                lists.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                texts.append(b"".join(collapsed(words, kept_words(len(words), found), word)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lists, RUNS), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, runs (start, length, period, in words), collapsed: the text with one period of each run.

    Words are separated by ASCII white space. A run is a stretch of at least `least` words (3 at
    least) and of three of its smallest period, as long as it gets. `collapsed` joins the words
    that no run contains after its first period by one space. Null, empty and blank texts have no
    runs and collapse to the empty text. Each row is scanned for itself, so nulls and repeats
    among ids don't matter. Other columns are ignored; an empty table gives an empty table.
    """
    if least < PERIODS:
        raise ValueError(f"a run has at least {PERIODS} words")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan(least), "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


DIGESTS = {"n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}


def digests(doc_id: int | None, text: bytes, least: int = LEAST) -> tuple:
    words, word = word_numbers(text)
    words = planted(doc_id, words)
    found = runs(words, least)
    best = tightest(found)
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
    left = hashlib.sha256()
    for piece in collapsed(words, kept_words(len(words), found), word):
        left.update(piece)
    return (len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), listed, left.hexdigest())


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            rows = [digests(doc, text) for doc, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(DIGESTS.values())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *DIGESTS])

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
