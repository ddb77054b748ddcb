"""Operator 10: toxicity by a factorization machine over hashed terms.

The terms of a text are its letter words, and the first letters of words, which carry over to
endings not seen in training; a term counts x = log2(1 + different words that have it). The score
is the logistic of

    bias + sum of w_a x_a over the terms + sum over pairs of terms of <v_a, v_b> x_a x_b

whose pair part is learned: an insult next to a mention of a group can weigh more, or less, than
the two alone. The machine is fitted on a bounded sample of labelled rows, in one task, as
minibatches; it is a few MB whatever the corpus. Scoring is one pass over all documents without
a shuffle.
"""

from __future__ import annotations

import io
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import kept, slices, table

BITS = 18
FACTORS = 4
PREFIXES = (4, 5)
#: At most this many labelled rows are fitted on: of each label, half of them, lowest hash of the id first.
SAMPLE_ROWS = 12_000
#: Terms of fewer sampled texts are not fitted.
LEAST_TEXTS = 2
EPOCHS = 12
BATCH = 128
SEED = 7
#: How strongly weights and pair factors are pulled back, in standard errors of their slopes; the least pull on a weight.
SHRINK_W, SHRINK_V, LEAST_W = 0.8, 1.5, 2e-3
WORDS = re.compile(r"[^\W\d_]+")
KEPT_WORDS = 300_000
#: Texts whose terms are laid out together when scoring.
TEXTS = 512


def held_out(doc_id: Column | str) -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0


class Terms:
    """Hashed terms of texts; remembers those of words it has met."""

    def __init__(self, only: np.ndarray | None = None):
        self.of_word: dict[str, tuple[int, ...]] = {}
        self.only = only

    def word(self, word: str) -> tuple[int, ...]:
        terms = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]
        found = tuple(xxhash.xxh3_64_intdigest(t.encode()) >> (64 - BITS) for t in terms)
        if self.only is not None:
            found = tuple(t for t in found if self.only[t])
        if len(word) <= 30:
            if len(self.of_word) >= KEPT_WORDS:
                self.of_word.clear()
            self.of_word[word] = found
        return found

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Terms and their x."""
        words = set(WORDS.findall((text or "").lower()))
        get, learn = self.of_word.get, self.word
        found: list[int] = []
        for w in words:
            ids = get(w)
            found += learn(w) if ids is None else ids
        terms, count = np.unique(np.array(found, dtype=np.int32), return_counts=True)
        return terms, np.log2(1 + count).astype(np.float32)


def laid_out(texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.concatenate([t for t, _ in texts]), np.concatenate([x for _, x in texts]), np.array([len(t) for t, _ in texts])


class Machine:
    """bias, w (terms), v (terms x factors)."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def margins(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return self.spread(*laid_out(texts))[0]

    def spread(self, terms: np.ndarray, x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of texts whose terms lie end to end; and their sums of v x."""
        starts, empty = np.cumsum(size) - size, size == 0
        # a last term of weight zero keeps reduceat right for texts without terms
        w = np.append(self.w[terms] * x, 0.0)
        v = np.vstack([self.v[terms] * x[:, None], np.zeros((1, self.v.shape[1]), self.v.dtype)])
        sums, squares, linear = np.add.reduceat(v, starts), np.add.reduceat((v * v).sum(axis=1), starts), np.add.reduceat(w, starts)
        for part in (sums, squares, linear):
            part[empty] = 0
        return self.bias + linear + ((sums * sums).sum(axis=1) - squares) / 2, sums

    def used(self) -> np.ndarray:
        return (self.w != 0) | (self.v != 0).any(axis=1)

    def packed(self) -> bytes:
        out = io.BytesIO()
        at = np.flatnonzero(self.used()).astype(np.int32)
        np.savez_compressed(out, bias=self.bias, at=at, w=self.w[at], v=self.v[at])
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Machine:
        got = np.load(io.BytesIO(data))
        w, v = np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, got["v"].shape[1]), np.float32)
        w[got["at"]], v[got["at"]] = got["w"], got["v"]
        return cls(float(got["bias"]), w, v)


def minibatches(texts: list[tuple[np.ndarray, np.ndarray]], told: np.ndarray, known: np.ndarray, r: np.random.Generator):
    """Batches of texts, laid out once for all epochs: told, sizes, x, different terms (by place in known), which of them each is, and how often each is met."""
    order = r.permutation(len(texts))
    for at in range(0, len(order), BATCH):
        picked = order[at : at + BATCH]
        terms, x, size = laid_out([texts[i] for i in picked])
        place = np.minimum(np.searchsorted(known, terms), len(known) - 1)
        used = known[place] == terms
        size = np.add.reduceat(np.append(used, False).astype(np.int64), np.cumsum(size) - size) * (size > 0)
        unique, where, met = np.unique(place[used], return_inverse=True, return_counts=True)
        yield told[picked], size, x[used].astype(np.float64), unique, where, met


def fit_machine(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> Machine:
    """AdaGrad over all terms that LEAST_TEXTS texts have, both labels with equal weight in sum: a soft threshold on w, dual averaging for v.

    No term is left out for what it tells by itself: the same rule holds every w back by SHRINK_W
    standard errors of its slope, and the factors of a term leave their start as far as their
    summed slopes exceed SHRINK_V standard errors. Factors that never left it are zero in the end.
    """
    r = np.random.default_rng(SEED)
    machine = Machine(0.0, np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, FACTORS), np.float32))
    if not len(texts) or labels.min() == labels.max():
        machine.bias = 0.0 if not len(texts) else (4.0 if labels[0] else -4.0)
        return machine
    terms, x, _ = laid_out(texts)
    count, squared = np.bincount(terms, minlength=1 << BITS), np.bincount(terms, x.astype(np.float64) ** 2, 1 << BITS)
    known = np.flatnonzero(count >= LEAST_TEXTS)
    n, share = len(known), labels.mean()
    if not n:
        machine.bias = 4.0 * (1 if share > 0.5 else -1)
        return machine
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    threshold = LEAST_W + SHRINK_W * np.sqrt(squared[known] / (16 * share * (1 - share))) / count[known]
    start = r.normal(0, 0.01, (n, FACTORS))
    w, v, bias = np.zeros(n), start.copy(), 0.0
    gw, gb, rate = np.full(n, 1e-3), 1e-3, 0.1
    slopes, squares = np.zeros((n, FACTORS)), np.full((n, FACTORS), 1e-14)
    batches = list(minibatches(texts, np.stack([labels, weight], axis=1), known, r))
    for epoch in range(epochs):
        for b in r.permutation(len(batches)):
            told, size, x, unique, where, met = batches[b]
            starts, empty = np.cumsum(size) - size, size == 0
            each_text = lambda y: np.where(empty, 0.0, np.add.reduceat(np.append(y, 0.0), starts))  # noqa: B023, E731
            vx = [np.take(column, where) * x for column in v[unique].T.copy()]
            sums = [each_text(y) for y in vx]
            margin = bias + each_text(w[unique][where] * x) + sum((s * s - each_text(y * y)) / 2 for s, y in zip(sums, vx, strict=True))
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - told[:, 0]) * told[:, 1] / len(size)
            each = np.repeat(slope, size) * x
            g = np.bincount(where, each, len(unique))
            gw[unique] += g * g
            step = rate / np.sqrt(gw[unique])
            moved = w[unique] - step * g
            w[unique] = np.sign(moved) * np.maximum(np.abs(moved) - step * threshold[unique] * met / len(size), 0)
            pulls = [each * (np.repeat(s, size) - y) for s, y in zip(sums, vx, strict=True)]
            s = slopes[unique] + np.stack([np.bincount(where, p, len(unique)) for p in pulls], axis=1)
            q = squares[unique] + np.stack([np.bincount(where, p * p, len(unique)) for p in pulls], axis=1)
            slopes[unique], squares[unique] = s, q
            # the slopes of noise add up over epochs too, as their root
            limit = SHRINK_V * np.sqrt((epoch + 1) * q.sum(axis=1))
            left = np.maximum(1 - limit / np.maximum(np.sqrt((s * s).sum(axis=1)), 1e-30), 0)
            v[unique] = start[unique] - 0.3 * rate * left[:, None] * s / np.sqrt(q)
            g = slope.sum()
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
    v[(v == start).all(axis=1)] = 0
    machine.bias, machine.w[known], machine.v[known] = bias, w, v
    return machine


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """text, toxic: at most sample_rows labelled rows that are not held out, the labels as even as they come."""
    known = labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("id").isNotNull() & ~held_out("id"))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("id")
    halves = [known.where(F.col("toxic") == y).orderBy(order, "id").limit(sample_rows // 2) for y in (0, 1)]
    # ids only, at most sample_rows of them
    picked = F.broadcast(halves[0].unionByName(halves[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return texts.join(picked, "id")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """The machine, from hashed terms of the sample; of texts repeated under one id, all count."""

    def hashed(batches):
        terms = Terms()
        for batch in slices(batches):
            found = [terms(t) for t in batch.column("text").to_pylist()]
            packed = [pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), *packed], names=["id", "toxic", "terms", "x"])

    def fitted(batches):
        got = [r for b in batches for r in zip(b.column("id").to_pylist(), b.column("toxic").to_pylist(), b.column("terms").to_pylist(), b.column("x").to_pylist(), strict=True)]
        got.sort()
        texts = [(np.frombuffer(t, dtype=np.int32), np.frombuffer(x, dtype=np.float32)) for _, _, t, x in got]
        machine = fit_machine(texts, np.array([y for _, y, *_ in got], dtype=np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([machine.packed()], pa.binary())], names=["machine"])

    terms = sample(docs, labels, sample_rows).select("id", "toxic", "text").mapInArrow(hashed, "id long, toxic int, terms binary, x binary")
    return Machine.unpacked(bytes(terms.repartition(1).mapInArrow(fitted, "machine binary").first().machine))


def scorer(data: bytes) -> tuple[Machine, Terms]:
    machine = Machine.unpacked(data)
    return machine, Terms(machine.used())


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score for every row of docs; null and empty texts get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(machine.packed())

    def run(batches):
        own, terms = kept(shared.value, scorer)
        for batch in slices(batches, most_rows=TEXTS):
            margin = own.margins([terms(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -30, 30))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def scored(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per document.

    Labels are learned only from rows whose crc32(doc_id) mod 5 is not 0. Null and empty texts
    have no terms and get the bias. A null doc_id is never labelled and not held out; repeated
    rows each give a row; null labels are left out; without any label all scores are 0.5. Other
    columns are ignored.
    """
    found = score(docs, fit(docs, labels, sample_rows))
    return found.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic (score under 0.5), each scored where it is.

    All columns and rows stay as they are, nulls and repeated rows included; null and empty texts
    have the bias alone. Without any label no row goes. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels).packed())

    @F.pandas_udf("double")
    def margin(texts):
        own, terms = kept(shared.value, scorer)
        parts = [own.margins([terms(t) for t in texts.iloc[at : at + TEXTS]]) for at in range(0, len(texts), TEXTS)]
        return pd.Series(np.concatenate(parts) if parts else [], dtype=float)

    return docs.where(margin(F.col("text").cast("string")) < 0)
