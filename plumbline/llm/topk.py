"""Operator 1: exact top-k search by block-at-a-time pruning.

Vectors are laid out in ranges of ids, cut into blocks. A block keeps a forward index (its
integer vectors) and for each term, that is dimension, the largest and smallest value in it. For
a query, the sum over terms of the larger of q * largest and q * smallest bounds every score in
the block. A shard is a bounded run of blocks. In a shard each query visits blocks in order of
falling bounds and scores whole blocks through the forward index until the next bound is below
its k-th score.

The shard that reaches farthest is searched first, for all queries at once; its k-th scores then
keep the queries out of all blocks of the other shards that cannot beat them. Queries go over the
other shards in passes, each with a bounded number of them; a pass adds its k best to one table.
Vectors are shuffled once, by range of id.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import slices, table, written
from plumbline.sources import scratch

TOP = 5
SCALE = 256
EVERY = 50
BLOCK = 64
SHARD = 4096
#: Numbers in the queries that one pass over the shards carries.
PASS_VALUES = 1 << 21
EXACT = 2.0**53
LOWEST = -(2**63)


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    got = np.load(io.BytesIO(data))
    return {k: got[k] for k in got.files}


def integer_rows(batch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and floor(SCALE * x); a vector that is null or holds null or non-finite x is left out."""
    ids, rows = [], []
    for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
        if i is None or x is None or any(v is None for v in x):
            continue
        row = np.floor(SCALE * np.array(x, dtype=np.float64))
        if np.isfinite(row).all():
            ids.append(i)
            rows.append(row)
    return np.array(ids, dtype=np.int64), rows


def dense(rows: list[np.ndarray]) -> np.ndarray:
    """Rows of unlike length: a missing component counts as 0."""
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = min(a.shape[1], b.shape[1])
    return a[:, :width], b[:, :width]


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where these are exact, else in whole numbers, held to 64 bits."""
    q, d = _same_width(q, d)
    if not q.size or not d.size:
        return np.zeros((len(q), len(d)), dtype=np.int64)
    if np.abs(q).sum(axis=1).max() * np.abs(d).max() < EXACT:
        return (q @ d.T).astype(np.int64)
    big = [[int(v) for v in row] for row in d]
    return np.array([[max(-(2**63), min(2**63 - 1, sum(int(a) * b for a, b in zip(row, other, strict=True)))) for other in big] for row in q], dtype=np.int64)


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Queries x blocks: summed term maxima, a little raised so that rounding can't lower them."""
    (q, high), low = _same_width(q, high), low[:, : q.shape[1]]
    most = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    return most + 1 + 1e-12 * (np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T)


def better(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        least = np.partition(scores, -k)[-k]
        at = np.flatnonzero(scores >= least)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Shard:
    """Blocks of vectors in order of id, with their term maxima and minima."""

    def __init__(self, data: bytes):
        got = unpacked(data)
        self.ids, self.rows, self.high, self.low = got["ids"], got["rows"].astype(np.float64), got["high"], got["low"]

    @staticmethod
    def pack(ids: np.ndarray, rows: np.ndarray) -> bytes:
        starts = np.arange(0, len(ids), BLOCK)
        small = rows.astype(np.float32)
        return packed(ids=ids, rows=small if (small == rows).all() else rows, high=np.maximum.reduceat(rows, starts), low=np.minimum.reduceat(rows, starts))

    def search(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
        """For each query its best k here; floor: a score that k rows elsewhere reach."""
        bound = bounds(q, self.high, self.low)
        order = np.argsort(-bound, axis=1, kind="stable")
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)
        bar = floor.astype(np.float64)
        active = np.arange(len(q))
        for step in range(bound.shape[1]):
            block = order[active, step]
            open_ = bound[active, block] >= bar[active]
            active, block = active[open_], block[open_]
            if not len(active):
                break
            for b in np.unique(block):
                who, at = active[block == b], slice(b * BLOCK, (b + 1) * BLOCK)
                scores = products(q[who], self.rows[at])
                for i, row in zip(who.tolist(), scores, strict=True):
                    near, score = self.ids[at], row
                    if len(found[i][0]) == k and score.max() < bar[i]:
                        continue
                    if ids[i] in near:
                        near, score = near[near != ids[i]], score[near != ids[i]]
                    near, score = np.concatenate([found[i][0], near]), np.concatenate([found[i][1], score])
                    best = better(near, score, k)
                    found[i] = near[best], score[best]
                    if len(best) == k:
                        bar[i] = max(bar[i], float(score[best[-1]]))
        return found


def _shards(batches):
    """A partition sorted by id as shards of at most SHARD rows; reach: how far their maxima go."""
    ids, rows, n, base = np.empty(0, np.int64), [], 0, TaskContext.get().partitionId() << 32

    def made(ids, rows, n):
        all_ = dense(rows)
        reach = float(np.square(np.abs(all_).max(axis=0)).sum()) if all_.size else 0.0
        return pa.RecordBatch.from_arrays([pa.array([base + n]), pa.array([Shard.pack(ids, all_)], pa.binary()), pa.array([reach], pa.float64())], names=["shard", "data", "reach"])

    for batch in batches:
        new, more = integer_rows(batch)
        ids, rows = np.concatenate([ids, new]), rows + more
        while len(ids) >= SHARD:
            yield made(ids[:SHARD], rows[:SHARD], n)
            ids, rows, n = ids[SHARD:], rows[SHARD:], n + 1
    if len(ids):
        yield made(ids, rows, n)


FOUND = "query_id long, vec_id long, score long"


def _found(ids: np.ndarray, found: list) -> pa.RecordBatch:
    size = [len(x) for x, _ in found]
    columns = (np.repeat(ids, size), *(np.concatenate([np.empty(0, np.int64), *(x[k] for x in found)]) for k in (0, 1)))
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["query_id", "vec_id", "score"])


def searched_first(queries: DataFrame, shard: bytes, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of one shard, for all queries where they are."""
    shared = queries.sparkSession.sparkContext.broadcast(shard)

    def run(batches):
        own = Shard(shared.value)
        for batch in slices(batches, most_rows=1024):
            ids, rows = integer_rows(batch)
            if len(ids):
                yield _found(ids, own.search(ids, dense(rows), np.full(len(ids), LOWEST), k))

    return queries.select("vec_id", "embedding").mapInArrow(run, FOUND)


def searched(shards: DataFrame, ids: np.ndarray, rows: np.ndarray, floor: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each shard, where they can still matter."""
    shared = shards.sparkSession.sparkContext.broadcast((ids, rows, floor))

    def run(batches):
        ids, rows, floor = shared.value
        for batch in batches:
            for data in batch.column("data"):
                yield _found(ids, Shard(data.as_py()).search(ids, rows, floor, k))

    return shards.select("data").mapInArrow(run, FOUND)


def best_of(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = TOP, every: int = EVERY, pass_values: int = PASS_VALUES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each vec_id divisible by `every`, its k best others.

    Scores are inner products of floor(256 * x), exact; ties go to the smaller vec_id. Vectors
    that are null or hold null or non-finite components take no part, nor do null ids; a missing
    component of a shorter vector counts as 0. Rows repeated under one id are one query (the
    smallest vector of them) and each a candidate for other ids, never for their own. Fewer than
    k others give fewer rows; none, or an empty table, give none. Other columns are ignored.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where(F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    shards = written(v.repartitionByRange("vec_id").sortWithinPartitions("vec_id").mapInArrow(_shards, "shard long, data binary, reach double"), "shards")
    queries = written(v.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    size = queries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    passes = max(1, -(-size[0] * (size[1] or 1) // pass_values))
    far = shards.orderBy(F.desc("reach"), "shard").select("shard", "data").first()
    if not far or not size[0]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    first = written(searched_first(queries, bytes(far.data), k), "first")
    reached = best_of(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    asked = written(queries.join(reached, "vec_id", "left").withColumn("pass", F.pmod(F.xxhash64("vec_id"), F.lit(passes))), "asked")
    others, path = shards.where(F.col("shard") != far.shard), scratch.place(vectors.sparkSession, "rest")
    for n in range(passes):
        # about pass_values numbers at most, whatever the table's size
        batch = asked.where(F.col("pass") == n).toArrow().combine_chunks()
        ids, rows, floor = np.empty(0, np.int64), [], []
        for part in batch.to_batches():
            new, more = integer_rows(part)
            ids, rows, floor = np.concatenate([ids, new]), rows + more, floor + [LOWEST if x is None else x for x in part.column("floor").to_pylist()]
        if len(ids):
            rest = best_of(searched(others, ids, dense(rows), np.array(floor, dtype=np.float64), k), k)
            rest.select("query_id", "vec_id", "score").write.mode("append").parquet(path)
    rest = vectors.sparkSession.read.schema(FOUND).parquet(path)
    return best_of(first.unionByName(rest), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM usable),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, sum(q.x * d.x)::BIGINT AS score
  FROM parts q JOIN parts d ON q.i = d.i AND q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored) WHERE rank <= 5
"""
