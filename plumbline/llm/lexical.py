"""Operator 11: ranked lexical search, reversed: documents stream through an index of the items.

1. Items with one text are one query. Queries are dealt into blocks of about BLOCK_BYTES of text;
   an index of one block (term to the queries that hold it) is all that is ever broadcast.
2. A first stream over the documents counts what weights need: documents, words, and for the
   block's terms the documents that hold each. Only sums leave a task.
3. A second stream sends each document's term counts through the index, adds up integer scores
   and updates one heap of at most k documents a query.
4. Heaps of tasks are merged in two levels, so that no merge sees more than a share of the tasks.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import doc_key, null_id, slices, table, text_bytes, written

TOP = 10
#: Text of items whose index goes to the executors at a time.
BLOCK_BYTES = 8 << 20
#: Groups of tasks whose heaps are merged first.
MERGES = 64

#: ASCII letters and digits (lower-cased) and all bytes of other characters; the rest separates.
SIGNS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

FOUND = "query long, task int, doc long, score long"


def terms(text: bytes) -> list[bytes]:
    return text.translate(SIGNS).split()


class Index:
    """Terms of a block of queries and, for each, the queries that hold it and how often."""

    def __init__(self, keys: list[int], texts: list[bytes]):
        self.keys = np.asarray(keys, dtype=np.int64)
        lists: dict[bytes, list[tuple[int, int]]] = {}
        for q, text in enumerate(texts):
            for term, n in Counter(terms(text)).items():
                lists.setdefault(term, []).append((q, n))
        self.number = {term: i for i, term in enumerate(lists)}
        self.starts = np.cumsum([0, *map(len, lists.values())])
        flat = [p for postings in lists.values() for p in postings]
        self.query, self.times = (np.asarray(x, dtype=np.int64) for x in (zip(*flat, strict=True) if flat else ([], [])))

    def postings(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For terms by number: places of all their postings, and how many each term has."""
        first = self.starts[found]
        size = self.starts[found + 1] - first
        before = np.cumsum(size) - size
        return np.arange(int(size.sum())) + np.repeat(first - before, size), size


def _counting(index: Index):
    """term (null: all documents), docs, words: what this task has seen."""

    def run(batches):
        known = index.number.keys()
        held: Counter = Counter()
        docs = words = 0
        for batch in slices(batches):
            for text in text_bytes(batch.column("text")):
                if found := terms(text):
                    docs += 1
                    words += len(found)
                    held.update(known & set(found))
        yield pa.RecordBatch.from_arrays([pa.array([None, *held.keys()], pa.binary()), pa.array([docs, *held.values()], pa.int64()), pa.array([words, *[0] * len(held)], pa.int64())], names=["term", "docs", "words"])

    return run


def weights(index: Index, counts: dict[bytes | None, tuple[int, int]]) -> np.ndarray:
    n_docs = counts[None][0]
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts.get(t, (0, 0))[0] + 1))) for t in index.number], dtype=np.int64)


def _searching(index: Index, weight: np.ndarray, n_docs: int, n_words: int, k: int):
    def run(batches):
        heaps: list[list[tuple[int, int]]] = [[] for _ in index.keys]
        floor = np.ones(len(heaps), dtype=np.int64)  # a score below it cannot enter the query's heap
        for batch in slices(batches):
            for doc, text in zip(batch.column("doc").to_pylist(), text_bytes(batch.column("text")), strict=True):
                words = terms(text)
                times = Counter(words)
                held = index.number.keys() & times.keys()
                if not held:
                    continue
                found = np.fromiter((index.number[t] for t in held), np.int64, len(held))
                tf = np.fromiter((times[t] for t in held), np.int64, len(held))
                m = 100 - 75 + (75 * len(words) * n_docs) // n_words
                value = weight[found] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                at, size = index.postings(found)
                score = np.zeros(len(heaps), dtype=np.int64)
                np.add.at(score, index.query[at], np.repeat(value, size) * index.times[at])
                for q in np.flatnonzero(score >= floor).tolist():
                    heap, one = heaps[q], (int(score[q]), -doc)
                    if len(heap) < k:
                        heapq.heappush(heap, one)
                    elif one > heap[0]:
                        heapq.heapreplace(heap, one)
                    if len(heap) == k:
                        floor[q] = heap[0][0]
        task = TaskContext.get().partitionId()
        rows = [(int(index.keys[q]), task, -doc, score) for q, heap in enumerate(heaps) for score, doc in heap]
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["query", "task", "doc", "score"])

    return run


def best_of(found: DataFrame, k: int, *by: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for each row of items (item_id, text), its k best documents.

    Terms are runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII. Scores
    are integers; equal ones go by ascending doc_id, null below all. A document is a row, so rows
    repeated under one id take a rank each. A row of items without terms, or whose terms no
    document holds, gives no rows; items may share an id and each row has its own ranks. Empty
    tables give none. Other columns are ignored. Documents are read twice for each block of items.
    """
    spark = docs.sparkSession
    texts = docs.select(doc_key().alias("doc"), F.col("text").cast("string").alias("text")).where("text is not null")
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    queries = written(asked.select("text").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    total, different = queries.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    blocks = max(1, min(-(-(total or 0) // block_bytes), different))
    parts = []
    for n in range(blocks):
        # about block_bytes of different texts, whatever the table's size
        block = queries.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == n).toArrow()
        index = Index(block.column("query").to_pylist(), text_bytes(block.column("text")))
        # at most one row for each term of the block
        sums = texts.select("text").mapInArrow(_counting(index), "term binary, docs long, words long").groupBy("term").agg(F.sum("docs"), F.sum("words")).collect()
        counts = {bytes(r[0]) if r[0] is not None else None: (r[1], r[2]) for r in sums}
        n_docs, n_words = counts.get(None, (0, 0))
        if n_docs and index.number:
            found = texts.mapInArrow(_searching(index, weights(index, counts), n_docs, n_words, k), FOUND)
            first = best_of(found.withColumn("merge", F.col("task") % MERGES), k, "query", "merge").drop("rank")
            parts.append(written(best_of(first, k, "query").select("query", "rank", "doc", "score"), "ranks"))
    if not parts:
        return spark.createDataFrame([], items.select("item_id").schema.add("rank", "integer").add("doc_id", "long").add("score", "long"))
    best = parts[0]
    for more in parts[1:]:
        best = best.unionByName(more)
    return asked.join(queries, "text").join(best, "query").select("item_id", F.col("rank").cast("int").alias("rank"), null_id("doc").alias("doc_id"), "score")


def op11_ranked_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms
  FROM documents WHERE text IS NOT NULL),
totals AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_words FROM docs),
items AS (
  SELECT item, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
    FROM benchmark) GROUP BY ALL),
held AS (
  SELECT doc, doc_id, n, term, count(*) AS tf FROM (SELECT doc, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, totals GROUP BY term),
scored AS (
  SELECT item, item_id, doc, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_words))))::BIGINT AS score
  FROM held JOIN weights USING (term) JOIN items USING (term), totals GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
