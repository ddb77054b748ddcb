"""Operator 4: line dedup over range-partitioned line hashes.

1. Each document sends a 128-bit hash for each line that can drop, with its document and position.
2. The hashes are range-partitioned and sorted by (hash, document, position). As the document is
   part of the range key, a line that a third of all documents hold spreads over many partitions.
3. Each partition is one stream. A hash that lies inside it is decided at once; the first and the
   last hash may go on in a neighbour, so their lines wait for a summary of at most two rows a
   partition.
4. What comes back to a document is not text but a compressed bitmap of the lines that stay.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE, doc_key, null_id, slices, table, text_bytes, written

LEAST_CHARS = 20
LEAST_DOCS = 3
WAITING = 200_000
STRIP = SPACE.encode()
COLUMNS = ("hi", "lo", "doc", "row", "line")


def line_key(line: bytes) -> bytes:
    return line.strip(STRIP).lower()


def _keyed(docs: DataFrame) -> DataFrame:
    """doc and row: the id, and the text's hash, which tells rows apart that share an id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(doc_key().alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))


def _hashes(least_chars: int):
    def run(batches):
        for batch in slices(batches):
            digests: list[bytes] = []
            lines: list[int] = []
            counts: list[int] = []
            for text in text_bytes(batch.column("text")):
                had = len(lines)
                for n, line in enumerate(text.split(b"\n")):
                    if len(line) < least_chars:
                        continue
                    key = line_key(line)
                    if len(key) >= least_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= least_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        lines.append(n)
                counts.append(len(lines) - had)
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            each = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), counts) for c in ("doc", "row")]
            columns = [halves[:, 0], halves[:, 1], *each, np.asarray(lines, dtype="i4")]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=list(COLUMNS))

    return run


def _decide(least_docs: int):
    """Sorted lines of a partition: kind 0 drops a line, 1 waits for a summary, 2 is a summary."""

    def rows(kind: int, at: np.ndarray, docs: int = 0) -> pa.RecordBatch:
        full = lambda x, t: pa.array(np.full(len(at), x, dtype=t))
        return pa.RecordBatch.from_arrays([full(kind, "i4"), *(pa.array(np.ascontiguousarray(at[c])) for c in COLUMNS), full(docs, "i8")], names=["kind", *COLUMNS, "docs"])

    def n_docs(run: np.ndarray) -> int:
        return int(1 + np.count_nonzero(run["doc"][1:] != run["doc"][:-1])) if len(run) else 0

    def run(batches):
        kind = np.dtype([(c, "i4" if c == "line" else "i8") for c in COLUMNS])
        open_ = np.empty(0, kind)  # rows of the hash that the stream is in
        waits, docs, last = True, 0, None  # its rows wait already; documents and last row of those sent on

        def send(part):
            nonlocal docs, last
            docs += n_docs(part) - int(last is not None and last["doc"][0] == part["doc"][0])
            last = part[-1:]
            return rows(1, part)

        for batch in batches:
            if not batch.num_rows:
                continue
            now = np.empty(batch.num_rows, kind)
            for c in COLUMNS:
                now[c] = batch.column(c).to_numpy(zero_copy_only=False)
            head = last if last is not None else open_[:1]
            if len(head):
                same = int(np.searchsorted((now["hi"] != head["hi"][0]) | (now["lo"] != head["lo"][0]), True))
            else:
                same = 0
            at = now
            if len(open_) or last is not None:
                open_, at = np.concatenate([open_, now[:same]]), now[same:]
                if len(open_) and (waits or len(open_) > WAITING):
                    waits = True
                    yield send(open_)
                    open_ = open_[:0]
                if not len(at):
                    continue
                if waits:
                    yield rows(2, last, docs)
                elif (drop := _dropped(open_, least_docs)).any():
                    yield rows(0, open_[drop])
                waits, docs, last = False, 0, None
            starts = np.flatnonzero(np.concatenate([[True], (at["hi"][1:] != at["hi"][:-1]) | (at["lo"][1:] != at["lo"][:-1])]))
            first_of_partition = waits
            done, open_ = at[: starts[-1]], at[starts[-1] :].copy()
            if first_of_partition and len(starts) > 1:
                first, done = done[: starts[1]], done[starts[1] :]
                yield send(first)
                yield rows(2, last, docs)
                waits, docs, last = False, 0, None
            if len(done) and (drop := _dropped(done, least_docs)).any():
                yield rows(0, done[drop])
            if waits:
                yield send(open_)
                open_ = open_[:0]
        if len(open_):
            yield send(open_)
        if last is not None:
            yield rows(2, last, docs)

    return run


def _dropped(at: np.ndarray, least_docs: int) -> np.ndarray:
    """Of whole hashes: the lines that go, all but those in the largest document."""
    new = np.concatenate([[True], (at["hi"][1:] != at["hi"][:-1]) | (at["lo"][1:] != at["lo"][:-1])])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(at))
    new_doc = new | np.concatenate([[True], at["doc"][1:] != at["doc"][:-1]])
    docs = np.add.reduceat(new_doc.astype("i8"), starts)
    size = ends - starts
    return np.repeat(docs >= least_docs, size) & (at["doc"] != np.repeat(at["doc"][ends - 1], size))


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc, row, line: the lines that go."""
    lines = written(_keyed(docs).mapInArrow(_hashes(least_chars), "hi long, lo long, doc long, row long, line int"), "lines")
    dealt = lines.repartitionByRange("hi", "lo", "doc").sortWithinPartitions("hi", "lo", "doc", "row", "line")
    found = written(dealt.mapInArrow(_decide(least_docs), "kind int, hi long, lo long, doc long, row long, line int, docs long"), "line-drops")
    # at most two summaries a partition, and one for each hash of over WAITING lines
    totals = found.where("kind = 2").groupBy("hi", "lo").agg(F.sum("docs").alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= least_docs)
    waiting = found.where("kind = 1").join(F.broadcast(totals), ["hi", "lo"]).where("doc <> keeper")
    return found.where("kind = 0").select("doc", "row", "line").unionByName(waiting.select("doc", "row", "line"))


def pack(lines: list[int]) -> bytes:
    """Keep bitmap up to the last line that goes; lines beyond it stay."""
    bits = np.ones((max(lines) // 8 + 1) * 8, dtype=np.uint8)
    bits[lines] = 0
    return zlib.compress(np.packbits(bits).tobytes())


def unpack(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    keep = np.ones(n_lines, dtype=bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8))[:n_lines].astype(bool)
        keep[: len(bits)] = bits
    return keep


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc, row, keep (compressed bitmap), for documents that lose a line."""

    def packed(batches):
        for batch in batches:
            maps = [pack(x) for x in batch.column("lines").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), pa.array(maps, pa.binary())], names=["doc", "row", "keep"])

    gone = dropped_lines(docs, least_chars, least_docs).groupBy("doc", "row").agg(F.collect_set("line").alias("lines"))
    return gone.mapInArrow(packed, "doc long, row long, keep binary")


def _apply(digest: bool):
    def run(batches):
        for batch in slices(batches):
            n_lines, n_dropped, kept = [], [], []
            for text, bitmap in zip(text_bytes(batch.column("text")), batch.column("keep").to_pylist(), strict=True):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if bitmap:
                    keep = unpack(bitmap, len(lines))
                    text = b"\n".join([x for x, k in zip(lines, keep.tolist(), strict=True) if k])
                    n_dropped.append(len(lines) - int(keep.sum()))
                else:
                    n_dropped.append(0)
                kept.append(hashlib.sha256(text).hexdigest() if digest else text)
            texts = pa.array(kept, pa.string()) if digest else pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), texts], names=["doc", "n_lines", "n_dropped", "kept"])

    return run


def drop_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, digest: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text left, or with digest its SHA-256).

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at
    least least_chars code points in at least least_docs documents stay only in the largest
    doc_id. Null and empty texts are one empty line. A null doc_id is one document below all
    others, and repeated rows are one document too; each row still gives a row. Other columns
    are ignored.
    """
    maps = keep_bitmaps(docs, least_chars, least_docs)
    both = _keyed(docs).join(maps.hint("shuffle_hash"), ["doc", "row"], "left").select("doc", "text", "keep")
    out = both.mapInArrow(_apply(digest), "doc long, n_lines long, n_dropped long, kept string")
    return out.select(null_id("doc").alias("doc_id"), "n_lines", "n_dropped", "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
hot AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN hot USING (key) GROUP BY doc_id
"""
