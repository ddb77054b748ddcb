"""Operator 9: SimHash near-dedup by a binary trie self-join.

Fingerprints are made where the texts are; after that only 64-bit numbers move. The different
fingerprints are joined with themselves: of four 16-bit blocks, two fingerprints within three
bits agree in at least one, so each fingerprint goes to four tries, one for each block value.
A trie is a sorted array; its nodes are ranges. Pairs of nodes are walked down together, adding
up the bits in which they differ, and dropped when these exceed the budget. A pair of nodes that
already lie in one component is dropped as well, since a link inside a component adds nothing;
so dense groups of near copies don't cost the square of their size.

Each task sends on a spanning star of what it has linked; stars are merged by alternating
large-star and small-star steps until they no longer change.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import doc_key, drop_written, slices, table, text_bytes, written

WORDS = 3
SEED = 42
BITS = 3
BLOCKS = BITS + 1
WIDTH = 64 // BLOCKS
FRONTIER = 1 << 18
TRIE_ROWS = 1 << 20
TRIE_MOST = 200_000
NODE_BITS = 4
MOST_ROUNDS = 60


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """A bit is set if it is set in over half the hashes of the word shingles, repeats included."""
    found = text.lower().split()  # ASCII white space, as bytes
    if not found:
        return 0
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(found) - words + 1)
    stops = ends[min(words, len(found)) - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 20):
        part = slice(at, min(n, at + (1 << 20)))
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[part].tolist(), stops[part].tolist(), strict=True)]
        ones += np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, row (hash of the text), fp (as a signed long)."""

    def run(batches):
        for batch in slices(batches):
            fps = [fingerprint(t, words) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(fps, pa.int64())], names=["doc_id", "row", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(text).alias("row"), text.alias("text")).mapInArrow(run, "doc_id long, row long, fp long")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def smallest_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of i and j in place; a label is the smallest position in it."""
    while len(i):
        a, b = labels[i], labels[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def trie_components(keys: np.ndarray, bits: int = BITS, shared: int = WIDTH) -> np.ndarray:
    """keys: sorted and different. Components of the links of keys whose first `shared` bits agree."""
    n = len(keys)
    labels = np.arange(n)
    runs = np.flatnonzero(np.concatenate([[True], (keys[1:] ^ keys[:-1]) >> np.uint64(64 - shared) != 0, [True]]))
    near = np.flatnonzero((np.bitwise_count(keys[1:] ^ keys[:-1]) <= bits) & ((keys[1:] ^ keys[:-1]) >> np.uint64(64 - shared) == 0))
    smallest_labels(labels, near, near + 1)
    lo, hi = runs[:-1], runs[1:]
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    todo = [(shared, lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int8))]
    while todo:
        depth, lo1, hi1, lo2, hi2, err = todo.pop()
        changes = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
        one = (changes[lo1] == changes[hi1 - 1]) & (changes[lo2] == changes[hi2 - 1]) & (labels[lo1] == labels[lo2])
        single = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        leaf = single & ~one
        if leaf.any():
            a, b = lo1[leaf], lo2[leaf]
            linked = np.bitwise_count(keys[a] ^ keys[b]) <= bits
            smallest_labels(labels, a[linked], b[linked])
        go = ~(one | single)
        lo1, hi1, lo2, hi2, err = lo1[go], hi1[go], lo2[go], hi2[go], err[go]
        if not len(lo1) or depth == 64:
            continue
        if len(lo1) > FRONTIER:
            half = len(lo1) // 2
            todo += [(depth, *(x[s] for x in (lo1, hi1, lo2, hi2, err))) for s in (slice(half, None), slice(None, half))]
            continue
        set_ = np.concatenate([[0], np.cumsum(keys >> np.uint64(63 - depth) & np.uint64(1))]).astype(np.int64)
        mid1, mid2 = hi1 - (set_[hi1] - set_[lo1]), hi2 - (set_[hi2] - set_[lo2])
        own = lo1 == lo2
        parts = [(lo1, mid1, lo2, mid2, err, None), (mid1, hi1, mid2, hi2, err, None), (lo1, mid1, mid2, hi2, err + 1, None), (mid1, hi1, lo2, mid2, err + 1, ~own)]
        kept = []
        for a, b, c, d, e, only in parts:
            ok = (a < b) & (c < d) & (e <= bits) & ~((a == c) & (b - a == 1))
            if only is not None:
                ok &= only
            kept.append([x[ok] for x in (a, b, c, d, e)])
        todo.append((depth + 1, *(np.concatenate(x) for x in zip(*kept, strict=True))))
    return labels


def _tries(batches):
    """Rows sorted by (block, part, key): a star for each component, as pairs of fingerprints."""

    def joined(block: np.ndarray, part: np.ndarray, key: np.ndarray):
        bounds = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (part[1:] != part[:-1]), [True]]))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            keys = key[lo:hi].view(np.uint64) ^ np.uint64(1 << 63)
            labels = trie_components(keys)
            at = np.flatnonzero(labels != np.arange(len(labels)))
            if len(at):
                turn = np.uint64(WIDTH * int(block[lo]))
                back = lambda x: ((x >> turn) | (x << (np.uint64(64) - turn)) if turn else x).view(np.int64)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(back(keys[at])), pa.array(back(keys[labels[at]]))], names=["a", "b"])

    block, part, key = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        new = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "part", "key"))
        block, part, key = (np.concatenate(x) for x in zip((block, part, key), new, strict=True))
        if len(key) >= TRIE_ROWS:
            # what is left open is the last trie
            other = (block != block[-1]) | (part != part[-1]) | (key >> np.int64(64 - WIDTH) != key[-1] >> np.int64(64 - WIDTH))
            cut = len(key) - int(np.argmax(other[::-1])) if other.any() else 0
            yield from joined(block[:cut], part[:cut], key[:cut])
            block, part, key = block[cut:], part[cut:], key[cut:]
    if len(key):
        yield from joined(block, part, key)


def node_pairs(node: Column, side: Column, err: Column) -> Column:
    """The pairs of nodes NODE_BITS down that a key takes part in: their number (from 1), the key's side in them, the bits in which they differ so far.

    Of a node with itself (side 0) come that of each of its nodes with itself and those of two
    different ones; of a pair of two nodes (sides 1 and 2) those that what is left of the budget
    allows.
    """
    size = 1 << NODE_BITS
    others = F.array(*[F.lit(x) for x in range(size)])
    near = F.filter(others, lambda y: err + F.bit_count(y.bitwiseXOR(node)) <= BITS)

    def pair(y: Column) -> Column:
        first = F.when(side == 0, node <= y).otherwise(side == 1)
        number = 1 + F.when(first, node).otherwise(y) * size + F.when(first, y).otherwise(node)
        at = F.when((side == 0) & (y == node), 0).when(first, 1).otherwise(2)
        return F.struct(number.alias("pair"), at.alias("side"), (err + F.bit_count(y.bitwiseXOR(node))).cast("int").alias("err"))

    return F.transform(near, pair)


def split_parts(parts: DataFrame, most: int) -> DataFrame:
    """parts (block, part, key, side, err) until none that can hold a link has over `most` keys, or all bits are used.

    A pair of nodes remembers the bits in which they differ, so a key goes to 15 pairs from a node
    with itself, to 11, 5 or 1 from a pair that has spent 1, 2 or 3 bits. A pair with keys on one
    side only holds no link and goes.
    """
    for depth in range(WIDTH + NODE_BITS, 65, NODE_BITS):
        sizes = parts.groupBy("block", "part").agg(F.count("*").alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi"))
        large = written(sizes.where(F.col("n") > most).select("block", "part", ((F.col("lo") == F.col("hi")) & (F.col("lo") > 0)).alias("idle")), "large")
        if not large.count():
            break
        node = F.shiftrightunsigned("key", 64 - depth).bitwiseAND(F.lit((1 << NODE_BITS) - 1)).cast("int")
        crowded = parts.join(large.where("not idle").select("block", "part"), ["block", "part"])
        split = crowded.select("block", "part", "key", F.explode(node_pairs(node, F.col("side"), F.col("err"))).alias("p"))
        rest = parts.join(large, ["block", "part"], "left_anti")
        parts = written(rest.unionByName(split.select("block", F.xxhash64("part", "p.pair").alias("part"), "key", "p.side", "p.err")), "parts")
    return parts


def links(different: DataFrame, most: int = TRIE_MOST) -> DataFrame:
    """a, b: stars that connect what is within the budget. different: fp, each once.

    A trie of over `most` fingerprints is walked further before it is dealt out: each of its pairs
    of nodes that can still hold a link is a part of its own, and so on (see split_parts).
    """
    turned = [F.struct(F.lit(b).alias("block"), F.shiftleft("fp", WIDTH * b).bitwiseOR(F.shiftrightunsigned("fp", 64 - WIDTH * b) if b else F.lit(0)).bitwiseXOR(F.lit(-(2**63))).alias("key")) for b in range(BLOCKS)]
    parts = different.select(F.inline(F.array(*turned))).select("block", F.shiftright("key", 64 - WIDTH).alias("part"), "key", F.lit(0).alias("side"), F.lit(0).alias("err"))
    sorted_ = split_parts(parts, most).select("block", "part", "key").repartition("block", "part").sortWithinPartitions("block", "part", "key")
    return sorted_.mapInArrow(_tries, "a long, b long")


def stars(edges: DataFrame) -> DataFrame:
    """v, root from pairs a, b: root is the smallest number of v's component, v itself left out."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        hung = both.join(least, "a")
        if large:
            return hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return hung.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    pairs, mark = written(edges.where("a <> b").distinct(), "edges"), None
    for _ in range(MOST_ROUNDS):
        after = written(star(star(pairs, True), False), "stars")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_written(pairs)
        pairs = after
        if seen == mark:
            return pairs.select(F.col("a").alias("v"), F.col("b").alias("root"))
        mark = seen
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")


def components(fps: DataFrame) -> DataFrame:
    """fp, root (a fingerprint for each component), component_id (smallest doc_id reachable), for each different fingerprint of doc_id, fp."""
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = least.join(stars(links(least.select("fp"))), F.col("fp") == F.col("v"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")


def grouped(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, row (hash of the text), fp, root, component_id."""
    fps = written(fingerprints(docs, words), "fingerprints")
    return fps.join(written(components(fps.select("doc_id", "fp")), "components"), "fp")


def near_groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, one row per document.

    An empty table gives an empty table; texts are taken whole; other columns are ignored.
    A-Z are lower-cased; words are split at ASCII white space; fewer words than a shingle make
    one shingle; none, or null text, give fingerprint zero, which links like any other. A null
    doc_id is never the smallest unless a component has no other. Repeated rows each give a row.
    """
    found = grouped(docs, words)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """Of each group one row of docs with all its columns: the one with the smallest doc_id, null last.

    Of rows with one id the one whose text has the smallest hash stays, of equal texts the first
    by the other columns. Null text counts as empty; an empty table gives an empty table.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), doc_key().alias("_i"), F.col("row").alias("_t"))
    kept = grouped(docs).groupBy("root").agg(F.min(order).alias("k")).select("k.*").drop("none")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    own = own.withColumns({"_i": doc_key("own.doc_id"), "_t": text_hash(F.col("own.text").cast("string"))})
    found = own.join(kept, ["_i", "_t"], "left_semi")  # one shuffle of texts serves the numbers below too
    others = [F.col(f"own.`{c}`") for c in docs.columns if c != "text"]
    nth = F.row_number().over(Window.partitionBy("_i", "_t").orderBy("own.text", F.to_json(F.struct(*others))))
    return found.withColumn("_n", nth).where("_n = 1").select("own.*")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
