"""Operator 13: sharding by fixed virtual slots and a versioned map of slots to shards.

1. A record's doc_id is hashed to one of SLOTS slots. Slots never change; only the map from slots
   to shards does.
2. Records (ids and sizes, no texts) are range-partitioned by (slot, id, row) and numbered as one
   stream a partition. What a slot has before a partition comes from one summary row for each slot
   and partition, so a slot that holds a third of all records is no task of its own.
3. Bytes are added up by slot. A slot that weighs over 1 / SPLIT of a shard (a hot id) is cut into
   parts by the records' places in it, so there are at most SLOTS + SPLIT x shards + shards parts.
4. Parts go to shards, heaviest first, each to the lightest shard. That map is version 1 of a
   table; rebalancing moves parts from the heaviest to the lightest shards and writes the next.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import doc_key, null_id, table, written
from plumbline.sources import scratch

SLOTS = 8192
SHARDS = 24
SPLIT = 16
#: Rebalancing ends when the heaviest and the lightest shard are this share of a shard apart.
NEAR = 0.001
#: Bytes that a record has besides its text.
RECORD = 8


@dataclass(frozen=True)
class Part:
    """A slot, or one of its parts: its shard, its records and bytes, and the first place it takes there."""

    slot: int
    part: int
    parts: int
    rows: int
    bytes: int
    shard: int = -1
    first: int = 0


MAP = "slot int, part int, parts int, rows long, bytes long, shard int, first long"


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc, size, crc, row, vslot of each record; null texts have no bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.monotonically_increasing_id()
    return docs.select(doc_key().alias("doc"), (F.octet_length(text) + F.lit(RECORD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), row.alias("row")).withColumn("vslot", F.pmod(F.xxhash64("doc"), F.lit(slots)).cast("int"))


def _number(batches):
    """Records of a partition with their place among those of their slot in it, and the partition."""
    task, last, count = TaskContext.get().partitionId(), -1, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        slot = batch.column("vslot").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        at = np.arange(len(slot)) - np.repeat(starts, np.diff(np.append(starts, len(slot))))
        if slot[0] == last:
            at[: starts[1] if len(starts) > 1 else len(at)] += count
        last, count = slot[-1], int(at[-1]) + 1
        columns = [batch.column(c) for c in ("doc", "size", "crc", "vslot")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(at), task, dtype="i4")), pa.array(at.astype("i8"))], names=["doc", "size", "crc", "vslot", "task", "at"])


def numbered(records: DataFrame) -> DataFrame:
    """doc, size, crc, vslot, place: each record's place in its slot, gapless from 0."""
    dealt = written(records, "records").repartitionByRange("vslot", "doc", "row").sortWithinPartitions("vslot", "doc", "crc", "size", "row")
    found = written(dealt.mapInArrow(_number, "doc long, size long, crc long, vslot int, task int, at long"), "numbered")
    counts = found.groupBy("vslot", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("vslot").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each slot, and one more for each border of two partitions
    counts = counts.select("vslot", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return found.join(F.broadcast(counts), ["vslot", "task"]).select("doc", "size", "crc", "vslot", (F.col("before") + F.col("at")).alias("place"))


def weighed(records: DataFrame, shards: int, split: int = SPLIT) -> list[Part]:
    """Slots, or the parts of heavy ones, with records and bytes; records as numbered() gives them."""
    slots = [tuple(r) for r in records.groupBy("vslot").agg(F.count("*"), F.sum("size")).collect()]  # at most SLOTS rows
    most = max(1, sum(b for _, _, b in slots) // (shards * split))
    heavy = {s: min(n, -(-b // most)) for s, n, b in slots if b > most and n > 1}
    found = [Part(s, 0, 1, n, b) for s, n, b in slots if s not in heavy]
    if heavy:
        cut = records.sparkSession.createDataFrame(list(heavy.items()), "vslot int, parts int")
        parts = records.join(F.broadcast(cut), "vslot").groupBy("vslot", "parts", (F.col("place") % F.col("parts")).cast("int").alias("part")).agg(F.count("*").alias("n"), F.sum("size").alias("b"))
        found += [Part(r.vslot, r.part, r.parts, r.n, r.b) for r in parts.collect()]
    return sorted(found, key=lambda p: (p.slot, p.part))


def _with_places(parts: Iterable[Part]) -> list[Part]:
    """Parts with the first place each takes in its shard."""
    taken: dict[int, int] = {}
    out = []
    for p in sorted(parts, key=lambda p: (p.slot, p.part)):
        out.append(replace(p, first=taken.get(p.shard, 0)))
        taken[p.shard] = out[-1].first + p.rows
    return out


def first_map(parts: list[Part], shards: int) -> list[Part]:
    """Heaviest first, each part to the lightest shard."""
    loads = [(0, s) for s in range(shards)]
    out = []
    for p in sorted(parts, key=lambda p: (-p.bytes, p.slot, p.part)):
        load, shard = loads[0]
        heapq.heapreplace(loads, (load + p.bytes, shard))
        out.append(replace(p, shard=shard))
    return _with_places(out)


def rebalanced(parts: list[Part], shards: int, near: float = NEAR) -> list[Part]:
    """The map edited for this many shards: parts move one at a time from the heaviest shard to the lightest.

    Each move is of the heaviest part that is lighter than half the gap (or, with none, than the
    gap), so the gap always shrinks. Shards beyond the number are emptied first.
    """
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    gone, at = [], {}
    for i, p in enumerate(parts):
        at[i] = p.shard
        held[p.shard].append((p.bytes, i)) if p.shard < shards else gone.append((p.bytes, i))
    for h in held:
        h.sort()
    load = [sum(b for b, _ in h) for h in held]

    def put(b: int, i: int, shard: int) -> None:
        insort(held[shard], (b, i))
        load[shard] += b
        at[i] = shard

    for b, i in sorted(gone, reverse=True):
        put(b, i, min(range(shards), key=lambda s: (load[s], s)))
    enough = near * sum(load) / max(1, shards)
    while True:
        light, heavy = min(range(shards), key=lambda s: (load[s], s)), max(range(shards), key=lambda s: (load[s], -s))
        gap = load[heavy] - load[light]
        place = bisect_right(held[heavy], (gap // 2, len(parts)))
        if gap <= enough or not (place or held[heavy] and held[heavy][0][0] < gap):
            return _with_places(replace(p, shard=at[i]) for i, p in enumerate(parts))
        b, i = held[heavy].pop(max(0, place - 1))
        load[heavy] -= b
        put(b, i, light)


def save_map(spark: SparkSession, parts: list[Part], path: str, version: int) -> None:
    """Version `version` of the map at path. A version that is there already is an error, never overwritten."""
    rows = [(p.slot, p.part, p.parts, p.rows, p.bytes, p.shard, p.first) for p in parts]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """slot, part, parts, rows, bytes, shard, first, version: the newest version, or the one named."""
    maps = spark.read.schema(f"{MAP}, version int").parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == F.lit(version))


def placed(records: DataFrame, parts: DataFrame) -> DataFrame:
    """Each numbered record with its shard under a map and its place there."""
    # a map has at most SLOTS + (SPLIT + 1) x shards rows
    by_slot = F.broadcast(parts.select(F.col("slot").alias("vslot"), "part", "parts", "shard", "first", "version"))
    cut = F.broadcast(parts.select(F.col("slot").alias("vslot"), "parts").distinct())
    found = records.join(cut, "vslot").withColumn("part", (F.col("place") % F.col("parts")).cast("int")).drop("parts")
    return found.join(by_slot, ["vslot", "part"]).withColumn("slot", F.col("first") + F.floor(F.col("place") / F.col("parts"))).drop("first", "parts")


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, path: str | None = None, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, part, map_version, next_shard.

    The law is `bytes`: shards are near equal in size, the sum of UTF-8 bytes plus 8 a record
    (null texts have none). `slot` is a record's place in its shard, gapless from 0; `vslot` and
    `part` are the virtual slot it is hashed to by doc_id and the part of it. Equal texts with
    different ids are records of their own and may lie apart. Records that share an id, or have
    none, share a slot, which is cut when it is heavy. The map is version 1 at `path` (a folder
    of the session's own, if none is given); version 2 is the same map edited for one shard more,
    and next_shard is the shard there. grown_shard is null, as the law is not `key`. Rerunning on
    the same table gives the same rows. An empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or scratch.place(spark, "slot-map")
    records = written(numbered(sized(docs, slots)), "placed")
    first = first_map(weighed(records, shards), shards)
    save_map(spark, first, path, 1)
    save_map(spark, rebalanced(first, shards + 1), path, 2)
    now, later = load_map(spark, path, 1), load_map(spark, path, 2)
    both = now.join(later.select("slot", "part", F.col("shard").alias("next_shard")), ["slot", "part"])
    out = placed(records, now).join(F.broadcast(both.select(F.col("slot").alias("vslot"), "part", "next_shard")), ["vslot", "part"])
    return out.select(null_id("doc").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "part", F.col("version").alias("map_version"), "next_shard")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))
