"""Operator 5: exact dedup by distributed MSD radix partitioning.

Texts are split by successive bytes, most significant first, until a group is a single text or
has ended; equality is the end of a group and needs no digest.

* Within a slice of a scan task, copies are folded into one representative, which carries the
  ids of its members. So a group of copies, however large, leaves each task as one row a slice.
* Texts are dealt by their leading bytes. A node of the tree of bytes with more than `leaf_bytes`
  of different texts is split by its next bytes, and so on (8, 32, 128, ... bytes). The nodes to
  split are tables (parent, next bytes, node) that Spark makes level by level; the driver only
  learns whether a level has any. A leaf is bounded by the same number at every size.
* Each partition goes on splitting its groups by the following bytes, from a stream sorted by
  node and bytes; it holds one group's different texts at a time.

Class totals are summed from representatives and joined back to them; members are then unfolded.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import doc_key, null_id, slices, table, text_bytes, written

FIRST_DIGIT = 8
#: Each split looks at the first 8, 32, 128, ... bytes.
GROWTH = 4
#: Bytes of different texts under one node that are left to one task.
LEAF_BYTES = 4 << 20
#: Nodes of one level that are broadcast (at most about 100 MB); Spark joins more of them by a shuffle.
MOST_BROADCAST = 1_000_000


def radix_groups(texts: list[bytes]) -> list[list[int]]:
    """Positions of equal texts: split by successive bytes until single or ended."""
    done: list[list[int]] = []
    todo = [(list(range(len(texts))), 0, FIRST_DIGIT)]
    while todo:
        group, at, width = todo.pop()
        buckets: dict[bytes, list[int]] = {}
        for i in group:
            buckets.setdefault(texts[i][at : at + width], []).append(i)
        for digit, members in buckets.items():
            if len(members) == 1 or len(digit) < width:
                done.append(members)
            else:
                todo.append((members, at + width, min(2 * width, 1 << 20)))
    return done


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def widths():
    """Bytes before a level, bytes that it looks at."""
    depth, width = 0, FIRST_DIGIT
    while True:
        yield depth, width
        depth, width = depth + width, (GROWTH - 1) * (depth + width)


def leading_bytes(depth: int, width: int) -> Column:
    """Bytes depth to depth + width of a text that is not lower-cased yet, without lower-casing the rest of it."""
    return F.substring(ascii_lower(F.left("text", F.lit(depth + width))).cast("binary"), depth + 1, width)


def stepped(texts: DataFrame, nodes: DataFrame, depth: int, width: int, how: str, digit: Column) -> DataFrame:
    """texts (text, node, depth) that go on below one of nodes, one level down; the others stay where they are, or go if how is inner."""
    n = nodes.select(F.col("parent").alias("_parent"), F.col("digit").alias("_digit"), F.col("child").alias("_child"))
    on = (F.col("node") == F.col("_parent")) & (digit == F.col("_digit")) & (F.octet_length("text") > depth + width)
    keep = [c for c in texts.columns if c not in ("node", "depth")]
    return texts.join(n, on, how).select(*keep, F.coalesce("_child", "node").alias("node"), F.when(F.col("_child").isNotNull(), depth + width).otherwise(F.col("depth")).alias("depth"))


def small(nodes: DataFrame, count: int) -> DataFrame:
    return F.broadcast(nodes) if count <= MOST_BROADCAST else nodes


def nodes_to_split(texts: DataFrame, leaf_bytes: int) -> list[tuple[int, int, DataFrame]]:
    """By level: bytes before it, its bytes, and its nodes (parent, digit, child) with over leaf_bytes of different texts."""
    levels: list[tuple[int, int, DataFrame]] = []
    under = texts.select("text", F.lit(0).cast("long").alias("node"), F.lit(0).alias("depth"))
    for level, (depth, width) in enumerate(widths()):
        digit = leading_bytes(depth, width).alias("digit")
        going = under.where(F.octet_length("text") > depth + width)
        # copies count here, but are cheap to count
        many = written(going.groupBy(F.col("node").alias("parent"), digit).agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > leaf_bytes) & (F.col("n") > 1)).withColumn("child", F.monotonically_increasing_id()), "crowded")
        found = many.count()
        if not found:
            return levels
        inside = stepped(going, small(many, found), depth, width, "inner", digit)
        different = inside.groupBy("node").agg(F.approx_count_distinct(F.xxhash64("text")).alias("kinds"), F.avg(F.octet_length("text")).alias("size")).where((F.col("kinds") > 1) & (F.col("kinds") * F.col("size") > leaf_bytes))
        # ids of one level don't occur in another
        base = (level + 1) << 56
        nodes = written(many.join(different, many["child"] == different["node"], "left_semi").select("parent", "digit", (F.col("child") + F.lit(base)).alias("child")), "nodes")
        if not (found := nodes.count()):
            return levels
        levels.append((depth, width, small(nodes, found)))
        under = stepped(going, levels[-1][2], depth, width, "inner", digit)
    return levels


MEMBERS = "array<struct<doc: long, row: long>>"
MEMBER = pa.list_(pa.struct([("doc", pa.int64()), ("row", pa.int64())]))


def _fold(batches):
    """Slices of documents to one row for each different text in the slice; members: the largest doc_id first."""
    for batch in slices(batches):
        ids, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
        texts = [t.lower() for t in text_bytes(batch.column("text"))]
        groups = radix_groups(texts)
        members = [[{"doc": ids[i], "row": rows[i]} for i in sorted(g, key=lambda i: (-ids[i], rows[i]))] for g in groups]
        yield pa.RecordBatch.from_arrays([pa.array([texts[g[0]] for g in groups], pa.binary()), pa.array(members, MEMBER)], names=["text", "members"])


def _classes(batches):
    """A partition sorted by node and bytes: gives equal representatives one class_id."""
    base = TaskContext.get().partitionId() << 36
    made = seen = 0
    held: list[tuple[bytes, int]] = []  # different texts of the group that is still open, with their class
    open_key = None
    for batch in slices(batches):
        keys = list(zip(batch.column("node").to_pylist(), batch.column("leading").to_pylist(), strict=True))
        texts = batch.column("text").to_pylist()
        if keys[0] != open_key:
            held = []
        everything = [t for t, _ in held] + texts
        n = len(held)
        classes, digests = [0] * len(texts), [b""] * len(texts)
        last, still = keys[-1], []
        for group in radix_groups(everything):
            known = next((held[i][1] for i in group if i < n), None)
            if known is None:
                known, made = base + made, made + 1
            digest = hashlib.sha256(everything[group[0]]).hexdigest()
            for i in group:
                if i >= n:
                    classes[i - n], digests[i - n] = known, digest
            if group[0] < n and last == open_key or group[-1] >= n and keys[group[-1] - n] == last:
                still.append((everything[group[0]], known))
        held, open_key = still, last
        pieces = pa.array(range(base + seen, base + seen + len(texts)), pa.int64())
        seen += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pieces, pa.array(digests, pa.string()), batch.column("members")], names=["class_id", "piece", "text_sha256", "members"])


def classes(source: DataFrame, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """class_id, piece, text_sha256, members (doc, row): slices' representatives of source (doc_id, row, text), equal ones in one class."""
    levels = nodes_to_split(source.select("text"), leaf_bytes)
    placed = source.select("doc_id", "row", "text").mapInArrow(_fold, f"text binary, members {MEMBERS}").withColumns({"node": F.lit(0).cast("long"), "depth": F.lit(0)})
    for depth, width, nodes in levels:
        placed = stepped(placed, nodes, depth, width, "left", F.substring("text", depth + 1, width))
    # a leaf is a node with the next bytes, as many as its level looks at; texts are sorted by some more
    width = F.when(F.col("depth") == 0, FIRST_DIGIT).otherwise((GROWTH - 1) * F.col("depth"))
    dealt = placed.repartition("node", F.substring("text", F.col("depth") + 1, width))
    sorted_ = dealt.withColumn("leading", F.substring("text", F.col("depth") + 1, width + 64)).sortWithinPartitions("node", "leading").select("node", "leading", "text", "members")
    return written(sorted_.mapInArrow(_classes, f"class_id long, piece long, text_sha256 string, members {MEMBERS}"), "exact")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (never null), row, text (never null). row tells the rows of one reading of docs apart."""
    return docs.select(doc_key().alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def exact_groups(docs: DataFrame, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest
    doc_id stays. Repeated rows are copies of each other, of which one stays. A null doc_id is
    below all others. Other columns are ignored; an empty table gives an empty table.
    """
    pieces = classes(keyed(docs), leaf_bytes).withColumn("top", F.element_at("members", 1)["doc"])
    totals = pieces.groupBy("class_id").agg(F.sum(F.size("members").cast("long")).alias("group_size"), F.max(F.struct("top", "piece")).alias("best"))
    joined = pieces.join(totals, "class_id").select(F.posexplode("members").alias("nth", "member"), "group_size", "text_sha256", F.col("best.top").alias("keep_id"), (F.col("best.piece") == F.col("piece")).alias("first"))
    return joined.select(null_id("member.doc").alias("doc_id"), null_id("keep_id").alias("keep_id"), "group_size", (F.col("first") & (F.col("nth") == 0)).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """The rows of docs that stay, with all their columns: one for each different text, whatever else repeats.

    Null text counts as empty; a null doc_id is below all others. Of rows with one id and equal
    texts the first by text, then by the other columns, stays, so a rerun keeps the same rows.
    Rows go through the classes by numbers of their own, so that equality is that of bytes.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.monotonically_increasing_id().alias("row"))
    own = written(own, "numbered")  # a row keeps its number from here on
    pieces = classes(own.select(doc_key("own.doc_id").alias("doc_id"), "row", F.coalesce(F.col("own.text").cast("string"), F.lit("")).alias("text")), leaf_bytes)
    tops = pieces.groupBy("class_id").agg(F.max(F.element_at("members", 1)["doc"]).alias("top"))
    able = pieces.join(tops, "class_id").select("class_id", F.explode(F.filter("members", lambda m: m["doc"] == F.col("top"))).alias("m")).select("class_id", "m.row")
    able = written(able, "able")
    counts = able.groupBy("class_id").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    # rows repeated under one id: the least of them, folded before it is shuffled
    tied = own.join(able.join(counts.where("n > 1").select("class_id"), "class_id"), "row")
    others = F.to_json(F.struct(*[F.col(f"own.`{c}`") for c in docs.columns if c != "text"]))
    least = tied.groupBy("class_id").agg(F.min(F.struct(F.col("own.text").alias("t"), others.alias("o"), "row")).alias("m")).select("m.row")
    stays = counts.where("n = 1").select("row").unionByName(least)
    return own.join(stays, "row", "left_semi").select("own.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(low) AS text_sha256
FROM (SELECT doc_id, {_LOW} AS low FROM documents)
WINDOW w AS (PARTITION BY low)
"""
