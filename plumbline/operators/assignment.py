"""Greedy one-to-one assignment: a walk in row order in which each row takes its best free candidate.

Rows of one class want the same candidates in the same order. A class is linked to queues of
candidates (of equal weight within a queue, so the least is taken first); a candidate may stand
in several queues. What a walk decides in one connected component doesn't touch another, so each
group of at most LIMIT links and candidates is walked in a task of its own, as one sorted stream.
Blocks are taken whole while they are small enough; larger ones are split into their components.
Only a component over LIMIT is settled by rounds of deferred acceptance over the whole cluster.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.components import components
from plumbline.sources.scratch import settled

#: Links, candidates and rows of a group that one task walks.
LIMIT = 1_000_000
#: First counts of a class's rows are taken in so many parts.
PARTS = 64

FOUND = "row_idx long, cand_idx long, weight double"


class Group:
    """Links and queues of one group, and who is taken."""

    def __init__(self):
        self.levels: dict[int, list] = {}  # class: [weight, similarity, its queues, their heap], best last when first asked
        self.queues: dict[int, list] = {}  # queue: [its candidates, place of the first that may be free]
        self.taken: set[int] = set()

    def link(self, cls: int, queue: int, weight: float, similarity: float) -> None:
        """Links of a class come best first."""
        levels = self.levels.setdefault(cls, [])
        if levels and levels[-1][0] == weight and levels[-1][1] == similarity:
            levels[-1][2].append(queue)
        else:
            levels.append([weight, similarity, [queue], None])

    def head(self, queue: int) -> int | None:
        waiting = self.queues.get(queue)
        if waiting is None:
            return None
        held, at = waiting
        while at < len(held) and held[at] in self.taken:
            at += 1
        waiting[1] = at
        return held[at] if at < len(held) else None

    def take(self, cls: int) -> tuple[int, float] | None:
        levels = self.levels.get(cls)
        while levels:
            weight, _, queues, heap = levels[0]
            if heap is None:
                heap = levels[0][3] = [(c, q) for q in queues if (c := self.head(q)) is not None]
                heapq.heapify(heap)
            while heap:
                cand, queue = heap[0]
                now = self.head(queue)
                if now == cand:
                    self.taken.add(cand)
                    return cand, weight
                heapq.heapreplace(heap, (now, queue)) if now is not None else heapq.heappop(heap)
            levels.pop(0)
        return None


def _walk(batches):
    """Rows sorted by group, then links (kind 0), queues (1) and rows (2)."""
    group, state = None, Group()
    for batch in batches:
        found = []
        for grp, kind, a, b, weight, similarity in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if grp != group:
                group, state = grp, Group()
            if kind == 0:
                state.link(a, b, weight, similarity)
            elif kind == 1:
                state.queues.setdefault(a, [[], 0])[0].append(b)
            elif got := state.take(b):
                found.append((a, *got))
        columns = zip(*found, strict=True) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["row_idx", "cand_idx", "weight"])


def walked(rows: DataFrame, links: DataFrame, cands: DataFrame) -> DataFrame:
    """The walk of groups (grp): rows row_idx, cls; links cls, queue, weight, similarity; cands queue, cand_idx."""
    none = F.lit(None).cast("double")
    table = links.select("grp", F.lit(0).alias("kind"), F.col("cls").alias("a"), F.col("queue").alias("b"), "weight", "similarity")
    table = table.unionByName(cands.select("grp", F.lit(1).alias("kind"), F.col("queue").alias("a"), F.col("cand_idx").alias("b"), none.alias("weight"), none.alias("similarity")))
    table = table.unionByName(rows.select("grp", F.lit(2).alias("kind"), F.col("row_idx").alias("a"), F.col("cls").alias("b"), none.alias("weight"), none.alias("similarity")))
    return table.repartition("grp").sortWithinPartitions("grp", "kind", "a", F.desc("weight"), F.desc("similarity"), "b").mapInArrow(_walk, FOUND)


def first_rows(rows: DataFrame, most: DataFrame, owner: str, order: str) -> DataFrame:
    """Of each owner's rows the first `most` by order; only owners that have more are sorted, in parts first."""
    sizes = rows.groupBy(owner).agg(F.count("*").alias("_n")).join(most, owner)
    over = sizes.where(F.col("_n") > F.col("most")).select(owner, "most")
    few = rows.join(over.select(owner), owner, "left_anti")
    many = rows.join(over, owner).withColumn("_part", F.pmod(F.xxhash64(order), F.lit(PARTS)))
    for keys in ([owner, "_part"], [owner]):
        many = many.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_r") <= F.col("most")).drop("_r")
    return few.unionByName(many.select(rows.columns))


def in_rounds(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """row_idx, cand_idx, weight of the same walk, as deferred acceptance with one priority, over lists cls, cand_idx, weight, similarity.

    Each row asks the candidate at its place of its class's list, and a candidate holds the lowest
    row that asked. Of rows of one class a later one always ends at a later place, so the k-th
    starts at the k-th place and is pushed on by those before it. A row that lost goes on to the
    next candidate that no lower row holds. It ends when no row has lost; each round takes at
    least one pair out, so a chain of n classes takes n rounds.
    """
    place = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("weight"), F.desc("similarity"), "cand_idx"))
    lists = settled(lists.select("cls", "cand_idx", "weight", place.alias("pos")))
    k = F.row_number().over(Window.partitionBy("cls").orderBy("row_idx"))
    state = rows.join(lists.select("cls").distinct(), "cls", "left_semi").select("row_idx", "cls", k.alias("k")).withColumn("at", F.col("k"))
    while True:
        asks = settled(state.join(lists.select("cls", F.col("pos").alias("at"), "cand_idx", "weight"), ["cls", "at"]))
        holds = settled(asks.groupBy("cand_idx").agg(F.min("row_idx").alias("holder")))
        judged = settled(asks.join(holds, "cand_idx").withColumn("lost", F.col("row_idx") > F.col("holder")))
        low = settled(judged.where("lost").groupBy("cls").agg(F.min("row_idx").alias("low_row"), F.min("at").alias("low_at")))
        if low.isEmpty():
            return judged.select("row_idx", "cand_idx", "weight")
        ahead = lists.join(low, "cls").where("pos > low_at").join(holds, "cand_idx", "left").where("holder is null or holder > low_row").groupBy("cls").agg(F.min("pos").alias("next"))
        moved = judged.join(ahead, "cls", "left").where("not lost or next is not null").withColumn("at", F.when(F.col("lost"), F.greatest(F.col("at") + 1, F.col("next"))).otherwise(F.col("at")))
        pushed = F.col("k") + F.max(F.col("at") - F.col("k")).over(Window.partitionBy("cls").orderBy("k"))
        state = moved.select("row_idx", "cls", "k", pushed.alias("at"))


def _sizes(links: DataFrame, cands: DataFrame, rows: DataFrame) -> DataFrame:
    """grp, size: links, candidates and rows of each group; cands and rows by their queues and classes."""
    per_queue = cands.groupBy("queue").agg(F.count("*").alias("n"))
    per_class = rows.groupBy("cls").agg(F.count("*").alias("n"))
    parts = [links.select("grp", F.lit(1).cast("long").alias("n")), links.select("grp", "queue").distinct().join(per_queue, "queue").select("grp", "n"), links.select("grp", "cls").distinct().join(per_class, "cls").select("grp", "n")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("grp").agg(F.sum("n").alias("size"))


def assign(rows: DataFrame, links: DataFrame, cands: DataFrame, limit: int = LIMIT) -> DataFrame:
    """row_idx, cand_idx, weight of the walk in row order.

    rows: row_idx, cls, one class each; links: cls, queue, weight, similarity, and grp, if links
    are known not to cross its values (classes and candidates of two values never meet); cands:
    queue, cand_idx. The best candidate is that of the greatest weight, then similarity, then the
    least cand_idx. Repeated links and repeated rows must not occur.
    """
    links = settled(links if "grp" in links.columns else links.withColumn("grp", F.lit(0).cast("long")), "links")
    cands = settled(cands.join(links.select("queue").distinct(), "queue", "left_semi"), "queues")
    # a class's rows beyond the number of its candidates get none, as those before them have the same list
    reach = links.select("cls", "queue").join(cands.groupBy("queue").agg(F.count("*").alias("n")), "queue").groupBy("cls").agg(F.sum("n").alias("most"))
    rows = settled(first_rows(rows.select("row_idx", "cls").join(reach.select("cls"), "cls", "left_semi"), reach, "cls", "row_idx"), "rows")
    # nor can a queue give more than its group has rows
    of_group = links.select("grp", "cls").distinct().join(rows, "cls").groupBy("grp").agg(F.count("*").alias("most"))
    cands = settled(first_rows(cands, links.select("grp", "queue").distinct().join(of_group, "grp").select("queue", "most"), "queue", "cand_idx"), "queues")
    sizes = settled(_sizes(links, cands, rows), "sizes")
    large = sizes.where(F.col("size") > limit).select("grp")
    if large.isEmpty():
        return walked(*_grouped(rows, links, cands))
    inside = links.join(large, "grp", "left_anti")
    crowded = links.join(large, "grp", "left_semi")
    node = lambda kind, c: F.xxhash64(F.lit(kind), F.col(c))
    shared = cands.join(crowded.select("queue").distinct(), "queue", "left_semi")
    edges = crowded.select(node("c", "cls").alias("u"), node("q", "queue").alias("v")).unionByName(shared.select(node("q", "queue").alias("u"), node("x", "cand_idx").alias("v")))
    of = components(edges)
    split = settled(crowded.drop("grp").withColumn("node", node("c", "cls")).join(of, "node").withColumnRenamed("component", "grp").drop("node"), "links")
    large = settled(_sizes(split, cands, rows).where(F.col("size") > limit).select("grp"), "large")
    found = walked(*_grouped(rows, inside.unionByName(split.join(large, "grp", "left_anti").select(inside.columns)), cands))
    rest = split.join(large, "grp", "left_semi")
    if not rest.isEmpty():
        best = Window.partitionBy("cls", "cand_idx").orderBy(F.desc("weight"), F.desc("similarity"))
        lists = rest.join(cands, "queue").withColumn("_b", F.row_number().over(best)).where("_b = 1").select("cls", "cand_idx", "weight", "similarity")
        found = found.unionByName(in_rounds(rows.join(rest.select("cls").distinct(), "cls", "left_semi"), lists))
    return found


def _grouped(rows: DataFrame, links: DataFrame, cands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return rows.join(links.select("grp", "cls").distinct(), "cls"), links, cands.join(links.select("grp", "queue").distinct(), "queue")
