"""Operator 7: removes repeated passages by longest-previous-factor arrays, keeping the first.

A byte goes if a string of `least` bytes that covers it also starts earlier. Suffixes of a whole
corpus cannot be sorted in one place, so they are first brought together where they can match:

1. Each string of `least` bytes has an anchor, the gram of its own with the smallest hash. Equal
   strings have equal anchors. An anchor stands for the run of strings that have it, whose bytes
   are its region; about one byte in 30 is an anchor. Anchors, not texts, are shuffled.
2. Regions that are equal, anchor and all, are one class: its first place stands for it and the
   later ones are its copies. Anchors are range-partitioned by (anchor, region), so that an anchor
   with very many regions spreads over partitions; neighbours meet in the few anchors at the ends
   of their ranges.
3. Anchors with several classes, and classes with copies, get the bytes of the first places. A
   task sorts their suffixes, those of a class once however many copies it has; previous and next
   smaller positions in suffix order give each suffix its longest previous factor, at the first
   place and, for a class with copies, at a place behind it. Where the factor is `least` or more
   the bytes go, and only there: a copy loses what the array says of its class. Slices of a scan
   task do the same with the copies among their own documents before they send anything on, so
   that one passage in a third of all rows is one row for each slice.
4. The classes of an anchor that has over `crowd` of them are first cut by where in a string the
   anchor stands, again and again in halves: equal strings agree in that and in ever more bytes
   around the anchor, which make the new key. Equal pieces are classes with copies like others.
5. Each document gets its runs and is cut.

Texts move compressed, and twice: to take out regions, and to be cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import doc_key, null_id, slices, table, text_bytes, written
from plumbline.llm.repeats_np import anchors, gram_hashes, gram_hashes_of, region_hashes, strings, strings_that_go

LEAST = 100
GRAM = 32
CROWD = 4_000
#: Bytes of regions whose suffixes are sorted together, besides the last group.
SORTED = 1 << 20
RUN = np.dtype([("doc", "i8"), ("row", "i8"), ("start", "i8"), ("size", "i8")])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc and row: the id, and the text's hash, which tells rows apart that share an id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(doc_key().alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))


def _packed(keyed: DataFrame) -> DataFrame:
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), pa.array([pack(t) for t in text_bytes(batch.column("text"))], pa.binary())], names=["doc", "row", "packed"])

    return keyed.mapInArrow(run, "doc long, row long, packed binary")


def joined_runs(runs: np.ndarray) -> np.ndarray:
    """Runs of RUN, sorted, with those that touch in one document put together."""
    runs = runs[np.lexsort((runs["start"], runs["row"], runs["doc"]))]
    if len(runs) < 2:
        return runs
    other = np.concatenate([[True], (runs["doc"][1:] != runs["doc"][:-1]) | (runs["row"][1:] != runs["row"][:-1])])
    part = np.cumsum(other) - 1
    # ends that grow from document to document, so that one running maximum serves all
    far = np.int64(1 << 40)
    end = np.maximum.accumulate(runs["start"] + runs["size"] + part * far) - part * far
    head = other | np.concatenate([[True], runs["start"][1:] > end[:-1]])
    at = np.flatnonzero(head)
    out = runs[at].copy()
    out["size"] = end[np.append(at[1:], len(runs)) - 1] - out["start"]
    return out


ANCHORS = "h long, c long, doc long, row long, place long"
FOUND = "kind int, h long, c long, doc long, row long, start long, size long"


def runs_of(doc, row, start, least: int) -> np.ndarray:
    """Runs that the strings starting there cover, those of each doc and row put together."""
    runs = np.empty(len(doc), RUN)
    runs["doc"], runs["row"], runs["start"], runs["size"] = doc, row, start, least
    return joined_runs(runs)


def count_bits(least: int) -> int:
    """Bits of a place that hold its number of strings; the first string's start is above them."""
    return least.bit_length()


def _copies(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of anchors in order of place: the later ones of a class, the number of its first, the firsts that have any."""
    order = np.lexsort((c, h))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])
    number = np.cumsum(new) - 1
    member = np.flatnonzero(~new)
    kept, first_of = np.unique(number[member], return_inverse=True)
    return order[member], first_of, order[np.flatnonzero(new)[kept]]


def _anchors(least: int, gram: int):
    """Anchors: h, c (hash of the region), place. Runs that a slice settles: place = -size, c = start."""
    bits = count_bits(least)

    def run(batches):
        for batch in slices(batches, most_bytes=3 << 20):
            texts = text_bytes(batch.column("text"))
            doc, row = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc", "row"))
            # in order of document; of rows that are the same, once
            order = np.lexsort((row, doc))
            texts, doc, row = [texts[i] for i in order.tolist()], doc[order], row[order]
            again = np.concatenate([[False], (doc[1:] == doc[:-1]) & (row[1:] == row[:-1])]) if len(doc) else np.empty(0, bool)
            text, start, count, at, h = anchors([b"" if a else t for t, a in zip(texts, again.tolist(), strict=True)], least, gram)
            c = region_hashes(texts, text, start, count + least - 1, at)
            member, first_of, at = _copies(h, c)
            first = np.ones(len(h), dtype=bool)
            first[member] = False
            gone = np.empty(0, RUN)
            if len(member):
                # each class with copies once: what goes from a copy is what its factors say
                data = [texts[t][a:b] for t, a, b in zip(text[at].tolist(), start[at].tolist(), (start + count + least - 1)[at].tolist(), strict=True)]
                _, _, region, offset = strings_that_go(data, text[at], start[at], np.ones(len(at), bool), least)
                runs = runs_of(region, np.zeros(len(region), np.int64), offset, least)
                n = np.bincount(runs["doc"], minlength=len(at))
                of = np.repeat(np.arange(len(member)), n[first_of])
                which = (np.cumsum(n) - n)[first_of][of] + np.arange(len(of)) - (np.cumsum(n[first_of]) - n[first_of])[of]
                gone = np.empty(len(of), RUN)
                gone["doc"], gone["row"] = doc[text[member[of]]], row[text[member[of]]]
                gone["start"], gone["size"] = start[member[of]] + runs["start"][which], runs["size"][which]
                gone = joined_runs(gone)
            columns = (
                np.concatenate([h[first].view(np.int64), np.zeros(len(gone), np.int64)]),
                np.concatenate([c[first].view(np.int64), gone["start"]]),
                np.concatenate([doc[text[first]], gone["doc"]]),
                np.concatenate([row[text[first]], gone["row"]]),
                np.concatenate([start[first] << bits | count[first], -gone["size"]]),
            )
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=["h", "c", "doc", "row", "place"])

    return run


def _found(kind: int, h, c, doc, row, start, size) -> pa.RecordBatch:
    columns = (np.full(len(h), kind, np.int32), h, c, doc, row, start, size)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=[f.split()[0] for f in FOUND.split(", ")])


def _classes(least: int):
    """Anchors sorted by h, c, document and place, size being strings. Kind 1: a later copy of its class; kind 2: a region to compare.

    Kind 5 is the first place of a class with copies, which may come as kind 2 or 3 as well. Kind 3 is such a region of the first or last anchor of a partition, which may have others in a
    neighbour; kind 4 says how many (size) regions of the last anchor went out as kind 2.
    """
    bits = count_bits(least)

    def run(batches):
        last_h = last_c = None
        last = np.full((5, 1), -1, dtype=np.int64)
        stands = last  # the first place of the open class
        first, n_open = True, 0  # the open anchor is the first one here; regions of it so far
        waiting = None  # the only region of an open anchor
        for batch in batches:
            h, c, doc, row, place = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("h", "c", "doc", "row", "place"))
            # the same place again: a row that is there twice
            now = np.stack([h, c, doc, row, place])
            again = (now == np.concatenate([last, now[:, :-1]], axis=1)).all(axis=0)
            if len(h):
                last = now[:, -1:]
            if again.any():
                h, c, doc, row, place = (x[~again] for x in (h, c, doc, row, place))
            if not len(h):
                continue
            start, count = place >> bits, place & ((1 << bits) - 1)
            new_h = np.concatenate([[h[0] != last_h], h[1:] != h[:-1]])
            new_c = new_h | np.concatenate([[c[0] != last_c], c[1:] != c[:-1]])
            began, last_h, last_c = last_h is None, h[-1], c[-1]
            if not new_c.all():
                later = ~new_c
                yield _found(1, h[later], c[later], doc[later], row[later], start[later], count[later])
                firsts = np.concatenate([stands, np.stack([h, c, doc, row, place])[:, new_c]], axis=1)
                copied = np.unique(np.cumsum(new_c)[later])
                h5, c5, doc5, row5, place5 = firsts[:, copied]
                yield _found(5, h5, c5, doc5, row5, place5 >> bits, place5 & ((1 << bits) - 1))
            if new_c.any():
                stands = np.stack([h, c, doc, row, place])[:, np.flatnonzero(new_c)[-1:]]
            new_h, h, c, doc, row, start, count = (x[new_c] for x in (new_h, h, c, doc, row, start, count))
            if not len(h):
                continue
            goes_on = not new_h[0]
            heads = np.flatnonzero(new_h)
            bounds = np.concatenate([[0] if goes_on else [], heads, [len(h)]]).astype(np.int64)
            n = np.diff(bounds)
            total = n.copy()
            if goes_on:
                total[0] += n_open
            edge = np.zeros(len(n), dtype=bool)
            edge[0] = began or goes_on and first
            several = total > 1
            if waiting is not None and goes_on:
                yield _found(2, *waiting)
            if waiting is not None and (goes_on or len(heads)):
                waiting = None
            for kind, which in ((3, edge), (2, several & ~edge)):
                out = np.repeat(which, n)
                if out.any():
                    yield _found(kind, h[out], c[out], doc[out], row[out], start[out], count[out])
            if not several[-1] and not edge[-1]:
                waiting = tuple(x[-1:].copy() for x in (h, c, doc, row, start, count))
            first, n_open = bool(edge[-1]), int(total[-1])
        if waiting is not None:
            yield _found(3, *waiting)
        elif n_open and not first:
            yield _found(4, *(np.array([x], dtype=np.int64) for x in (last_h, 0, 0, 0, 0, n_open)))

    return run


def _regions(least: int):
    """The bytes of regions: a document's row each, from its packed text and the places in it."""

    def run(batches):
        for batch in batches:
            unpack = zstandard.ZstdDecompressor()
            for i in range(batch.num_rows):
                h, c, start, count, copied = (x.to_numpy(zero_copy_only=False) for x in batch.column("places")[i].values.flatten())
                # once, copied if any of its rows says so
                order = np.lexsort((~copied, start, c, h))
                once = np.ones(len(h), dtype=bool)
                once[1:] = np.any([x[order][1:] != x[order][:-1] for x in (h, c, start)], axis=0)
                h, c, start, count, copied = (x[order[once]] for x in (h, c, start, count, copied))
                text, n = unpack.decompress(batch.column("packed")[i].as_py()), len(h)
                data = [text[s : s + k + least - 1] for s, k in zip(start.tolist(), count.tolist(), strict=True)]
                doc, row = (pa.array([batch.column(k)[i].as_py()] * n, pa.int64()) for k in ("doc", "row"))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(h), pa.array(c), doc, row, pa.array(start), pa.array(copied), pa.array(data, pa.binary())], names=REGION)

    return run


#: part: the regions that are sorted together; h and c: the class.
REGIONS = "part long, h long, c long, doc long, row long, start long, copied boolean, data binary"
REGION = [f.split()[0] for f in REGIONS.split(", ")]


def _factors(least: int):
    """Regions sorted by part. Kind 0: a run goes; kind 6: what goes from the copies of a class, start being in the region."""

    def settled(h, c, doc, row, start, copied, data):
        # a region without copies none of whose strings is there twice, by hash, has nothing to sort
        place, region = strings(np.array([len(x) for x in data]), least)
        hashes = gram_hashes_of(np.frombuffer(b"".join(data), np.uint8), least)[place]
        _, number, times = np.unique(hashes, return_inverse=True, return_counts=True)
        twice = copied.copy()
        twice[region[times[number] > 1]] = True
        order = np.lexsort((start, row, doc))
        order = order[twice[order]]
        if not len(order):
            return
        h, c, doc, row, start, copied, data = *(x[order] for x in (h, c, doc, row, start, copied)), [data[i] for i in order.tolist()]
        document = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])]))
        region, offset, again, behind = strings_that_go(data, document, start, copied, least)
        runs = runs_of(doc[region], row[region], start[region] + offset, least)
        none = np.zeros(len(runs), np.int64)
        yield _found(0, none, none, runs["doc"], runs["row"], runs["start"], runs["size"])
        runs = runs_of(h[again], c[again], behind, least)
        none = np.zeros(len(runs), np.int64)
        yield _found(6, runs["doc"], runs["row"], none, none, runs["start"], runs["size"])

    def run(batches):
        held: list = [[] for _ in REGION]
        size = 0

        def take(n: int):
            yield from settled(*(np.array(x[:n], dtype=np.int64) for x in held[1:6]), np.array(held[6][:n], dtype=bool), held[7][:n])

        for batch in batches:
            for column, k in zip(held, REGION, strict=True):
                column.extend(batch.column(k).to_pylist())
            size += batch.nbytes
            if size < SORTED:
                continue
            cut = len(held[0])
            while cut and held[0][cut - 1] == held[0][-1]:
                cut -= 1
            if cut:
                yield from take(cut)
                held = [x[cut:] for x in held]
                size = sum(map(len, held[7]))
        if held[0]:
            yield from take(len(held[0]))

    return run


def _halved(least: int, gram: int):
    """Regions cut by where the anchor stands: by how many bytes of a string follow it, fewer than the middle of lo and hi or not.

    The new h is made of the bytes around the anchor that all strings of the part have.
    """

    def run(batches):
        for batch in batches:
            for part in slices([batch], most_bytes=1 << 20):
                out: list[list] = [[] for _ in HALVES.split(", ")]
                for h, lo, hi, doc, row, start, data in zip(*(part.column(k).to_pylist() for k in ("h", "lo", "hi", "doc", "row", "start", "data")), strict=True):
                    hashes = gram_hashes(np.frombuffer(data[:least], np.uint8), gram)
                    anchor, middle = int(hashes.argmin()), (lo + hi) // 2
                    # string i has i + least - anchor - gram bytes behind its anchor
                    cut = min(max(middle - least + anchor + gram, 0), len(data) - least + 1)
                    for a, b, low, high in ((0, cut, lo, middle), (cut, len(data) - least + 1, middle, hi)):
                        if a < b:
                            piece = data[a : b + least - 1]
                            around = data[anchor - (least - gram - high + 1) : anchor + gram + low]
                            digest = xxhash.xxh3_128_digest(piece, b - a)
                            fields = (xxhash.xxh3_64_intdigest(around, (h ^ low) & (2**64 - 1)), low, high, doc, row, start + a, piece, *np.frombuffer(digest, "<i8").tolist())
                            for column, x in zip(out, fields, strict=True):
                                column.append(x)
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                out[0] = np.array(out[0], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=[f.split()[0] for f in HALVES.split(", ")])

    return run


HALVES = "h long, lo int, hi int, doc long, row long, start long, data binary, a long, b long"


def thinned(regions: DataFrame, least: int, gram: int, crowd: int) -> tuple[DataFrame, DataFrame | None]:
    """regions with at most `crowd` different ones to compare for each part, and the copies that this made (or None).

    It takes a round for each halving, and only while a part is crowded. In the end a part has
    the strings with one place of the anchor and one content, so there is just one of it. Of equal
    pieces the first goes on; it also stays as a class with copies, whose part is its own.
    """
    pieces = regions.withColumns({"lo": F.lit(0), "hi": F.lit(least - gram + 1)})
    columns, members, classes = [*REGION, "lo", "hi"], None, None
    for _ in range((least - gram + 1).bit_length() + 1):
        pieces = written(pieces.select(columns), "regions")
        crowded = written(pieces.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("part"), "crowded")
        if not crowded.count():
            break
        dense = pieces.join(crowded, "part", "left_semi")
        halves = written(dense.withColumnRenamed("part", "key").drop("h").withColumnRenamed("key", "h").mapInArrow(_halved(least, gram), HALVES), "halves")
        place = F.struct("doc", "row", "start")
        firsts = halves.groupBy("h", "lo", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n"))
        told = written(halves.join(firsts, ["h", "lo", "a", "b"]).withColumns({"later": place != F.col("first"), "c": F.col("a").bitwiseXOR(F.col("b"))}), "told")
        gone = told.where("later").select("h", "c", "doc", "row", "start")
        alone = told.where("not later and n > 1").withColumns({"part": F.col("c"), "copied": F.lit(True)}).select(REGION)
        alone = alone.unionByName(dense.where("copied").withColumn("part", F.col("c")).select(REGION))
        members, classes = (gone, alone) if members is None else (members.unionByName(gone), classes.unionByName(alone))
        split = told.where("not later").withColumns({"part": F.col("h"), "copied": F.lit(False)}).select(columns)
        pieces = pieces.join(crowded, "part", "left_anti").select(columns).unionByName(split)
    pieces = pieces.select(REGION)
    return (pieces if classes is None else pieces.unionByName(classes)), members


def repeated_runs(docs: DataFrame, least: int = LEAST, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc, row, start, size: runs of bytes that go; they may overlap. Strings of `least` bytes hold a gram, so it is `gram` at least."""
    if not 0 < gram <= least:
        raise ValueError(f"least ({least}) must be gram ({gram}) or more")
    keyed = _keyed(docs)
    sent = written(keyed.mapInArrow(_anchors(least, gram), ANCHORS), "anchors")
    dealt = sent.where("place >= 0").repartitionByRange("h", "c").sortWithinPartitions("h", "c", "doc", "row", "place")
    found = written(dealt.mapInArrow(_classes(least), FOUND), "classes")
    # at most two anchors a partition
    edges = found.where("kind >= 3 and kind < 5").groupBy("h").agg(F.sum(F.when(F.col("kind") == 4, F.col("size")).otherwise(1)).alias("n")).where("n > 1").select("h")
    several = found.where("kind = 2").unionByName(found.where("kind = 3").join(F.broadcast(edges), "h", "left_semi"))
    classes = several.withColumn("copied", F.lit(False)).unionByName(found.where("kind = 5").withColumn("copied", F.lit(True)))
    wanted = classes.groupBy("doc", "row").agg(F.collect_list(F.struct("h", "c", "start", "size", "copied")).alias("places"))
    regions = _packed(keyed).join(wanted.hint("shuffle_hash"), ["doc", "row"]).select("doc", "row", "packed", "places").mapInArrow(_regions(least), REGIONS)
    members = found.where("kind = 1").select("h", "c", "doc", "row", "start")
    # ids alone tell whether any anchor is crowded
    if several.groupBy("h").count().where(F.col("count") > crowd).limit(1).count():
        regions, more = thinned(regions, least, gram, crowd)
        members = members if more is None else members.unionByName(more)
    factors = written(regions.repartition("part").sortWithinPartitions("part").mapInArrow(_factors(least), FOUND), "factors")
    # a copy is a row for each slice, a class has one run as a rule: a hot class streams past it
    goes = factors.where("kind = 6").select("h", "c", F.col("start").alias("behind"), "size")
    copies = members.hint("merge").join(goes, ["h", "c"]).select("doc", "row", (F.col("start") + F.col("behind")).alias("start"), "size")
    settled = sent.where("place < 0").select("doc", "row", F.col("c").alias("start"), (-F.col("place")).alias("size"))
    return settled.unionByName(factors.where("kind = 0").select("doc", "row", "start", "size")).unionByName(copies)


def _cut(digest: bool):
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for packed, runs in zip(batch.column("packed").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                text = unpack.decompress(packed)
                spans: list[list[int]] = []
                for start, size in sorted((r["start"], r["size"]) for r in runs or []):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], start + size)
                    else:
                        spans.append([start, start + size])
                rest, at = [], 0
                for a, b in spans:
                    rest.append(text[at:a])
                    at = b
                left = b"".join([*rest, text[at:]])
                n_bytes.append(len(text))
                n_removed.append(len(text) - len(left))
                n_spans.append(len(spans))
                kept.append(hashlib.sha256(left).hexdigest() if digest else left)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.string() if digest else pa.binary())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, crowd: int = CROWD, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left, or with digest their SHA-256).

    Bytes are those of the text in UTF-8, null as empty, so what is left may begin or end within
    a character. Matches never cross documents. Order is by doc_id, a null one first, then place;
    rows that repeat an id with the same text are one document, with another text they follow
    each other in the order of their texts' hashes. Each row gives a row. Other columns are
    ignored; an empty table gives an empty table. `least` under `gram` is a ValueError; shorter
    strings need a smaller gram.
    """
    runs = repeated_runs(docs, least, gram, crowd).groupBy("doc", "row").agg(F.collect_list(F.struct("start", "size")).alias("runs"))
    both = _packed(_keyed(docs)).join(runs.hint("shuffle_hash"), ["doc", "row"], "left").select("doc", "packed", "runs")
    out = both.mapInArrow(_cut(digest), f"doc long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")
    return out.select(null_id("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")
