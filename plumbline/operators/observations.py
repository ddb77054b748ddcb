"""Rows of sheets under their headers: which row is a header, what continues it, what a data row says.

Rows of a sheet pass through a task as one stream in order. The stream's state is the headers
that hold, the last context lines and, while a sheet's best header is still looked for, its first
rows; so a sheet may be as long as it likes. What needs the text of cells (their slots, whether
they are data) is worked out before, and addresses are put together after it, as expressions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import address as A
from plumbline.functions.slots import header_slot, renormalized
from plumbline.functions.text import clean, let, normalized, without_tail
from plumbline.operators import collect, sanitize
from plumbline.sources.scratch import settled

#: Rows in which a sheet's header stands, points it needs, rows that may continue it.
BEST_ROWS, FIRST_ROWS, LEAST_POINTS, CONTINUATIONS = 35, 50, 4, 3
#: Context lines that are kept, that are used, and the longest.
CONTEXT_KEPT, CONTEXT_USED, CONTEXT_CHARS = 4, 3, 350
#: Words of headers that earn points, and of columns that are no address.
ADDRESS_WORDS, PART_WORDS, PLACE_WORDS = "адрес|местоположение|местонахождение", "улица|номер дома|дом", "населенный пункт|город|муницип"
NO_ADDRESS_WORDS = "планируемый срок|примеч|количество|потребность|мощность"
PLACES = ("postal_index", "subject", "municipality", "locality", "territory", "microdistrict")


def sheet_rows(cells: DataFrame, part: list[str]) -> DataFrame:
    """part, row_idx, cells: what is told of the cells (col_idx, value) of each row that has any, blanks between them null; of two at one place the smaller.

    Of each cell its value and key, whether it names a slot and whether it is data: worked out
    where the cells are read, not in the arrays of rows.
    """
    there = cells.select(*part, "row_idx", "col_idx", clean("value").alias("value")).where("value is not null")
    cell = F.struct("col_idx", "value", normalized("value").alias("key"), header_slot(F.col("value")).isNotNull().alias("slotted"), data_value(F.col("value")).alias("data"))
    held = there.select(*part, "row_idx", cell.alias("c")).groupBy(*part, "row_idx").agg(F.array_sort(F.collect_list("c")).alias("_m"))
    width = there.groupBy(*part).agg(F.max("col_idx").alias("_w"))
    at = lambda i: F.get(F.filter("_m", lambda x: x["col_idx"] == i), F.lit(0))
    return held.join(width, part).select(*part, "row_idx", F.transform(F.sequence(F.lit(0), F.col("_w")), at).alias("cells"))


def data_value(v: Column) -> Column:
    """A cell that measures or names something and so is no header: a number that is no year, a decimal, an address, a long text."""
    bare = F.regexp_replace(F.replace(v, F.lit(","), F.lit(".")), " ", "")
    number = bare.rlike("^-?[0-9]+([.][0-9]+)?$") & ~bare.rlike("^(19|20)[0-9]{2}$")
    return F.coalesce(number | v.rlike("[0-9]+[.,][0-9]+") | collect.plausible(v) | (F.length(v) > 120), F.lit(False))


def marked_rows(rows: DataFrame, part: list[str]) -> DataFrame:
    """rows with what the stream asks of them: keys and slots of cells, data, points as a header, text, is_context."""
    each = lambda name: F.transform("cells", lambda x: x[name])
    rows = rows.withColumns({"values": each("value"), "keys": each("key"), "slotted": F.transform("cells", lambda x: F.coalesce(x["slotted"], F.lit(False))), "data": F.transform("cells", lambda x: F.coalesce(x["data"], F.lit(False)))})
    some = F.filter("values", lambda x: x.isNotNull())
    text = F.array_join("values", " | ")
    norm = normalized(text)
    points = 2 * F.size(F.filter("slotted", lambda s: s)) + F.when(norm.rlike(ADDRESS_WORDS), 4).otherwise(0) + F.when(norm.rlike(PART_WORDS), 2).otherwise(0) + F.when(norm.rlike(PLACE_WORDS), 1).otherwise(0) + F.when(F.size(some) >= 5, 1).otherwise(0)
    return rows.select(*part, "row_idx", "values", "keys", "slotted", "data", F.when(F.size(some) >= 2, points).otherwise(0).alias("points"), text.alias("text"), collect.place_line(text).alias("is_context"))


def numbered(names: Iterable[str | None]) -> list[str]:
    """`column_n` for a blank, `_2`, `_3` behind repeats."""
    seen: dict[str, int] = {}
    out = []
    for n, name in enumerate(names, 1):
        name = name or f"column_{n}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def continues(row: dict, header: dict) -> bool:
    """Fills a gap that a merged header left to its right, without data; or names slots or years, and no address."""
    there = [i for i, v in enumerate(row["values"]) if v]
    gap = any(not header["values"][i] and any(header["values"][:i]) for i in there)
    if gap and not any(row["data"][i] for i in there):
        return True
    if row["told"] or not there:
        return False
    named = sum(1 for i in there if row["slotted"][i] or (len(row["values"][i]) == 4 and row["values"][i].isdigit() and row["values"][i].startswith("20")))
    return named >= max(2, len(there) // 2)


def combined(header: dict, more: list[dict]) -> list[str]:
    """One name a column: the header (or, over a gap, the last one to its left), then what continues it, each once."""
    names, left = [], None
    for i, own in enumerate(header["values"]):
        left = own or left
        below = [r["values"][i] for r in more if r["values"][i]]
        parts = [own] if own else [left] if below and left else []
        parts += [v for k, v in enumerate(below) if v not in parts and v not in below[:k]]
        names.append(" ".join(parts) or None)
    return numbered(names)


def repeats(keys: list[str | None], header_keys: list[str]) -> bool:
    same = sum(1 for n, (a, b) in enumerate(zip(keys, header_keys, strict=True), 1) if (a or f"column {n}") == b)
    return same >= max(3, len(header_keys) // 2)


def observed(rows: Iterable[dict], mode: str) -> Iterator[tuple[dict, list[str], list[str]]]:
    """Data rows of one sheet with their headers and the context lines before them.

    mode `best`: the row with most points among the first ones, the first of equals, and up to three
    rows that continue it; `first`: the first row with enough points, later repeats of it left out;
    `every`: each row with enough points is a new header. Without a header a sheet has no rows.
    """
    rows = iter(rows)
    headers: list[str] | None = None
    header_keys: list[str] = []
    ahead: list[dict] = []
    if mode == "best":
        for row in rows:
            ahead.append(row)
            if len(ahead) == BEST_ROWS:
                break
        best = max(range(len(ahead)), key=lambda i: (ahead[i]["points"], -i), default=None)
        if best is None or ahead[best]["points"] < LEAST_POINTS:
            return
        header, ahead, more = ahead[best], ahead[best + 1 :], []
        while len(more) < CONTINUATIONS:
            if not ahead and (row := next(rows, None)) is not None:
                ahead.append(row)
            if not ahead or not continues(ahead[0], header):
                break
            more.append(ahead.pop(0))
        headers = combined(header, more)
    context: list[tuple[str, str]] = []
    for n, row in enumerate(_chained(ahead, rows)):
        if mode != "best" and (headers is None or mode == "every"):
            if row["points"] >= LEAST_POINTS and (mode == "every" or n < FIRST_ROWS):
                headers = numbered(row["values"])
                header_keys = [k or f"column {i}" for i, k in enumerate(row["keys"], 1)]
                continue
            if headers is None:
                if row["is_context"] and mode == "every":
                    _remember(context, row)
                continue
        if mode == "first" and repeats(row["keys"], header_keys):
            continue
        if row["is_context"]:
            _remember(context, row)
            continue
        yield row, headers, [text for _, text in context]


def _chained(first: list[dict], rest: Iterator[dict]) -> Iterator[dict]:
    while first:
        yield first.pop(0)
    yield from rest


def _remember(context: list[tuple[str, str]], row: dict) -> None:
    if len(row["text"]) <= CONTEXT_CHARS and row["text_key"] not in [k for k, _ in context]:
        context.append((row["text_key"], row["text"]))
        del context[:-CONTEXT_KEPT]


PAYLOAD = pa.map_(pa.string(), pa.string())


def observation_rows(cells: DataFrame, part: list[str], mode: str = "best") -> DataFrame:
    """part (strings), row_idx, payload (header to value, blanks left out), context (last lines of places before the row).

    cells: part, row_idx, col_idx, value. See observed() for mode.
    """
    marked = marked_rows(sheet_rows(cells, part), part).withColumns({"text_key": normalized("text"), "told": F.col("text").rlike(A.STREET) | normalized("text").rlike(ADDRESS_WORDS)})
    order = marked.select(*[F.col(p).cast("string").alias(p) for p in part], *[c for c in marked.columns if c not in part])

    def run(batches):
        names = [*part, "row_idx", "payload", "context"]

        def stream():
            for batch in batches:
                yield from batch.to_pylist()

        def sheets():
            rows = stream()
            waiting = next(rows, None)
            while waiting is not None:
                key = [waiting[p] for p in part]

                def of_sheet():
                    nonlocal waiting
                    while waiting is not None and [waiting[p] for p in part] == key:
                        row, waiting = waiting, next(rows, None)
                        yield row

                own = of_sheet()
                for row, headers, context in observed(own, mode):
                    yield *key, row["row_idx"], [(h, v) for h, v in zip(headers, row["values"], strict=True) if v], context
                for _ in own:  # the rest of a sheet without a header
                    pass

        def packed(rows):
            kinds = [*[pa.string()] * len(part), pa.int64(), PAYLOAD, pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        held = []
        for out in sheets():
            held.append(out)
            if len(held) == 4096:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    schema = ", ".join(f"{p} string" for p in part) + ", row_idx long, payload map<string,string>, context array<string>"
    dealt = order.repartition(*part).sortWithinPartitions(*part, "row_idx")
    return dealt.mapInArrow(run, schema)


def _unique(parts: Column) -> Column:
    """Parts whose normalized text is new, in order."""
    told = F.filter(F.transform(parts, lambda p: F.struct(p.alias("p"), normalized(p).alias("k"))), lambda x: x["p"].isNotNull())
    first = let(told, lambda xs: F.filter(xs, lambda x, i: (x["p"] != "") & (F.array_position(F.transform(xs, lambda y: y["k"]), x["k"]) == i + 1)))
    return F.transform(first, lambda x: x["p"])


def observation_addresses(rows: DataFrame, part: list[str]) -> DataFrame:
    """part, row_idx, address of the rows (payload, context) that say one.

    The best value under an address header, completed by street and house of other columns; without
    one the street and house themselves; else the most address-like value. Before it go the last
    context lines and the places of other columns that it doesn't name.
    """
    rows = settled(rows, "observed")
    ids = [*part, "row_idx"]
    entry = rows.select(*ids, F.posexplode(F.map_entries("payload")).alias("i", "e")).select(*ids, "i", F.col("e.key").alias("header"), clean(F.col("e.value")).alias("value")).where("value is not null")
    entry = A.parsed(entry.withColumn("slot", header_slot("header")), "value")
    h, v, p = F.col("_h"), F.col("value"), F.col("parsed")
    points = lambda c, n: F.when(c, n).otherwise(0)
    # what is asked of a value is a column of a table: the aggregate names it several times
    entry = entry.withColumn("_h", normalized("header")).withColumns({"titled": h.rlike(ADDRESS_WORDS), "hint": v.rlike(collect.ADMIN_WORDS), "plausible": collect.plausible(v), "listed": ~h.rlike(NO_ADDRESS_WORDS)})
    titled, hint, plausible = (F.col(c) for c in ("titled", "hint", "plausible"))
    first = 20 + points(h.contains("местоположение"), 4) - points(h.contains("кадастр"), 8) + points(plausible | hint, 8) + points((p["sw"] != "") | (p["ter"] != ""), 6) + points(p["hb"] != "", 10) + points(p["hm"] != "", 4) - points(sanitize.dumped_table(v), 20)
    other = points(titled, 10) + points(plausible, 7) + points(hint, 3)
    formed = F.when(F.col("slot") == "street", renormalized("street", v)).when(F.col("slot") == "house", renormalized("house", v)).otherwise(v)
    entry = settled(entry.select(*ids, "i", "value", "slot", "titled", "listed", first.alias("first"), other.alias("other"), formed.alias("formed")), "entries")
    best = lambda cond, score: F.max(F.when(cond, F.struct(F.col(score).alias("s"), F.length(v).alias("n"), (-F.col("i")).alias("o"), v.alias("v")))).getField("v")
    slot_value = lambda s: F.min(F.when((F.col("slot") == s) & F.col("formed").isNotNull(), F.struct("i", F.col("formed").alias("v")))).getField("v").alias(s)
    picked = entry.groupBy(*ids).agg(best(titled, "first").alias("_a"), best(F.col("listed") & (F.col("other") > 0), "other").alias("_b"), *[slot_value(s) for s in (*PLACES, "street", "house")])
    both = F.col("street").isNotNull() & F.col("house").isNotNull()
    text = F.coalesce(without_tail("_a"), F.when(~both, F.col("_b")))
    behind = lambda a, b: F.concat(F.rtrim(a, F.lit(" ,")), F.lit(", "), b)
    # each parse reads its rows twice, so these are tables too
    picked = settled(picked.withColumn("_t", text).drop("_a", "_b"), "picked")
    picked = A.parsed(picked, "_t").withColumn("_t", F.when((F.col("parsed.sw") == "") & F.col("street").isNotNull(), behind(F.col("_t"), F.col("street"))).otherwise(F.col("_t"))).drop("parsed")
    picked = A.parsed(settled(picked, "picked"), "_t").withColumn("_t", F.when((F.col("parsed.hb") == "") & F.col("house").isNotNull(), behind(F.col("_t"), F.col("house"))).otherwise(F.col("_t"))).drop("parsed")
    lines = F.slice("context", F.greatest(F.lit(1), F.size("context") - CONTEXT_USED + 1), CONTEXT_USED)
    unnamed = [F.when(F.col("_t").isNull() | ~normalized("_t").contains(normalized(s)), F.col(s)) for s in PLACES]
    said = F.when(F.col("_t").isNotNull(), F.array("_t")).when(both, F.array("street", "house"))
    parts = F.concat(lines, F.array_compact(F.array(*unnamed)), said)
    out = picked.join(rows.select(*ids, "context"), ids).select(*ids, F.array_join(_unique(parts), ", ").alias("address"))
    return out.where("address <> ''")
