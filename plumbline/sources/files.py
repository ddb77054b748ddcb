"""Files as rows: discovery, decoding, office documents, registry snapshots."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from xml.etree import ElementTree as E

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("xlsx", "xlsm", "csv", "txt", "md", "docx", "odt")
CELLS = "file string, kind string, sheet string, row_idx int, col_idx int, locator string, value string"


def discovered(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, content, ...: files of the folder and below, without office lock files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.lower(name).rlike(rf"\.({'|'.join(suffixes)})$") & ~name.startswith("~$") & ~name.startswith(".~lock"))


def _table(codec: str) -> tuple[str, str]:
    """The characters of bytes 128 to 255 in Latin-1 and in a Cyrillic code page, where it has them."""
    known = [b for b in range(128, 256) if bytes([b]).decode(codec, "ignore")]
    return "".join(map(chr, known)), bytes(known).decode(codec)


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-16 by its mark or by its NUL bytes, else UTF-8 if valid, else Windows-1251, or code page 866 where a byte is none of it."""
    mark = F.hex(F.substring(content, 1, 2))
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    latin = F.decode(content, "ISO-8859-1")
    nul = F.instr(latin, "\0")
    wide = F.when(nul % 2 == 0, F.decode(content, "UTF-16LE")).otherwise(F.decode(content, "UTF-16BE"))
    cyrillic = F.when(F.instr(latin, "\x98") > 0, F.translate(latin, *_table("cp866"))).otherwise(F.translate(latin, *_table("cp1251")))
    text = F.when(mark.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).when(nul > 0, wide).otherwise(F.coalesce(utf8, cyrillic))
    return F.regexp_replace(text, "^﻿", "")


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _elements(file, name: str):
    """Elements of that name, one after another; each is gone when the next one is read."""
    path = []
    for event, e in E.iterparse(file, events=("start", "end")):
        if event == "start":
            path.append(e)
            continue
        path.pop()
        if _local(e) == name:
            yield e
        elif any(_local(x) == name for x in path):
            continue  # a part of what comes next
        e.clear()
        if path:
            del path[-1][:]


def _workbook(data: bytes, columns: frozenset[int] | None = None):
    """sheet, row, column, value, locator of a workbook's cells; of all columns or those named (from 1).

    Sheets are read cell by cell, so memory holds the file, its shared strings and one cell.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as file:
                shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in _elements(file, "si")]
        parts = {}
        if "xl/_rels/workbook.xml.rels" in names:
            parts = {r.get("Id"): r.get("Target") for r in E.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter() if _local(r) == "Relationship"}
        for n, s in enumerate((s for s in E.fromstring(z.read("xl/workbook.xml")).iter() if _local(s) == "sheet"), 1):
            sheet, own = s.get("name"), next((v for k, v in s.attrib.items() if k.rsplit("}", 1)[-1] == "id"), None)
            target = parts.get(own, f"worksheets/sheet{n}.xml")
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if part not in names:
                raise ValueError(f"sheet {sheet} has no part {part}")
            with z.open(part) as file:
                for c in _elements(file, "c"):
                    letters, row = re.fullmatch(r"([A-Z]+)([0-9]+)", c.get("r")).groups()
                    column = 0
                    for x in letters:
                        column = column * 26 + ord(x) - 64
                    if columns is not None and column not in columns:
                        continue
                    raw = "".join(t.text or "" for t in c.iter() if _local(t) in ("v", "t"))
                    value = shared[int(raw)] if c.get("t") == "s" and raw else raw
                    yield sheet, int(row), column, value, f"{sheet}!{letters}{row}"


def _tables(body, table: str, row: str, cell: str, paragraph: str, repeat: str | None = None):
    """Cells of tables, then paragraphs outside of them."""
    text = lambda e: " ".join("".join(e.itertext()).split())
    inside = set()
    for t, e in enumerate((x for x in body.iter() if _local(x) == table), 1):
        inside.update(id(x) for x in e.iter())
        for r, line in enumerate((x for x in e.iter() if _local(x) == row), 1):
            column, values = 0, []
            for c in (x for x in line if _local(x) == cell):
                times = int(next((v for k, v in c.attrib.items() if repeat and k.endswith(repeat)), 1))
                value = text(c)
                for _ in range(times if value else 1):
                    column += 1
                    if value:
                        values.append(value)
                        yield "cell", f"T{t}", r, column, value, f"T{t}:R{r}:C{column}"
                column += 0 if value else times - 1
            if len(values) > 1:
                yield "row", f"T{t}", r, 0, " | ".join(values), f"T{t}:R{r}"
    for n, e in enumerate((x for x in body.iter() if _local(x) == paragraph and id(x) not in inside), 1):
        if value := text(e):
            yield "paragraph", "", n, 1, value, f"P{n}"


def cells_of_file(path: str, data: bytes, columns: frozenset[int] | None = None):
    """(kind, sheet, row, column, value, locator) of one office file; nothing if it can't be opened. columns (from 1) choose among those of a workbook."""
    kind = path.rsplit(".", 1)[-1].lower()
    try:
        if kind in ("xlsx", "xlsm"):
            for sheet, row, column, value, locator in _workbook(data, columns):
                yield "cell", sheet, row, column, value, locator
        elif kind == "docx":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                yield from _tables(E.fromstring(z.read("word/document.xml")), "tbl", "tr", "tc", "p")
        elif kind == "odt":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                yield from _tables(E.fromstring(z.read("content.xml")), "table", "table-row", "table-cell", "p", "number-columns-repeated")
    except (zipfile.BadZipFile, KeyError, E.ParseError):
        yield "unreadable", "", 0, 0, path, path


#: Cells that leave a task in one batch.
BATCH = 10_000


def office_cells(files: DataFrame, columns: list[int] | None = None) -> DataFrame:
    """Cells, rows and paragraphs of xlsx, docx and odt files; an unreadable file gives a row of that kind.

    columns: those of a workbook that are wanted, from 1; all, if not given. Cells leave a task in
    batches, so a sheet may have any number of rows.
    """
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
    names = [c.split()[0] for c in CELLS.split(", ")]
    wanted = None if columns is None else frozenset(columns)

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = ((path, k, s, r - 1, c - 1, at, v.strip()) for k, s, r, c, v, at in cells_of_file(path, data, wanted) if v.strip())
                while rows := list(itertools.islice(found, BATCH)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, CELLS)


def text_lines(files: DataFrame) -> DataFrame:
    """file, n, line of text files, decoded."""
    return files.select(F.col("path").alias("file"), F.posexplode(F.split(decoded(F.col("content")), "\r?\n")).alias("n", "line")).where(F.btrim("line") != "").withColumn("n", F.col("n") + 1)


def registry_csv(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows of a snapshot: no header, `;`, all text, bad lines dropped."""
    schema = "ter string, kod1 string, kod2 string, kod3 string, chk string, section string, name string, name2 string"
    return spark.read.csv(path, sep=";", schema=schema, mode="DROPMALFORMED", header=False, quote='"')


def latest_snapshot(files: DataFrame) -> DataFrame:
    """path of the snapshot with the latest stamp in its name, then time, then name."""
    stamp = F.regexp_extract("path", r"data-([0-9]{8}T[0-9]{4})", 1)
    return files.agg(F.max(F.struct(stamp.alias("stamp"), "modificationTime", "path")).alias("m")).select("m.path")


def snapshot_problems(content: Column) -> Column:
    """Why a payload can't be a snapshot, or null."""
    head = F.lower(F.decode(F.substring(content, 1, 2000), "ISO-8859-1"))
    return F.when(F.length(content) == 0, "empty").when(head.rlike("^\\s*<(!doctype|html)"), "html").when((F.length(content) < 2000) & ~head.contains(";"), "no_separator")
