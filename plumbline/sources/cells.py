"""Tables and texts as cells and lines, each with its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.scratch import settled


def cells_of(rows: DataFrame, columns: list[str], row: str = "row_idx", keep: list[str] | None = None) -> DataFrame:
    """row_idx, col_idx (from 0), value, locator: one row for each cell that isn't blank."""
    cells = rows.select(*(keep or []), F.col(row).alias("row_idx"), F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("col_idx", "value"))
    cells = cells.withColumn("value", F.btrim("value")).where("value <> ''")
    return cells.withColumn("locator", F.concat(F.lit("R"), F.col("row_idx").cast("string"), F.lit("C"), (F.col("col_idx") + 1).cast("string")))


def lines_of(rows: DataFrame, ids: list[str], text: str) -> DataFrame:
    """ids, n (from 1), line: lines that aren't blank."""
    return rows.select(*ids, F.posexplode(F.split(text, "\n")).alias("n", "line")).where(F.btrim("line") != "").withColumn("n", (F.col("n") + 1).cast("long"))


def delimiter_of(line: Column, comma: bool = False) -> Column:
    """The sign that cuts a line into cells: |, tab or ;, or a comma that is there twice."""
    out = F.when(line.contains("|"), "|").when(line.contains("\t"), "\t").when(line.contains(";"), ";")
    return out.when((F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))) >= 2, ",") if comma else out


def line_cells(lines: DataFrame, ids: list[str], comma: bool = False) -> DataFrame:
    """A row for each line (cell 0) and for each of its cells, with a locator."""
    cut = delimiter_of(F.col("line"), comma)
    parts = F.when(cut.isNull(), F.array()).otherwise(F.filter(F.transform(F.split("line", F.concat(F.lit("\\Q"), cut, F.lit("\\E"))), lambda x: F.btrim(x)), lambda x: x != ""))
    all_ = lines.select(*ids, "n", F.posexplode(F.concat(F.array(F.btrim("line")), parts)).alias("cell", "value"))
    return all_.withColumn("locator", F.when(F.col("cell") == 0, F.concat(F.lit("L"), F.col("n").cast("string"))).otherwise(F.concat(F.lit("L"), F.col("n").cast("string"), F.lit(":C"), F.col("cell").cast("string"))))


def blocks_of(rows: DataFrame, ids: list[str], text: str) -> DataFrame:
    """ids, n, block: pieces between blank lines."""
    return rows.select(*ids, F.posexplode(F.split(text, "\n[ \t]*\n")).alias("n", "block")).where(F.btrim("block") != "")


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """rows with number, from 1 in the order of `by`, without sorting them all in one task."""
    dealt = settled(rows.repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "numbered")
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.groupBy("_part").count().select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row for each partition
    own = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    return dealt.join(F.broadcast(offsets), "_part").withColumn("number", own + F.col("_before")).drop("_part", "_before")


def column_of_sheets(cells: DataFrame, column: int, first_row: DataFrame, part: list[str]) -> DataFrame:
    """part, row_idx, value, locator of one column of every sheet, from the sheet's first data row on. first_row: part, first_row."""
    letters = F.concat(F.lit(chr(65 + column // 26 - 1) if column >= 26 else ""), F.lit(chr(65 + column % 26)))
    own = cells.where((F.col("col_idx") == column) & (F.btrim("value") != "")).join(first_row, part).where("row_idx >= first_row")
    return own.select(*part, "row_idx", F.btrim("value").alias("value"), F.concat(F.col(part[0]).cast("string"), F.lit("!"), letters, (F.col("row_idx") + 1).cast("string")).alias("locator"))
