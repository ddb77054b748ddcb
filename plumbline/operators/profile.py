"""Looking at tables: which column holds what, where headers are, which rows are blank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import normalized
from plumbline.operators.collect import HINTS


def filled(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.btrim(c.cast("string")) != "", F.lit(False))


def content_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, filled, with_digits, with_letters, with_hint, mean_length as shares (4 places), from one pass."""

    def share(cond: Column) -> Column:
        return F.round(F.avg(F.coalesce(cond, F.lit(False)).cast("double")), 4)

    each = []
    for c in columns:
        t = F.col(c).cast("string")
        each.append(F.struct(F.lit(c).alias("column_name"), share(filled(c)).alias("filled"), share(t.rlike("[0-9]")).alias("with_digits"), share(t.rlike("(?iuU)[a-zа-я]")).alias("with_letters"), share(t.rlike(HINTS)).alias("with_hint"), F.round(F.avg(F.length(t).cast("double")), 4).alias("mean_length")))
    return rows.agg(F.array(*each).alias("p")).select(F.inline("p"))


#: Weights of the address column's score, and of a reference column's.
GT_WEIGHTS = {"fill": 140.0, "address": 60.0, "house": 25.0, "street": 20.0, "marker": 15.0, "numeric": -120.0, "length": 0.15, "most": 80.0, "short": -30.0}
REFERENCE_WEIGHTS = {"fill": 120.0, "address": 80.0, "house": 26.0, "street": 20.0, "marker": 16.0, "numeric": -140.0, "length": 0.12, "most": 110.0, "short": -35.0}
GT_BONUS, REFERENCE_BONUS = ((0.98, 0.75, 60.0), (0.90, 0.60, 30.0)), ((0.90, 0.55, 35.0),)
#: Points of headers of a reference column, and headers of its helpers, without blanks.
HEADER_POINTS = {"normalizedaddress": 280.0, "normalizedadress": 280.0, "нормализованныйадрес": 280.0, "эталонныйадрес": 260.0, "адресэталон": 250.0, "referenceaddress": 250.0, "groundtruth": 240.0, "gt": 220.0, "rawaddress": 170.0, "исходныйадрес": 160.0, "адрес": 120.0}
HELPERS = ("postalindex", "индекс", "oktmo", "oktmocode", "oktmoname", "октмо", "кодоктмо", "municipality", "муниципалитет", "locality", "населенныйпункт", "street", "улица", "house", "дом", "matchkey", "ключсопоставления", "sourcecount", "sources", "rawexamples")
HELPER_MALUS, NEAR_MALUS = 180.0, 20.0
#: What headers of address columns hold, by kind.
HEADER_KINDS = (("address", "(?iuU)\\b(?:адрес|местополож|локац)"), ("street", "(?iuU)\\b(?:улиц|переул|проспект|проезд|название\\s+ул)"), ("house", "(?iuU)(?:№|\\bномер)\\s*дома|\\bдом\\b"), ("modifier", "(?iuU)\\b(?:корпус|литера?|строение|владение)\\b"))


def column_scores(cells: DataFrame, n_rows: Column, weights: dict[str, float] = GT_WEIGHTS, bonus: tuple = GT_BONUS, with_territory: bool = False) -> DataFrame:
    """col_idx, fill, address, house, street, marker, numeric, mean_length, score of each column of cells (col_idx, value).

    All values count; each different one is parsed once. n_rows: a literal, the rows of the sheet.
    """
    from plumbline.functions.address import parsed

    v = parsed(cells.where(filled("value")).select("col_idx", F.btrim(F.col("value").cast("string")).alias("value")), "value")
    share = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("double"))
    sw, hb = F.col("parsed.sw") != "", F.col("parsed.hb") != ""
    some = sw | hb | (F.col("parsed.ter") != "") if with_territory else sw | hb
    m = v.groupBy("col_idx").agg((F.count("*") / F.max(n_rows)).alias("fill"), share(some).alias("address"), share(hb).alias("house"), share(sw).alias("street"), share(F.col("value").rlike(HINTS)).alias("marker"), share(F.col("value").rlike(r"^\d+\.?\d*$")).alias("numeric"), F.avg(F.length("value")).alias("mean_length"))
    score = F.least(F.col("mean_length"), F.lit(weights["most"])) * weights["length"] + F.when(F.col("mean_length") < 8, weights["short"]).otherwise(0.0)
    for k in ("fill", "address", "house", "street", "marker", "numeric"):
        score = score + F.col(k) * weights[k]
    more = F.lit(0.0)
    for least_fill, least_address, points in reversed(bonus):
        more = F.when((F.col("fill") >= least_fill) & (F.col("address") >= least_address), points).otherwise(more)
    return m.withColumn("score", score + more)


def best_address_column(rows: DataFrame, columns: list[str]) -> str:
    """The column whose content looks most like addresses, the first of equals."""
    cells = rows.select(F.posexplode(F.array(*[F.col(f"`{c}`").cast("string") for c in columns])).alias("col_idx", "value"))
    best = column_scores(cells, F.lit(max(1, rows.count()))).orderBy(F.desc("score"), "col_idx").first()
    return columns[best.col_idx if best else 0]


def header_points(value: Column) -> Column:
    """How much a header says that its column is a reference's addresses."""
    key = F.regexp_replace(normalized(value), " ", "")
    exact, near = F.lit(0.0), F.lit(0.0)
    for word, points in HEADER_POINTS.items():
        exact = F.when(key == word, points).otherwise(exact)
        if word != "адрес":
            near = F.greatest(near, F.when(key.contains(word) | F.lit(word).contains(key), points - NEAR_MALUS).otherwise(0.0))
    helper = F.lit(False)
    for word in HELPERS:
        helper = helper | (key == word) | (key.contains(word) if len(word) > 4 else F.lit(False))
    return F.when(key == "", 0.0).otherwise(F.when(exact > 0, exact).otherwise(near) - F.when(helper, HELPER_MALUS).otherwise(0.0))


def reference_column(cells: DataFrame, n_rows: int, most_rows: int = 12) -> DataFrame:
    """col_idx, first_row, score of each column of a sheet's cells (row_idx from 0, col_idx, value): its header, its content, its place; the best first."""
    points = cells.where(F.col("row_idx") < most_rows).select("col_idx", "row_idx", header_points(F.col("value")).alias("points")).where("points > 0")
    head = points.groupBy("col_idx").agg(F.max("points").alias("points"), F.max_by("row_idx", F.struct("points", F.negative("row_idx"))).alias("head"))
    data = cells.join(F.broadcast(head), "col_idx", "left").where("head is null or row_idx > head")  # a row a column
    rows_below = data.select("col_idx", "value", (F.lit(n_rows) - 1 - F.coalesce("head", F.lit(-1))).alias("below"))
    found = column_scores(rows_below.select("col_idx", "value"), F.lit(1), REFERENCE_WEIGHTS, (), True)
    below = rows_below.groupBy("col_idx").agg(F.max("below").alias("below"))
    both = found.join(below, "col_idx").join(head, "col_idx", "left")
    fill = F.col("fill") / F.greatest(F.col("below"), F.lit(1))
    (least_fill, least_address, more), = REFERENCE_BONUS
    value = F.col("score") + (fill - F.col("fill")) * REFERENCE_WEIGHTS["fill"] + F.when((fill >= least_fill) & (F.col("address") >= least_address), more).otherwise(0.0)
    place = F.greatest(F.lit(0.0), F.lit(8.0) - F.col("col_idx") * 0.75)
    return both.select("col_idx", (F.coalesce("head", F.lit(-1)) + 1).alias("first_row"), (value + F.coalesce("points", F.lit(0.0)) + place).alias("score")).orderBy(F.desc("score"), "col_idx")


def address_columns(cells: DataFrame, start_row: int) -> DataFrame:
    """col_idx, kind of the columns whose headers above start_row name an address or its parts; of several whole addresses the first, if no part is there."""
    head = cells.where((F.col("row_idx") < start_row) & filled("value")).groupBy("col_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", F.btrim("value").alias("v")))), lambda x: x["v"]), " ").alias("h"))
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(HEADER_KINDS):
        kind = F.when(F.col("h").rlike(pattern), name).otherwise(kind)
    found = head.select("col_idx", kind.alias("kind")).where("kind is not null")
    parts = found.agg(F.bool_or(F.col("kind") != "address").alias("parts"), F.min(F.when(F.col("kind") == "address", F.col("col_idx"))).alias("first"))
    return found.join(F.broadcast(parts), F.lit(True)).where("parts or col_idx = first").select("col_idx", "kind").orderBy("col_idx")


def match_inputs(rows: DataFrame, columns: list[str], mode: str = "columns") -> DataFrame:
    """row_idx, pool, value: the columns as they are, each its own pool, or with mode `document` all of their cells in one."""
    cells = rows.select("row_idx", F.inline(F.array(*[F.struct(F.lit(c if mode == "columns" else "document").alias("pool"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])))
    return cells.where(filled("value"))


def companion_columns(rows: DataFrame, columns: list[str], targets: list[str], mode: str = "auto", least: float = 0.05) -> dict[str, list[str]]:
    """For each target the columns that travel with it: none, those left of it, right of it, or between it and the next.

    auto takes the side that is filled more, if the difference is over `least`.
    """
    at = [columns.index(t) for t in targets]
    shares = rows.agg(*[F.avg(filled(c).cast("double")).alias(c) for c in columns]).first().asDict()
    out: dict[str, list[str]] = {}
    for n, i in enumerate(at):
        left = columns[(at[n - 1] + 1 if n else max(0, i - 1)) : i]
        right = columns[i + 1 : at[n + 1] if n + 1 < len(at) else len(columns)]
        mean = lambda xs: sum(shares[x] or 0 for x in xs) / len(xs) if xs else 0.0
        side = {"none": [], "left": left, "right": right, "between": left[-1:]}.get(mode)
        out[targets[n]] = side if side is not None else (left if mean(left) > mean(right) + least else right if mean(right) > mean(left) + least else [])
    return out


def without_blank_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.where(F.exists(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), lambda x: F.btrim(x) != ""))


def header_row(cells: DataFrame, words: dict[str, int], part: list[str], most_rows: int = 35, least: int = 4) -> DataFrame:
    """part, row_idx, score: the row among the first ones whose cells score highest as headers, the first of equals."""
    text = normalized("value")
    score = F.lit(0)
    for word, points in words.items():
        score = score + F.when(text.contains(word), points).otherwise(0)
    rows = cells.where(F.col("row_idx") < most_rows).groupBy(*part, "row_idx").agg(F.sum(score).alias("score"))
    best = rows.where(F.col("score") >= least).groupBy(*part).agg(F.max_by("row_idx", F.struct("score", F.negative("row_idx"))).alias("row_idx"), F.max("score").alias("score"))
    return best


def find_header(cells: DataFrame, token: str, part: list[str], most_rows: int = 20) -> DataFrame:
    """part, row_idx, col_idx of the first cell that equals, holds or is held by the token."""
    v, t = normalized("value"), normalized(F.lit(token))
    hit = cells.where((F.col("row_idx") < most_rows) & (v != "") & (v.contains(t) | t.contains(v)))
    return hit.groupBy(*part).agg(F.min(F.struct("row_idx", "col_idx")).alias("m")).select(*part, "m.*")


def flat_headers(cells: DataFrame, start_row: int, prefix: str, part: list[str]) -> DataFrame:
    """part, col_idx, header: `A: top / sub` from the rows above the data, `A: Колонка n` without any."""
    above = F.collect_list(F.when((F.col("row_idx") < start_row) & filled("value"), F.struct("row_idx", F.btrim("value").alias("v"))))
    joined = F.array_join(F.array_distinct(F.transform(F.array_sort(above), lambda x: x["v"])), " / ")
    head = cells.groupBy(*part, "col_idx").agg(joined.alias("h"))
    return head.select(*part, "col_idx", F.concat(F.lit(f"{prefix}: "), F.when(F.col("h") != "", F.col("h")).otherwise(F.concat(F.lit("Колонка "), (F.col("col_idx") + 1).cast("string")))).alias("header"))


def merged_headers(cells: DataFrame, first: int, rows: int, part: list[str]) -> DataFrame:
    """part, col_idx, header: several header rows as one; gaps of merged cells are filled from the left."""
    left = Window.partitionBy(*part, "row_idx").orderBy("col_idx").rowsBetween(Window.unboundedPreceding, 0)
    head = cells.where(F.col("row_idx").between(first, first + rows - 1))
    spread = head.withColumn("v", F.when(F.col("row_idx") < first + rows - 1, F.last(F.when(filled("value"), F.btrim("value")), ignorenulls=True).over(left)).otherwise(F.when(filled("value"), F.btrim("value"))))
    text = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("row_idx", "v")))), lambda x: x["v"])), " ")
    named = spread.groupBy(*part, "col_idx").agg(text.alias("h")).withColumn("header", F.when(F.col("h") != "", F.col("h")).otherwise(F.concat(F.lit("column_"), (F.col("col_idx") + 1).cast("string")))).drop("h")
    n = F.row_number().over(Window.partitionBy(*part, "header").orderBy("col_idx"))
    return named.withColumn("_n", n).select(*part, "col_idx", F.when(F.col("_n") == 1, F.col("header")).otherwise(F.concat("header", F.lit("_"), F.col("_n").cast("string"))).alias("header"))


def column_numbers(spec: str, width: int) -> list[int]:
    """Columns of `B, C, 4, D:F` as numbers from 1, in order, each once, in range; `*` is all."""
    if spec.strip().lower() in ("*", "all"):
        return list(range(1, width + 1))

    def number(token: str) -> int:
        token = token.strip().upper()
        n = int(token) if token.isdigit() else sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(token)))
        if not 1 <= n <= width:
            raise ValueError(f"no column {token}")
        return n

    out: list[int] = []
    for token in filter(None, (t.strip() for t in spec.replace(";", ",").split(","))):
        a, _, b = token.partition(":")
        for n in range(number(a), number(b or a) + 1):
            if n not in out:
                out.append(n)
    return out
