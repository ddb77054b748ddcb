"""More queries over the given tables: rules of rows, and jobs on tables made from them.

Rules are asked on texts of known kinds, which are dealt to customers by their keys; a text holds a
number that depends on the key. Both what is asked and what must come out are written down here by
kind, so the SQL doesn't know how a rule works.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import address as A
from plumbline.functions import slots as S
from plumbline.functions import text as T
from plumbline.operators import assembly, collect, matching, observations, profile, reference, registry, sanitize
from plumbline.queries import LOW, STREETS, _duck, _street, _with, query, table, view
from plumbline.sources import cells as C
from plumbline.sources import regions
from plumbline.sources.scratch import settled, spread


def _case(kinds: list[tuple], at: int, key: str = "c_custkey") -> str:
    """SQL for both engines: field `at` of the kind that a key has; {n} stands for a number from 1 to 90."""
    whens = []
    for i, kind in enumerate(kinds):
        value = kind[at]
        if value is None:
            text = "CAST(NULL AS STRING)"
        else:
            text = "'" + value.replace("'", "''") + "'"
            text = f"replace({text}, '{{n}}', concat('', 1 + {key} % 90))" if "{n}" in value else text
        whens.append(f"WHEN {i} THEN {text}")
    return f"CASE {key} % {len(kinds)} " + " ".join(whens) + " END"


def dealt(spark: SparkSession, sf_dir: str, kinds: list[tuple], names: list[str]) -> DataFrame:
    """row_idx and the named fields, the first of each kind, a row for each customer."""
    keys = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return keys.selectExpr("c_custkey AS row_idx", *[f"{_case(kinds, i)} AS {n}" for i, n in enumerate(names)])


def expected(kinds: list[tuple], outs: dict[str, int]) -> str:
    return ("SELECT c_custkey AS row_idx, " + ", ".join(f"{_case(kinds, i)} AS {n}" for n, i in outs.items()) + " FROM customer").replace("AS STRING", "AS VARCHAR")


# --- why a row is dropped, and what is wrong with it

_ROW = ["address", "street", "territory", "microdistrict", "house", "municipality", "locality", "raw", "sources", "scope_code", "code"]


def _kind(address, street=None, house=None, reason=None, issues="", **more):
    return (*(more.get(n) if n not in ("address", "street", "house") else {"address": address, "street": street, "house": house}[n] for n in _ROW), reason, issues)


_DROPS = [
    _kind(None, reason="empty_address", issues="empty_address"),
    _kind("ул. Ленина, д. {n}", "ул. Ленина", "д. {n}"),
    _kind("ул. Ленина" + ", ул. Ленина" * 60 + ", д. {n}", "ул. Ленина", "д. {n}", "address_too_long", "address_too_long"),
    _kind("ул. Ленина, д. {n}", "ул. Ленина", "д. {n}", "contaminated_table_dump", raw="ул. Ленина, д. {n} | Кадастровый номер | 12"),
    _kind("Тюменская область", reason="subject_only_address", issues="subject_only_address,too_general_location,no_house"),
    _kind("городской округ город Ишим", reason="too_general_location", issues="too_general_location,no_house"),
    _kind("ул. Ленина", "ул. Ленина", reason="street_without_house", issues="street_without_house"),
    _kind("мкр. 3", microdistrict="мкр. 3", reason="street_without_house", issues="street_without_house"),
    _kind("просто слова", reason="no_house", issues="no_house"),
    _kind("ул. Ленина, д. 0", "ул. Ленина", "д. 0", "invalid_house_number", "invalid_house_number"),
    _kind("д. {n}", house="д. {n}", reason="house_without_street_or_territory", issues="house_without_street_or_territory"),
    _kind("ул. Мира, д. {n}", "ул. Мира", "д. {n}", "oktmo_scope_conflict", scope_code="71701000001", code="71701999001"),
    _kind("ул. Мира, д. {n}", "ул. Мира", "д. {n}", scope_code="71701000001", code="71701000777"),
    _kind("ул. Мира, д. {n}", "ул. Мира", "д. {n}", "route_source_fragment", raw="школа ул. Мира, д. {n}", sources="маршрут 7.xlsx"),
    _kind("школа, ул. Мира, д. {n}", "ул. Мира", "д. {n}", "object_name_in_address", "object_name_in_address"),
    _kind("маршрут 5, ул. Мира, д. {n}", "ул. Мира", "д. {n}", "route_fragment_in_address", "route_fragment_in_address"),
    _kind("ул. Мира, д. {n}", "ул. Мира", "д. {n}", "invalid_municipality_slot", municipality="Тюмень"),
    _kind("ул. Мира, д. {n}", "ул. Мира", "д. {n}", municipality="Тюменский район", locality="п. Речной"),
    _kind("ул. Мира, д. {n}", "ул. Мира", "д. {n}", "invalid_locality_slot", locality="Речной"),
    _kind("ул. Мира, д. {n}", "ул. Мира", "д. {n}", "object_name_in_territory_slot", territory="лицей 2"),
    _kind("ул. Мира, д. {n}", "ул. Мира", "д. {n}", "unbalanced_microdistrict_slot", microdistrict="мкр. (3"),
    _kind("очень длинное имя из многих слов, д. {n}", "очень длинное имя из многих слов", "д. {n}", "invalid_street_slot"),
    _kind("ул. Мира, корпус {n}", "ул. Мира", "корпус {n}", "invalid_house_slot"),
    _kind("ул. Мира, д. {n} (во дворе", "ул. Мира", "д. {n}", "unbalanced_address_fragment", "unbalanced_address_fragment"),
    _kind("Садовая, д. {n}А, к. 2", "Садовая", "д. {n}А, к. 2"),
]


def _drop_row(df: DataFrame) -> dict:
    return {n: F.col(n) for n in _ROW} | {"scope_valid": F.col("scope_code").isNotNull()}


@query(expected(_DROPS, {"reason": len(_ROW)}))
def drop_reasons(spark, sf_dir):
    rows = dealt(spark, sf_dir, _DROPS, _ROW)
    return rows.select("row_idx", sanitize.drop_reason(_drop_row(rows)).alias("reason"))


@query(expected(_DROPS, {"issues": len(_ROW) + 1}))
def issues_of_rows(spark, sf_dir):
    rows = dealt(spark, sf_dir, _DROPS, _ROW)
    return rows.select("row_idx", F.array_join(sanitize.issue_codes(_drop_row(rows)), ",").alias("issues"))


_ISSUES = f"(SELECT c_custkey AS row_idx, trim({_case(_DROPS, 0)}) AS address, {_case(_DROPS, len(_ROW) + 1)} AS issues FROM customer)".replace("AS STRING", "AS VARCHAR")


@query(
    f"""WITH e AS (SELECT row_idx, address, unnest(CASE WHEN issues = '' THEN ['clean'] ELSE string_split(issues, ',') END) AS issue FROM {_ISSUES}),
r AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY row_idx) AS n FROM e WHERE issue <> 'clean' AND coalesce(address, '') <> '')
SELECT e.issue, count(*) AS n_rows, any_value(s.samples) AS samples FROM e LEFT JOIN (SELECT issue, string_agg(address, ' | ' ORDER BY n) AS samples FROM r WHERE n <= 5 GROUP BY issue) s ON e.issue = s.issue GROUP BY e.issue"""
)
def issue_samples(spark, sf_dir):
    rows = dealt(spark, sf_dir, _DROPS, _ROW)
    return sanitize.issue_samples(rows.withColumn("issues", sanitize.issue_codes(_drop_row(rows))), "address")


# --- predicates: yes and no as one letter each

_PREDICATES = [
    ("Тюменский муниципальный район", "10000000"),
    ("город Тюмень", "11010000"),
    ("п. Речной-{n}", "01010000"),
    ("ул. Ленина", "00110000"),
    ("Московский тракт", "00110000"),
    ("Садовая {n}", "00010000"),
    ("д. {n}А, к. 2", "00010001"),
    ("школа {n}", "00000100"),
    ("маршрут {n}", "00000010"),
    ("Тюменская область", "00000000"),
    ("мкр. {n}", "00010000"),
]


@query(expected(_PREDICATES, {"flags": 1}))
def slot_predicates(spark, sf_dir):
    """Municipality, locality, street with its word, plain street, nothing, organisation, route, house."""
    rows = dealt(spark, sf_dir, _PREDICATES, ["v"])
    v = F.col("v")
    flags = [sanitize.ideal_municipality(v), sanitize.ideal_locality(v), sanitize.explicit_street(v), sanitize.plain_street(v), F.lit(False), sanitize.names_organisation(v), sanitize.route_fragment(v), sanitize.ideal_house(v)]
    return rows.select("row_idx", F.concat(*[F.coalesce(f, F.lit(False)).cast("int").cast("string") for f in flags]).alias("flags"))


# --- texts

_TEXTS = [
    # value, level key, named words, region key, postal index, without tail, locator row
    ("город Тюмень", "тюмень", "город тюмень", "тюмень", None, "город Тюмень", None),
    ("Тюменской области", "тюменской области", "области тюменской", "тюменская", None, "Тюменской области", None),
    ("Пермского края", "пермского края", "края пермского", "пермский", None, "Пермского края", None),
    ("625000, ул. Мира, {n}", "625000 ул мира {n}", None, "625000 ул мира {n}", "625000", "625000, ул. Мира, {n}", None),
    ("ул. Мира, {n}, тел. 12-34", "ул мира {n} тел 12 34", None, "ул мира {n} тел 12 34", None, "ул. Мира, {n}", None),
    ("ул. Мира a@b.ru", "ул мира a b ru", "mail", "ул мира a b ru", None, "ул. Мира", None),
    ("Лист!B{n}", "лист b{n}", None, "лист b{n}", None, "Лист!B{n}", "{n}"),
    ("L{n}:C2", "l{n} c2", None, "l{n} c2", None, "L{n}:C2", "{n}"),
    ("село Ёлкино", "елкино", "елкино село", "село елкино", None, "село Ёлкино", None),
    ("«Заря»  и  К", "заря и к", "заря", "заря и к", None, "«Заря» и К", None),
]


@query(expected(_TEXTS, {"level": 1, "region": 3, "postal": 4, "no_tail": 5, "locator": 6}))
def text_keys(spark, sf_dir):
    rows = dealt(spark, sf_dir, _TEXTS, ["v"])
    return rows.select("row_idx", T.level_key("v").alias("level"), T.region_key("v").alias("region"), T.postal_index("v").alias("postal"), T.without_tail("v").alias("no_tail"), T.locator_row("v").cast("string").alias("locator"))


_NAMED = [t for t in _TEXTS if t[2] and t[2] != "mail"]


@query(expected(_NAMED, {"words": 2}))
def named_words(spark, sf_dir):
    return dealt(spark, sf_dir, _NAMED, ["v"]).select("row_idx", T.named_words("v").alias("words"))


_SQL_LETTERS = "SELECT c_custkey AS row_idx, 1 + c_custkey % 700 AS number FROM customer"


@query(_SQL_LETTERS)
def sheet_letters(spark, sf_dir):
    """Columns of a sheet by their letters, back to numbers."""
    n = F.col("c_custkey") % 700
    letters = F.concat(F.when(n >= 26, F.char((F.floor(n / 26) + 64).cast("int"))).otherwise(""), F.char((n % 26 + 65).cast("int")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_idx"), T.column_index(letters).cast("long").alias("number"))


# --- addresses of many shapes

_SHAPES = [
    # raw, territory, street words, street numbers, house, modifiers
    ("г. Тюмень, ул. Ленина, д. {n}", "", "ленина", "", "{n}", ""),
    ("г. Тюмень, ул. Ленина, д. {n}А", "", "ленина", "", "{n}", "а"),
    ("г. Тюмень, ул. 9 Мая, д. {n}", "", "мая", "9", "{n}", ""),
    ("{n}, ул. Садовая", "", "садовая", "", "{n}", ""),
    ("п. Речной, ул. Мира, {n}", "речной", "мира", "", "{n}", ""),
    ("снт Заря, ул. Лесная, д. {n}", "заря", "лесная", "", "{n}", ""),
    ("625000, г. Тюмень, ул. Мира, д. {n} корп. 2 стр. 3", "", "мира", "", "{n}", "к2с3"),
    ("г. Тюмень, ул. Мира, {n}/2", "", "мира", "", "{n}", "к2"),
    ("г. Тюмень, ул. Мира, д. {n}, кв. 7", "", "мира", "", "{n}", ""),
    ("г. Тюмень, ул. Мира, д. {n} лит. Б", "", "мира", "", "{n}", "литб"),
    ("г. Тюмень, пер. 2-й Тихий, д. {n}", "", "тихий", "2", "{n}", ""),
    ("с. Каменка, пер. Тихий, дом {n}", "каменка", "тихий", "", "{n}", ""),
    ("г. Тюмень, ул. Совесткая, {n}", "", "советская", "", "{n}", ""),
    ("дачный поселок Дубки, ул. Мира, д. {n}", "дубки", "мира", "", "{n}", ""),
    ("заимка Лесная, ул. Мира, д. {n}", "лесная", "мира", "", "{n}", ""),
    ("ст-ца Новая, ул. Мира, д. {n}", "новая", "мира", "", "{n}", ""),
    ("ж/д платформа Озерная, ул. Мира, д. {n}", "озерная", "мира", "", "{n}", ""),
]


@query(expected(_SHAPES, {"ter": 1, "sw": 2, "sn": 3, "hb": 4, "hm": 5}))
def parse_many_shapes(spark, sf_dir):
    p = A.parsed(dealt(spark, sf_dir, _SHAPES, ["raw"]), "raw", "тюмень")
    return p.select("row_idx", "parsed.ter", "parsed.sw", F.array_join("parsed.sn", " ").alias("sn"), "parsed.hb", "parsed.hm")


_CARDS = [
    # raw, subject, municipality, locality, street, house, premise, line
    ("Тюменская область, Тюменский район, п. Речной, улица Мира, дом {n}", "Тюменская область", "Тюменский район", "п. Речной", "ул. Мира", "д. {n}", None, "Тюменский район, п. Речной, ул. Мира, д. {n}"),
    ("город Тюмень, проспект Победы, д. {n} корп. 2", None, None, "г. Тюмень", "пр-кт Победы", "д. {n}, к. 2", None, "г. Тюмень, пр-кт Победы, д. {n}, к. 2"),
    ("с. Каменка, пер. Тихий, д. {n}, кв. 5", None, None, "с. Каменка", "пер. Тихий", "д. {n}", "кв. 5", "с. Каменка, пер. Тихий, д. {n}, кв. 5"),
    ("г. Тюмень, ул.Ленина, д. {n}Б", None, None, "г. Тюмень", "ул. Ленина", "д. {n}Б", None, "г. Тюмень, ул. Ленина, д. {n}Б"),
]


@query(expected(_CARDS, {"subject": 1, "municipality": 2, "locality": 3, "street": 4, "house": 5, "premise": 6, "line": 7}))
def address_cards(spark, sf_dir):
    s = S.with_slots(dealt(spark, sf_dir, _CARDS, ["raw"]), "raw", "тюмень")
    return s.select("row_idx", *[F.col(f"slots.{c}").alias(c) for c in ("subject", "municipality", "locality", "street", "house", "premise")], S.line_of(F.col("slots")).alias("line"))


@query(expected(_CARDS, {"locality": 3, "street": 4, "house": 5}))
def deconstructed_addresses(spark, sf_dir):
    """Slot columns in place of the address column."""
    wide = S.deconstructed(dealt(spark, sf_dir, _CARDS, ["raw"]), "raw", ["house", "street"], keep_source=False)
    return wide.select("row_idx", "locality", "street", "house")


_GUARDS = [
    # raw, output, kept
    ("г. Тюмень, улица Ленина, дом {n}", "г. Тюмень, ул. Ленина, д. {n}", "false"),
    ("улица Ленина", "улица Ленина", "true"),
    ("какие-то слова", "какие-то слова", "true"),
]


@query(expected(_GUARDS, {"output": 1, "kept": 2}))
def guarded_normalization(spark, sf_dir):
    g = S.guarded(dealt(spark, sf_dir, _GUARDS, ["raw"]), "raw", "тюмень")
    return g.select("row_idx", "output", F.col("kept_original").cast("string").alias("kept"))


_PLACES = [
    # official name, display, other spelling, display if it is the same
    ("город Тюмень", "г. Тюмень", "г Тюмень", "город Тюмень"),
    ("село Каменка", "с. Каменка", "д. Каменка", "село Каменка"),
    ("посёлок городского типа Боровский", "пгт Боровский", "п. Речной", None),
    ("рп Винзили", "р. п. Винзили", "р. п. Винзили", "рп Винзили"),
    ("хутор Дальний", "х. Дальний", "станица Ближняя", None),
    ("Тюменский район", None, "Тюменский район", "Тюменский район"),
]


@query(expected(_PLACES, {"display": 1, "same": 3}))
def official_localities(spark, sf_dir):
    rows = dealt(spark, sf_dir, _PLACES, ["name", "_", "other"])
    return rows.select("row_idx", S.official_locality(F.col("name")).alias("display"), S.official_if_same(F.col("other"), F.col("name")).alias("same"))


_SPELLED = [
    # street, house, municipality, microdistrict; the same as votes compare them
    ("улица Мира", "дом {n}", "Тюменский р-н", "микрорайон 3", "ул. Мира", "д. {n}", "Тюменский район", "мкр. 3"),
    ("проезд Южный", "{n}а", "г.о. Ишим", "мкр 3", "пр-д Южный", "д. {n}А", "городской округ Ишим", "мкр. 3"),
    ("пр. Геологов", "д. {n} корпус 2", "Ишимский район", "квартал 5", "пр-д Геологов", "д. {n}, к. 2", "Ишимский район", "квартал 5"),
]


@query(expected(_SPELLED, {"street": 4, "house": 5, "municipality": 6, "microdistrict": 7}))
def renormalized_slots(spark, sf_dir):
    names = ["street", "house", "municipality", "microdistrict"]
    rows = dealt(spark, sf_dir, _SPELLED, names)
    return rows.select("row_idx", *[S.renormalized(n, F.col(n)).alias(n) for n in names])


_HEADERS = [("Улица, название", "street"), ("Номер дома", "house"), ("Почтовый индекс", "postal_index"), ("Населенный пункт", "locality"), ("Муниципальное образование", "municipality"), ("Субъект РФ", "subject"), ("Адрес объекта", "address"), ("Площадь", None), ("Код ОКТМО", "oktmo_code")]


@query(expected(_HEADERS, {"slot": 1}))
def header_slots(spark, sf_dir):
    return dealt(spark, sf_dir, _HEADERS, ["header"]).select("row_idx", S.header_slot(F.col("header")).alias("slot"))


_REGIONS = [("Тюменской области", "Тюменская область", "Уральский федеральный округ"), ("Пермский край", "Пермский край", "Приволжский федеральный округ"), ("г. Москва", "Москва", "Центральный федеральный округ"), ("Республика Коми", "Республика Коми", "Северо-Западный федеральный округ"), ("Неведомая область", None, None)]


@query(expected(_REGIONS, {"region": 1, "district": 2}))
def regions_of_rows(spark, sf_dir):
    """Regions by name, and their federal districts."""
    rows, known = dealt(spark, sf_dir, _REGIONS, ["name"]), regions.default_regions(spark)
    met = registry.match_regions(rows, known).select("name", "region_id").join(known.withColumnRenamed("name", "region"), "region_id")
    return rows.join(met, "name", "left").select("row_idx", "region", F.col("federal_district").alias("district"))


_PIECES = [
    # text, fragments
    ("школа 5, ул. Мира, д. {n}; улица Садовая, дом 7", "ул. Мира, д. {n} | ул. Садовая, д. 7"),
    ("ост. ул. 2-я Тихая, {n}", "ул. 2-я Тихая, д. {n}"),
    ("Московский тракт, {n}, корп. 2", "Московский тракт, д. {n}, к. 2"),
    ("просто текст {n}", ""),
    ("ул. Мира {n}, ул. Мира {n}", "ул. Мира, д. {n}"),
]


@query(expected(_PIECES, {"fragments": 1}))
def address_fragments(spark, sf_dir):
    return dealt(spark, sf_dir, _PIECES, ["v"]).select("row_idx", F.array_join(sanitize.address_fragments(F.col("v")), " | ").alias("fragments"))


# --- tables

_QUALITY = f"""SELECT row_idx, (35.0 * (hb <> '')::INT + 25.0 * (sw <> '')::INT + 14.0 * (row_idx % 2 = 0)::INT + least(length(address), 140) * 0.05 + 0.8 * (row_idx % 5)
  + CASE row_idx % 3 WHEN 0 THEN 18.0 WHEN 1 THEN 6.0 ELSE 0.0 END + 2.0)::DOUBLE AS quality FROM ({_duck('addr_a')})"""


def _scored(spark, sf_dir):
    a = view(spark, sf_dir, "addr_a").withColumns({"code": F.when(F.col("row_idx") % 2 == 0, "71701"), "kind": F.expr("CASE row_idx % 3 WHEN 0 THEN 'existing_reference' WHEN 1 THEN 'address_cell' ELSE 'line' END"), "filled": (F.col("row_idx") % 5).cast("double")})
    row = {"address": F.col("address"), "street": F.col("sw"), "house_base": F.col("hb"), "code": F.col("code"), "normalized": F.col("address"), "raw": F.col("address")}
    return a.withColumn("quality", sanitize.quality(row, F.col("filled"), F.col("kind")))


@query(_QUALITY)
def candidate_quality(spark, sf_dir):
    return _scored(spark, sf_dir).select("row_idx", "quality")


@query(
    f"""WITH a AS (SELECT v.*, q.quality FROM ({_duck('addr_a')}) v JOIN ({_QUALITY}) q USING (row_idx)),
l AS (SELECT hb, 'street' AS slot, sw AS value, quality FROM a UNION ALL SELECT hb, 'house', CASE WHEN hm = '' THEN NULL ELSE concat(hb, ' ', hm) END, quality FROM a),
v AS (SELECT hb, slot, value, count(*) AS n, max(quality) AS q FROM l WHERE value IS NOT NULL GROUP BY ALL),
t AS (SELECT hb, slot, value FROM (SELECT *, row_number() OVER (PARTITION BY hb, slot ORDER BY n DESC, q DESC, length(value) DESC, value DESC) AS r FROM v) WHERE r = 1),
e AS (SELECT hb, address, min(row_idx) AS first FROM a GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY hb ORDER BY first, address) AS n FROM e),
x AS (SELECT hb, string_agg(address, ' | ' ORDER BY n) AS examples FROM r WHERE n <= 5 GROUP BY hb)
SELECT g.hb, g.candidate_count, g.best_score, x.examples, s.value AS street, h.value AS house FROM (SELECT hb, count(*) AS candidate_count, round(max(quality), 3) AS best_score FROM a GROUP BY hb) g
JOIN x USING (hb) LEFT JOIN t s ON s.hb = g.hb AND s.slot = 'street' LEFT JOIN t h ON h.hb = g.hb AND h.slot = 'house'"""
)
def merged_groups(spark, sf_dir):
    """Candidates of one house number as one row: slots by vote, the best score, examples."""
    a = _scored(spark, sf_dir).withColumns({"street": F.col("sw"), "house": F.when(F.col("hm") != "", F.concat_ws(" ", "hb", "hm"))})
    return sanitize.merged_groups(a, "hb", ["street", "house"], "quality", "address", "row_idx").select("hb", "candidate_count", "best_score", "examples", "street", "house")


@query("SELECT o_orderkey, max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) = 1 AS staged FROM orders")
def duplicate_guard(spark, sf_dir):
    """Orders whose customer has one of a kind that is there already."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "P", "existing_reference").otherwise("new").alias("kind"))
    return collect.duplicate_guard(o, "o_custkey", "kind").select("o_orderkey", "staged")


@query(
    """WITH c AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, v) AS k, count(*) OVER (PARTITION BY o_custkey) AS kinds FROM c)
SELECT o_custkey, concat(string_agg(concat(v, ' [', n, ']'), ' | ' ORDER BY k) FILTER (WHERE k <= 2), CASE WHEN max(kinds) > 2 THEN concat(' | +', max(kinds) - 2) ELSE '' END) AS summary FROM r GROUP BY o_custkey"""
)
def vote_summary(spark, sf_dir):
    return collect.vote_summary(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", 2)


@query("SELECT min(o_orderkey) AS o_orderkey, o_custkey, o_orderpriority FROM orders GROUP BY o_custkey, o_orderpriority")
def dedupe_with_satellites(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return collect.dedupe_with_satellites(o, "o_custkey", ["o_orderpriority"], "o_orderkey")


@query("SELECT event_type AS role, value >= 50 AS valid, count(*) AS n FROM events GROUP BY ALL")
def scope_match_summary(spark, sf_dir):
    return collect.scope_summary(table(spark, sf_dir, "events").select(F.col("event_type").alias("role"), (F.col("value") >= 50).alias("valid")))


@query("SELECT min(p_partkey) AS p_partkey FROM part WHERE p_size > 25 GROUP BY lower(p_name)")
def conflict_rows(spark, sf_dir):
    """Rejected rows of one reason, the first of each text."""
    p = table(spark, sf_dir, "part").withColumn("reason", F.when(F.col("p_size") > 25, "scope_conflict").otherwise("other"))
    return collect.conflict_rows(p, "p_name", "reason", "p_partkey").select("p_partkey")


@query(
    """WITH s AS (SELECT 'b' AS stream, s_name AS v, s_suppkey AS k, 1 AS o FROM supplier UNION ALL SELECT 'a', replace(c_name, 'Customer', 'Supplier'), c_custkey, 0 FROM customer)
SELECT stream, v, k FROM (SELECT *, row_number() OVER (PARTITION BY lower(v) ORDER BY o, k) AS n FROM s) WHERE n = 1"""
)
def candidate_streams(spark, sf_dir):
    """Candidates of two streams, each text from the first that has it."""
    a = table(spark, sf_dir, "customer").select(F.regexp_replace("c_name", "Customer", "Supplier").alias("v"), F.col("c_custkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("v"), F.col("s_suppkey").alias("k"))
    return collect.union_streams({"a": a, "b": b}, "v", ["k"]).select("stream", "v", "k")


@query(
    """WITH b AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS priority, o_orderstatus = 'F' AS new FROM orders)
SELECT o_custkey, min_by(priority, (CASE WHEN new THEN 1000000000000 ELSE 0 END) + o_orderkey) FILTER (WHERE priority IS NOT NULL) AS priority, count(*) AS source_count FROM b GROUP BY o_custkey"""
)
def reference_update(spark, sf_dir):
    """A reference and new rows: what is there stays, blanks are filled, new keys are added."""
    o = table(spark, sf_dir, "orders").withColumns({"priority": F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")), "example": F.lit("x")})
    new = F.col("o_orderstatus") == "F"
    return reference.updated(o.where(~new), o.where(new), "o_custkey", ["priority"], "example", "o_orderkey").select("o_custkey", "priority", "source_count")


# --- the registry: nations are districts, customers' codes are places

_REGISTRY = "SELECT DISTINCT concat(substring(concat('00', c_nationkey), -2), substring(concat('000', c_custkey % 200), -3)) AS code, concat('село Место', c_custkey % 200) AS name, substring(concat('00', c_nationkey), -2) AS ter FROM {customer} UNION ALL SELECT substring(concat('00', n_nationkey), -2), n_name, substring(concat('00', n_nationkey), -2) FROM {nation}"


def _registry(spark, sf_dir):
    return settled(spark.sql(_REGISTRY.format(customer=f"parquet.`{sf_dir}/customer.parquet`", nation=f"parquet.`{sf_dir}/nation.parquet`")))


_REG = f"WITH reg AS ({_REGISTRY.format(customer='customer', nation='nation')}), keyed AS (SELECT *, CASE WHEN name LIKE 'село %' THEN lower(substring(name, 6)) ELSE trim(regexp_replace(lower(name), '[^0-9a-z]+', ' ', 'g')) END AS key FROM reg) "


@query(_REG + "SELECT DISTINCT key, code, name, ter FROM keyed")
def name_index(spark, sf_dir):
    return registry.name_index(_registry(spark, sf_dir)).select("key", "code", "name", "ter")


@query(_REG + "SELECT count(*) AS contexts, count(DISTINCT key) AS name_keys, count(DISTINCT ter) AS subjects, count(*) FILTER (WHERE length(code) = 5) AS municipalities FROM keyed")
def registry_statistics(spark, sf_dir):
    return registry.registry_statistics(_registry(spark, sf_dir))


@query(_REG + "SELECT key, max_by(name, code) AS name, max(code) AS code FROM keyed WHERE length(code) = 5 GROUP BY key UNION ALL SELECT key, name, code FROM keyed WHERE length(code) = 2")
def codes_of_municipalities(spark, sf_dir):
    return registry.codes_of_municipalities(_registry(spark, sf_dir))


@query(_REG + "SELECT c_custkey AS row_idx, k.name AS municipality FROM customer LEFT JOIN keyed k ON k.code = concat(substring(concat('00', c_nationkey), -2), substring(concat('000', c_custkey % 200), -3))")
def municipalities_of_codes(spark, sf_dir):
    c = view(spark, sf_dir, "codes")
    return registry.municipalities(c, _registry(spark, sf_dir)).select("row_idx", "municipality")


@query(_REG + ", scopes AS (" + _duck("scopes") + ") SELECT scope, count(*) AS n_rows FROM keyed JOIN scopes USING (ter) WHERE length(code) = 5 AND substring(code, 3, 3)::INT BETWEEN lo AND hi AND NOT substring(code, 3, 3)::INT BETWEEN no_lo AND no_hi GROUP BY scope")
def subject_scopes(spark, sf_dir):
    ranges = view(spark, sf_dir, "scopes").select("scope", "ter", F.array(F.struct("lo", "hi")).alias("include"), F.array(F.struct(F.col("no_lo").alias("lo"), F.col("no_hi").alias("hi"))).alias("exclude"))
    return registry.subject_scopes(_registry(spark, sf_dir).where("length(code) = 5"), ranges)


@query(
    """WITH a AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN concat('', c_nationkey) WHEN 1 THEN concat('NATION_', c_nationkey) WHEN 2 THEN concat('место в nation ', c_nationkey, ' где-то') ELSE 'нигде' END AS value, CASE WHEN c_custkey % 4 < 3 THEN c_nationkey END AS scope FROM customer)
SELECT value, scope FROM a WHERE scope IS NOT NULL"""
)
def resolved_scopes(spark, sf_dir):
    """Scopes by number, by name, and by a name inside a text."""
    asked = table(spark, sf_dir, "customer").selectExpr("CASE c_custkey % 4 WHEN 0 THEN concat('', c_nationkey) WHEN 1 THEN concat('NATION_', c_nationkey) WHEN 2 THEN concat('место в nation ', c_nationkey, ' где-то') ELSE 'нигде' END AS value")
    scopes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("scope"), F.col("n_name").alias("name"), F.concat(F.lit("т"), F.col("n_nationkey").cast("string")).alias("ter"))
    return registry.resolve_scope(asked, scopes)


@query(_REG + "SELECT value, role, max(weight) AS weight, bool_and(context_required) AS context_required FROM (SELECT key AS value, 'municipality' AS role, 45.0 AS weight, false AS context_required FROM keyed WHERE code = '03' UNION ALL SELECT DISTINCT k.key, 'locality', CASE WHEN u.n >= 3 THEN 20.0 ELSE 90.0 END, u.n >= 3 FROM keyed k JOIN (SELECT key, count(*) AS n FROM keyed GROUP BY key) u USING (key) WHERE k.code LIKE '03_%' UNION ALL SELECT lower(p_name), 'manual', 35.0, true FROM part) GROUP BY ALL")
def scope_keys(spark, sf_dir):
    """Search keys of one municipality and its places, and the user's own."""
    keys = registry.scope_keys(_registry(spark, sf_dir), "03")
    return registry.with_user_keys(keys, table(spark, sf_dir, "part").select(F.col("p_name").alias("value")))


@query("WITH k AS (SELECT p_partkey, unnest([p_name, p_brand, upper(p_name)]) AS value, unnest([0, 1, 2]) AS i FROM part) SELECT arg_min(value, p_partkey * 3 + i) AS value, trim(regexp_replace(lower(value), '[^0-9a-z]+', ' ', 'g')) AS key FROM k GROUP BY 2")
def user_keys(spark, sf_dir):
    """Keys in lines and between semicolons, each once."""
    t = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("; "), "p_brand", F.lit("\n\n "), F.upper("p_name")).alias("text"))
    return registry.user_keys(t, "text", "p_partkey")


@query(_REG + ", f AS (SELECT code, name, 100.0 AS score, count(*) OVER (PARTITION BY ter, lower(name)) = 1 AS unambiguous FROM keyed WHERE key = 'место7') SELECT * FROM f ORDER BY code LIMIT 20")
def settlement_search(spark, sf_dir):
    """Places for a search term; the limit is the feature."""
    return registry.settlement_search(registry.name_index(_registry(spark, sf_dir)), "с. Место7").select("code", "name", "score", "unambiguous")


_HITS = """WITH d AS (SELECT c_custkey AS id, c_custkey % 3 = 0 AS has_context, concat('дом у ', CASE c_custkey % 4 WHEN 0 THEN 'места один' WHEN 1 THEN 'места два' WHEN 2 THEN 'места один и места два' ELSE 'ничего' END) AS text FROM {customer})"""


@query(
    _HITS.format(customer="customer")
    + """, h AS (SELECT id, 'места один' AS value, has_context AS valid, 45.0 AS weight FROM d WHERE contains(text, 'места один') UNION ALL SELECT id, 'места два', true, 20.0 FROM d WHERE contains(text, 'места два'))
SELECT id, bool_or(valid) AS valid, arg_max(value, (valid::INT * 1000 + weight)) AS best, string_agg(concat(value, ':locality'), ', ' ORDER BY value) AS text FROM h GROUP BY id"""
)
def scope_hits(spark, sf_dir):
    """Search keys that a text holds; the heavier one needs a context."""
    d = spark.sql(_HITS.format(customer=f"parquet.`{sf_dir}/customer.parquet`") + " SELECT id, has_context, text, '' AS code FROM d")
    keys = spark.createDataFrame([("места один", "locality", 45.0, True, ""), ("места два", "locality", 20.0, False, "")], "value string, role string, weight double, context_required boolean, code string")
    h = registry.scope_hits(d, keys)
    return h.select("id", "valid", "best", registry.hit_text(F.col("hits")).alias("text"))


_MUNICIPAL = [
    # parent's section name, its heading, the district's name; municipality, by district
    ("Тюменский район", None, "Большой муниципальный район", "Тюменский район", "0"),
    ("Речное сельское поселение", None, "Большой муниципальный район", "Большой муниципальный район", "1"),
    ("Речное сельское поселение", "Речной муниципальный округ", "Большой муниципальный район", "Речной муниципальный округ", "0"),
    (None, None, "Большой муниципальный район", "Большой муниципальный район", "1"),
    (None, "Ишимский район", None, "Ишимский район", "0"),
]


@query(expected(_MUNICIPAL, {"municipality": 3, "by_district": 4}))
def row_municipalities(spark, sf_dir):
    rows = dealt(spark, sf_dir, _MUNICIPAL, ["section", "heading", "district"]).withColumns({"parent_code": F.concat(F.lit("p"), F.col("row_idx").cast("string")), "district_code": F.concat(F.lit("d"), F.col("row_idx").cast("string"))})
    none = F.lit(None).cast("string")
    names = rows.select(F.col("parent_code").alias("code"), F.col("section").alias("section_name"), F.col("heading").alias("heading_name")).unionByName(rows.select(F.col("district_code").alias("code"), F.col("district").alias("section_name"), none.alias("heading_name")))
    m = registry.row_municipalities(rows.select("row_idx", "parent_code", "district_code"), names)
    return m.select("row_idx", "municipality", F.when(F.col("municipality_code") == F.col("district_code"), "1").otherwise("0").alias("by_district"))


@query("WITH t AS (SELECT DISTINCT p_name AS term FROM part) SELECT term, term AS form FROM t UNION SELECT term, replace(term, 'widget', 'widgets') FROM t UNION SELECT term, replace(term, 'widget', 'w') FROM t")
def term_forms(spark, sf_dir):
    """Search keys with a word in its other forms."""
    forms = spark.createDataFrame([("widget", "widgets"), ("widget", "w")], "word string, form string")
    return registry.term_forms(table(spark, sf_dir, "part").select(F.col("p_name").alias("term")), forms)


@query(
    """WITH q AS (SELECT DISTINCT concat(p_name, ' ', lower(p_type)) AS query FROM part), c AS (SELECT DISTINCT p_name AS choice FROM part),
s AS (SELECT query, choice, (100.0 * len(list_intersect(string_split(query, ' '), string_split(choice, ' '))) / len(list_distinct(list_concat(string_split(query, ' '), string_split(choice, ' ')))))::DOUBLE AS score FROM q, c)
SELECT query, choice, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, choice) AS n FROM s WHERE score >= 20) WHERE n <= 3"""
)
def top_similar(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return matching.top_similar(p.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("query")).distinct(), p.select(F.col("p_name").alias("choice")).distinct(), 20.0, 3).select("query", "choice", "score")


# --- sheets

_CELLS = """SELECT c_nationkey AS sheet, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row_idx, c_name, c_mktsegment FROM {customer}"""


def _sheet(spark, sf_dir):
    rows = spark.sql(_CELLS.format(customer=f"parquet.`{sf_dir}/customer.parquet`"))
    cell = lambda i, v: F.struct(F.lit(i).alias("col_idx"), v.alias("value"))
    body = rows.select("sheet", "row_idx", F.inline(F.array(cell(0, F.col("c_name")), cell(1, F.col("c_mktsegment")))))
    head = rows.select("sheet").distinct().select("sheet", F.lit(0).alias("row_idx"), F.inline(F.array(cell(0, F.lit("Улица")), cell(1, F.lit("Номер дома")))))
    return head.unionByName(body.withColumn("row_idx", F.col("row_idx").cast("int")))


@query("SELECT DISTINCT c_nationkey AS sheet, 0 AS row_idx, 11::BIGINT AS score FROM customer")
def header_rows(spark, sf_dir):
    """The row of each sheet whose cells read most like headers."""
    return profile.header_row(_sheet(spark, sf_dir), {"улица": 5, "дом": 6}, ["sheet"])


@query("SELECT c_nationkey AS sheet, col_idx, header FROM (SELECT DISTINCT c_nationkey FROM customer), (VALUES (0, 'A: Улица'), (1, 'A: Номер дома')) h(col_idx, header)")
def flat_headers(spark, sf_dir):
    return profile.flat_headers(_sheet(spark, sf_dir), 1, "A", ["sheet"])


@query("SELECT DISTINCT c_nationkey AS sheet, 0 AS row_idx, 1 AS col_idx FROM customer")
def found_headers(spark, sf_dir):
    return profile.find_header(_sheet(spark, sf_dir), "дом", ["sheet"])


@query(f"SELECT sheet, row_idx, concat(c_name, '|', c_mktsegment) AS payload FROM ({_CELLS.format(customer='customer')})")
def structured_rows(spark, sf_dir):
    """Data rows as maps from header to value."""
    cells = _sheet(spark, sf_dir)
    headers = cells.where("row_idx = 0").select("sheet", "col_idx", F.col("value").alias("header"), F.lit(1).alias("first_row"))
    p = collect.structured_rows(cells, headers, ["sheet"])
    return p.select("sheet", F.col("row_idx").cast("long").alias("row_idx"), F.concat_ws("|", F.element_at("payload", F.lit("Улица")), F.element_at("payload", F.lit("Номер дома"))).alias("payload"))


@query(f"SELECT sheet, row_idx, c_mktsegment AS value, concat(sheet, '!B', row_idx + 1) AS locator FROM ({_CELLS.format(customer='customer')})")
def column_of_sheets(spark, sf_dir):
    """One column of every sheet below its header, with places."""
    cells = _sheet(spark, sf_dir)
    first = profile.header_row(cells, {"улица": 5, "дом": 6}, ["sheet"]).select("sheet", (F.col("row_idx") + 1).alias("first_row"))
    return C.column_of_sheets(cells, 1, first, ["sheet"]).withColumn("row_idx", F.col("row_idx").cast("long"))


@query("SELECT 0 AS col_idx, 'street' AS kind UNION ALL SELECT 1, 'house'")
def address_columns(spark, sf_dir):
    """Columns whose headers name an address or its parts."""
    return profile.address_columns(_sheet(spark, sf_dir).select("row_idx", "col_idx", "value").distinct(), 1)


@query(_with("SELECT row_idx, 'document' AS pool, address AS value FROM addr_blank WHERE address IS NOT NULL UNION ALL SELECT row_idx, 'document', payload FROM addr_blank WHERE payload IS NOT NULL", "addr_blank"))
def match_inputs(spark, sf_dir):
    return profile.match_inputs(view(spark, sf_dir, "addr_blank"), ["address", "payload"], "document")


@query(
    f"""WITH a AS (SELECT address FROM ({_duck('addr_a')})), m AS (SELECT avg(length(address)) AS len FROM a)
SELECT 0 AS col_idx, 1.0::DOUBLE AS fill, 1.0::DOUBLE AS address, 1.0::DOUBLE AS house, 1.0::DOUBLE AS street, 0.0::DOUBLE AS numeric, len AS mean_length, 140.0 + 60 + 25 + 20 + 15 + 60 + least(len, 80) * 0.15 AS score FROM m
UNION ALL SELECT 1, 1.0, 0.0, 0.0, 0.0, 1.0, avg(length(concat('', c_custkey))), 140.0 - 120 + avg(length(concat('', c_custkey))) * 0.15 - 30 FROM customer"""
)
def column_scores(spark, sf_dir):
    """How much the columns of a sheet look like addresses."""
    rows = view(spark, sf_dir, "addr_a")
    cells = rows.select(F.posexplode(F.array("address", F.col("row_idx").cast("string"))).alias("col_idx", "value"))
    return profile.column_scores(cells, F.lit(rows.count())).select("col_idx", "fill", "address", "house", "street", "numeric", "mean_length", "score")


# --- jobs

def _parsed_sides(spark, sf_dir):
    """Rows and candidates with streets in two territories, numbered and misspelt ones, codes and source rows."""
    streets = ["Ленина", "Мирная", "9 Мая", "50 лет Октября", "Центральная", "Советская"]
    wrong = ["Ленена", "Мурная", "9 Мая", "50 лет Октяюря", "Центральня", "Советская"]
    pick = lambda names, k: "CASE " + k + " % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(names)) + " END"
    a = spark.sql(f"SELECT c_custkey AS row_idx, concat(CASE c_custkey % 5 WHEN 0 THEN 'п. Речной, ' WHEN 1 THEN 'с. Каменка, ' ELSE 'г. Тюмень, ' END, CASE WHEN c_custkey % 17 = 3 THEN '' ELSE concat('ул. ', {pick(streets, 'c_custkey')}, ', ') END, 'д. ', 1 + c_custkey % 23, CASE c_custkey % 7 WHEN 0 THEN ' корп. 2' ELSE '' END) AS raw, CASE c_custkey % 4 WHEN 0 THEN '71701' WHEN 1 THEN '71702' ELSE '' END AS code FROM parquet.`{sf_dir}/customer.parquet`")
    b = spark.sql(f"SELECT s_suppkey AS cand_idx, CASE WHEN s_suppkey % 10 = 7 THEN concat('г. Тюмень, ул. ', {pick(streets, 's_suppkey')}, ', д. ', 1 + s_suppkey % 23, CASE s_suppkey % 7 WHEN 0 THEN ' корп. 2' ELSE '' END) ELSE concat(CASE s_suppkey % 3 WHEN 0 THEN 'п. Речной, ' WHEN 1 THEN 'город Тюмень, ' ELSE '' END, CASE s_suppkey % 2 WHEN 0 THEN 'улица ' ELSE 'ул. ' END, CASE WHEN s_suppkey % 4 > 1 THEN {pick(streets, 's_suppkey')} ELSE {pick(wrong, 's_suppkey')} END, ', ', 1 + s_suppkey % 23, CASE s_suppkey % 7 WHEN 0 THEN ', корпус 2' ELSE '' END) END AS raw, CASE s_suppkey % 3 WHEN 0 THEN '71701000' ELSE '' END AS code, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey END AS source_row FROM parquet.`{sf_dir}/supplier.parquet`")
    side = lambda df: settled(A.parsed(df, "raw", "тюмень").withColumn("text", T.normalized("raw")).select(*df.columns, "text", "parsed.*"))
    return side(a), side(b)


@query()
def match_all_passes(spark, sf_dir):
    """All passes on parsed addresses. Greedy, so no SQL; held against a plain walk in the tests."""
    gt, cand = _parsed_sides(spark, sf_dir)
    return matching.cascade(gt, cand).select("row_idx", "cand_idx", "pass", "weight")


# --- assembly: keys, votes and the final dedupe on addresses made from keys of tables

_RAW = f"""SELECT c_custkey AS row_idx, concat(CASE c_custkey % 3 WHEN 0 THEN 'ул. ' ELSE 'улица ' END, {_street('c_custkey', STREETS)}) AS street,
  concat(CASE c_custkey % 4 WHEN 0 THEN 'зд. ' WHEN 1 THEN 'дом ' WHEN 2 THEN 'д. ' ELSE 'строение ' END, 1 + c_custkey % 25, CASE c_custkey % 5 WHEN 0 THEN ', корп. 2' ELSE '' END) AS house,
  CASE c_custkey % 6 WHEN 0 THEN concat('кв. ', c_custkey % 2) END AS premise, concat(70 + c_nationkey % 3, ' 701 ', 100 + c_nationkey % 2) AS oktmo_code,
  CASE c_custkey % 7 WHEN 0 THEN 'г. Ишим' END AS locality, c_mktsegment AS raw_examples, CASE c_custkey % 9 WHEN 0 THEN NULL ELSE c_custkey % 4 END AS source_count FROM {{customer}}"""
_RAW_DUCK = _RAW.format(customer="customer")
#: The rule in SQL: what the parts of the key are, from the same keys of the table and not from the texts.
_CORE = f"""SELECT *, concat_ws('|', {_street('row_idx', LOW)}, CASE row_idx % 4 WHEN 0 THEN 'зд' WHEN 3 THEN 'стр' ELSE 'д' END,
  (1 + row_idx % 25)::VARCHAR, CASE WHEN row_idx % 5 = 0 THEN 'к2' END, 'кв ' || CASE WHEN row_idx % 6 = 0 THEN (row_idx % 2)::VARCHAR END) AS core,
  'oktmo:' || replace(oktmo_code, ' ', '') AS scope FROM ({_RAW_DUCK})"""


def _raw(spark, sf_dir):
    df = spark.sql(_RAW.format(customer=f"parquet.`{sf_dir}/customer.parquet`"))
    return df.withColumn("address", F.concat_ws(", ", "street", "house", "premise"))


@query(f"SELECT row_idx, concat('core|', scope, '|', core) AS assembly_key FROM ({_CORE})")
def assembly_keys(spark, sf_dir):
    return assembly.with_assembly_key(_raw(spark, sf_dir), "address").select("row_idx", "assembly_key")


@query(
    f"""WITH RECURSIVE k AS (
  SELECT *, concat('core|', scope, '|street|', core) AS core_key, concat('address|', row_idx % 700) AS text_key, row_number() OVER (ORDER BY row_idx) AS i FROM ({_CORE})),
walk AS (
  SELECT 0::BIGINT AS i, NULL::BIGINT AS row_idx, NULL::BIGINT AS target, []::VARCHAR[] AS names, []::BIGINT[] AS owners
  UNION ALL
  SELECT i, row_idx, target, CASE WHEN target IS NULL THEN list_concat(names, [core_key, text_key]) ELSE names END, CASE WHEN target IS NULL THEN list_concat(owners, [row_idx, row_idx]) ELSE owners END
  FROM (SELECT k.i, k.row_idx, k.core_key, k.text_key, names, owners, coalesce(owners[list_position(names, k.core_key)], owners[list_position(names, k.text_key)]) AS target FROM walk JOIN k ON k.i = walk.i + 1)),
t AS (SELECT row_idx, coalesce(target, row_idx) AS target FROM walk WHERE i > 0),
n AS (SELECT target, sum(CASE WHEN coalesce(source_count, 0) = 0 THEN 1 ELSE source_count END)::BIGINT AS source_count FROM t JOIN k USING (row_idx) GROUP BY target),
e AS (SELECT target, raw_examples, min(row_idx) AS first FROM t JOIN k USING (row_idx) GROUP BY ALL),
x AS (SELECT target, string_agg(raw_examples, ' | ' ORDER BY first) AS raw_examples FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY first) AS r FROM e) WHERE r <= 5 GROUP BY target)
SELECT target AS row_idx, source_count, raw_examples FROM n JOIN x USING (target)"""
)
def final_output_merge(spark, sf_dir):
    rows = assembly.with_final_keys(_raw(spark, sf_dir), "address")
    rows = rows.withColumn("text_key", F.concat(F.lit("address|"), (F.col("row_idx") % 700).cast("string")))
    out = assembly.dedupe_merging(rows, "row_idx", ["core_key", "text_key"], "source_count", {"raw_examples": assembly.EXAMPLES})
    return out.select("row_idx", "source_count", "raw_examples")


_VOTES = f"""SELECT c_custkey AS row_idx, c_nationkey AS place, c_acctbal / 100.0 AS quality,
  CASE c_custkey % 5 WHEN 0 THEN concat('школа ', c_custkey % 3) WHEN 1 THEN concat('ул. ', {_street('c_nationkey', STREETS)}) WHEN 2 THEN concat('улица ', {_street('c_nationkey', STREETS)}) ELSE concat('пер. ', {_street('(c_custkey % 3)', STREETS)}) END AS street,
  CASE c_custkey % 4 WHEN 0 THEN '625' || (100 + c_nationkey) WHEN 1 THEN 'нет' ELSE '999999' END AS postal_index FROM {{customer}}"""


@query(
    f"""WITH r AS ({_VOTES.format(customer='customer')}),
s AS (SELECT row_idx, place, 'street' AS slot, CASE WHEN row_idx % 5 = 2 THEN replace(street, 'улица', 'ул.') ELSE street END AS value,
        CASE WHEN row_idx % 5 = 0 THEN street WHEN row_idx % 5 < 3 THEN {_street('place', LOW)} ELSE {_street('(row_idx % 3)', LOW)} END AS vote,
        quality + CASE WHEN row_idx % 5 = 0 THEN -80.0 ELSE 5.0 END AS v FROM r),
p AS (SELECT row_idx, place, 'postal_index' AS slot, postal_index AS value, postal_index AS vote, quality + CASE WHEN row_idx % 4 = 0 THEN 8.0 ELSE 0.0 END AS v FROM r),
e AS (SELECT * FROM s UNION ALL SELECT * FROM p),
e2 AS (SELECT * REPLACE (CASE WHEN slot = 'street' AND vote LIKE 'школа%' THEN '' ELSE vote END AS vote), CASE WHEN v >= 0 THEN v END AS able FROM e),
g AS (SELECT place, slot, vote, count(*) AS votes, min(row_idx) AS first, arg_min(value, row_idx) AS first_value, coalesce(max(able), 0) AS score FROM e2 GROUP BY ALL),
b AS (SELECT place, slot, vote, value, row_number() OVER (PARTITION BY place, slot, vote ORDER BY able DESC, length(value) DESC, row_idx) AS r FROM e2 WHERE able IS NOT NULL),
t AS (SELECT g.*, coalesce(b.value, first_value) AS value, CASE WHEN b.value IS NULL THEN 0 ELSE length(b.value) END AS len FROM g LEFT JOIN b ON g.place = b.place AND g.slot = b.slot AND g.vote = b.vote AND b.r = 1)
SELECT place, slot, value, votes FROM (SELECT *, row_number() OVER (PARTITION BY place, slot ORDER BY votes DESC, score DESC, len DESC, first) AS r FROM t) WHERE r = 1"""
)
def votes_with_penalties(spark, sf_dir):
    """Streets that name a school never win by their score; spellings of one street are one vote."""
    rows = spark.sql(_VOTES.format(customer=f"parquet.`{sf_dir}/customer.parquet`"))
    return assembly.voted_slots(rows, "place", ["street", "postal_index"], "quality", "row_idx")


# --- registry: what rules say of a code, names in scopes

_RANGES = "SELECT substring(concat('00', n_nationkey), -2) AS ter, 10 * n_regionkey AS lo, 10 * n_regionkey + 60 AS hi, n_name AS value, n_nationkey AS n FROM {nation}"
_RULES_DUCK = f"WITH codes AS ({_duck('codes')}), ranges AS ({_RANGES.format(nation='nation')}), blocks AS (SELECT DISTINCT substring(code, 1, 5) AS block FROM codes WHERE row_idx % 4 = 0)"


@query(
    _RULES_DUCK
    + """SELECT DISTINCT code, coalesce(r.value, 'block ' || b.block, CASE WHEN code LIKE '1%' THEN 'prefix ' || CASE WHEN code LIKE '111%' THEN '111' WHEN code LIKE '11%' THEN '11' ELSE '1' END END) AS value
FROM codes LEFT JOIN ranges r ON substring(code, 1, 2) = r.ter AND substring(code, 3, 3)::INT BETWEEN r.lo AND r.hi LEFT JOIN blocks b ON substring(code, 1, 5) = b.block"""
)
def rules_of_codes(spark, sf_dir):
    codes = view(spark, sf_dir, "codes")
    none = F.lit(None).cast("string")
    ranges = spark.sql(_RANGES.format(nation=f"parquet.`{sf_dir}/nation.parquet`")).select("ter", "lo", "hi", none.alias("block"), none.alias("prefix"), "value", F.col("n").cast("long").alias("n"))
    block = codes.where("row_idx % 4 = 0").select(F.substring("code", 1, 5).alias("block")).distinct()
    blocks = block.select(none.alias("ter"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"), "block", none.alias("prefix"), F.concat(F.lit("block "), "block").alias("value"), F.lit(0).cast("long").alias("n"))
    prefix = spark.sql("SELECT explode(array('1', '11', '111')) AS prefix")
    prefixes = prefix.select(none.alias("ter"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"), none.alias("block"), "prefix", F.concat(F.lit("prefix "), "prefix").alias("value"), F.lit(0).cast("long").alias("n"))
    rules = ranges.withColumns({"lo": F.col("lo").cast("int"), "hi": F.col("hi").cast("int")}).unionByName(blocks).unionByName(prefixes)
    return registry.values_of_codes(codes, rules)


_PLACE_ROWS = f"""SELECT concat(c_nationkey, '') AS scope, concat(substring(concat('00', c_nationkey), -2), substring(concat('000000', c_custkey), -6)) AS code,
  concat(CASE c_custkey % 3 WHEN 0 THEN 'село ' WHEN 1 THEN 'деревня ' ELSE '' END, {_street('c_custkey', STREETS)}, CASE c_custkey % 3 WHEN 2 THEN ' сельское поселение' ELSE '' END) AS name,
  concat(c_mktsegment, ' район') AS municipality FROM {{customer}}"""
_ASKED = f"SELECT DISTINCT concat('с. ', {_street('s_suppkey', STREETS)}) AS name, concat(s_nationkey, '') AS scope, CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING муниципальный округ' WHEN 1 THEN 'нет такого' END AS hint FROM {{supplier}}"


@query(
    f"""WITH i AS ({_PLACE_ROWS.format(customer='customer')}), q AS ({_ASKED.format(supplier='supplier')}),
m AS (SELECT q.name, q.scope, q.hint, i.code, i.name AS found, i.municipality,
        row_number() OVER (PARTITION BY q.name, q.scope, coalesce(q.hint, '') ORDER BY (coalesce(q.hint, '') LIKE 'BUILDING%' AND i.municipality LIKE 'BUILDING%') DESC, (i.name LIKE '%сельское поселение') ASC, i.code::BIGINT) AS r
      FROM q JOIN i ON q.scope = i.scope AND lower(substring(q.name, 4)) = lower(trim(replace(replace(replace(i.name, 'село ', ''), 'деревня ', ''), ' сельское поселение', '')))
      WHERE i.name NOT LIKE '%поселение')
SELECT name, scope, hint, code, found, municipality, 100.0::DOUBLE AS score FROM m WHERE r = 1"""
)
def names_in_scopes(spark, sf_dir):
    """Equal names in many scopes: each meets its own only, the hinted municipality's first."""
    index = spark.sql(_PLACE_ROWS.format(customer=f"parquet.`{sf_dir}/customer.parquet`"))
    asked = spark.sql(_ASKED.format(supplier=f"parquet.`{sf_dir}/supplier.parquet`"))
    return registry.lookup_scoped(asked, index)


# --- observation rows: a sheet for each nation with a header, its customers, a line of places, another header

_PLACE = "CASE c_custkey % 3 WHEN 0 THEN 'Северный' WHEN 1 THEN 'Южный' ELSE 'Восточный' END"
_SHEET = f"""SELECT concat(c_nationkey, '') AS sheet, 10 * c_custkey + 10 AS row_idx, 0 AS col_idx, concat(c_custkey, '') AS value FROM {{customer}}
UNION ALL SELECT concat(c_nationkey, ''), 10 * c_custkey + 10, 1, concat('ул. ', {_street('c_custkey', STREETS)}) FROM {{customer}}
UNION ALL SELECT concat(c_nationkey, ''), 10 * c_custkey + 10, 2, concat(1 + c_custkey % 40, '') FROM {{customer}}
UNION ALL SELECT concat(c_nationkey, ''), 10 * c_custkey + 15, 1, concat('г. ', {_PLACE}) FROM {{customer}} WHERE c_custkey % 11 = 0
UNION ALL SELECT concat(n_nationkey, ''), row_idx, col_idx, value FROM {{nation}}, (VALUES (0, 0, '№'), (0, 1, 'Улица'), (0, 2, 'Дом'), (2001, 0, 'Код'), (2001, 1, 'Адрес'), (2001, 2, 'Номер дома')) AS h(row_idx, col_idx, value)"""


@query(
    f"""WITH c AS (SELECT concat(c_nationkey, '') AS sheet, 10 * c_custkey + 10 AS row_idx, c_custkey AS k, {_street('c_custkey', STREETS)} AS street FROM customer)
SELECT c.sheet, c.row_idx, CASE WHEN c.row_idx < 2001 THEN 'Улица' ELSE 'Адрес' END AS street_header, 'ул. ' || c.street AS street, (1 + c.k % 40)::VARCHAR AS house FROM c"""
)
def observed_rows(spark, sf_dir):
    """Rows of sheets under the header that holds for them; lines of places are no rows."""
    cells = spark.sql(_SHEET.format(customer=f"parquet.`{sf_dir}/customer.parquet`", nation=f"parquet.`{sf_dir}/nation.parquet`"))
    found = observations.observation_rows(cells, ["sheet"], "every")
    e = found.select("sheet", "row_idx", F.map_entries("payload").alias("e"))
    return e.select("sheet", "row_idx", F.col("e")[1]["key"].alias("street_header"), F.col("e")[1]["value"].alias("street"), F.col("e")[2]["value"].alias("house"))


# --- houses of all kinds, predicates, cleaned references, on addresses made from keys of tables

_HOUSES = f"""SELECT c_custkey AS row_idx, concat('г. Тюмень, ', CASE c_custkey % 6 WHEN 5 THEN concat(1 + c_custkey % 9, '-я линия') ELSE concat('ул. ', {_street('c_custkey', STREETS)}) END, ', ',
  CASE c_custkey % 6 WHEN 0 THEN 'строение ' WHEN 1 THEN 'зд. ' WHEN 2 THEN 'д. ' WHEN 3 THEN 'стр. ' ELSE '' END, 1 + c_custkey % 70, CASE c_custkey % 4 WHEN 0 THEN 'А' WHEN 1 THEN ', стр. 3' ELSE '' END) AS address FROM {{customer}}"""


@query(
    f"""SELECT c_custkey AS row_idx, CASE c_custkey % 6 WHEN 5 THEN 'линия' ELSE {_street('c_custkey', LOW)} END AS sw, CASE c_custkey % 6 WHEN 5 THEN (1 + c_custkey % 9)::VARCHAR ELSE '' END AS sn,
  (1 + c_custkey % 70)::VARCHAR AS hb, CASE c_custkey % 4 WHEN 0 THEN 'а' WHEN 1 THEN 'с3' ELSE '' END AS hm,
  CASE c_custkey % 6 WHEN 5 THEN (1 + c_custkey % 9) || '-я линия' ELSE 'ул. ' || {_street('c_custkey', STREETS)} END AS street,
  concat(CASE c_custkey % 6 WHEN 0 THEN 'стр. ' WHEN 1 THEN 'зд. ' WHEN 3 THEN 'стр. ' ELSE 'д. ' END, 1 + c_custkey % 70, CASE c_custkey % 4 WHEN 0 THEN 'А' WHEN 1 THEN ', стр. 3' ELSE '' END) AS house FROM customer"""
)
def house_kinds(spark, sf_dir):
    """Buildings without a house, houses with a building, houses of all kinds, streets that are a number and a kind."""
    rows = spark.sql(_HOUSES.format(customer=f"parquet.`{sf_dir}/customer.parquet`"))
    s = S.with_slots(rows, "address", "тюмень")
    return s.select("row_idx", "parsed.sw", F.array_join("parsed.sn", " ").alias("sn"), "parsed.hb", "parsed.hm", "slots.street", "slots.house")


@query(
    _with(
        """SELECT row_idx, coalesce(address, '') <> '' AND ((address LIKE '%ул. %' OR address LIKE '%улица %') AND (street <> '' OR house IS NOT NULL) OR street <> '' AND house IS NOT NULL) AS looks, address IS NOT NULL AND house IS NOT NULL AND street <> '' AS core FROM addr_blank""",
        "addr_blank",
    )
)
def address_predicates(spark, sf_dir):
    rows = spread(view(spark, sf_dir, "addr_blank"), "row_idx").withColumn("there", F.coalesce("address", F.lit("")))
    looks = sanitize.looks_like_address(F.col("there"), F.col("street"), F.col("house")) & (F.col("there") != "")
    core = sanitize.address_core(F.col("there"), F.col("street"), F.col("house"), F.lit(None)) & (F.col("there") != "")
    return rows.select("row_idx", looks.alias("looks"), core.alias("core"))


@query(
    _with(
        """SELECT min(row_idx) AS row_idx, street, house FROM (SELECT row_idx, street, house FROM addr_blank WHERE address IS NOT NULL AND street <> '' AND house IS NOT NULL AND house <> '0') GROUP BY street, house""",
        "addr_blank",
    )
)
def cleaned_reference(spark, sf_dir):
    """Rows without issues, the first of each street and house."""
    rows = spread(view(spark, sf_dir, "addr_blank"), "row_idx").withColumn("key", F.concat_ws("|", "street", "house"))
    issues = sanitize.issue_codes({"address": F.col("address"), "street": F.col("street"), "house_base": F.col("house")})
    return reference.cleaned(rows, "key", issues).select("row_idx", "street", "house")


_REGION_ROWS = "SELECT c_custkey AS region_id, CASE c_custkey % 4 WHEN 0 THEN 'Тюменская область' WHEN 1 THEN 'Алтайский край' WHEN 2 THEN 'Республика Алтай' ELSE 'Неизвестная земля' END AS name, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE ' ' END AS federal_district FROM {customer}"


@query(f"SELECT region_id, name, CASE WHEN federal_district <> ' ' THEN federal_district WHEN name LIKE 'Тюм%' THEN 'Уральский федеральный округ' WHEN name LIKE '%Алта%' THEN 'Сибирский федеральный округ' END AS federal_district FROM ({_REGION_ROWS.format(customer='customer')})")
def regions_with_districts(spark, sf_dir):
    return regions.with_districts(spark.sql(_REGION_ROWS.format(customer=f"parquet.`{sf_dir}/customer.parquet`")))


@query(
    f"""WITH c AS (SELECT concat(c_nationkey, '') AS sheet, 10 * c_custkey + 10 AS row_idx, 'ул. ' || {_street('c_custkey', STREETS)} || ', д. ' || (1 + c_custkey % 40) AS address FROM customer),
f AS (SELECT concat(c_nationkey, '') AS sheet, 'г. ' || {_PLACE} AS line, min(10 * c_custkey + 15) AS first FROM customer WHERE c_custkey % 11 = 0 GROUP BY ALL),
w AS (SELECT c.sheet, c.row_idx, string_agg(f.line, ', ' ORDER BY f.first) AS lines FROM c JOIN f ON c.sheet = f.sheet AND f.first < c.row_idx GROUP BY ALL)
SELECT c.sheet, c.row_idx, concat_ws(', ', w.lines, c.address) AS address FROM c LEFT JOIN w ON c.sheet = w.sheet AND c.row_idx = w.row_idx"""
)
def observed_addresses(spark, sf_dir):
    """Addresses of the same rows: street and house of two columns, or an address and a house, behind the last lines of places."""
    cells = spark.sql(_SHEET.format(customer=f"parquet.`{sf_dir}/customer.parquet`", nation=f"parquet.`{sf_dir}/nation.parquet`"))
    return observations.observation_addresses(observations.observation_rows(cells, ["sheet"], "every"), ["sheet"])
