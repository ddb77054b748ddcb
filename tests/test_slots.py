import pytest
from plumbline.functions import slots as S
from plumbline.operators import registry as R
from pyspark.sql import functions as F

LINES = [
    ("г. Тюмень, Ленина, 10", "г. Тюмень, ул. Ленина, д. 10"),
    ("г. Тюмень, улица Ленина, дом 10 корп. 2", "г. Тюмень, ул. Ленина, д. 10, к. 2"),
    ("625000, деревня Патрушева, улица Ленина, д. 10", "д. Патрушева, ул. Ленина, д. 10"),
    ("г. Тюмень, пр.Геологоразведчиков, 5", "г. Тюмень, пр-д Геологоразведчиков, д. 5"),
]
STREETS = [("пр.Геологоразведчиков", "пр-д Геологоразведчиков"), ("ул. Ленина ЖК «Северный»", "ул. Ленина"), ("ул. прт Блюхера", "пр-кт Блюхера"), ("ул Мира", "ул. Мира"), ("Московский тракт", "Московский тракт")]


@pytest.mark.parametrize(("raw", "want"), STREETS)
def test_street(spark, raw, want):
    assert spark.range(1).select(S.street_display(F.lit(raw)).alias("s")).first().s == want


def test_lines(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(LINES)], "i int, raw string")
    got = {r.i: r.line for r in S.with_slots(df, "raw", "тюмень").select("i", S.line_of(F.col("slots")).alias("line")).collect()}
    assert [got[i] for i in range(len(LINES))] == [b for _, b in LINES]
    wide = S.deconstructed(df, "raw", ["street", "house"], keep_source=False)
    assert wide.columns[:3] == ["i", "street", "house"] and "raw" not in wide.columns


def test_normalize_with_registry(spark):
    reg = spark.createDataFrame([("71001", "Тюменский муниципальный район"), ("71001001001", "деревня Патрушева")], "code string, name string").withColumn("ter", F.substring("code", 1, 2))
    df = spark.createDataFrame([("625000, деревня Патрушева, улица Ленина, д. 10",)], "raw string")
    r = S.normalized_addresses(df, "raw", reg).first()
    assert (r.oktmo_code, r.municipality, r.territory_key, r.slots.postal_index) == ("71001001001", "Тюменский муниципальный район", "oktmo:71001001001", "625000")
    assert r.normalized == "Тюменский муниципальный район, д. Патрушева, ул. Ленина, д. 10"


def test_guard(spark):
    df = spark.createDataFrame([("улица Альфа дом 2",), ("только город",)], "raw string")
    got = {r.raw: (r.output, r.kept_original) for r in S.guarded(df, "raw").collect()}
    assert got == {"улица Альфа дом 2": ("ул. Альфа, д. 2", False), "только город": ("только город", True)}


def test_headers_and_order(spark):
    heads = ["Улица", "Номер дома", "Почтовый индекс", "Код ОКТМО", "Адрес объекта", "прочее"]
    df = spark.createDataFrame([(h,) for h in heads], "h string")
    assert [r.s for r in df.select(S.header_slot(F.col("h")).alias("s")).collect()] == ["street", "house", "postal_index", "oktmo_code", "address", None]
    assert S.slot_order("house, street", ["street", "house", "locality"]) == ["house", "street", "locality"]
    assert S.slot_order({"street": 2, "house": 1}, ["street", "house"]) == ["house", "street"]
    assert "microdistrict" not in S.slot_order(None)


def test_scope_hits_and_score(spark):
    records = spark.createDataFrame([(1, "д патрушева ул ленина", "", False), (2, "с мирный", "", True), (3, "иное", "71", False)], "id int, text string, code string, has_context boolean")
    keys = spark.createDataFrame([("патрушева", "locality", 90.0, False, ""), ("мирный", "locality", 20.0, True, ""), ("район", "municipality", 45.0, True, "71")], "value string, role string, weight double, context_required boolean, code string")
    hits = R.scope_hits(records, keys)
    assert {r.id: (r.valid, r.best) for r in hits.collect()} == {1: (True, "патрушева"), 2: (True, "мирный"), 3: (True, "район")}
    h = hits.where("id = 1").select("hits")
    pair = h.crossJoin(h.withColumnRenamed("hits", "other"))
    got = pair.select(R.pair_score(F.col("hits"), F.col("other"), F.lit(""), F.lit("")).alias("a"), R.pair_score(F.col("hits"), F.col("other"), F.lit("71"), F.lit("72")).alias("b"), R.pair_score(F.col("hits"), F.col("other"), F.lit("71"), F.lit("7100")).alias("c")).first()
    assert tuple(got) == (9.0, -80.0, 14.0)


def test_house_kinds_and_numbered_lines(spark):
    want = [("ул. Мира, зд. 10А", "ул. Мира", "зд. 10А"), ("ул. Мира, строение 5", "ул. Мира", "стр. 5"), ("ул. Мира, д. 5, стр. 2", "ул. Мира", "д. 5, стр. 2"), ("г. Тюмень, 5-я линия, 3", "5-я линия", "д. 3")]
    df = spark.createDataFrame([(w[0],) for w in want], "raw string")
    got = {r.raw: (r.street, r.house) for r in S.with_slots(df, "raw", "тюмень").select("raw", "slots.street", "slots.house").collect()}
    assert got == {raw: (street, house) for raw, street, house in want}
    forms = spark.createDataFrame([("здание 7б",), ("строение 3",), ("дом 4 корп 1",), ("12",)], "h string").select("h", S.renormalized("house", F.col("h")).alias("r"))
    assert {r.h: r.r for r in forms.collect()} == {"здание 7б": "зд. 7Б", "строение 3": "стр. 3", "дом 4 корп 1": "д. 4, к. 1", "12": "д. 12"}
