from plumbline.operators import registry as R
from pyspark.sql import functions as F

RULES = [("10", 100, 200, None, None, "range", 0), ("10", 150, 160, None, None, "later", 1), (None, None, None, "10300", None, "block", 2), (None, None, None, None, "10", "short", 3), (None, None, None, None, "10300", "long", 4), (None, None, None, None, "1030", "mid", 5), ("20", 9, 5, None, None, "none", 6)]


def test_values_of_codes(spark):
    rules = spark.createDataFrame(RULES, "ter string, lo int, hi int, block string, prefix string, value string, n int")
    want = {"10155001": "range", "10100": "range", "10300001": "block", "10301": "mid", "1030": "mid", "10999": "short", "10": "short", "20007": None, "": None, "10 150": "range"}
    got = R.values_of_codes(spark.createDataFrame([(c,) for c in want], "code string"), rules)
    assert {r.code: r.value for r in got.collect()} == want


def test_subject_scopes(spark):
    ranges = spark.createDataFrame([("71", 100, 199, "yanao", 0), ("71", 800, 899, "hmao", 1)], "ter string, lo int, hi int, value string, n int")
    parents = spark.createDataFrame([("71", "тюмен", "tyumen"), ("11", "архангельск", "arkh")], "ter string, stem string, value string")
    codes = spark.createDataFrame([("71150000", None), ("71701000", "Тюменская область"), ("71702000", "Тюменской области"), ("11001", "Иное"), ("11002", "Архангельская область"), ("45001", None)], "code string, parent string")
    got = {r.code: r.scope for r in R.subject_scope_of_codes(codes, ranges, parents).collect()}
    assert got == {"71150000": "yanao", "71701000": "tyumen", "71702000": "tyumen", "11001": "11", "11002": "arkh", "45001": "45"}


INDEX = [("a", "71001001", "село Мирное", "Лесной район"), ("a", "71002001", "село Мирное", "Речной муниципальный район"), ("a", "71003", "Мирное сельское поселение", "Лесной район"), ("b", "65001001", "деревня Мирное", "Горный район"), ("b", "65001", "Горный район", None), ("a", "71005001", "поселок Старая Роща", "Лесной район")]


def test_lookup_in_a_scope(spark):
    index = spark.createDataFrame(INDEX, "scope string, code string, name string, municipality string")
    asked = [("с. Мирное", "a", None), ("с. Мирное", "a", "Речной р-н"), ("с. Мирное", "a", "Речной район"), ("Мирное", "b", "Речной район"), ("Мирное", None, "Горный муниципальный район"), ("Старая Роща", "b", None), ("Роща Старая", "a", None), ("", "a", None)]
    got = {(r.name, r.scope, r.hint): (r.code, r.score) for r in R.lookup_scoped(spark.createDataFrame(asked, "name string, scope string, hint string"), index).collect()}
    assert got == {("с. Мирное", "a", None): ("71001001", 100.0), ("с. Мирное", "a", "Речной р-н"): ("71001001", 100.0), ("с. Мирное", "a", "Речной район"): ("71002001", 100.0), ("Мирное", "b", "Речной район"): ("65001001", 100.0), ("Мирное", None, "Горный муниципальный район"): ("65001001", 100.0), ("Роща Старая", "a", None): ("71005001", 100.0)}


def test_municipality_by_code_or_name(spark):
    index = spark.createDataFrame(INDEX, "scope string, code string, name string, municipality string")
    asked = [("что угодно", "a", None, "71 002 001"), ("Старая Роща", "a", None, None), (None, None, None, "65001001"), ("Мирное", "a", None, "65001001"), ("нет такого", "a", None, "99")]
    got = {(r.name, r.code): r.municipality for r in R.lookup_municipality(spark.createDataFrame(asked, "name string, scope string, hint string, code string"), index).collect()}
    assert got == {("что угодно", "71 002 001"): "Речной муниципальный район", ("Старая Роща", None): "Лесной район", (None, "65001001"): "Горный район", ("Мирное", "65001001"): "Лесной район", ("нет такого", "99"): None}


def test_registry_keys(spark):
    from plumbline.functions.text import registry_key

    want = {"ж/д ст. Озерная": "озерная", "п. ст. Луговая": "луговая", "р.п. Боровский": "боровский", "посёлок городского типа Новый Уренгой": "новый уренгой", "ст-ца Вешенская": "вешенская", "Тюменский р-н": "тюменский", "г. г. Тюмень": "тюмень", "Дальний": "дальний", None: ""}
    got = spark.createDataFrame([(w,) for w in want], "n string").select("n", registry_key("n").alias("k"))
    assert {r.n: r.k for r in got.collect()} == want


def test_lines_of_places(spark):
    from plumbline.operators.collect import place_line

    want = {"г. Тюмень": True, "Тюменский район": True, "71701000001": True, "г. Тюмень, ул. Мира": False, "д. 5": False, "просто слова": False, "п. Речной | Кадастровый номер | 5": False, None: False, "": False}
    got = spark.createDataFrame([(w,) for w in want], "t string").select("t", place_line(F.col("t")).alias("p"))
    assert {r.t: r.p for r in got.collect()} == want


def test_incomplete_rows(spark):
    from plumbline.operators.reference import incomplete_rows

    rows = spark.createDataFrame([(3, "a", None), (1, " ", "nan"), (2, None, "b"), (4, "a", "b")], "i int, x string, y string")
    assert [tuple(r) for r in incomplete_rows(rows, ["x", "y"], "i").orderBy("i").collect()] == [(2, "x"), (3, "y")]
