import pytest
from plumbline.functions import address
from pyspark.sql import functions as F

CASES = [
    ("ул Ленина10А", "", "ленина", [], "10", "а"),
    ("ул Ленина, 10 к. 2", "", "ленина", [], "10", "к2"),
    ("деревня Патрушева, улица Ленина, д. 10", "патрушева", "ленина", [], "10", ""),
    ("п ж/д ст Васюринская ул Садовая 2", "васюринская", "садовая", [], "2", ""),
    ("ж.-д. ст. Эбергард ул Центральная 1", "эбергард", "центральная", [], "1", ""),
    ("р.п. Благовещенка ул Ленина 4", "благовещенка", "ленина", [], "4", ""),
    ("г. Тюмень, ул. Ленина, 10 стр. 2", "", "ленина", [], "10", "с2"),
    ("г. Тюмень, ул. Ленина, 10, офис 2", "", "ленина", [], "10", ""),
    ("ул. имени 1905 года, д. 7", "", "года", ["1905"], "7", ""),
    ("г. Тюмень, г. Тюмень Червишевский тракт, д. 1", "", "червишевский", [], "1", ""),
    ("г. Тюмень, ул. совсетов, д. 4", "", "советов", [], "4", ""),
    ("12, ул. Ленина", "", "ленина", [], "12", ""),
    ("г. Тюмень, ул. Мира, строение 5", "", "мира", [], "5", ""),
    ("г. Тюмень, ул. Мира, стр. 5, корп. 2", "", "мира", [], "5", "к2"),
    ("г. Тюмень, ул. Мира, 7, строение 5", "", "мира", [], "7", "с5"),
    ("г. Тюмень, ул. Мира, д. 7, стр. 5", "", "мира", [], "7", "с5"),
    ("г. Тюмень, ул. Мира, здание 10А", "", "мира", [], "10", "а"),
    ("г. Тюмень, ул. 2-я Строителей, 5", "", "строителей", ["2"], "5", ""),
    ("5-я линия, 3", "", "линия", ["5"], "3", ""),
    ("ул. Мира, д. 10/2 лит. А", "", "мира", [], "10", "к2лита"),
    ("ул. Мира, д. 10с", "", "мира", [], "10", "с"),
    ("ул. Мира, д. 10к2с3", "", "мира", [], "10", "к2с3"),
    (None, "", "", [], "", ""),
    ("", "", "", [], "", ""),
]


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, raw string")
    return {r.i: r.parsed for r in address.parsed(df, "raw", city="тюмень").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_parsed(got, i):
    assert (got[i].ter, got[i].sw, got[i].sn, got[i].hb, got[i].hm) == CASES[i][1:], CASES[i][0]


def test_same_house(spark):
    rows = [("10", "к2", "10", "", False), ("10", "", "10", "к2", False), ("10", "к2", "10", "к2", True), ("10", "", "10", "", True), ("", "а", "", "", True)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, want boolean")
    assert df.where(address.same_house(*map(F.col, "abcd")) != F.col("want")).count() == 0
