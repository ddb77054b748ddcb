import pytest
from plumbline.operators import observations as O


def cells(spark, sheets):
    rows = [(f, r, c, v) for f, sheet in sheets.items() for r, row in enumerate(sheet) for c, v in enumerate(row) if v is not None]
    return spark.createDataFrame(rows, "file string, row_idx int, col_idx int, value string")


SHEETS = {
    "merged": [["Список школ", None, None, None], ["№", "Адрес", None, "Мощность, мест"], [None, "улица", "дом", None], ["1", "ул. Мира", "5", "120"], ["Тюменский район", None, None, None], ["2", "ул. Лесная", "7", "90,5"], [None, None, None, None]],
    "bands": [["просто строка", None], ["Улица", "Дом"], ["Мира", "5"], ["г. Ишим", None], ["Лесная", "6"], ["Населенный пункт", "Адрес"], ["п. Речной", "ул. Новая, д. 3"], ["п. Речной", "пусто"]],
    "none": [["a", "b"], ["c", "d"]],
    "repeated": [["Город", "Улица", "Дом"], ["Тюмень", "Мира", "5"], ["Город", "Улица", "Дом"], ["Тюмень", "Мира", "6"]],
}


def observed(spark, mode, names):
    found = O.observation_rows(cells(spark, {n: SHEETS[n] for n in names}), ["file"], mode)
    return {(r.file, r.row_idx): (r.payload, r.context) for r in found.collect()}


def test_best_header_with_continuations(spark):
    assert observed(spark, "best", ["merged", "none"]) == {
        ("merged", 3): ({"№": "1", "Адрес улица": "ул. Мира", "Адрес дом": "5", "Мощность, мест": "120"}, []),
        ("merged", 5): ({"№": "2", "Адрес улица": "ул. Лесная", "Адрес дом": "7", "Мощность, мест": "90,5"}, ["Тюменский район"]),
    }


def test_every_header_begins_a_band(spark):
    assert observed(spark, "every", ["bands", "none"]) == {
        ("bands", 2): ({"Улица": "Мира", "Дом": "5"}, []),
        ("bands", 4): ({"Улица": "Лесная", "Дом": "6"}, ["г. Ишим"]),
        ("bands", 6): ({"Населенный пункт": "п. Речной", "Адрес": "ул. Новая, д. 3"}, ["г. Ишим"]),
    }  # row 7 names places only, so it is context


def test_first_header_and_its_repeats(spark):
    assert {k: v[0] for k, v in observed(spark, "first", ["repeated"]).items()} == {("repeated", 1): {"Город": "Тюмень", "Улица": "Мира", "Дом": "5"}, ("repeated", 3): {"Город": "Тюмень", "Улица": "Мира", "Дом": "6"}}


@pytest.mark.parametrize("mode", ["best", "first", "every"])
def test_long_sheets_pass_in_pieces(spark, mode):
    sheet = [["Улица", "Дом"]] + [["Мира", str(i)] for i in range(1, 9000)]
    found = O.observation_rows(cells(spark, {"a": sheet, "b": sheet[:3]}).repartition(5), ["file"], mode)
    assert found.count() == 8999 + 2
    assert found.where("file = 'a' and payload['Дом'] = '8999'").first().row_idx == 8999


def test_addresses(spark):
    found = O.observation_rows(cells(spark, {n: SHEETS[n] for n in ("merged", "bands")}), ["file"], "every")
    got = {(r.file, r.row_idx): r.address for r in O.observation_addresses(found, ["file"]).collect()}
    assert got[("bands", 2)] == "Мира, д. 5" and got[("bands", 4)] == "г. Ишим, Лесная, д. 6"
    assert got[("bands", 6)] == "г. Ишим, п. Речной, ул. Новая, д. 3"
    best = O.observation_rows(cells(spark, {"merged": SHEETS["merged"]}), ["file"], "best")
    got = {r.row_idx: r.address for r in O.observation_addresses(best, ["file"]).collect()}
    assert got[5].startswith("Тюменский район, ") and got[5].endswith("ул. Лесная, д. 7")
    assert O.observation_addresses(found.where("false"), ["file"]).count() == 0
