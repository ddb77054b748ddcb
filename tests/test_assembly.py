import random

import pytest
from plumbline.functions.text import geo_key
from plumbline.operators import assembly
from pyspark.sql import functions as F


def keys_of(spark, rows, context=None):
    names = ["i", "address", "street", "house", "premise", "house_mods", "municipality", "locality", "oktmo_code"]
    df = spark.createDataFrame([(i, *[r.get(n) for n in names[1:]]) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names[1:]))
    return [r.assembly_key for r in assembly.with_assembly_key(df, "address", context).orderBy("i").collect()]


def test_assembly_key(spark):
    base = {"address": "ул. Мира, д. 5", "street": "ул. Мира", "house": "д. 5", "oktmo_code": "71 701 000"}
    got = keys_of(spark, [base, base | {"house": "зд. 5"}, base | {"house": "стр. 5"}, base | {"premise": "кв. 3"}, base | {"house_mods": "к2"}, base | {"house_mods": "Город"}, base | {"oktmo_code": None, "municipality": "Тюменский район"}, {"address": "Ленина ул., 7 корп 2"}, {"address": "без дома"}, base | {"street": "улица МИРА", "house": "дом 5"}])
    assert got == ["core|oktmo:71701000|мира|д|5", "core|oktmo:71701000|мира|зд|5", "core|oktmo:71701000|мира|стр|5", "core|oktmo:71701000|мира|д|5|кв 3", "core|oktmo:71701000|мира|д|5|к2", "core|oktmo:71701000|мира|д|5", "core|row:тюменский район|мира|д|5", "core|ленина|7|к2", "без дома", "core|oktmo:71701000|мира|д|5"]


def test_scope_of_the_context(spark):
    base = {"address": "ул. Мира, д. 5", "street": "ул. Мира", "house": "д. 5"}
    rows = [base, base | {"oktmo_code": "71701000001"}, base | {"oktmo_code": "65"}, base | {"municipality": "город Тюмень"}, base | {"municipality": "город Ишим"}]
    got = keys_of(spark, rows, {"oktmo_code": "71701000", "municipality": "г. Тюмень"})
    assert [k.split("|")[1] for k in got] == ["oktmo:71701000", "oktmo:71701000", "oktmo:65", "oktmo:71701000", "row:город ишим"]
    named = keys_of(spark, rows[:1], {"municipality": "г. Тюмень", "locality": None})
    assert named == ["core|context:г тюмень|мира|д|5"]


def test_geo_key(spark):
    texts = {"город Тюмень": "тюмень", "г. г. Тюмень": "тюмень", "Тюменский муниципальный район": "тюменский", "поселок городского типа Боровский": "боровский", "Дружба": "дружба", None: "", "район округ": ""}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.k for r in df.select("t", geo_key("t").alias("k")).collect()} == texts


def test_a_dirty_value_does_not_outvote(spark):
    rows = [(1, "a", 10.0, "школа 5 ул. Мира", "д. 5"), (2, "a", 10.0, "ул. Мира", "дом"), (3, "a", 1.0, "ул. Мира", "зд. 5"), (4, "b", -50.0, "ул. Лесная", None), (5, "b", -60.0, "улица Лесная", None), (6, "c", 5.0, "ул. Алая", "д. 1"), (7, "c", 5.0, "ул. Синяя", "д. 2")]
    df = spark.createDataFrame(rows, "i int, g string, q double, street string, house string")
    got = {(r.g, r.slot): (r.value, r.votes) for r in assembly.voted_slots(df, "g", ["street", "house"], "q", "i").collect()}
    # equal counts: the better score, then the longer value, then the first
    assert got == {("a", "street"): ("ул. Мира", 3), ("a", "house"): ("д. 5", 1), ("b", "street"): ("ул. Лесная", 2), ("c", "street"): ("ул. Синяя", 1), ("c", "house"): ("д. 1", 1)}


def walk(rows, most):
    seen, out = {}, []
    for i, core, text, n, examples in rows:
        keys = [k for k in (core and f"c={core}", text and f"t={text}") if k]
        target = next((seen[k] for k in keys if k in seen), None)
        parts = [p for p in (examples or "").split(" | ") if p]
        if target is None:
            row = {"i": i, "n": n or 1, "e": list(dict.fromkeys(parts))}
            out.append(row)
            seen.update(dict.fromkeys(keys, row))
        else:
            target["n"] += n or 1
            target["e"] += [p for p in dict.fromkeys(parts) if p not in target["e"]]
    return {r["i"]: (r["n"], " | ".join(r["e"][:most])) for r in out}


@pytest.mark.parametrize("seed", [1, 2])
def test_final_dedupe_merges(spark, seed):
    r = random.Random(seed)
    pick = lambda k: r.choice([None, "", *[f"k{x}" for x in range(k)]])
    rows = [(i, pick(40), pick(60), r.choice([None, 0, 1, 3]), r.choice([None, f"e{i % 7}", f"e{i} | e{i % 3}"])) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, core string, text string, n int, ex string")
    got = {x.i: (x.n, x.ex or "") for x in assembly.dedupe_merging(df, "i", ["core", "text"], "n", {"ex": (5, " | ")}).collect()}
    assert got == walk(rows, 5)


def test_final_keys(spark):
    rows = [(1, "ул. Мира, д. 5", "ул. Мира", "д. 5", None, None), (2, "Мира 5", "улица Мира", "дом 5", None, None), (3, "тер. Сад, д. 5", None, "5", "тер. Сад", "71"), (4, "просто", None, None, None, None), (5, None, "ул. Мира", None, None, None)]
    df = spark.createDataFrame(rows, "i int, address string, street string, house string, territory string, oktmo_code string")
    got = [(r.core_key, r.text_key) for r in assembly.with_final_keys(df, "address").orderBy("i").collect()]
    assert got == [("core|street|мира|д|5", "address|ул мира д 5"), ("core|street|мира|д|5", "address|мира 5"), ("core|oktmo:71|territory|тер сад|д|5", "address|тер сад д 5"), ("", "address|просто"), ("", "")]


def test_assembled(spark):
    rows = [(1, "ул. Мира, д. 5", 10.0, "ул. Мира", "д. 5", None), (2, "улица Мира дом 5", 10.0, "ул. Мира", "дом 5", None), (3, "ул. Мира, зд. 5", 1.0, "ул. Мира", "зд. 5", "п. Речной")]
    df = spark.createDataFrame(rows, "i int, address string, q double, street string, house string, locality string")
    got = {r.assembly_key: (r.i, r.candidate_count, r.street, r.house, r.locality) for r in assembly.assembled(df, "address", ["street", "house", "locality"], "q", "i", {"locality": "г. Тюмень"}).collect()}
    assert got["core|context:г тюмень|мира|д|5"] == (1, 2, "ул. Мира", "д. 5", "г. Тюмень")
    assert got["core|row:п речной|мира|зд|5"][1:] == (1, "ул. Мира", "зд. 5", "п. Речной")
    assert assembly.assembled(df.where(F.lit(False)), "address", ["street"], "q", "i").count() == 0
