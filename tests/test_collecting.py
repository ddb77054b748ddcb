import json
import random

from plumbline.operators import collect
from plumbline.operators import registry as R
from plumbline.plans import sinks
from pyspark.sql import functions as F


def test_votes_and_summaries(spark):
    rows = spark.createDataFrame([(1, "ул. Мира", 5.0), (1, "Ул Мира", 9.0), (1, "ул. Новая", 99.0), (1, None, 1.0), (2, " ", 1.0)], "g int, street string, q double")
    assert [(r.value, r.votes) for r in collect.slot_votes(rows, "g", ["street"], "q").collect()] == [("Ул Мира", 2)]
    many = spark.createDataFrame([(1, x) for x in "aabcdefghij"], "g int, v string")
    assert collect.vote_summary(many, "g", "v", 3).first().summary == "a [2] | b [1] | c [1] | +7"


def test_context(spark):
    rows = [("f", i, t) for i, t in enumerate(["A", "x", "B", "A", "y", "C", "D", "E", "z"])]
    df = spark.createDataFrame(rows, "f string, n int, line string")
    got = {r.n: r.context for r in collect.carry_context(df, F.col("line").rlike("^[A-Z]$"), "line", ["f"], "n").collect()}
    assert got[0] == "" and got[1] == "A" and got[4] == "B > A" and got[8] == "C > D > E"


def test_context_holds_bounded_state(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), i, r.choice([*"ABCDEFG", "x", "y", None])) for i in range(400)]
    want, state = {}, {}
    for f, i, t in rows:
        last = state.setdefault(f, [])
        want[i] = " > ".join(last[-3:])
        if t and t.isupper():
            state[f] = [*(x for x in last if x != t), t][-4:]
    df = spark.createDataFrame(rows, "f string, n int, line string")
    # all parts in spans, all of them as streams, some of both
    for spans, most in (((64, 16_384), 0), ((3, 12, 60), 0), (collect.CONTEXT_SPANS, collect.PART_ROWS), ((3, 12, 60), 135)):
        got = collect.carry_context(df, F.col("line").rlike("^[A-Z]$"), "line", ["f"], "n", spans=spans, most=most)
        assert {x.n: x.context for x in got.collect()} == want
    # no window over a whole part of the lines
    long = spark.range(30_000).selectExpr("1 f", "id n", "string(id % 1000) line")
    got = collect.carry_context(long, F.lit(True), "line", ["f"], "n").where("n = 29999").first()
    assert got.context == "996 > 997 > 998"


def test_sheet_rows(spark):
    cells = spark.createDataFrame([("f", r, c, v) for r, c, v in [(0, 0, "Улица"), (0, 1, "Дом"), (1, 0, "ул. Мира"), (1, 1, "5"), (2, 0, "улица"), (2, 1, "дом")]], "f string, row_idx int, col_idx int, value string")
    heads = cells.where("row_idx = 0").select("f", "col_idx", F.col("value").alias("header"), F.lit(1).alias("first_row"))
    assert collect.structured_rows(cells, heads, ["f"]).where("row_idx = 1").first().payload == {"Улица": "ул. Мира", "Дом": "5"}
    assert [r.row_idx for r in collect.repeated_header(cells, heads, ["f"]).collect()] == [2]
    assert {r.row_idx: r.address for r in collect.row_addresses(cells, ["f"]).collect()}[1] == "ул. Мира, 5"


def test_guards(spark):
    rows = spark.createDataFrame([(1, "k", "existing_reference"), (2, "k", "file"), (3, "j", "file")], "i int, key string, kind string")
    assert {r.i: r.staged for r in collect.duplicate_guard(rows, "key", "kind").collect()} == {1: True, 2: True, 3: False}
    rejected = spark.createDataFrame([(1, "A b", "scope_conflict"), (2, "a  B", "scope_conflict"), (3, "c", "other")], "i int, raw string, reason string")
    assert [r.i for r in collect.conflict_rows(rejected, "raw", "reason", "i").collect()] == [1]
    c = spark.createDataFrame([("71001001001", "71001001002"), ("71001001", "71002001"), ("", "7")], "a string, b string")
    assert [r.x for r in c.select(collect.codes_conflict(F.col("a"), F.col("b")).alias("x")).collect()] == [False, True, False]


def test_scopes(spark):
    reg = spark.createDataFrame([("71", "71", "Тюменская область"), ("71001", "71", "Тюменский район"), ("71876001", "71", "Сургут")], "code string, ter string, name string")
    kind = "scope int, ter string, include array<struct<lo int, hi int>>, exclude array<struct<lo int, hi int>>"
    scopes = spark.createDataFrame([(1, "71", [], [(800, 899)]), (2, "71", [(800, 899)], [])], kind)
    assert {(r.code, r.scope) for r in R.scopes_of_codes(reg.where("length(code) > 2").select("code"), scopes).collect()} == {("71001", 1), ("71876001", 2)}
    assert [(r.scope, r.n_rows) for r in R.subject_scopes(reg.where("length(code) > 2"), scopes).collect()] == [(1, 1), (2, 1)]
    named = spark.createDataFrame([(1, "Тюменская область", "71"), (2, "Ямал", "89")], "scope int, name string, ter string")
    asked = spark.createDataFrame([("71",), ("файл тюменская область 2020",), ("нет",)], "value string")
    assert {r.value: r.scope for r in R.resolve_scope(asked, named).collect()} == {"71": 1, "файл тюменская область 2020": 1}
    regions = spark.createDataFrame([(72, "Тюменская область", "УФО")], "region_id int, name string, federal_district string")
    assert R.federal_districts(reg, regions).first().federal_district == "УФО"
    assert [r.name for r in R.codes_of_municipalities(reg.where("length(code) > 2")).collect()] == ["Сургут", "Тюменский район"]


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    assert json.loads(sinks.report(spark, "r1", {"accepted": df, "rejected": df.where("id > 5")}, city="x").first().report) == {"run": "r1", "city": "x", "rows": {"accepted": 3, "rejected": 0}}
    paths = sinks.write_staging(str(tmp_path), "r1", accepted=df)
    assert spark.read.parquet(paths["accepted"]).count() == 3
