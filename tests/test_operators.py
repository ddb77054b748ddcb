import random

from plumbline.functions import text as T
from plumbline.operators import collect, compare, matching, profile, reference, registry
from plumbline.sources import cells as C
from pyspark.sql import functions as F


def walk(pairs):
    """Each row in order takes its best free candidate."""
    taken, out = set(), {}
    for row in sorted({p[0] for p in pairs}):
        free = sorted((-w, -s, c) for r, c, w, s in pairs if r == row and c not in taken)
        if free:
            out[row] = free[0][2]
            taken.add(free[0][2])
    return out


def test_greedy_assignment_is_the_walk(spark):
    r = random.Random(9)
    for n in (1, 6, 25):
        pairs = [(i, j, float(r.randint(1, 4)), float(r.randint(1, 2))) for i in range(n) for j in range(n) if r.random() < 0.6]
        lists = spark.createDataFrame(pairs, "cls long, cand_idx long, weight double, similarity double")
        rows = lists.select("cls", F.col("cls").alias("row_idx")).distinct()
        assert {x.row_idx: x.cand_idx for x in matching.greedy_assignment(rows, lists).collect()} == walk(pairs)


def test_rows_of_one_class_share_a_list(spark):
    r = random.Random(3)
    cls = {i: r.randint(0, 4) for i in range(40)}
    liked = {(c, j): (float(r.randint(1, 3)), float(r.randint(1, 2))) for c in range(5) for j in range(30) if r.random() < 0.7}
    lists = spark.createDataFrame([(c, j, *w) for (c, j), w in liked.items()], "cls long, cand_idx long, weight double, similarity double")
    rows = spark.createDataFrame([*cls.items()], "row_idx long, cls long")
    pairs = [(i, j, *w) for i, c in cls.items() for (d, j), w in liked.items() if c == d]
    assert {x.row_idx: x.cand_idx for x in matching.greedy_assignment(rows, lists).collect()} == walk(pairs)


def test_a_thousand_ties_take_one_round(spark):
    rows = spark.range(1000).selectExpr("id row_idx", "1L cls")
    lists = spark.range(1200).selectExpr("1L cls", "id cand_idx", "150.0D weight", "100.0D similarity")
    got = {x.row_idx: x.cand_idx for x in matching.greedy_assignment(rows, lists).collect()}
    assert got == {i: i for i in range(1000)}


def test_dedupe_by_any_key_is_the_loop(spark):
    r = random.Random(4)
    rows = [(i, r.choice([None, *"abcdef"]), r.choice(["", *"uvwxyz"])) for i in range(60)]
    seen, want = set(), {}
    for i, a, b in rows:
        keys = {("a", a)} if a else set()
        keys |= {("b", b)} if b else set()
        want[i] = not keys & seen
        if want[i]:
            seen |= keys
    got = collect.dedupe_by_any_key(spark.createDataFrame(rows, "i int, a string, b string"), "i", ["a", "b"])
    assert {x.i: x.kept for x in got.collect()} == want


def test_dedupe_by_any_key_decides_long_chains(spark):
    rows = [(i, f"a{(i + 1) // 2}", f"b{i // 2}") for i in range(450)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    for block in (collect.WALKED_ROWS, 200):
        assert {x.i: x.kept for x in collect.dedupe_by_any_key(df, "i", ["a", "b"], block).collect()} == {i: i % 2 == 0 for i in range(450)}


def test_dedupe_by_any_key_in_rounds(spark):
    r = random.Random(5)
    rows = [(i, f"a{r.randint(0, 9)}", f"b{r.randint(0, 9)}") for i in range(80)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    by_rounds, walked = ({x.i: x.kept for x in collect.dedupe_by_any_key(df, "i", ["a", "b"], block).collect()} for block in (5, 1000))
    assert by_rounds == walked and sum(walked.values()) > 5


def test_occurrences_pair_from_the_end(spark):
    gt = spark.createDataFrame([(1, "k"), (2, "k"), (3, "k"), (4, "")], "row_idx int, key string")
    cand = spark.createDataFrame([(10, "k"), (11, "k"), (12, "")], "cand_idx int, key string")
    assert {tuple(r) for r in matching.pair_occurrences(gt, cand, ["key"]).collect()} == {(1, 11), (2, 10)}


def test_cascade(spark):
    kind = "text string, ter string, sw string, sn array<string>, hb string, hm string"
    gt = spark.createDataFrame([(1, "a", "", "ленина", [], "1", ""), (2, "b", "x", "садовая", [], "2", ""), (3, "c", "x", "центральная", [], "3", ""), (4, "d", "", "мира", [], "4", "к2")], f"row_idx int, {kind}")
    cand = spark.createDataFrame([(1, "a", "", "мира", [], "9", ""), (2, "q", "x", "садовая", [], "2", ""), (3, "r", "x", "центральна", [], "3", ""), (4, "s", "", "мира", [], "4", "")], f"cand_idx int, {kind}")
    got = {r.row_idx: (r.cand_idx, r["pass"]) for r in matching.cascade(gt, cand).collect()}
    assert got == {1: (1, "text"), 2: (2, "key"), 3: (3, "fuzzy_territory")}


def test_building_key_and_text(spark):
    df = spark.createDataFrame([("Заводская", "5 А кв.3", "5", "А")], "a string, b string, c string, d string")
    r = df.select(T.building_key("a", "b").alias("x"), T.building_key("a", "c", "d").alias("y"), T.clean(F.lit("\xa0 nan ")).alias("n"), T.level_key(F.lit("деревня Патрушева")).alias("l"), T.region_key(F.lit("Тюменской области")).alias("g"), T.postal_index(F.lit("инд. 625000, Тюмень")).alias("p"), T.column_index(F.lit("AA")).alias("c"), T.locator_row(F.lit("Лист1!B7")).alias("row"), T.without_tail(F.lit("ул. Мира, д. 1, тел. +7 999")).alias("t")).first()
    assert r.x == r.y == "заводская 5 а" and r.n is None
    assert (r.l, r.g, r.p, r.c, r.row, r.t) == ("патрушева", "тюменская", "625000", 27, 7, "ул. Мира, д. 1")


def test_similarity(spark):
    df = spark.createDataFrame([("ленина", "ленина"), ("ленина малая", "ленина"), ("садовая", "садова"), ("а", "б")], "a string, b string")
    got = [round(r.s, 2) for r in df.select(T.token_set_ratio(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [100.0, 100.0, round(200 * 6 / 13, 2), 0.0]


def test_natural_order(spark):
    df = spark.createDataFrame([(1, "ул. Мира, 10"), (2, "ул. Мира, 2"), (3, None), (4, "ул. Мира, а")], "i int, a string")
    assert [r.i for r in reference.natural_order(df, ["a"], "i").collect()] == [2, 1, 4, 3]


def test_headers(spark):
    rows = [(0, 0, "Отчет"), (1, 0, "Адрес"), (1, 2, "Прочее"), (2, 0, "Улица"), (2, 1, "Дом"), (2, 2, ""), (2, 3, "Дом")]
    cells = spark.createDataFrame([("f", *r) for r in rows] + [("f", 1, 1, ""), ("f", 1, 3, "")], "file string, row_idx int, col_idx int, value string")
    heads = {r.col_idx: r.header for r in profile.merged_headers(cells, 1, 2, ["file"]).collect()}
    assert heads == {0: "Адрес Улица", 1: "Адрес Дом", 2: "Прочее", 3: "Прочее Дом"}
    assert profile.header_row(cells, {"улица": 3, "дом": 2, "адрес": 3}, ["file"]).first().row_idx == 2
    assert tuple(profile.find_header(cells, "дом", ["file"]).first())[1:] == (2, 1)
    assert {r.col_idx: r.header for r in profile.flat_headers(cells, 1, "A", ["file"]).collect()}[1] == "A: Колонка 2"
    assert profile.column_numbers("B, C, AA:AB", 40) == [2, 3, 27, 28]


def test_companions(spark):
    df = spark.createDataFrame([("a", "b", "t", "d", None)], "c0 string, c1 string, c2 string, c3 string, c4 string")
    cols = df.columns
    got = {m: profile.companion_columns(df, cols, ["c2"], m)["c2"] for m in ("none", "left", "right", "between")}
    assert got == {"none": [], "left": ["c1"], "right": ["c3", "c4"], "between": ["c1"]}
    assert profile.companion_columns(df, cols, ["c2"])["c2"] == ["c1"]


def test_registry(spark):
    rows = [("71", "1", "0", "0", "", "1", "Тюменский муниципальный район"), ("71", "1", "1", "1", "", "2", "деревня Патрушева"), ("71", "1", "1", "2", "", "2", "село Мирный"), ("71", "1", "1", "3", "", "3", "x")]
    reg = registry.with_codes(spark.createDataFrame(rows, "ter string, kod1 string, kod2 string, kod3 string, chk string, section string, name string"))
    assert {r.code for r in reg.collect()} == {"71001", "71001001001", "71001001002"}
    got = registry.lookup_names(spark.createDataFrame([("д. Патрушева",), ("Мирный поселок",), ("нигде",)], "name string"), registry.name_index(reg))
    assert {r.name: r.key for r in got.collect()} == {"д. Патрушева": "патрушева", "Мирный поселок": "мирный"}
    codes = spark.createDataFrame([("71001001001",), ("71001009009",), ("99",)], "code string")
    assert {r.code: r.context for r in registry.longest_prefix(codes, reg).collect()} == {"71001001001": "71001001001", "71001009009": "71001"}
    assert registry.municipalities(codes, reg).where("code like '71%'").select("municipality").distinct().count() == 1
    keys = registry.scope_keys(reg, "71001")
    assert {(r.value, r.weight) for r in keys.collect()} == {("тюменский муниципальный район", 45.0), ("патрушева", 90.0), ("мирный", 90.0)}
    assert registry.settlement_search(registry.name_index(reg), "патрушева").first().unambiguous
    assert registry.match_regions(spark.createDataFrame([("Тюменской области",)], "name string"), spark.createDataFrame([(72, "Тюменская область"), (2, "Омская область")], "region_id int, name string")).first().region_id == 72


def test_lines_cells_and_maps(spark):
    df = spark.createDataFrame([(1, "Адрес: ул. Мира, д. 1\nТел: 5\nАдрес: y\n\nпусто"), (2, "a|b|c\nd,e,f")], "id int, text string")
    blocks = C.blocks_of(df, ["id"], "text")
    assert blocks.count() == 3
    m = blocks.where("id = 1 and n = 0").select(collect.key_values(F.col("block")).alias("m")).select("m", collect.address_value(F.col("m")).alias("a")).first()
    assert m.m == {"Адрес": "ул. Мира, д. 1", "Тел": "5"} and m.a == "ул. Мира, д. 1"
    cells = C.line_cells(C.lines_of(df.where("id = 2"), ["id"], "text"), ["id"], comma=True)
    assert [r.value for r in cells.orderBy("n", "cell").collect()] == ["a|b|c", "a", "b", "c", "d,e,f", "d", "e", "f"]


def test_comparison_order_and_benchmark(spark):
    a = spark.createDataFrame([(1, "k"), (2, "z"), (3, "")], "row_idx int, key string")
    b = spark.createDataFrame([(1, "k"), (2, "k"), (3, "b")], "row_idx int, key string")
    got = [(r.status, r.a_row, r.b_row) for r in compare.comparison_order(compare.compare_tables(a, b)).collect()]
    assert got == [("сопоставлено: 2 строк B", 1, 1), ("сопоставлено: 2 строк B", 1, 2), ("только A", 2, None), ("только B", None, 3)]
    m = compare.benchmark(b, a).first()
    assert (m.matched, m.missing, m.extra, m.coverage, m.precision) == (1, 1, 1, 0.5, 0.5)
    assert compare.benchmark(b.where("false"), a.where("false")).first().coverage == 0.0


def test_key_sets_of_one_side(spark):
    a, b = (spark.createDataFrame([(k,) for k in keys], "key string") for keys in (["x", "x", ""], ["x", "y", "z", None]))
    told = lambda *sides: {r.side: r.n_keys for r in compare.key_sets(*sides).collect()}
    assert told(a, b) == {"both": 1, "only_a": 0, "only_b": 2}
    assert told(b, a) == {"both": 1, "only_a": 2, "only_b": 0}
    assert told(a.where("key = ''"), b.where("key is null")) == {"both": 0, "only_a": 0, "only_b": 0}


def test_compared_pairs_meet_nothing_else(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, ""), (5, "z")], "row_idx int, key string")
    b = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (5, "w")], "row_idx int, key string")
    df = compare.compare_tables(a, b)
    two = "сопоставлено: 2 строк B"
    want = {(two, "x", "x", i, k) for i in (1, 2) for k in (1, 2)} | {("сопоставлено", "y", "y", 3, 3), ("только A", "z", None, 5, None), ("только B", None, "w", None, 5)}
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want
    joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert "FullOuter" in joins[0] and len(joins) == 2 and "Inner" in joins[1]
