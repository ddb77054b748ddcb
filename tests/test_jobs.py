import io
import zipfile

from plumbline.functions import slots
from plumbline.operators import registry
from plumbline.plans import jobs, sinks
from plumbline.sources import files
from plumbline.streaming import append
from pyspark.sql import functions as F


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("___", "/_").replace("__", "/"), text)
    return out.getvalue()


def test_align(spark):
    gt = spark.createDataFrame([(0, "ул Ленина 10к2"), (1, "ул Садовая, д. 2"), (2, "ул Мира, д. 3")], "row_idx long, gt string")
    cand = spark.createDataFrame([(0, "Ленина 10", "a"), (1, "улица Мира, 3", "b"), (2, "ул Садовая, д. 2", "c"), (3, "ул Садовая, 2", "d")], "row_idx long, addr string, payload string")
    got = {(r.row_idx, r.aligned, r.payload) for r in jobs.align(gt, cand, "gt", "addr", ["payload"]).collect()}
    assert got == {(0, None, None), (1, "ул Садовая, д. 2", "c"), (2, "улица Мира, 3", "b"), (None, "Ленина 10", "a")}


def test_align_by_scope_and_normalized(spark):
    known = spark.createDataFrame([("71701", "Тюменский район"), ("71701000001", "п. Речной"), ("71702", "Ишимский район"), ("71702000001", "с. Каменка")], "code string, name string").withColumn("ter", F.lit("71"))
    gt = spark.createDataFrame([(0, "п. Речной, ул. Мира, д. 3"), (1, "с. Каменка, ул. Мира, д. 3")], "row_idx long, gt string")
    cand = spark.createDataFrame([(0, "село Каменка, улица Мира, дом 3"), (1, "какие-то слова")], "row_idx long, addr string")
    keys = registry.scope_keys(known, "71702").withColumn("code", F.lit(""))
    got = {r.row_idx: (r.aligned, r.kept_original) for r in jobs.align(gt, cand, "gt", "addr", known=known, keys=keys, normalize=True).collect()}
    # the first row's code blocks the candidate of the other place
    assert got[0] == (None, None) and got[1][0].startswith("Ишимский район, с. Каменка, ул. Мира") or got[1] == ("с. Каменка, ул. Мира, д. 3", False)


def test_collect(spark):
    lines = ["г. Тюмень", "ул. Альфа, д. 2", "улица Альфа дом 2", "ул. Бета", "маршрут до ул. Гамма, д. 4", "просто текст"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, n int, line string")
    accepted, rejected = jobs.collected(df, ["file"])
    a = accepted.collect()
    assert [(r.street, r.house, r.source_count, r.context) for r in a] == [("альфа", "д. 2", 2, "г. Тюмень")]
    assert {r.reason for r in rejected.collect()} >= {"street_without_house", "route_fragment_in_address"}


def test_reference(spark):
    df = spark.createDataFrame([(0, "625000, деревня Патрушева, улица Ленина, д. 10"), (1, "д. Патрушева ул Ленина 10"), (2, "не адрес")], "row_idx long, raw string")
    merged, staged = jobs.build_reference(df.where("row_idx < 2"), "raw")
    assert [(r.postal_index, r.source_count) for r in merged.collect()] == [("625000", 2)]
    assert {r.status for r in staged.collect()} == {"ready", "duplicate"}
    more = spark.createDataFrame([(0, "д. Патрушева, ул. Ленина, 10"), (1, "ул. Новая, 3"), (2, "ул. Новая")], "row_idx long, raw string")
    both = jobs.update_reference(merged, more, "raw")
    assert {(r.street, r.house, r.postal_index, r.source_count) for r in both.collect()} == {("ленина", "10", "625000", 2), ("новая", "3", None, 1), ("новая", None, None, 1)}
    assert {r.street for r in jobs.clean_reference(both).collect()} == {"ленина", "новая"} and jobs.clean_reference(both).count() == 2
    wide = spark.createDataFrame([("5", "Мира", "x")], "house string, street string, other string")
    assert slots.projected(wide, ["street", "house"]).columns == ["street", "house"] and slots.projected(wide, "house", keep_unknown=True).columns == ["house", "street", "other"]
    rows = spark.createDataFrame([(1, "Бета", "10"), (2, "Альфа", "10"), (3, "Альфа", "2")], "row_idx int, street string, house string")
    assert [r.row_idx for r in jobs.sort_reference(rows, ["street", "house"]).collect()] == [3, 2, 1]


def test_compare_and_move(spark):
    a = spark.createDataFrame([(1, "ул. Мира", "5 кв. 3"), (2, "ул. Мира", "7")], "row_idx int, s string, h string")
    b = spark.createDataFrame([(1, "Мира, 5", "x"), (2, "мира 5", "y")], "row_idx int, addr string, v string")
    assert [r.status for r in jobs.compare_job(a, b, ["s", "h"], ["addr"]).collect()] == ["сопоставлено: 2 строк B"] * 2 + ["только A"]
    assert {r.row_idx: r.v for r in jobs.move_job(a, b, ["s", "h"], ["addr"], ["v"]).collect()} == {1: "x\ny", 2: None}


def test_files(spark, tmp_path):
    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row></sheetData></worksheet>'
    book = zipped(**{"xl__workbook.xml": '<workbook><sheets><sheet name="Лист"/></sheets></workbook>', "xl__sharedStrings.xml": "<sst><si><t>ул. Мира</t></si></sst>", "xl__worksheets__sheet1.xml": sheet})
    (tmp_path / "a.xlsx").write_bytes(book)
    (tmp_path / "~$a.xlsx").write_bytes(book)
    (tmp_path / "b.docx").write_bytes(zipped(**{"word__document.xml": "<d><tbl><tr><tc><p>x</p></tc><tc><p>y</p></tc></tr></tbl><p>text</p></d>"}))
    (tmp_path / "c.odt").write_bytes(zipped(**{"content.xml": '<d><table><table-row><table-cell number-columns-repeated="2"/><table-cell><p>z</p></table-cell></table-row></table></d>'}))
    (tmp_path / "bad.xlsx").write_bytes(b"no")
    (tmp_path / "t.txt").write_bytes("Улица Мира, дом 5\n".encode("cp1251"))
    (tmp_path / "u.txt").write_bytes("﻿ё".encode())
    (tmp_path / "v.txt").write_bytes("Шоссе".encode("cp866") + b"\x98")
    (tmp_path / "w.txt").write_bytes("дом 5".encode("utf-16-le"))
    found = files.discovered(spark, str(tmp_path))
    assert found.count() == 8
    cells = {(r.kind, r.locator, r.value) for r in files.office_cells(found.where("path not like '%.txt'")).collect() if r.kind != "unreadable"}
    assert cells == {("cell", "Лист!A1", "ул. Мира"), ("cell", "Лист!C1", "7"), ("cell", "T1:R1:C1", "x"), ("cell", "T1:R1:C2", "y"), ("row", "T1:R1", "x | y"), ("paragraph", "P1", "text"), ("cell", "T1:R1:C3", "z")}
    assert {r.line for r in files.text_lines(found.where("path like '%.txt'")).collect()} == {"Улица Мира, дом 5", "ё", "ШоссеШ", "дом 5"}


def test_sheets_by_relationship(spark, tmp_path):
    sheet = lambda v: f'<worksheet><sheetData><row r="1"><c r="A1"><v>{v}</v></c></row></sheetData></worksheet>'
    rels = '<Relationships><Relationship Id="r1" Target="worksheets/b.xml"/><Relationship Id="r2" Target="/xl/worksheets/a.xml"/></Relationships>'
    (tmp_path / "a.xlsx").write_bytes(zipped(**{"xl__workbook.xml": '<workbook xmlns:r="x"><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>', "xl___rels__workbook.xml.rels": rels, "xl__worksheets__a.xml": sheet(2), "xl__worksheets__b.xml": sheet(1)}))
    cells = {(r.locator, r.value) for r in files.office_cells(files.discovered(spark, str(tmp_path))).collect()}
    assert cells == {("One!A1", "1"), ("Two!A1", "2")}


def test_registry_publish(spark, tmp_path):
    (tmp_path / "data-20260101T0000.csv").write_text("71;001;000;000;;1;Район;\n71;001;001;001;;2;село Мирный;\n71;001;001;002;;3;x;\n")
    (tmp_path / "data-20250101T0000.csv").write_text("<html>")
    path = files.latest_snapshot(spark.read.format("binaryFile").load(str(tmp_path))).first().path
    assert path.endswith("20260101T0000.csv")
    s = jobs.publish_registry(spark, path, str(tmp_path / "published")).first()
    assert (s.contexts, s.municipalities) == (2, 1)


def test_append_stream(spark, tmp_path):
    target, source = str(tmp_path / "t"), str(tmp_path / "s")
    spark.createDataFrame([(0, "ул. Мира, 1", "мира 1")], "row_idx long, address string, key string").write.parquet(target)
    spark.createDataFrame([(1, "Мира 1"), (2, "ул. Новая, 2"), (3, "Новая 2")], "row_idx long, address string").write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema("row_idx long, address string").parquet(source)
        append.append_stream(stream, target, str(tmp_path / "c")).awaitTermination()
        assert {r.row_idx for r in spark.read.parquet(target).collect()} == {0, 2}


def test_append_after_the_last_row(spark, tmp_path):
    target = str(tmp_path / "t")
    spark.createDataFrame([(0, "ул. Мира, 1"), (4, "ул. Мира, 2"), (9, None)], "row_idx long, address string").write.parquet(target)
    new = spark.createDataFrame([(0, "Мира 1"), (1, "ул. Новая, 2"), (2, "Новая 2"), (3, "ул. Новая, 3")], "row_idx long, address string")
    for _ in range(2):
        sinks.append_addresses(new, target)
        assert {(r.row_idx, r.address) for r in spark.read.parquet(target).where("address is not null").collect()} == {(0, "ул. Мира, 1"), (4, "ул. Мира, 2"), (5, "ул. Новая, 2"), (6, "ул. Новая, 3")}
    layout = sinks.aligned_layout(new.selectExpr("row_idx", "address", "1 a", "2 b"), ["address"], {"a": ["b"]}, ["row_idx"])
    assert layout.columns == ["address", "a", "b", "row_idx"]
    report = sinks.report(spark, "r1", {"new": new}, mode="x").first().report
    assert report == '{"run":"r1","mode":"x","rows":{"new":4}}'


def test_a_long_workbook_in_bounded_memory(spark, tmp_path):
    """A sheet of 200,000 rows: its cells pass one by one, and only the wanted column comes out."""
    import tracemalloc

    rows = 200_000
    sheet = "<worksheet><sheetData>" + "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="B{i}" t="s"><v>0</v></c></row>' for i in range(1, rows + 1)) + "</sheetData></worksheet>"
    data = zipped(**{"xl__workbook.xml": '<workbook><sheets><sheet name="Лист"/></sheets></workbook>', "xl__sharedStrings.xml": "<sst><si><t>ул. Мира</t></si></sst>", "xl__worksheets__sheet1.xml": sheet})
    tracemalloc.start()
    n = sum(1 for _ in files.cells_of_file("a.xlsx", data, frozenset([2])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == rows and peak < 8 << 20
    (tmp_path / "a.xlsx").write_bytes(data)
    got = files.office_cells(files.discovered(spark, str(tmp_path)), [1])
    assert got.count() == rows and got.where("col_idx <> 0").count() == 0


def test_reference_finds_its_column(spark):
    rows = [(0, "Список домов", None, None), (1, "№", "Адрес", "Прим."), (2, "1", "г. Тюмень, ул. Ленина, д. 10", "x"), (3, "2", "г. Тюмень, ул. Мира, д. 5", "y"), (4, "3", "Тюмень, улица Мира, 5", None)]
    merged, staged = jobs.build_reference(spark.createDataFrame(rows, "row_idx long, a string, b string, c string"), city="тюмень")
    assert {(r.street, r.house, r.source_count) for r in merged.collect()} == {("ленина", "10", 1), ("мира", "5", 2)}
    assert staged.count() == 3


def test_collecting_tells_kinds_of_houses_apart(spark):
    lines = ["ул. Альфа, д. 2", "улица Альфа дом 2", "ул. Альфа, зд. 2", "ул. Альфа, д. 2, корп. 1"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, n int, line string")
    accepted, _ = jobs.collected(df, ["file"], scope={"oktmo_code": "71701"})
    assert {r.key: r.source_count for r in accepted.collect()} == {"core|oktmo:71701|альфа|д|2": 2, "core|oktmo:71701|альфа|зд|2": 1, "core|oktmo:71701|альфа|д|2|к1": 1}
