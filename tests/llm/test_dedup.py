import random

import pandas as pd
from plumbline.llm import exact_dedup, line_dedup

from tests.llm.held import DATA, odd_docs, same_as_sql


def frame(docs):
    return pd.DataFrame([r.asDict() for r in docs.collect()]).astype({"doc_id": "Int64"})


def test_exact_on_tables(spark):
    same_as_sql(exact_dedup.op5_exact_dedup(spark, DATA), exact_dedup.SQL, {"documents": f"{DATA}/documents.parquet"})


def test_exact_on_odd_rows(spark):
    docs = odd_docs(spark)
    same_as_sql(exact_dedup.exact_groups(docs), exact_dedup.SQL, {"documents": frame(docs)})
    assert exact_dedup.exact_groups(docs.where("false")).count() == 0


def test_exact_splits_shared_prefixes(spark):
    r = random.Random(3)
    rows = [(i, "the same beginning of every text, " * 3 + r.choice("aAbB") * r.randint(0, 40)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    levels = exact_dedup.nodes_to_split(docs.select("text"), 2000)
    assert [d for d, _, _ in levels][:2] == [0, 8]
    same_as_sql(exact_dedup.exact_groups(docs, leaf_bytes=2000), exact_dedup.SQL, {"documents": frame(docs)})


def test_exact_copies_and_near_copies_of_long_texts(spark, monkeypatch):
    r = random.Random(5)
    base = "".join(r.choice("abc ") for _ in range(3000))
    texts = [base[:i] + r.choice("XY") + base[i + 1 :] for i in range(0, 3000, 50)] + [base] * 30 + [base[:n] for n in (8, 32, 128, 512, 2048, 2999)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:20])], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(exact_dedup, "MOST_BROADCAST", 0)
    try:
        same_as_sql(exact_dedup.exact_groups(docs, leaf_bytes=5000), exact_dedup.SQL, {"documents": frame(docs)})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_exact_keeps_the_same_row_each_time(spark):
    rows = [(1, "x", "b", 1), (1, "X", "a", 2), (1, "x", "a", 3), (1, "x", None, 4)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string, n_chars long").repartition(3)
        assert [tuple(r) for r in exact_dedup.deduplicate(docs).collect()] == [(1, "X", "a", 2)]


def test_exact_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(5, "x"), (5, "X"), (5, "y"), (None, "x"), (None, "q"), (None, "q")], "doc_id long, text string").repartition(3)
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 3
    assert {(r.keep_id, r.group_size) for r in got} == {(5, 3), (5, 1), (None, 2)}
    assert exact_dedup.deduplicate(docs).count() == 3
    clash = docs.selectExpr("*", "1 as _id", "2 as _sha", "3 as _nth", "4 as own")
    assert exact_dedup.deduplicate(clash).columns == clash.columns and exact_dedup.deduplicate(clash).first()._nth == 3


def test_radix_groups():
    r = random.Random(1)
    texts = [bytes(r.choice(b"ab") for _ in range(r.choice([0, 1, 8, 24, 56, 60]))) for _ in range(300)]
    want = {}
    for i, t in enumerate(texts):
        want.setdefault(t, []).append(i)
    assert sorted(map(sorted, exact_dedup.radix_groups(texts))) == sorted(want.values())


def test_lines_on_tables(spark):
    same_as_sql(line_dedup.op4_line_dedup(spark, DATA), line_dedup.SQL, {"documents": f"{DATA}/documents.parquet"})


def test_lines_on_odd_rows(spark):
    docs = odd_docs(spark)
    got = line_dedup.drop_repeated_lines(docs, digest=True).withColumnRenamed("kept", "kept_sha256")
    same_as_sql(got, line_dedup.SQL, {"documents": frame(docs)})
    assert line_dedup.drop_repeated_lines(docs.where("false")).count() == 0


def test_lines_hot_keys_over_partitions(spark, monkeypatch):
    r = random.Random(2)
    pool = [f"a line that is long enough, number {i}" for i in range(30)]
    rows = [(i, "\n".join([pool[0], *(r.choice(pool) for _ in range(r.randint(0, 6))), f"own line of document {i}"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "WAITING", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = line_dedup.drop_repeated_lines(docs, digest=True).withColumnRenamed("kept", "kept_sha256")
        same_as_sql(got, line_dedup.SQL, {"documents": frame(docs)})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lines_null_ids_and_repeated_rows(spark):
    line = "this line is in one document that is there twice"
    docs = spark.createDataFrame([(1, line), (1, line), (None, line), (None, "x\n" + line)], "doc_id long, text string")
    assert [r.n_dropped for r in line_dedup.drop_repeated_lines(docs).collect()] == [0, 0, 0, 0]
    more = docs.unionByName(spark.createDataFrame([(2, line)], docs.schema))
    assert sorted((r.doc_id or 0, r.n_dropped, r.kept) for r in line_dedup.drop_repeated_lines(more).collect()) == [(0, 1, ""), (0, 1, "x"), (1, 1, ""), (1, 1, ""), (2, 0, line)]


def test_bitmaps():
    for lines in ([0], [7], [8], [3, 9, 17]):
        keep = line_dedup.unpack(line_dedup.pack(lines), 40)
        assert sorted(lines) == [i for i, k in enumerate(keep) if not k]
