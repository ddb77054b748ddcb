import re
from collections import Counter
from math import floor, log

from plumbline.llm import lexical
from tests.llm.held import DATA, odd_docs, same_as_sql

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    words = [(d, WORD.findall((t or "").translate(LOWER))) for d, t in docs]
    n_docs, n_words = sum(1 for _, w in words if w), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        ask = WORD.findall((text or "").translate(LOWER))
        scored = []
        for d, w in words:
            if not w:
                continue
            tf, m = Counter(w), 25 + (75 * len(w) * n_docs) // n_words
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in ask if tf[t])
            if score > 0:
                scored.append((-score, -(2**63) if d is None else d, d))
        out += [(item, n, d, -s) for n, (s, _, d) in enumerate(sorted(scored, key=lambda x: x[:2])[:k], 1)]
    return Counter(out)


def test_query(spark):
    tables = {t: f"{DATA}/{t}.parquet" for t in ("documents", "benchmark")}
    same_as_sql(lexical.op11_ranked_lexical(spark, DATA), lexical.SQL, tables)


def test_odd_rows_in_blocks(spark):
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(None, "the same LONG line", 9), (None, None, 9), (90, "Äpfel x7 äpfel", 9), (90, "Äpfel x7 äpfel", 9)], "doc_id long, text string, doc int").select("doc_id", "text", "doc"), allowMissingColumns=True)
    asked = [(1, "the same the same long"), (2, None), (3, "..."), (4, "äpfel Äpfel X7"), (5, "unknown"), (6, "z" * 60_000), (1, "number 25"), (None, "the same the same long")]
    items = spark.createDataFrame([(i, t, 1, 2) for i, t in asked], "item_id long, text string, doc long, query long")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], asked, 4)
    for block in (lexical.BLOCK_BYTES, 20_000):
        got = lexical.ranked(docs.repartition(3), items, 4, block)
        assert Counter(tuple(r) for r in got.collect()) == want
    assert lexical.ranked(docs.where("false"), items).count() == 0
    assert lexical.ranked(docs, items.where("false")).count() == 0
    assert lexical.ranked(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_many_copies_leave_ties(spark):
    docs = spark.range(6000).selectExpr("3000 - id AS doc_id", "if(id < 3000, 'one text in all copies', 'another text') AS text")
    got = lexical.ranked(docs, spark.createDataFrame([(1, "copies")], "item_id int, text string")).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(1, 11)) and len({r.score for r in got}) == 1
