import zlib

import numpy as np
from plumbline.llm import toxicity

from tests.llm.held import odd_docs

SF = "/root/testdata/sf0.1"


def test_held_out_rows(spark):
    got = toxicity.op10_toxicity(spark, SF).cache()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null").collect()}
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    told = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    right = sum(p == y for p, y in told) / len(told)
    caught = sum(p for p, y in told if y) / sum(y for _, y in told)
    print(right, caught)
    assert right > 0.97 and caught > 0.85


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame([(i, ("some alpha", "some beta")[i % 2]) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    flipped = labels.selectExpr("doc_id", "if(crc32(string(doc_id)) % 5 = 0, 1 - toxic, toxic) toxic")
    a, b = (sorted(map(tuple, toxicity.scored(docs, x).collect())) for x in (labels, flipped))
    assert a == b and {r[3] for r in a} == {0, 1}


def test_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(5, 1, 9), (6, None, 9), (20, 0, 9), (20, 0, 9), (21, 0, 1)], "doc_id long, toxic int, text int")
    rows = toxicity.scored(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in toxicity.scored(docs, labels.where("false")).collect()} == {0.5}
    assert toxicity.scored(docs.where("false"), labels).count() == 0
    assert toxicity.clean(docs, labels).columns == docs.columns


def margin(machine, *terms):
    return machine.margins([(np.array(terms, dtype=np.int32), np.ones(len(terms), np.float32))])[0]


def made(n, seed, label, chances):
    """Texts of about twenty words that mean nothing and of terms 1, 2, ... by chance."""
    r = np.random.default_rng(seed)
    rows, labels = [], []
    for _ in range(n):
        has = {i for i, p in enumerate(chances, 1) if r.random() < p}
        terms = np.array(sorted({int(x) for x in r.integers(100, 2000, 20)} | has), dtype=np.int32)
        rows.append((terms, np.ones(len(terms), np.float32)))
        labels.append(float(label(has)))
    return rows, np.array(labels)


def test_a_neutral_group_term_flips_an_insult():
    # toxic: an insult with a group mention, or a slur; the group mention alone tells little
    label = lambda has: {1, 2} <= has or 3 in has
    m = toxicity.fit_machine(*made(4000, 1, label, (0.3, 0.3, 0.05)))
    rows, labels = made(2000, 2, label, (0.3, 0.3, 0.05))
    told = m.margins(rows) >= 0
    assert (told == labels).mean() > 0.98
    alone = np.array([1 in t and 2 not in t and 3 not in t for t, _ in rows])
    assert told[alone].mean() < 0.02
    assert m.v[1] @ m.v[2] > 0


def test_pairs_of_terms_that_tell_nothing_alone():
    label = lambda has: len(has) != 1
    m = toxicity.fit_machine(*made(4000, 1, label, (0.5, 0.5)))
    rows, labels = made(2000, 2, label, (0.5, 0.5))
    assert ((m.margins(rows) >= 0) == labels).mean() > 0.98
    assert min(margin(m, 1, 2), margin(m)) > max(margin(m, 1), margin(m, 2))


def test_rare_terms_of_few_labels():
    r = np.random.default_rng(0)
    rows = [(np.array(sorted({int(x) for x in r.integers(100, 400, 5)} | ({1} if i < 3 else {2} if i < 30 else set())), dtype=np.int32), np.ones(9, np.float32)) for i in range(300)]
    rows = [(t, x[: len(t)]) for t, x in rows]
    m = toxicity.fit_machine(rows, np.array([float(i < 30) for i in range(300)]))
    assert m.w[1] > 0


def test_margins_are_the_double_loop():
    r = np.random.default_rng(4)
    m = toxicity.Machine(0.3, r.normal(size=1 << toxicity.BITS).astype(np.float32), r.normal(size=(1 << toxicity.BITS, 4)).astype(np.float32))
    texts = [(np.unique(r.integers(0, 1 << toxicity.BITS, n)).astype(np.int32), None) for n in (0, 1, 2, 7, 0, 40)]
    texts = [(t, r.random(len(t)).astype(np.float32)) for t, _ in texts]
    want = [0.3 + sum(m.w[a] * xa for a, xa in zip(t, x)) + sum(m.v[t[i]] @ m.v[t[j]] * x[i] * x[j] for i in range(len(t)) for j in range(i)) for t, x in texts]
    assert np.allclose(m.margins(texts), want, rtol=1e-4, atol=1e-4)


def test_a_query_is_its_machine_text_by_text(spark):
    docs = spark.createDataFrame([(i, ("you fool and you clown", "a fool of the north", "a clown of the north", "the north wind")[i % 4] + f" {i}") for i in range(400)] + [(None, None), (9000, ""), (9001, "fool " * 30_000), (9002, "x" * 200_000)], "doc_id long, text string")
    labels = docs.where("doc_id < 400").selectExpr("doc_id", "int(doc_id % 4 = 0) toxic")
    m = toxicity.fit(docs, labels)
    terms = toxicity.Terms()
    want = {r.doc_id: 1 / (1 + np.exp(-m.margins([terms(r.text)])[0])) for r in docs.collect()}
    got = toxicity.scored(docs, labels).collect()
    assert all(abs(r.score - want[r.doc_id]) < 1e-6 and r.predicted == (r.score >= 0.5) for r in got) and len(got) == docs.count()
    stays = {r.doc_id for r in toxicity.clean(docs, labels).collect()}
    assert stays == {r.doc_id for r in got if not r.predicted}
