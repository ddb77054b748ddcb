"""Each stage against a plain version, on what the stage before it kept."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from plumbline.llm import bpe, mixing, toxicity

from tests.llm.held import DATA, odd_docs
from tests.llm.test_simhash import plain_components, plain_fingerprint


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("which", ["table", "odd"])
def test_stages(spark, which):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet") if which == "table" else odd_docs(spark)
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "near dedup", "mixing", "encoding"]

    bad = {r.doc_id for r in toxicity.scored(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect() if r.predicted}
    clean = corpus_pipeline.written(stages["toxicity"](spark, docs, DATA), "t")
    rows = [r for r in docs.collect() if r.doc_id not in bad]
    assert clean.columns == columns and Counter(clean.collect()) == Counter(rows)

    last = {}
    for r in rows:
        last[low(r.text)] = max(last.get(low(r.text), -1), r.doc_id)
    rows = [r for r in rows if last[low(r.text)] == r.doc_id]
    exact = corpus_pipeline.written(stages["exact dedup"](spark, clean, DATA), "e")
    assert exact.columns == columns and Counter(exact.collect()) == Counter(rows)

    groups = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in rows])
    rows = [r for r in rows if groups[r.doc_id][1] == r.doc_id]
    near = corpus_pipeline.written(stages["near dedup"](spark, exact, DATA), "n")
    assert near.columns == columns and Counter(near.collect()) == Counter(rows)

    copies = {r.doc_id: r.copies for r in mixing.mix_sizes(near).collect()}
    mixed = corpus_pipeline.written(stages["mixing"](spark, near, DATA), "m")
    want = Counter({r: copies[r.doc_id] for r in rows if copies[r.doc_id]})
    assert mixed.columns == columns and Counter(mixed.collect()) == want

    library = Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in stages["encoding"](spark, mixed, DATA).collect())
    encoded = Counter()
    for r, n in want.items():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        encoded[r.doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()] += n
    assert got == encoded


def test_run(spark):
    assert set(corpus_pipeline.run(spark, DATA).columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_null_and_repeated_ids_and_no_rows(spark):
    stages = [f for _, f in corpus_pipeline.STAGES]
    long = "word " * 40_000
    rows = [(None, "one text of some words", "en", "a", 1), (None, "quite another text here", "en", None, 1), (3, "Same words again and again", "en", "b", 1), (3, "same words again and again", None, "b", 1), (3, "a second text with this id", "de", "b", 2), (4, None, None, None, None), (5, "", "en", "a", 0), (6, long, "en", "a", 9), (7, long + "end", "en", "a", 9), (8, "z" * 200_000, "en", "c", 9)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    columns, empty = docs.columns, docs.where("false")
    exact = corpus_pipeline.written(stages[1](spark, stages[0](spark, docs, DATA), DATA), "e")
    assert sorted((r.doc_id or 0, low(r.text)[:9]) for r in exact.collect()) == sorted([(0, "one text "), (0, "quite ano"), (3, "same word"), (3, "a second "), (5, ""), (6, "word word"), (7, "word word"), (8, "zzzzzzzzz")])
    near = corpus_pipeline.written(stages[2](spark, exact, DATA), "n")
    assert sorted((r.doc_id or 0, low(r.text)[:9]) for r in near.collect()) == sorted([(0, "one text "), (0, "quite ano"), (3, "same word"), (3, "a second "), (5, ""), (6, "word word"), (8, "zzzzzzzzz")])
    mixed = stages[3](spark, near, DATA)
    assert mixed.columns == columns and stages[4](spark, mixed, DATA).count() == mixed.count() > 0
    for stage in stages[:4]:
        empty = stage(spark, empty, DATA)
        assert empty.columns == columns and empty.count() == 0
    assert stages[4](spark, empty, DATA).count() == 0
