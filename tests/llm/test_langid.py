import zlib

import numpy as np
import pytest
from plumbline.llm import langid

from tests.llm.held import odd_docs

SF = "/root/testdata/sf0.01"


SOME = ["▁", "a", "b", "▁a", "ab", "ba", "▁ab", "bab", "abbabba"]


def log_total(s, pieces, p):
    """Log of the sum over all segmentations, by logaddexp over prefixes."""
    at = np.full(len(s) + 1, -np.inf)
    at[0] = 0
    for i in range(len(s)):
        if pieces.begins.get(s[i]) is None:
            at[i + 1] = np.logaddexp(at[i + 1], at[i] + np.log(p[0]))
        for j in range(i + 1, min(len(s), i + pieces.reach) + 1):
            if x := pieces.begins.get(s[i:j]):
                at[j] = np.logaddexp(at[j], at[i] + np.log(p[x]))
    return at[-1]


def all_cuts(s, pieces):
    """Every segmentation of a short word as a list of piece numbers."""
    if not s:
        yield []
    for j in range(1, len(s) + 1):
        x = pieces.begins.get(s[:j])
        x = 0 if x is None and j == 1 else x
        if x is not None:
            yield from ([x, *rest] for rest in all_cuts(s[j:], pieces))


@pytest.mark.parametrize("block", [1024, 3, 1])
def test_forward_sums_all_segmentations(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    pieces = langid.Pieces(SOME)
    p = langid.probabilities(np.random.default_rng(0).random((2, pieces.width)) * 50)
    words = ["a", "ab", "abab", "xab", "bbabxaab", "abbabbabba"]
    want = [[np.log(sum(np.prod(p[l, cut]) for cut in all_cuts("▁" + w, pieces))) for l in (0, 1)] for w in words]
    assert np.allclose(langid.log_totals(words, pieces, p.T), want, rtol=1e-12)
    assert np.allclose([[log_total("▁" + w, pieces, p[l]) for l in (0, 1)] for w in words], want)
    scorer = langid.Scorer(pieces, p)
    assert np.allclose(scorer.texts([["ab", "a", "ab"], []]), [2 * np.array(want[1]) + want[0], [0, 0]])


@pytest.mark.parametrize("block", [1024, 3])
def test_expected_counts_are_those_of_all_segmentations(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    pieces = langid.Pieces(SOME)
    p = langid.probabilities(np.random.default_rng(1).random((2, pieces.width)) * 50)
    words, lang, n = ["abab", "xab", "bbabxaab", "a"], np.array([0, 1, 1, 0]), np.array([3, 1, 2, 5])
    want = np.zeros((2, pieces.width))
    for w, l, k in zip(words, lang, n):
        cuts = [(c, np.prod(p[l, c])) for c in all_cuts("▁" + w, pieces)]
        for c, x in cuts:
            np.add.at(want[l], c, k * x / sum(y for _, y in cuts))
    assert np.allclose(langid.expected(words, lang, n, pieces, p, 2), want)


def test_long_words_and_unknown_scripts_stay_in_range(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 64)
    pieces = langid.load_pieces(langid.default_path())
    r = np.random.default_rng(3)
    p = langid.probabilities(r.gamma(0.05, size=(3, pieces.width)) * 1e6, pieces.least)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(r.choice(list(letters), 500)), "ж" * 600, "ა" * 90, "𐌰" * 700, "word" * 500, "x" + "ა" * 300 + "the"]
    got = langid.log_totals(words, pieces, p.T)
    want = [[log_total("▁" + w, pieces, p[l]) for l in range(3)] for w in words]
    assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-9)
    assert len(set(got[0])) == 3
    n = langid.expected(words, np.array([0, 1, 2, 0, 1, 2]), np.ones(6), pieces, p, 3)
    assert np.isfinite(n).all() and n.sum() > 0


def test_all_pieces_count():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=langid.default_path())
    pieces = langid.load_pieces(langid.default_path())
    usable = {x for i in range(model.get_piece_size()) if (x := model.id_to_piece(i)) == x.lower() and langid.WORDS.fullmatch(x.removeprefix("▁"))}
    assert all(pieces.begins[x] for x in usable) and pieces.reach == max(map(len, usable))


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES_AT_ONCE", 2)
    alphabet = "abcdefghij"
    docs = spark.createDataFrame([(i, f"{alphabet[i % 5] * 4} {alphabet[5 + i % 5] * 3} ", f"l{i % 5}") for i in range(100)] + [(1000, "e" * 5000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(docs).collect()}
    assert all(got[i][0] == f"l{i % 5}" and 0.5 < got[i][1] <= 1 for i in range(100))
    assert got[1000][0] == "l4"


def test_held_out_rows(spark):
    got = langid.op3_language(spark, SF).collect()
    docs = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    told = [r.lang_pred == docs[r.doc_id][0] for r in got if r.held_out and docs[r.doc_id][0] and r.lang_pred != "und"]
    print(sum(told) / len(told), len(told))
    assert sum(told) / len(told) > 0.98


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = {r.doc_id: r for r in langid.identified(docs).collect()}
    assert len(got) == docs.count()
    assert got[3].lang_pred == got[4].lang_pred == "und" and got[5].lang_pred == "en"
    assert all(r.lang_pred == "und" for r in langid.identified(docs.where("lang is null")).collect())
    assert langid.identified(docs.where("false")).count() == 0


@pytest.mark.parametrize("text", ["²", "12 _", "\n"])
def test_no_letter(spark, text):
    docs = spark.createDataFrame([(1, "some words", "en"), (2, text, "en"), (None, "some", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.identified(docs).collect()} == {1: "en", 2: "und", None: "en"}
