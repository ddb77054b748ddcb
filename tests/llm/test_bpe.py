import hashlib
import random

import pytest
from plumbline.llm import bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    r = random.Random(5)
    signs = ["\u00a0", "\u2009", "\u2028", "\u202f", "\u1680", "\u200b", "a", "B", "é", "é", "Σ", "ß", "İ", " ", "\n", "\x1c", "\x85", "　", "'s", "'LL", "12", "½", "🙂", "<|endoftext|>", "<|", "!?", "́", "the ", "中", "_", "힣", "ﬁ", "\x00", "​"]
    yield from ["", " ", "<|startoftext|>x<|endoftext|>", "Hello world's 123 don't", "x" * 5000, "ΣΑΣ σας"]
    for _ in range(400):
        yield "".join(r.choice(signs) for _ in range(r.randint(1, 30)))


def test_same_as_library(library):
    codec = bpe.Codec(bpe.load_vocabulary(bpe.default_path()))
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        ids, decoded = codec.encode(text)
        got = [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)]
        assert got == want, repr(text)
        assert decoded == library.decode(want, skip_special_tokens=False), repr(text)


def test_tables(spark, library):
    rows = [(1, "Hello  World", 9), (2, None, 9), (None, "", 9), (1, "Hello  World", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = bpe.encode(docs)
    assert out.count() == 4
    back = {r.doc_id: r.text for r in bpe.decode(out).collect()}
    assert back[1] == "hello</w> world</w>" and back[2] == ""
    got = bpe.encode_digests(docs).where("doc_id = 2").first()
    assert (got.n_tokens, got.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert bpe.encode(docs.where("false")).count() == 0
