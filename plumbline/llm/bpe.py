"""Operator 8: BPE encoding and decoding with a fixed public vocabulary.

Each word is a doubly linked list of symbols. A priority queue holds the adjacent pairs that
have a merge rank; the lowest rank, leftmost first, is applied and its new neighbours are
queued. Entries whose symbols have changed meanwhile are stale and skipped. Decoding joins the
vocabulary strings of the ids.

The vocabulary, a fixed file of a few MB, is broadcast; texts never leave their partition, so
there is no shuffle at any size.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import kept, slices, table

#: Fixed values of the vocabulary file: its word pattern, its white space, its special strings.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
BLANKS = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: str.split() also splits at these, which the vocabulary's white space doesn't hold.
ODD_BLANKS = regex.compile(r"[\x1c-\x1f]")

CHUNKS_KEPT = 400_000
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """Reads the vocabulary file on the driver: ids, merge ranks by id pair, special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    end = spec["model"]["end_of_word_suffix"] or ""
    merges = {}
    for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
        merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    signs = byte_symbols()
    return {
        "inner": [vocab[s] for s in signs],
        "last": [vocab[s + end] for s in signs],
        "merges": merges,
        "special": special,
        "strings": {i: s for s, i in (vocab | special).items()},
    }


class Codec:
    """Encodes and decodes with one loaded vocabulary; keeps a bounded memory of seen chunks."""

    def __init__(self, vocabulary: dict):
        self.inner, self.last = vocabulary["inner"], vocabulary["last"]
        self.merges, self.strings = vocabulary["merges"], vocabulary["strings"]
        self.special = vocabulary["special"]
        marks = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.marks = regex.compile(f"({marks})") if marks else None
        self.sign = os.path.commonprefix([*self.special])  # a text without it holds no special string
        # what is met while a memory fills is kept one more time, so common chunks stay
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.words: dict[str, list[int]] = {}
        self.older_words: dict[str, list[int]] = {}

    def merge_word(self, word: str) -> list[int]:
        data = word.encode("utf-8", "replace")
        sym = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        n, get = len(sym), self.merges.get
        # an entry is a rank and a place; it is stale unless the pair that stands there now has that rank
        queue = [m[0] << 32 | i for i in range(n - 1) if (m := get((sym[i], sym[i + 1])))]
        if not queue:
            return sym
        heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or sym[i] < 0 or (m := get((sym[i], sym[j]))) is None or m[0] != entry >> 32:
                continue
            new = m[1]
            sym[i], sym[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := get((new, sym[k])):
                    heappush(queue, m[0] << 32 | i)
            if (h := before[i]) >= 0 and (m := get((sym[h], new))):
                heappush(queue, m[0] << 32 | h)
        return [s for s in sym if s >= 0]

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a piece of text without white space."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        chunk = "".join(map(str.lower, chunk)) if "Σ" in chunk else chunk.lower()
        out: list[int] = []
        for word in WORDS.findall(chunk):
            ids = self.words.get(word)
            if ids is None:
                ids = self.older_words.get(word) or self.merge_word(word)
                if len(word) <= 24:
                    if len(self.words) >= CHUNKS_KEPT // 4:
                        self.older_words, self.words = self.words, {}
                    self.words[word] = ids
            out += ids
        return out

    def seen(self, chunk: str) -> tuple[bytes, str]:
        found = self.older.get(chunk)
        if found is None:
            ids = self.encode_chunk(chunk)
            found = pack(f"<{len(ids)}I", *ids), " ".join([self.strings[i] for i in ids])
        if len(chunk) <= 40:
            if len(self.chunks) >= CHUNKS_KEPT // 2:
                self.older, self.chunks = self.chunks, {}
            self.chunks[chunk] = found
        return found

    def encode_plain(self, text: str, ids: list[bytes], strings: list[str]) -> None:
        get, learn = self.chunks.get, self.seen
        for chunk in BLANKS.split(text) if ODD_BLANKS.search(text) else text.split():
            if chunk:
                a, b = get(chunk) or learn(chunk)
                if a:
                    ids.append(a)
                    strings.append(b)

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the decoded text."""
        ids: list[bytes] = []
        strings: list[str] = []
        if self.marks and self.sign in text:
            for part in self.marks.split(text):
                if part in self.special:
                    ids.append(np.asarray([self.special[part]], dtype="<u4").tobytes())
                    strings.append(part)
                else:
                    self.encode_plain(part, ids, strings)
        else:
            self.encode_plain(text, ids, strings)
        return b"".join(ids), " ".join(strings)

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])


def _mapped(docs: DataFrame, vocabulary_path: str | None, digests: bool) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path or default_path()))
    kinds = [pa.int64(), pa.int64(), *([pa.string(), pa.string()] if digests else [pa.binary(), pa.string()])]
    names = [c.split()[0] for c in (DIGEST_SCHEMA if digests else SCHEMA).split(", ")]

    def encode(batches):
        codec = kept(shared.value, Codec)
        for batch in slices(batches):
            rows: list[list] = [[], [], []]
            for text in batch.column("text").to_pylist():
                ids, decoded = codec.encode(text or "")
                rows[0].append(len(ids) // 4)
                rows[1].append(hashlib.sha256(ids).hexdigest() if digests else ids)
                rows[2].append(hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest() if digests else decoded)
            columns = [batch.column("doc_id"), *rows]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(encode, DIGEST_SCHEMA if digests else SCHEMA)


def encode(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit), decoded, one row per document.

    Null text counts as empty and gives no tokens; repeated rows each give a row; other columns
    are ignored. Whole texts are encoded, however long. An empty table gives an empty table.
    """
    return _mapped(docs, vocabulary_path, digests=False)


def encode_digests(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """encode() with digests in place of the ids and the decoded text."""
    return _mapped(docs, vocabulary_path, digests=True)


def decode(encoded: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id and ids as encode() gives them; null ids give empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path or default_path()))

    def join(batches):
        strings = shared.value["strings"]
        for batch in slices(batches):
            texts = [" ".join([strings[i] for i in np.frombuffer(x or b"", dtype="<u4").tolist()]) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(join, "doc_id long, text string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
