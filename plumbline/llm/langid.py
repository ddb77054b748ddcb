"""Operator 3: language identification by segmentation-marginalised unigrams.

Each language gives each piece of a fixed public vocabulary a probability. The probability of a
word is the sum over all ways to cut it into pieces, by the forward algorithm; that of a text is
the product over its words, as pieces don't cross words. Piece probabilities are learned by
expectation maximisation over the same segmentations, on a bounded sample for each language:
Spark counts its words, and sums expected piece counts, which are vocabulary x languages numbers.

Words of any length are summed whole: a long one is swept block by block, and the sums at the
places that pieces can still reach are carried into the next block. Sums are scaled every few
places, so they don't run out of a float's range however long or odd a word is.

Scoring is one pass without a shuffle; a worker remembers the words it has scored, and the
forward algorithm runs over all new words of a slice together.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import kept, slices, table, written

WORDS = re.compile(r"[^\W\d_]+")
START = "▁"
#: At most this many rows of each language are learned from, lowest hash of the id first.
SAMPLE_PER_LANGUAGE = 1_500
#: Languages of one model; more languages make more models, which score one after another.
LANGUAGES_AT_ONCE = 200
STEPS = 2
SMOOTHING = 0.1
UNKNOWN = 1e-7
#: Places between two scalings; characters that a sweep lays out at once.
RESCALE = 8
BLOCK = 1024
#: Numbers that a lattice, and a worker's memory of words, hold at most.
CELLS = 400_000
KEPT_CELLS = 1_600_000
NO_LANGUAGE = "und"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Pieces of letters, lower-cased ones only, with numbers of our own; 0 is for unknown characters.

    begins: each beginning of a piece, with the piece's number or None if it is none itself.
    """

    def __init__(self, pieces):
        usable = sorted({p for p in pieces if p and p == p.lower() and (p == START or WORDS.fullmatch(p.removeprefix(START)))})
        self.width = len(usable) + 1
        self.reach = max(map(len, usable), default=1)
        #: No piece is less likely, so that sums stay in range between two scalings.
        self.least = 10.0 ** (-300 / (self.reach + RESCALE))
        self.begins: dict[str, int | None] = {p[:n]: None for p in usable for n in range(1, len(p))}
        self.begins.update({p: i for i, p in enumerate(usable, 1)})


def load_pieces(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Pieces(model.id_to_piece(i) for i in range(model.get_piece_size()))


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


class Lattice:
    """All pieces that start at places first to first + BLOCK of some words: edges from start to end, sorted by start, then word.

    Places count from first. Sums at a place are final once all places before it are done; those
    of the last `reach` places are not yet when the block ends, and are handed on.
    """

    def __init__(self, words: list[str], pieces: Pieces, first: int = 0):
        at, start, end, piece = [], [], [], []
        begins = pieces.begins
        self.reach, self.first = pieces.reach, first
        self.size = np.array([len(w) + 1 for w in words], dtype=np.int64)
        self.places = int(min(BLOCK, self.size.max(initial=0) - first))
        for k, word in enumerate(words):
            s = START + word
            n = len(s)
            for i in range(first, min(n, first + BLOCK)):
                one = begins.get(s[i])
                if one is None:  # no piece by itself: an unknown character
                    at.append(k), start.append(i - first), end.append(i + 1 - first), piece.append(0)
                    if s[i] not in begins:
                        continue
                else:
                    at.append(k), start.append(i - first), end.append(i + 1 - first), piece.append(one)
                for j in range(i + 2, n + 1):
                    p = begins.get(s[i:j], 0)
                    if p:
                        at.append(k), start.append(i - first), end.append(j - first), piece.append(p)
                    elif p == 0:
                        break
        at, start, end, piece = (np.array(x, dtype=np.int64) for x in (at, start, end, piece))
        order = np.argsort(start, kind="stable")
        self.at, self.start, self.end, self.piece = (x[order] for x in (at, start, end, piece))
        self.bounds = np.searchsorted(self.start, np.arange(self.places + 1))

    def sums(self, columns: int) -> np.ndarray:
        return np.zeros((len(self.size), self.places + self.reach + 1, columns))

    def _scaled(self, sums: np.ndarray, logs: np.ndarray, place: int, places: slice) -> None:
        by = sums[:, place]
        by = np.where(by > 0, by, 1.0)
        sums[:, places] /= by[:, None]
        logs += np.log(by)

    def forward(self, p: np.ndarray, sums: np.ndarray, logs: np.ndarray, seen: np.ndarray | None = None) -> None:
        """p: edges x columns. Adds up in sums (scaled; logs has the scale) the probabilities of prefixes. seen: gets their logs."""
        for place in range(self.places):
            if place % RESCALE == 0:
                self._scaled(sums, logs, place, slice(place, place + self.reach + 1))
            if seen is not None:
                seen[:, place] = np.log(np.maximum(sums[:, place, 0], 1e-300)) + logs[:, 0]
            s = slice(self.bounds[place], self.bounds[place + 1])
            at, end = self.at[s], self.end[s]
            sums[at, end] += sums[at, place] * p[s]  # no word has two edges from here to one end

    def backward(self, p: np.ndarray, sums: np.ndarray, logs: np.ndarray, seen: np.ndarray) -> None:
        """The same from the ends of words: the probabilities of suffixes, from each place on."""
        for place in range(self.places + self.reach, -1, -1):
            ended = self.size - self.first == place
            if place <= self.places and ended.any():  # later ends came with what was handed on
                sums[ended, place], logs[ended] = 1, 0
            if place < self.places:
                s = slice(self.bounds[place], self.bounds[place + 1])
                at = self.at[s]
                if len(at):
                    heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                    sums[at[heads], place] = np.add.reduceat(sums[at, self.end[s]] * p[s], heads)
                if place % RESCALE == 0:
                    self._scaled(sums, logs, place, slice(place, place + self.reach + 1))
            seen[:, place] = np.log(np.maximum(sums[:, place, 0], 1e-300)) + logs[:, 0]


def firsts(longest: int) -> range:
    return range(0, longest, BLOCK)


def log_totals(words: list[str], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """p: pieces x columns. Log probability of each word in each column, summed over its segmentations."""
    out, carried = np.empty((len(words), p.shape[1])), None
    logs = np.zeros((len(words), p.shape[1]))
    for first in firsts(max(map(len, words), default=0) + 1):
        lattice = Lattice(words, pieces, first)
        sums = lattice.sums(p.shape[1])
        if carried is None:
            sums[:, 0] = 1
        else:
            sums[:, : pieces.reach + 1] = carried
        lattice.forward(p[lattice.piece], sums, logs)
        end = lattice.size - first
        ends = np.flatnonzero((end > 0) & (end <= lattice.places))
        out[ends] = np.log(sums[ends, end[ends]]) + logs[ends]
        carried = sums[:, lattice.places :]
    return out


def by_length(words: list[str], cells: int):
    """Positions of words of like length, so that a lattice has about that many cells at most."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * (min(BLOCK, len(words[order[stop]])) + 20) <= cells:
            stop += 1
        yield order[at:stop]
        at = stop


def expected(words: list[str], lang: np.ndarray, count: np.ndarray, pieces: Pieces, p: np.ndarray | None, n_lang: int) -> np.ndarray:
    """Expected piece counts, languages x pieces; without p, of all places where a piece fits.

    Of a word of several blocks, only what is handed from block to block is kept on the way
    forward; on the way back each block is swept forward once more.
    """
    width = pieces.width
    found = np.zeros(n_lang * width)
    for picked in by_length(words, 100_000):
        own = [words[i] for i in picked]
        l, n = lang[picked], count[picked].astype(float)
        starts = [*firsts(max(map(len, own)) + 1)]
        if p is None:
            for first in starts:
                lattice = Lattice(own, pieces, first)
                found += np.bincount(l[lattice.at] * width + lattice.piece, n[lattice.at], len(found))
            continue
        carried, states = np.zeros((len(own), pieces.reach + 1, 1)), []
        carried[:, 0], logs = 1, np.zeros((len(own), 1))
        for first in starts:
            states.append((carried, logs.copy()))
            if first == starts[-1]:
                break
            lattice = Lattice(own, pieces, first)
            sums = lattice.sums(1)
            sums[:, : pieces.reach + 1] = carried
            lattice.forward(p[l[lattice.at], lattice.piece][:, None], sums, logs)
            carried = sums[:, lattice.places :]
        back, back_logs, total = None, np.zeros((len(own), 1)), np.zeros(len(own))
        for first, (carried, logs) in zip(reversed(starts), reversed(states), strict=True):
            lattice = Lattice(own, pieces, first)
            edge = p[l[lattice.at], lattice.piece][:, None]
            sums, ahead = lattice.sums(1), np.zeros((len(own), lattice.places))
            sums[:, : pieces.reach + 1] = carried
            lattice.forward(edge, sums, logs, ahead)
            end = lattice.size - first
            ends = np.flatnonzero((end > 0) & (end <= lattice.places))
            total[ends] = np.log(sums[ends, end[ends], 0]) + logs[ends, 0]
            sums, behind = lattice.sums(1), np.zeros((len(own), lattice.places + pieces.reach + 1))
            if back is not None:
                sums[:, lattice.places :] = back
            lattice.backward(edge, sums, back_logs, behind)
            back = sums[:, : pieces.reach + 1]
            share = np.exp(ahead[lattice.at, lattice.start] + np.log(edge[:, 0]) + behind[lattice.at, lattice.end] - total[lattice.at])
            found += np.bincount(l[lattice.at] * width + lattice.piece, n[lattice.at] * share, len(found))
    return found.reshape(n_lang, width)


def probabilities(counts: np.ndarray, least: float = 0.0) -> np.ndarray:
    known = counts[:, 1:] + SMOOTHING
    return np.maximum(np.hstack([np.full((len(counts), 1), UNKNOWN), known / known.sum(axis=1, keepdims=True)]), least)


class Scorer:
    """Log probabilities of words in each language; remembers a bounded number of them."""

    def __init__(self, pieces: Pieces, p: np.ndarray):
        self.pieces, self.p = pieces, np.ascontiguousarray(p.T)
        self.row: dict[str, int] = {}
        self.most = max(1000, KEPT_CELLS // p.shape[0])
        self.logs = np.empty((0, p.shape[0]))

    def fresh(self, words: list[str]) -> np.ndarray:
        logs = np.empty((len(words), self.p.shape[1]))
        for picked in by_length(words, CELLS // self.p.shape[1]):
            logs[picked] = log_totals([words[i] for i in picked], self.pieces, self.p)
        return logs

    def texts(self, texts: list[list[str]]) -> np.ndarray:
        """Sums over the words of each text; zeros for a text without words."""
        new = list({w for text in texts for w in text if w not in self.row})
        if len(self.row) + len(new) > self.most:
            self.row, self.logs = {}, self.logs[:0]
            new = list({w for text in texts for w in text})
        if new:
            self.row.update(zip(new, range(len(self.logs), len(self.logs) + len(new)), strict=True))
            self.logs = np.vstack([self.logs, self.fresh(new)])
        row = self.row
        return np.array([self.logs[[row[w] for w in text]].sum(axis=0) if text else np.zeros(self.p.shape[1]) for text in texts])


def sample_words(docs: DataFrame, per_language: int) -> DataFrame:
    """lang, word, n of the sample."""
    known = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang")).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))  # Spark keeps only the first ranks before it shuffles
    picked = F.broadcast(known.withColumn("nth", nth).where(F.col("nth") <= per_language).select("id", "lang").distinct())

    def counted(batches):
        for batch in slices(batches):
            n: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for word in words_of(text):
                    n[lang, word] = n.get((lang, word), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["lang", "word", "n"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return texts.join(picked, ["id", "lang"]).select("lang", "text").mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, vocabulary_path: str | None = None) -> list[tuple[list[str], Pieces, np.ndarray]]:
    """Models of at most LANGUAGES_AT_ONCE languages, in order: languages, pieces, piece probabilities by language."""
    pieces = load_pieces(vocabulary_path or default_path())
    words = written(sample_words(docs, per_language), "words")
    languages = sorted(r.lang for r in words.select("lang").distinct().collect())
    return [fitted(words, languages[at : at + LANGUAGES_AT_ONCE], pieces) for at in range(0, len(languages), LANGUAGES_AT_ONCE)]


def fitted(words: DataFrame, languages: list[str], pieces: Pieces) -> tuple[list[str], Pieces, np.ndarray]:
    """The model of some languages from lang, word, n."""
    context, p = words.sparkSession.sparkContext, None
    for _ in range(STEPS + 1):
        shared = context.broadcast((pieces, languages, p))

        def counts(batches, shared=shared):
            pieces, languages, p = shared.value
            number = {x: i for i, x in enumerate(languages)}
            total = np.zeros((len(languages), pieces.width))
            for batch in batches:
                lang = np.array([number[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
                total += expected(batch.column("word").to_pylist(), lang, batch.column("n").to_numpy(zero_copy_only=False), pieces, p, len(languages))
            l, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(l * total.shape[1] + piece), pa.array(total[l, piece])], names=["at", "n"])

        # pieces x languages numbers at most
        sums = words.where(F.col("lang").isin(languages)).mapInArrow(counts, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        found = np.zeros(len(languages) * pieces.width)
        found[sums["at"].to_numpy(dtype=np.int64)] = sums["n"]
        p = probabilities(found.reshape(len(languages), pieces.width), pieces.least)
    return languages, pieces, p


def scorer(model) -> Scorer:
    return Scorer(model[1], model[2])


def predict(docs: DataFrame, models: list) -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = [docs.sparkSession.sparkContext.broadcast(m) for m in models]
    languages = [x for m in models for x in m[0]]

    def run(batches):
        for batch in slices(batches, most_bytes=8 << 20):
            texts = [words_of(t) for t in batch.column("text").to_pylist()]
            texts = [w if w and any(any(map(str.isalpha, x)) for x in w) else [] for w in texts]
            lang, score = [NO_LANGUAGE] * len(texts), [0.0] * len(texts)
            if languages:
                logs = np.hstack([kept(m.value, scorer).texts(texts) for m in shared])
                shares = np.exp(logs - logs.max(axis=1, keepdims=True))
                best = logs.argmax(axis=1)
                for i, text in enumerate(texts):
                    if text:
                        lang[i], score[i] = languages[best[i]], float(shares[i, best[i]] / shares[i].sum())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior of lang_pred), one row per document.

    Only text and non-null lang of documents whose crc32(doc_id) mod 4 is not 2 are learned
    from; a null doc_id is not learned from and not held out. Texts that are null or have no
    letter get `und` and score 0, as do all texts when no language can be learned. Repeated rows
    each give a row; other columns are ignored. Ties go to the language that sorts first. Words are
    taken whole, however long, and all pieces of the vocabulary count. Any number of languages can
    be told apart; a model holds vocabulary x languages numbers.
    """
    return predict(docs, learn(docs, per_language, vocabulary_path)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))
