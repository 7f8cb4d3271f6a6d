"""Language identification with segmentation-marginalised unigram models.

Every language has probabilities for the pieces of one fixed public vocabulary. A word's
probability sums over all its segmentations into pieces (forward algorithm), and a text's over its
words. The probabilities come from expectation maximisation over the same lattices.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symlake.llm.common import prepare

#: The learning sample: about so many documents of each language.
SAMPLE_DOCS = 500
#: So many languages are scored at once; and below this, sums are scaled up.
COLUMNS, TINY = 8, 1e-100
EM_ROUNDS, SHARED = 4, 0.02
#: Longer runs of letters are scored position by position instead of in a matrix; the same sums.
LONG_CHARS = 64
#: Bounds of the learning sample besides SAMPLE_DOCS: characters of each language (in expectation), letters of a run.
SAMPLE_CHARS, LEARN_CHARS = 20_000_000, 512
_CACHE = 250_000
_WORD = re.compile(r"[^\W\d_]+")
_UNKNOWN, _SCALE, _SHIFT = 1e-7, 8.0, np.uint64(44)
_BASE, _START = np.uint64(0x9E3779B97F4A7C15), "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_of(text: str | None) -> list[str]:
    """The lower-case letter runs of a text, none if it has no letter."""
    found = _WORD.findall((text or "").lower())
    if found and not any(map(str.isalpha, found)) and not any(c.isalpha() for w in found for c in w):
        return []
    return found


class Lattice:
    """The pieces of the vocabulary that are made of letters, and the segmentations of words into them."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        pieces = sorted({p.lower() for i in range(model.get_piece_size()) if (p := model.id_to_piece(i)) and all(c.isalpha() or c == _START for c in p)} - {""})
        self.size, self.chars = len(pieces), np.array([len(p) for p in pieces])
        # A span grows only while it is the start of some piece: all starts are looked up, value -1 if no piece.
        values = {p[:n]: -1 for p in pieces for n in range(1, len(p))} | {p: i for i, p in enumerate(pieces)}
        self.keys, self.values = np.array([self._key(x) for x in values], np.uint64), np.array(list(values.values()), np.int32)
        self.tables = self._tables()

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c)) % 2**64
        return h

    def _tables(self) -> list[tuple[np.uint64, np.ndarray]]:
        """Hash tables key -> its place in keys; what collides in one goes to the next."""
        left, tables, odd = np.arange(len(self.keys)), [], 0x2545F4914F6CDD1D
        while len(left):
            odd = (odd * 0x5851F42D4C957F2D + 2) % 2**64 | 1
            at = (self.keys[left] * np.uint64(odd)) >> _SHIFT
            table = np.full(1 << 20, -1, np.int32)
            table[at] = left
            tables.append((np.uint64(odd), table))
            left = left[table[at] != left]
        return tables

    def find(self, h: np.ndarray) -> np.ndarray:
        """The places of keys, -1 for what is none."""
        out = np.full(len(h), -1, np.int32)
        ask = np.arange(len(h))
        for odd, table in self.tables:
            at = table[(h[ask] * odd) >> _SHIFT]
            hit = (at >= 0) & (self.keys[at] == h[ask])
            out[ask[hit]] = at[hit]
            ask = ask[~hit & (at >= 0)]
            if not len(ask):
                break
        return out

    def groups(self, words: list[str], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(indices, matrix of code points) of the words of each length up to most, with the start mark; some million code points at once."""
        marked = [_START + w for w in words]
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        for n in np.unique(size[size <= most + 1]).tolist():
            for at in np.array_split(at := np.flatnonzero(size == n), -(-len(at) // max(1, min(20_000, 1_300_000 // n)))):
                text = "".join(marked[i] for i in at.tolist())
                yield at, np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).reshape(len(at), n)

    def edges(self, points: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, words, pieces) for all spans that are pieces of some words; piece -1 is a letter outside the vocabulary."""
        found = []
        for i in range(points.shape[1]):
            rows, h = np.arange(len(points)), np.zeros(len(points), np.uint64)
            for j in range(i, points.shape[1]):
                h = h * _BASE + points[rows, j].astype(np.uint64)
                at = self.find(h)
                piece = np.where(at >= 0, self.values[at], -1)
                known = piece >= 0
                if j == i:
                    found.append((i, j + 1, rows, piece))
                elif known.any():
                    found.append((i, j + 1, rows[known], piece[known]))
                rows, h = rows[at >= 0], h[at >= 0]
                if not len(rows):
                    break
        return found

    def weights(self, p: np.ndarray, i: int, j: int, piece: np.ndarray) -> np.ndarray:
        w = p[piece] * _SCALE ** (j - i)
        if j == i + 1:
            w[piece < 0] = _UNKNOWN * _SCALE
        return w

    def forward(self, points: np.ndarray, p: np.ndarray, edges: list | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """alpha[position, word, language], scaled by _SCALE per letter, and the logarithms of what it was divided by besides so that it stays in range (None: nothing)."""
        alpha, logs, last = np.zeros((points.shape[1] + 1, len(points), p.shape[1])), None, 0
        alpha[0] = 1
        for i, j, rows, piece in edges or self.edges(points):
            if i > last:
                last = i
                if (low := alpha[i] < TINY).any():
                    by = np.where(low, alpha[i], 1)
                    alpha[i:] /= by
                    logs = np.zeros_like(alpha) if logs is None else logs
                    logs[i:] += np.log(by)
            alpha[j, rows] += alpha[i, rows] * self.weights(p, i, j, piece)
        return alpha, logs

    def long_log_probability(self, word: str, p: np.ndarray, segment: int = 4096) -> np.ndarray:
        """What log_probabilities gives for one word, however long, in memory for a segment of its letters."""
        points = np.frombuffer((_START + word).encode("utf-32-le", "replace"), np.uint32)
        n, width, languages = len(points), int(self.chars.max()), p.shape[1]
        # alpha of the last `width` positions, latest first; log_by is what it was divided by.
        ring, log_by = np.zeros((width, languages)), np.zeros(languages)
        ring[0] = 1
        ahead = np.zeros((width, width, languages))  # weights of spans that begin before the segment and end in it
        for at in range(0, n, segment):
            stop = min(n, at + segment)
            size = stop - at
            into = np.zeros((size + width, width, languages))  # [end - at - 1, letters - 1]
            into[:width] = ahead
            rows, h = np.arange(size), np.zeros(size, np.uint64)
            for letters in range(1, width + 1):
                inside = rows + at + letters <= n
                rows, h = rows[inside], h[inside]
                h = h * _BASE + points[rows + at + letters - 1].astype(np.uint64)
                place = self.find(h)
                piece = np.where(place >= 0, self.values[place], -1)
                if letters == 1:
                    into[rows, 0] = self.weights(p, 0, 1, piece)
                else:
                    known = piece >= 0
                    into[rows[known] + letters - 1, letters - 1] = self.weights(p, 0, letters, piece[known])
                rows, h = rows[place >= 0], h[place >= 0]
                if not len(rows):
                    break
            for i in range(size):
                new = (ring * into[i]).sum(axis=0)
                ring[1:] = ring[:-1]
                ring[0] = new
                if i % 16 == 15:
                    by = np.maximum(ring.max(axis=0), 1e-300)
                    ring /= by
                    log_by += np.log(by)
            ahead = into[size:].copy()
        return np.log(ring[0]) + log_by - n * np.log(_SCALE)

    def log_probabilities(self, words: list[str], p: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), p.shape[1]))
        long = [i for i, w in enumerate(words) if len(w) > LONG_CHARS]
        for i in long:
            for c in range(0, p.shape[1], COLUMNS):
                out[i, c : c + COLUMNS] = self.long_log_probability(words[i], p[:, c : c + COLUMNS])
        for at, points in self.groups(words, LONG_CHARS):
            edges = self.edges(points)
            for c in range(0, p.shape[1], COLUMNS):
                alpha, logs = self.forward(points, p[:, c : c + COLUMNS], edges)
                out[at, c : c + COLUMNS] = np.log(alpha[-1]) + (0 if logs is None else logs[-1]) - points.shape[1] * np.log(_SCALE)
        return out

    def fit(self, words: list[str], seen: tuple[np.ndarray, np.ndarray, np.ndarray], languages: int, rounds: int = EM_ROUNDS) -> np.ndarray:
        """Piece probabilities [piece, language] from the counts seen: (word, language, n)."""
        word, lang, n = seen
        p = np.repeat((1 / self.size / np.maximum(self.chars, 1))[:, None], languages, axis=1)
        p /= p.sum(axis=0)
        for _ in range(rounds):
            expected = np.zeros((self.size, languages))
            for at, points in self.groups(words, LEARN_CHARS):
                edges = self.edges(points)
                place = np.full(len(words), -1)
                place[at] = np.arange(len(at))
                own = place[word] >= 0
                for c in range(0, languages, COLUMNS):
                    some = own & (lang >= c) & (lang < c + COLUMNS)
                    counts = np.zeros((len(at), min(COLUMNS, languages - c)))
                    np.add.at(counts, (place[word[some]], lang[some] - c), n[some])
                    part = p[:, c : c + COLUMNS]
                    alpha, logs = self.forward(points, part, edges)
                    beta = np.zeros_like(alpha)
                    beta[-1] = counts / np.maximum(alpha[-1], 1e-300)
                    for i, j, rows, piece in reversed(edges):
                        flow = self.weights(part, i, j, piece) * beta[j, rows]
                        if logs is not None:
                            flow *= np.exp(logs[i, rows] - logs[j, rows])
                        beta[i, rows] += flow
                        known = piece >= 0
                        np.add.at(expected[:, c : c + COLUMNS], piece[known], (alpha[i, rows] * flow)[known])
            own = expected / np.maximum(expected.sum(axis=0), 1e-300)
            everyone = own.mean(axis=1, keepdims=True)
            p = (1 - SHARED) * own + SHARED * (0.9 * everyone + 0.1 / self.size)
        return p


def held_out() -> Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, vocabulary: str | None = None, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, piece probabilities, log priors) from the labelled documents that aren't held out.

    About sample_docs documents of each language are used, fewer if they would hold more than
    SAMPLE_CHARS, chosen by a hash of doc_id and text; the counts that reach the driver are bounded
    by that. Runs of over LEARN_CHARS letters aren't learned from. Predictions know no such bounds.
    """
    vocabulary = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    labelled = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    chars = {r["lang"]: max(1, r["chars"]) for r in sizes}
    sizes = sorted((r["lang"], r["n"]) for r in sizes)
    if not sizes:
        return [], np.zeros((1, 0)), np.zeros(0)
    share = spark.createDataFrame([(lang, min(1.0, sample_docs / n, SAMPLE_CHARS / chars[lang])) for lang, n in sizes], "lang string, share double")
    # The text counts too, so that rows without an id don't share one fate.
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((lang, w) for w in words_of(text) if len(w) <= LEARN_CHARS)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    rows = (
        labelled.join(F.broadcast(share), "lang").filter(u < F.col("share")).select("lang", "text")
        .mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    )
    languages = [lang for lang, _ in sizes]
    at = {lang: i for i, lang in enumerate(languages)}
    index: dict[str, int] = {}
    found = [(index.setdefault(w, len(index)), at[lang], n) for lang, w, n in zip(*(rows.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True)]
    seen = tuple(np.array(x, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
    total = np.array([n for _, n in sizes], float)
    return languages, Lattice(vocabulary).fit(list(index), seen, len(languages)), np.log(total / total.sum())


class _Scores(dict):
    """Word -> row of the score table; scored in bulk once a batch is through."""

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        value = self[word] = len(self)
        return value

    new: list[str]


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], vocabulary: str | None = None) -> DataFrame:
    """doc_id, lang_pred, score of every row: the best language and its posterior probability.

    Null text and text without a letter give `und` with score 0, as does a model without languages.
    Ties go to the language that sorts first. Null and repeated doc_ids are rows of their own; an
    empty table gives no rows. Other columns than doc_id and text are ignored.
    """
    return identify_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model, vocabulary).select("doc_id", "lang_pred", "score")


def identify_rows(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], vocabulary: str | None = None) -> DataFrame:
    """docs with two more columns, lang_pred and score, as of identify(); columns of these names are replaced."""
    prepare(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    vocabulary = vocabulary or default_vocabulary()
    languages, p, prior = model
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary)
        known = _Scores()
        known.new, table = [], np.empty((0, len(languages)))
        for batch in batches:
            if len(known) > _CACHE:
                known.clear()
                table = table[:0]
            rows, ends = [], []
            for text in batch.column(place):
                words = words_of(text.as_py()) if languages else []
                rows.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                ends.append(len(words))
            if known.new:
                table = np.concatenate([table, lattice.log_probabilities(known.new, p)])
                known.new = []
            best, score = ["und"] * len(rows), np.zeros(len(rows))
            sizes = np.array(ends)
            if some := np.flatnonzero(sizes).tolist():
                at = np.concatenate([rows[i] for i in some])
                sums = np.add.reduceat(table[at], np.concatenate([[0], np.cumsum(sizes[some])[:-1]]), axis=0) + prior
                top = sums.argmax(axis=1)
                chance = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                for k, i in enumerate(some):
                    best[i], score[i] = languages[top[k]], chance[k]
            columns = [*batch.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "score"])

    out = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, out)
