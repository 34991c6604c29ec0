"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary. The probability of a word is the
sum over all of its segmentations into pieces, computed by a forward pass over its bytes; words are independent,
so a text's score is the sum of the log probabilities of its words. Words of any length are taken whole: where a
forward sum would underflow it is scaled, and long words are walked in stretches. The piece probabilities are fitted by
expectation-maximisation (forward-backward) on word counts of a bounded sample of labelled rows.

Scale: fitting sees at most about `rows_per_language` documents a language; its tables are (language, word) counts
that Spark aggregates, and only (language, piece) sums, at most vocabulary * languages numbers, reach the driver.
Scoring is one map-only pass: nothing is shuffled, and a worker scores each distinct word once while it is cached.

Defined results: null text or text without a letter gives `und` with score 0; no labelled row at all (or an empty table) makes every
prediction `und`; ties go to the language that sorts first; very long texts are scored whole; repeated rows are scored alike; columns other than
the id, text and label are ignored, so clashing names cannot matter. A null id is never learned from.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diskloom.llm.common import materialize, text_batches

LETTERS = re.compile(r"[^\W\d_]+")
#: Runs of letters are learned from in parts of this many letters; they are scored whole.
LEARNED_LETTERS = 48
#: Words of more bytes are walked alone, in stretches of so many.
LONG_WORD = 2048
#: Forward sums below TINY are multiplied by its inverse, which is taken off their logarithm.
TINY = 1e-150
CACHE = 300_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def load_pieces(path: str) -> list[bytes]:
    """The pieces of a vocabulary file of (base64 piece, rank) lines; all single bytes are added if missing."""
    with open(path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    pieces |= {bytes([b]) for b in range(256)}
    # text is lower-cased and split into words first, so other pieces than these can't occur
    usable = re.compile(rb" ?[^\x00-@A-Z\[-`{-\x7f]+|[\x00-\xff]", re.DOTALL)
    return sorted(p for p in pieces if usable.fullmatch(p))


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def parts_of(words: list[str]) -> list[str]:
    """Words cut where they are longer than what is learned from."""
    return [w[i : i + LEARNED_LETTERS] for w in words for i in range(0, len(w), LEARNED_LETTERS)]


def forward(word: str, probability: dict[bytes, tuple[float, ...]], k: int) -> list[float]:
    """Log probability of a word in each of k languages, summed over all segmentations, in exact fractions: for tests."""
    from fractions import Fraction
    from math import log

    b, longest = b" " + word.encode("utf-8", "replace"), max(map(len, probability))
    alpha = [[Fraction(1)] * k]
    for j in range(1, len(b) + 1):
        total = [Fraction(0)] * k
        for i in range(max(0, j - longest), j):
            p = probability.get(b[i:j])
            if p is not None:
                total = [t + a * Fraction(q) for t, a, q in zip(total, alpha[i], p, strict=True)]
        alpha.append(total)
    return [log(t.numerator) - log(t.denominator) if t else -700.0 for t in alpha[-1]]


class Pieces:
    """The pieces by a 64-bit hash of their bytes, so that all substrings of many words are looked up at once."""

    BITS = 20

    def __init__(self, pieces: list[bytes]):
        h = np.array([self.hash_of(p) for p in pieces], np.uint64)
        self.longest = max(map(len, pieces), default=1)
        self.order = np.argsort(h)
        self.keys = h[self.order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[self._slot(h)] = True

    @staticmethod
    def hash_of(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * 0x9E3779B97F4A7C15 + b + 1) % (1 << 64)
        return h

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def edges(self, flat: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece number) of every piece within its word; left: bytes from each place to its word's end."""
        starts, lengths, numbers = [], [], []
        at, h = np.arange(len(flat)), np.zeros(len(flat), np.uint64)
        for n in range(1, self.longest + 1):
            inside = left[at] >= n
            at, h = at[inside], h[inside]
            if not len(at):
                break
            h = h * np.uint64(0x9E3779B97F4A7C15) + flat[at + n - 1] + np.uint64(1)
            maybe = np.flatnonzero(self.seen[self._slot(h)])
            where = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            ok = self.keys[where] == h[maybe]
            starts.append(at[maybe[ok]])
            numbers.append(self.order[where[ok]])
            lengths.append(np.full(int(ok.sum()), n))
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(numbers)


class Model:
    """Languages, pieces and the probability of each piece in each language."""

    def __init__(self, languages: list[str], pieces: list[bytes], probability: np.ndarray):
        self.languages, self.probability = languages, probability
        # built once on the driver and broadcast, not by every task
        self.pieces = Pieces(pieces)


def forward_all(words: list[str], pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """The log probabilities of many words: a row for each, a column for each language."""
    coded = [b" " + w.encode("utf-8", "replace") for w in words]
    out = np.zeros((len(words), probability.shape[1]))
    short = [k for k, b in enumerate(coded) if len(b) <= LONG_WORD]
    if short:
        out[short] = _forward([coded[k] for k in short], pieces, probability)
    for k, b in enumerate(coded):
        if len(b) > LONG_WORD:
            out[k] = _forward_long(b, pieces, probability)
    return out


def _steps(source: np.ndarray, target: np.ndarray, number: np.ndarray, step: np.ndarray, last: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Edges by the byte they end at: (sources, pieces, the states they lead to, the first edge of each)."""
    order = np.lexsort((target, step))
    source, target, number, step = source[order], target[order], number[order], step[order]
    bounds = np.searchsorted(step, np.arange(1, last + 2))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if a < b:
            into = target[a:b]
            heads = np.flatnonzero(np.append(True, into[1:] != into[:-1]))
            yield source[a:b], number[a:b], into[heads], heads


def _forward(coded: list[bytes], pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    flat = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(coded)), sizes)
    start, length, number = pieces.edges(flat, np.repeat(ends, sizes) - np.arange(len(flat)))
    # word w's states are its byte places and one past them: state = place + w
    first = ends - sizes
    source = start + word[start]
    alpha = np.zeros((len(flat) + len(coded), probability.shape[1]))
    begin = first + np.arange(len(coded))
    alpha[begin] = 1.0
    scale = np.zeros((len(coded), probability.shape[1]))
    of = np.repeat(np.arange(len(coded)), sizes + 1)
    for src, num, into, heads in _steps(source, source + length, number, start + length - first[word[start]], int(sizes.max())):
        new = np.add.reduceat(alpha[src] * probability[num], heads, axis=0)
        alpha[into] = new
        low = (new > 0) & (new < TINY)
        if low.any():
            # all states that later ones are reached from are scaled together
            for at, lang in zip(*np.nonzero(low), strict=True):
                state = into[at]
                alpha[max(begin[of[state]], state - pieces.longest) : state + 1, lang] /= TINY
                scale[of[state], lang] += np.log(TINY)
    return np.log(np.maximum(alpha[ends + np.arange(len(coded))], 1e-300)) + scale


def _forward_long(b: bytes, pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """The same for one word, a stretch of LONG_WORD bytes after another; only the last states go from one to the next."""
    k, reach = probability.shape[1], pieces.longest
    alpha, scale = np.zeros((1, k)), np.zeros(k)
    alpha[0] = 1.0
    for at in range(0, len(b), LONG_WORD):
        flat = np.frombuffer(b[at : at + LONG_WORD + reach], np.uint8).astype(np.uint64)
        start, length, number = pieces.edges(flat, len(flat) - np.arange(len(flat)))
        inside = start < LONG_WORD
        start, length, number = start[inside], length[inside], number[inside]
        # states 0 to LONG_WORD + reach of this stretch; what earlier pieces gave its first ones is there already
        held = np.zeros((len(flat) + 1, k))
        held[: len(alpha)] = alpha[: len(held)]
        for src, num, into, heads in _steps(start, start + length, number, start + length, len(flat)):
            held[into] += np.add.reduceat(held[src] * probability[num], heads, axis=0)
            low = (held[into[0]] > 0) & (held[into[0]] < TINY)
            if low.any():
                held[max(0, into[0] - reach) :, low] /= TINY
                scale[low] += np.log(TINY)
        alpha = held[LONG_WORD:] if len(b) > at + LONG_WORD else held[-1:]
    return np.log(np.maximum(alpha[-1], 1e-300)) + scale


def expected_counts(word: str, n: float, p: dict[bytes, float], out: dict[bytes, float], longest: int | None = None) -> None:
    """Add n times the expected number of uses of each piece in a random segmentation of the word."""
    b = b" " + word.encode("utf-8", "replace")
    m, longest = len(b), longest or max(map(len, p))
    spans = [(i, j, b[i:j], q) for j in range(1, m + 1) for i in range(max(0, j - longest), j) if (q := p.get(b[i:j]))]
    alpha, beta = [1.0] + [0.0] * m, [0.0] * m + [1.0]
    for i, j, _, q in spans:
        alpha[j] += alpha[i] * q
    for i, j, _, q in sorted(spans, key=lambda s: -s[0]):
        beta[i] += beta[j] * q
    if alpha[m] > 0:
        for i, j, piece, q in spans:
            out[piece] = out.get(piece, 0.0) + n * alpha[i] * q * beta[j] / alpha[m]


def held_out(doc_id) -> F.Column:
    """True for ids whose crc32, as text, leaves 2 when divided by 4; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def smooth(counts: np.ndarray) -> np.ndarray:
    """Rows: pieces, columns: languages. Mixed with what all languages share and with a uniform share."""
    own = counts / np.maximum(counts.sum(axis=0), 1e-9)
    return 0.99 * own + 0.009 * own.mean(axis=1, keepdims=True) + 0.001 / len(counts)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", vocabulary: str | None = None, rows_per_language: int = 400, rounds: int = 3) -> Model:
    """Fit on about rows_per_language rows of each label, chosen by a hash of the id."""
    pieces = load_pieces(vocabulary or default_vocabulary())
    spark = labelled.sparkSession
    text_batches(spark)
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("l")).where(F.col("i").isNotNull() & F.col("l").isNotNull())
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], pieces, np.zeros((len(pieces), 0)))
    share = spark.createDataFrame([(x, min(1_000_000, -(-rows_per_language * 1_000_000 // n))) for x, n in sizes.items()], "l string, share long")
    sample = rows.join(F.broadcast(share), "l").where(F.pmod(F.xxhash64(F.lit("fit"), F.col("i").cast("string")), F.lit(1_000_000)) < F.col("share")).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    seen.update((lang, w) for w in parts_of(words_of(text)))
            yield pa.RecordBatch.from_pydict({"l": [k[0] for k in seen], "w": [k[1] for k in seen], "n": pa.array(list(seen.values()), pa.int64())})

    words = materialize(sample.mapInArrow(count, "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n")), "langid-words")
    place = {p: i for i, p in enumerate(pieces)}
    probability = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, languages, probability))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, langs, table = shared.value
            longest = max(map(len, names))
            model = {x: dict(zip(names, table[:, k].tolist(), strict=True)) for k, x in enumerate(langs)}
            sums: dict[str, dict[bytes, float]] = {x: {} for x in langs}
            for batch in batches:
                for lang, word, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    expected_counts(word, n, model[lang], sums[lang], longest)
            for lang, got in sums.items():
                yield pa.RecordBatch.from_pydict({"l": pa.array([lang] * len(got), pa.string()), "p": pa.array(list(got), pa.binary()), "c": pa.array(list(got.values()), pa.float64())})

        counts = np.zeros_like(probability)
        for r in words.mapInArrow(expect, "l string, p binary, c double").groupBy("l", "p").agg(F.sum("c").alias("c")).toLocalIterator():
            counts[place[bytes(r["p"])], languages.index(r["l"])] = r["c"]
        probability = smooth(counts)
        shared.unpersist()
    return Model(languages, pieces, probability)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; score is the posterior under equal priors."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k, pieces = len(m.languages), m.pieces
        known: dict[str, int] = {}
        logs = np.zeros((1024, max(k, 1)))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(1).to_pylist()
                flat, sizes = [], []
                for text in texts:
                    found = words_of(text) if text and k else []
                    # a run may consist of numerals that are no digits: that is no letter
                    if found and not any(c.isalpha() for w in found for c in w):
                        found = []
                    sizes.append(len(found))
                    flat += found
                fresh = set(flat).difference(known)
                if len(known) + len(fresh) > CACHE:
                    known, fresh = {}, set(flat)
                if len(known) + len(fresh) > len(logs):
                    logs = np.vstack([logs, np.zeros((len(known) + len(fresh), max(k, 1)))])
                if fresh:
                    new = list(fresh)
                    logs[len(known) : len(known) + len(new)] = forward_all(new, pieces, m.probability)
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                of = logs[np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))] if flat else np.zeros((0, max(k, 1)))
                ends = np.cumsum(sizes)
                langs, scores = [], []
                for end, n in zip(ends, sizes, strict=True):
                    if not n:
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    total = of[end - n : end].sum(axis=0)
                    best = int(total.argmax())
                    langs.append(m.languages[best])
                    scores.append(float(1.0 / np.exp(total - total[best]).sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(score, f"`{id_col}` {kind}, lang_pred string, score double")


def identify(docs: DataFrame, **fit_options) -> DataFrame:
    """Fit on the rows that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.where(~held_out("doc_id") & F.col("doc_id").isNotNull()), **fit_options)
    return predict(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, min_score: float = 0.5, **fit_options) -> DataFrame:
    """The rows whose language is told with a posterior of min_score or more; `und` rows go. Columns are unchanged.

    Rows are scored where they stand (text travels through the worker once), so no join is needed.
    """
    from pyspark.sql import types as T

    model = fit(docs.where(~held_out("doc_id")), **fit_options)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    scored = predict(whole, model, "row", "text")
    assert isinstance(scored.schema["row"].dataType, T.StructType)
    return scored.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select("row.*")
