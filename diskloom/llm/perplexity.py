"""Quality rules: fixed counts, and the perplexity of a modified Kneser-Ney model of word trigrams of each language.

A word is what stands between white space in the lower-cased text, as a 64-bit hash; two marks stand before a text. All
trigrams of all documents are counted. A trigram (u, v, w) goes to the part of its middle word v: there the counts of u v w,
of its context u v, the number of words before v w and that of pairs around v are all at hand, in sorted arrays, so one
shuffle of words serves all orders. Only the number of words before each w crosses parts; it is summed in blocks.

A document is scored by the counts of all others: its own trigrams are taken from the counts of its trigrams and bigrams,
as a text that stands only once would else predict itself. Discounts and the counts of single words are the whole language's.
Documents outside their language's band of log perplexity are rejected; the band is the quartiles of the language's
documents that pass the base rules, widened by `width` times their distance.

Scale: the trigrams are shuffled, never stored. A first pass over the text counts them; WAVES more passes, each for a share of the
parts, send them again with their documents and score these on the spot. The files of a shuffle go when its pass is done. Words of a sample
are written as short numbers, all others as their hashes; that changes how much is shuffled, not the result. What is gathered grows with
the input. Parts grow in number with the input; one task holds all trigrams around one word. Sums of a document come back in each wave.
Documents are told apart by their place, which is the same at each reading of files; other tables are written down first.

Defined results: null text has no words, all counts 0, fails the base rule and has null perplexity; a null language
is a language of its own; text without words has null perplexity and is judged by the base rule alone; very long texts are counted whole;
a document on the edge of a band is inside; repeated rows are judged alike; null ids are carried; other columns are not read, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diskloom.llm.common import materialize, text_batches

WIDTH = 6.0
#: Words that a task holds before it writes them out to their parts.
HELD_WORDS = 2_500_000
#: Documents are scored in so many passes, each of which reads the text again, so that no more than that share of the words is on disk at once.
WAVES = 2
#: Words written as numbers, at most, and bytes of stored input whose words are looked through for them.
FREQUENT = 1 << 19
SAMPLE_BYTES = 64_000_000
#: Pairs of a trigram and a document whose probabilities a task works out at once.
SCORED_PAIRS = 500_000
#: Bytes of stored input for each part.
PART_BYTES = 8_000_000
_SPACES = (" ", "\t", "\n", "\v", "\f", "\r")


def discounts(counts: np.ndarray) -> np.ndarray:
    """D(0), D(1), D(2), D(3 and more) of modified Kneser-Ney; plain fractions where counts of counts are missing."""
    return discounts_of([float((counts == k).sum()) for k in range(1, 5)])


def discounts_of(n: list[float]) -> np.ndarray:
    """The same from how many counts are 1, 2, 3 and 4."""
    if not all(n[:2]):
        return np.array([0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1] if n[2] else 1.0, 3 - 4 * y * n[3] / n[2] if n[2] and n[3] else 1.5]
    return np.array([0, *(min(max(v, 0.05), k + 0.95) for k, v in enumerate(d))])


def windows(words: np.ndarray) -> np.ndarray:
    """A hash of each run of 8 of these hashes."""
    h = words
    with np.errstate(over="ignore"):
        for j in (1, 2, 4):
            h = h[:-j] * np.uint64(0x9E3779B97F4A7C15) + h[j:]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def base_counts(text: str | None, hashed: np.ndarray | None = None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. hashed: word_hashes of the text, where they are there."""
    if not text:
        return 0, 0, 0, 0, 0
    low = (word_hashes(text) if hashed is None else hashed)[2:]
    n_words = len(low)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, "#*$%&|<>"))
    raw = text.encode("utf-8", "surrogatepass")
    lines = [line for line in raw.split(b"\n") if line.strip()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    # what stands twice stands twice in lower case
    if n_words > 8 and np.diff(np.sort(windows(low))).min() == 0:
        h = windows(np.fromiter(map(xxhash.xxh3_64_intdigest, raw.split()), np.uint64, n_words))
        n = n_words - 7
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        if same.any():
            twice = np.zeros(n, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(n_words + 1, np.int64)
            edge[:n] += twice
            edge[8 : 8 + n] -= twice
            repeat = int((np.cumsum(edge)[:n_words] > 0).sum())
    return n_words, chars, symbols, dup, repeat


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed planes of bytes."""
    out = []
    for a in arrays:
        z = pa.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), "zstd", asbytes=True) if len(a) else b""
        out.append(struct.pack("<BII", a.itemsize, len(a), len(z)) + z)
    return b"".join(out)


def unpack(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        width, n, size = struct.unpack_from("<BII", raw, at)
        at += 9
        planes = pa.decompress(raw[at : at + size], n * width, "zstd", asbytes=True) if n else b""
        out.append(np.frombuffer(planes, np.uint8).reshape(width, n).T.copy().view(f"<u{width}").ravel())
        at += size
    return out


def steps(a: np.ndarray) -> np.ndarray:
    """A sorted array as its differences, which pack smaller; np.cumsum gives it back."""
    return np.diff(a, prepend=a.dtype.type(0))


def word_hashes(text: str) -> np.ndarray:
    """Two marks (0) and the hash of each word."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    out = np.zeros(len(words) + 2, np.uint64)
    out[2:] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return out


class Frequent:
    """Words that are written as numbers: 0 is the mark, then the given ones, by frequency; `n` stands for all others."""

    def __init__(self, words: np.ndarray):
        self.words = np.append(np.uint64(0), words[words != 0]).astype(np.uint64)
        self.n = len(self.words)
        self.shift = np.uint64(64 - (4 * self.n).bit_length())
        self.slots = np.full(1 << (4 * self.n).bit_length(), self.n, np.uint32)
        # of words that share a slot the most frequent one has a number
        self.slots[self.words[::-1] >> self.shift] = np.arange(self.n - 1, -1, -1, dtype=np.uint32)
        self.checked = np.append(self.words, np.uint64(0))

    def numbers(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the number of each word, the sorted other words): the k-th other word has the number n + k."""
        numbers = self.slots[words >> self.shift]
        missed = np.flatnonzero((self.checked[numbers] != words) | (numbers == self.n))
        other, k = np.unique(words[missed], return_inverse=True)
        numbers[missed] = self.n + k
        return numbers, other


def part_of(words: np.ndarray, parts: int) -> np.ndarray:
    return ((words * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)


def ordered(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """An order by v, u, w, which are numbers below n."""
    bits = np.uint64(int(n).bit_length())
    if 3 * int(bits) > 64:
        return np.lexsort((w, u, v)).astype(np.uint32)
    key = v.astype(np.uint64)
    for some in (u, w):
        key <<= bits
        key |= some
    return np.argsort(key).astype(np.uint32)


def in_order(held: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """u, v, w and what goes with them (held: u v w, that) by v, u, w, which are numbers below n. held is emptied, so that nothing stays twice."""
    cols, also = held
    held.clear()
    bits = np.uint64(int(n).bit_length())
    if 3 * int(bits) > 64:
        order = ordered(*cols, n)
        also = also[order]
        for k in range(3):
            cols[k] = cols[k][order]
        return *cols, also
    key = cols[1].astype(np.uint64)
    for k in (0, 2):
        key <<= bits
        key |= cols[k]
    del cols
    order = np.argsort(key)
    also = also[order]
    key = key[order]
    del order
    out = []
    for _ in range(3):
        out.append(key.astype(np.uint32))
        out[-1] &= np.uint32((1 << int(bits)) - 1)
        key >>= bits
    return out[1], out[2], out[0], also


def to_parts(texts: list[np.ndarray], docs: np.ndarray, parts: int, frequent: Frequent, wave: int | None = None, waves: int = 1) -> Iterator[tuple[int, int, bytes]]:
    """(part, first document, packed words) of hashed texts.

    Without a wave: each trigram and how often it stands here, (other words, u, steps of v, w, count). Of one wave: the
    trigrams in their order with their documents, (other words, u, v, w, steps between documents), for the wave's parts.
    """
    sizes = np.array([len(t) for t in texts])
    ids, other = frequent.numbers(np.concatenate(texts))
    inner = np.ones(len(ids), bool)
    starts = np.cumsum(sizes) - sizes
    inner[starts] = inner[starts + 1] = False
    at = np.flatnonzero(inner)
    part = part_of(np.append(frequent.words, other), parts)[ids[at - 1]]
    doc = np.repeat(docs, sizes - 2)
    if wave is not None and waves > 1:
        mine = part % waves == wave
        at, part, doc = at[mine], part[mine], doc[mine]
    if not len(at):
        return
    order = np.argsort(part, kind="stable")
    at, part, doc = at[order], part[order], doc[order]
    edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        u, v, w = cols = ids[np.stack([at[a:z] - 2, at[a:z] - 1, at[a:z]])]
        rare = cols >= frequent.n
        own, k = np.unique(cols[rare], return_inverse=True)
        cols[rare] = frequent.n + k
        hashes = steps(other[own - frequent.n])
        if wave is None:
            order = ordered(u, v, w, frequent.n + len(own))
            u, v, w = cols[:, order]
            first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (u[1:] != u[:-1]) | (w[1:] != w[:-1])))
            yield int(part[a]), int(doc[a]), pack(hashes, u[first], steps(v[first]), w[first], np.diff(np.append(first, len(u))).astype(np.uint32))
        else:
            yield int(part[a]), int(doc[a]), pack(hashes, u, v, w, np.diff(doc[a:z], prepend=doc[a]).astype(np.uint32))


def together(chunks: list[list[np.ndarray]], frequent: Frequent) -> tuple[np.ndarray, np.ndarray]:
    """Unpacked words of several tasks: (their sorted other words, u v w by common numbers)."""
    hashes = [np.cumsum(c[0], dtype=np.uint64) for c in chunks]
    other, numbers = np.unique(np.concatenate(hashes), return_inverse=True)
    table, at, done = np.arange(frequent.n + max(map(len, hashes)), dtype=np.uint32), 0, 0
    cols = np.empty((3, sum(len(c[1]) for c in chunks)), np.uint32)
    for c, own in zip(chunks, hashes, strict=True):
        table[frequent.n : frequent.n + len(own)] = frequent.n + numbers[at : at + len(own)]
        at += len(own)
        for k in range(3):
            cols[k, done : done + len(c[1])] = table[c[1 + k]]
        done += len(c[1])
        del c[1:4]
    return other, cols


def counted(raws: list[bytes], frequent: Frequent) -> tuple[list[int], list[int], bytes]:
    """Of what tasks counted in a part: how many trigrams stand 1, 2, 3, 4 times and how many there are, the same of bigrams by
    the words before them, and the last words of bigrams with the words before them (steps of numbers, n, steps of other words, n)."""
    chunks = [unpack(raw) for raw in raws]
    for c in chunks:
        c[2] = np.cumsum(c[2], dtype=np.uint32)
    other, cols = together(chunks, frequent)
    held = [cols, np.concatenate([c[-1] for c in chunks])]
    chunks.clear()
    del cols
    u, v, w, n = in_order(held, frequent.n + len(other))
    tri = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (u[1:] != u[:-1]) | (w[1:] != w[:-1])))
    c3 = np.add.reduceat(n, tri, dtype=np.int64)
    pairs = (v[tri].astype(np.uint64) << np.uint64(32)) | w[tri]
    del u, v, w, n, tri
    pairs.sort()
    bi = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    c2 = np.diff(np.append(bi, len(pairs)))
    last, n = np.unique(pairs[bi].astype(np.uint32), return_counts=True)
    n, cut = n.astype(np.uint32), int(np.searchsorted(last, frequent.n))
    n3, n2 = ([int((c == k).sum()) for k in range(1, 5)] + [len(c)] for c in (c3, c2))
    return n3, n2, pack(steps(last[:cut]), n[:cut], steps(other[last[cut:] - frequent.n]), n[cut:])


def totals(numbers: np.ndarray, counts: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each of these sorted numbers (the sum of its counts, of their discounts), in blocks that hold a number whole."""
    total, back = np.zeros(int(numbers[-1]) + 1), np.zeros(int(numbers[-1]) + 1)
    at = 0
    while at < len(numbers):
        z = int(np.searchsorted(numbers, numbers[min(at + SCORED_PAIRS, len(numbers)) - 1], "right"))
        first, end = int(numbers[at]), int(numbers[z - 1]) + 1
        some, c = numbers[at:z] - numbers[at], counts[at:z]
        total[first:end], back[first:end] = np.bincount(some, c), np.bincount(some, d[np.minimum(c, 3)])
        at = z
    return total, back


class Trigrams:
    """The trigrams around some middle words with their documents, sorted by v, u, w, document; n_ names how many of each there are."""

    def __init__(self, n_words: int, held: list[np.ndarray], keys: np.ndarray):
        """held: u, v, w, doc; it is emptied, and each goes as soon as it is not needed."""
        self.n_words, self.keys = n_words, keys
        u, v, w, doc = held
        held.clear()
        end = np.uint32(len(u))
        new_uv = np.append(True, (v[1:] != v[:-1]) | (u[1:] != u[:-1]))
        del u
        new_tri = new_uv | np.append(True, w[1:] != w[:-1])
        pair = np.flatnonzero(new_tri | np.append(True, doc[1:] != doc[:-1])).astype(np.uint32)
        #: of each (trigram, document): how often, the trigram's number, the document
        self.of = doc[pair]
        del doc
        self.own = np.diff(pair, append=end)
        self.tri = np.cumsum(new_tri[pair], dtype=np.uint32)
        self.tri -= np.uint32(1)
        del pair
        tri = np.flatnonzero(new_tri).astype(np.uint32)
        #: of each trigram
        self.c3 = np.diff(tri, append=end)
        self.ctx = np.cumsum(new_uv[tri], dtype=np.uint32)
        self.ctx -= np.uint32(1)
        del new_uv, new_tri
        pairs = v[tri].astype(np.uint64)
        del v
        pairs <<= np.uint64(32)
        pairs |= w[tri]
        del w, tri
        order = np.argsort(pairs).astype(np.uint32)
        pairs = pairs[order]
        new_bi = np.append(True, pairs[1:] != pairs[:-1])
        bigrams = pairs[new_bi]
        del pairs
        self.bi = np.empty(len(order), np.uint32)
        self.bi[order] = np.cumsum(new_bi, dtype=np.uint32) - np.uint32(1)
        #: of each bigram v w
        self.c2 = np.bincount(self.bi)
        self.bi_v, self.bi_w = (bigrams >> np.uint64(32)).astype(np.int64), bigrams.astype(np.uint32)

    @classmethod
    def merged(cls, held: list[tuple[int, bytes]], frequent: Frequent) -> Trigrams:
        """Of what several tasks wrote for one wave: (task and first document, packed words), in this order. held is emptied."""
        chunks = [unpack(raw) for _, raw in held]
        firsts = [key for key, _ in held]
        held.clear()
        other, cols = together(chunks, frequent)
        doc, keys, n, at, last = np.empty(cols.shape[1], np.uint32), [], 0, 0, None
        for key, c in zip(firsts, chunks, strict=True):
            docs = np.uint64(key) + np.cumsum(c.pop(), dtype=np.uint64)
            new = np.append(docs[0] != last, docs[1:] != docs[:-1])
            doc[at : at + len(docs)] = np.cumsum(new) + (n - 1)
            keys.append(docs[new])
            n, at, last = n + len(keys[-1]), at + len(docs), docs[-1]
        chunks.clear()
        n_words = frequent.n + len(other)
        given = [cols, doc]
        del cols, doc
        u, v, w, doc = in_order(given, n_words)
        # the documents of each trigram in order
        by = np.cumsum(np.append(False, (v[1:] != v[:-1]) | (u[1:] != u[:-1]) | (w[1:] != w[:-1])), dtype=np.uint64)
        by <<= np.uint64(32)
        by |= doc
        del doc
        by.sort()
        given += [u, v, w, by.astype(np.uint32)]
        del u, v, w, by
        return cls(n_words, given, np.concatenate(keys))

    def last_words(self) -> np.ndarray:
        """Numbers of the words w, in order: as `counted` has them."""
        return np.unique(self.bi_w)

    def log_probabilities(self, d3: np.ndarray, d2: np.ndarray, p1: np.ndarray) -> np.ndarray:
        """For each document the sum of log p(w | u v) by the counts of all others. p1: of each word, from last_words."""
        n_docs = len(self.keys)
        taken = lambda d, c: d[np.minimum(c, 3)]
        share = lambda some, all_: np.where(all_ > 0, some / np.maximum(all_, 1), 0.0)
        (total_ctx, back_ctx), (total_v, back_v) = totals(self.ctx, self.c3, d3), totals(self.bi_v, self.c2, d2)
        out = np.zeros(n_docs)
        # what is taken from the counts concerns one document alone, so documents are dealt with in blocks
        by_doc = np.argsort(self.of, kind="stable").astype(np.uint32)
        ends = np.cumsum(np.bincount(self.of, minlength=n_docs))
        at = 0
        while at < len(by_doc):
            z = int(ends[np.searchsorted(ends, min(at + SCORED_PAIRS, len(by_doc)))])
            some = np.sort(by_doc[at:z])
            at = z
            own, tri, of = self.own[some].astype(np.int64), self.tri[some], self.of[some].astype(np.int64)
            c = self.c3[tri].astype(np.int64)
            rest = c - own
            ctx, bi = self.ctx[tri].astype(np.int64), self.bi[tri].astype(np.int64)
            _, by = np.unique(ctx * n_docs + of, return_inverse=True)
            total = total_ctx[ctx] - np.bincount(by, own)[by]
            back = back_ctx[ctx] - np.bincount(by, taken(d3, c) - taken(d3, rest))[by]
            pairs, by = np.unique(bi * n_docs + of, return_inverse=True)
            pair_bi = pairs // n_docs
            c2 = self.c2[pair_bi]
            rest2 = c2 - np.bincount(by, rest == 0).astype(np.int64)
            v = self.bi_v[pair_bi]
            _, by_v = np.unique(v * n_docs + pairs % n_docs, return_inverse=True)
            total2 = total_v[v] - np.bincount(by_v, c2 - rest2)[by_v]
            back2 = back_v[v] - np.bincount(by_v, taken(d2, c2) - taken(d2, rest2))[by_v]
            p2 = share(rest2 - taken(d2, rest2), total2) + np.where(total2 > 0, share(back2, total2), 1.0) * p1[self.bi_w[pair_bi]]
            p3 = share(rest - taken(d3, rest), total) + np.where(total > 0, share(back, total), 1.0) * p2[by]
            out += np.bincount(of, own * np.log(p3), n_docs)
        return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Runs of rows of one language and part."""
    held: list[dict] = []
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if held and (row["lang"], row["part"]) != (held[0]["lang"], held[0]["part"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def read(docs: DataFrame, parts: int, id_col: str, text_col: str, lang_col: str, words: np.ndarray, wave: int | None = None, waves: int = 1) -> DataFrame:
    """Without a wave: a row (key, id, lang, base counts) for each document, and rows (lang, part, words) of all counted words.

    Of one wave: rows (lang, part, task and first document, words). lang: a sign and the language, so that a null language is none of the others.
    """
    label = F.col(lang_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.when(label.isNull(), "-").otherwise(F.concat(F.lit("+"), label)).alias("lang"), F.col(text_col).alias("text"))
    counting = wave is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        texts: dict[str, list[np.ndarray]] = {}
        numbers: dict[str, list[int]] = {}
        held = count = 0
        kinds = None
        frequent = Frequent(words)

        def row(ids: pa.Array, langs: list, part: list, key: list, base: list, words: list) -> pa.RecordBatch:
            columns = [ids, pa.array(langs, pa.string()), pa.array(part, pa.int32()), pa.array(key, pa.int64()), *(pa.array(c, pa.int64()) for c in base), pa.array(words, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["id", "lang", "part", "key", *NAMES, "words"])

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, some in texts.items():
                for part, first, raw in to_parts(some, np.array(numbers[lang], np.int64), parts, frequent, wave, waves):
                    yield row(pa.nulls(1, kinds), [lang], [part], [(task << 32) + first], [[None]] * 5, [raw])
            texts.clear()
            numbers.clear()

        for whole in batches:
            kinds = whole.schema.field(0).type
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                n = batch.num_rows
                langs, out = batch.column(1).to_pylist(), []
                for k, text in enumerate(batch.column(2).to_pylist()):
                    hashed = word_hashes(text or "")
                    if counting:
                        out.append(base_counts(text, hashed))
                    if len(hashed) > 2:
                        texts.setdefault(langs[k], []).append(hashed)
                        numbers.setdefault(langs[k], []).append(count + k)
                        held += len(hashed)
                if counting:
                    yield row(batch.column(0), langs, [-1 - (count + k) % parts for k in range(n)], [(task << 32) + count + k for k in range(n)], [[r[j] for r in out] for j in range(5)], [None] * n)
                count += n
                if held > HELD_WORDS:
                    yield from flush()
                    held = 0
        yield from flush()

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang string, part int, key long, {', '.join(f'{c} long' for c in NAMES)}, words binary")


def gather(rows: DataFrame, parts: int, words: np.ndarray) -> DataFrame:
    """The rows of documents as they are, and one row a language and part: (n3, n2: counts of counts, last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = schema = None
        frequent = Frequent(words)

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                n3, n2, last = counted(held, frequent)
                columns = [pa.nulls(1, f.type) for f in schema]
                columns[1], columns[2] = pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int32())
                stats = [pa.array([n], pa.list_(pa.int64())) for n in (n3, n2)]
                yield pa.RecordBatch.from_arrays([*columns, *stats, pa.array([last], pa.binary())], names=[*schema.names, "n3", "n2", "last"])
            held.clear()

        for batch in batches:
            schema = batch.schema
            part = batch.column("part").to_numpy()
            docs = batch.filter(pa.array(part < 0))
            if docs.num_rows:
                none = pa.nulls(docs.num_rows, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*docs.columns, none, none, pa.nulls(docs.num_rows, pa.binary())], names=[*schema.names, "n3", "n2", "last"])
            for k in np.flatnonzero(part >= 0):
                key = (batch.column("lang")[k].as_py(), int(part[k]))
                if key != now:
                    yield from done()
                    now = key
                held.append(batch.column("words")[k].as_py())
        yield from done()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(parts, "lang", "part").sortWithinPartitions("lang", "part").mapInArrow(run, f"{kinds}, n3 array<long>, n2 array<long>, last binary").drop("words")


def sum_last(state: DataFrame, parts: int, n_frequent: int) -> DataFrame:
    """(lang, part, block, n: packed sums over all parts of the part's last words in the block, distinct): by blocks of numbers, then of hashes."""
    cut = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("from", pa.int32()), ("last", pa.binary())])
    back = pa.schema([("lang", pa.string()), ("to", pa.int32()), ("block", pa.int32()), ("n", pa.binary()), ("distinct", pa.int64())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                numbers, n, other, n_other = unpack(row["last"])
                numbers, other = np.cumsum(numbers, dtype=np.uint64), np.cumsum(other, dtype=np.uint64)
                for words, n, block in ((numbers, n, numbers.astype(np.int64) * parts // n_frequent), (other, n_other, parts + block_of(other, parts))):
                    if len(words):
                        edges = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
                        yield _batch([(row["lang"], int(block[a]), row["part"], pack(steps(words[a:z]), n[a:z])) for a, z in zip(edges[:-1], edges[1:], strict=True)], cut)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            got = [unpack(r["last"]) for r in rows]
            words, by = np.unique(np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got]), return_inverse=True)
            n = np.bincount(by, np.concatenate([g[1] for g in got])).astype(np.uint32)
            ends = np.cumsum([len(g[0]) for g in got])
            yield _batch([(r["lang"], r["from"], r["part"], pack(n[by[z - len(g[0]) : z]]), len(words) if not k else 0) for k, (r, g, z) in enumerate(zip(rows, got, ends, strict=True))], back)

    blocks = state.select("lang", "part", "last").mapInArrow(split, "lang string, part int, `from` int, last binary")
    return blocks.repartition(parts, "lang", "part").sortWithinPartitions("lang", "part").mapInArrow(total, "lang string, `to` int, block int, n binary, distinct long")


def block_of(words: np.ndarray, parts: int) -> np.ndarray:
    """Of sorted words, in their order."""
    return ((words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def frequent_words(docs: DataFrame, text_col: str, size: int) -> np.ndarray:
    """The hashes of the most frequent words of a sample of the texts, by frequency."""
    rows = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # no more than one text in four, and a bounded number of bytes
    rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < max(1, int(1_000_000 * min(0.25, SAMPLE_BYTES / max(size, 1)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = [word_hashes(text)[2:] for text in batch.column(0).to_pylist()]
            words, n = np.unique(np.concatenate(hashed), return_counts=True) if hashed else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])

    counts = rows.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = materialize(counts, "frequent-words")
    # as many rows as there are different counts below 1,000
    least, left = 1000, FREQUENT
    for n, words in sorted(((r["n"], r["words"]) for r in counts.groupBy(F.least("n", F.lit(1000)).alias("n")).agg(F.count("*").alias("words")).collect()), reverse=True):
        left -= words
        if left < 0:
            break
        least = n

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pack(*(c.to_numpy().view(np.uint64) for c in batch.columns))], pa.binary())], names=["words"])

    # FREQUENT words at most
    got = [unpack(r["words"]) for r in counts.where(F.col("n") >= least).mapInArrow(packed, "words binary").collect()]
    if not got:
        return np.zeros(0, np.uint64)
    words, n = (np.concatenate([g[k] for g in got]) for k in (0, 1))
    return words[np.lexsort((words, n.max() - n))]


@contextmanager
def passes(spark: SparkSession) -> Iterator[None]:
    """For several readings of a table: files are cut into the same tasks, however many executors have come or gone, and
    queries lose their shuffle files when they end, not when the driver happens to collect garbage."""
    cores = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.files.minPartitionNum": spark.conf.get("spark.sql.files.minPartitionNum", None) or str(cores)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def read_from_files(docs: DataFrame) -> bool:
    """Whether the rows come straight from files, so that each reading gives the same ones in the same tasks."""
    node = docs._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter") and node.deterministic():
        node = node.children().apply(0)
    return node.nodeName() == "LogicalRelation" and node.relation().getClass().getSimpleName() == "HadoopFsRelation"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, the base counts, log_ppl) of every row, as a written table."""
    text_batches(docs.sparkSession)
    with passes(docs.sparkSession):
        if not read_from_files(docs):
            docs = materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), "ngram-texts")
            id_col, text_col, lang_col = docs.columns
        return _score(docs, id_col, text_col, lang_col)


def _score(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    # about 4 million words a part where the size of the input is known
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = max(8, min(4 * docs.rdd.getNumPartitions(), size // PART_BYTES))
    words = frequent_words(docs, text_col, size)
    rows = materialize(gather(read(docs, parts, id_col, text_col, lang_col, words), parts, words), "word-counts")
    state = rows.where(F.col("part") >= 0)
    last = materialize(sum_last(state, parts, Frequent(words).n), "last-words")
    sums = lambda c: F.array(*[F.sum(F.col(c)[k]) for k in range(5)]).alias(c)
    distinct = {r["lang"]: r["n"] for r in last.groupBy("lang").agg(F.sum("distinct").alias("n")).collect()}
    # one row for each language label
    laws = {r["lang"]: (discounts_of([float(x) for x in r["n3"][:4]]), discounts_of([float(x) for x in r["n2"][:4]]), r["n2"][4], distinct[r["lang"]]) for r in state.groupBy("lang").agg(sums("n3"), sums("n2")).collect()}
    sent = pa.schema([("task", pa.int64()), ("part", pa.int32()), ("sums", pa.binary())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent(words)
        for rows in _groups(batches):
            d3, d2, bigrams, n_words = laws[rows[0]["lang"]]
            part = rows[0]["part"]
            rows.sort(key=lambda r: r["key"])
            held = [(r["key"], r["words"]) for r in rows if r["key"] >= 0]
            rows[:] = [r for r in rows if r["key"] < 0]
            t = Trigrams.merged(held, frequent)
            p1 = np.zeros(t.n_words)
            # blocks are numbered backwards from -1
            p1[t.last_words()] = 0.05 / n_words + 0.95 * np.concatenate([unpack(r["words"])[0] for r in reversed(rows)]) / bigrams
            logs = t.log_probabilities(d3, d2, p1).astype(np.float32).view(np.uint32)
            keys = t.keys
            # the next group is not to be read beside this one
            del t, p1
            task = (keys >> np.uint64(32)).astype(np.int64)
            edges = np.append(np.flatnonzero(np.append(True, task[1:] != task[:-1])), len(task))
            doc = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield _batch([(int(task[a]), part, pack(steps(doc[a:z]), logs[a:z])) for a, z in zip(edges[:-1], edges[1:], strict=True)], sent)

    def add(p: pd.DataFrame) -> pd.DataFrame:
        got = [unpack(raw) for raw in p.sort_values(["part", "sums"])["sums"]]
        doc = np.concatenate([np.cumsum(g[0], dtype=np.uint32) for g in got])
        logs = np.concatenate([g[1].view(np.float32) for g in got])
        some, by = np.unique(doc, return_inverse=True)
        return pd.DataFrame({"_key": (int(p["task"].iloc[0]) << 32) + some.astype(np.int64), "logs": np.bincount(by, logs)})

    scored = rows.where(F.col("part") < 0).select("key", "id", "lang", *NAMES)
    for wave in range(WAVES):
        sought = last.where(F.col("to") % WAVES == wave).select("lang", F.col("to").alias("part"), (-1 - F.col("block")).cast("long").alias("key"), F.col("n").alias("words"))
        met = read(docs, parts, id_col, text_col, lang_col, words, wave, WAVES).select("lang", "part", "key", "words").unionByName(sought)
        met = met.repartition(parts, "lang", "part").sortWithinPartitions("lang", "part")
        logs = materialize(met.mapInArrow(judge, "task long, part int, sums binary").groupBy("task").applyInPandas(add, "_key long, logs double"), "wave-sums")
        scored = scored.join(logs.select("_key", F.col("logs").alias(f"_logs_{wave}")), F.col("key") == F.col("_key"), "left").drop("_key")
    some = [F.col(f"_logs_{wave}") for wave in range(WAVES)]
    # null where a text has no word
    logs = sum((F.coalesce(c, F.lit(0.0)) for c in some), F.lit(0.0))
    return materialize(scored.select("id", "lang", *NAMES, F.when(F.coalesce(*some).isNotNull(), -logs / F.col("n_words")).alias("log_ppl")), "ngram-scores")


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", width: float = WIDTH) -> DataFrame:
    """(id, base counts, base_failed, kept, perplexity) of every row."""
    scored = score(docs, id_col, text_col, lang_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    bands = scored.where(~failed & F.col("log_ppl").isNotNull()).groupBy("lang").agg(F.percentile_approx("log_ppl", [0.25, 0.75], 10_000).alias("q"))
    bands = bands.select("lang", (F.col("q")[0] - width * (F.col("q")[1] - F.col("q")[0]) - 1e-9).alias("lo"), (F.col("q")[1] + width * (F.col("q")[1] - F.col("q")[0]) + 1e-9).alias("hi"))
    # one row for each language label
    judged = scored.join(F.broadcast(bands), "lang", "left")
    inside = F.coalesce(F.col("log_ppl").between(F.col("lo"), F.col("hi")), F.lit(True))
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"), F.round(F.exp("log_ppl"), 6).alias("perplexity"))
