"""Benchmark decontamination by the q-gram lemma and banded alignment.

Text and items are lower-cased and runs of white space become one space. An item of m characters occurs in a document
if some region of it is within k = min(error * m, (m - q) / q) edits of the item. By the q-gram lemma such a region
shares at least t = m - q + 1 - k q of the item's q-grams, all on k + 1 neighbouring diagonals (position in the
document less position in the item). Hits are counted in diagonal bands 2 (k + 1) wide that overlap by half, so one
band holds them all; bands with t hits are verified by an alignment confined to the band and k diagonals around it.
Items below `min_chars` characters are too short for edits to mean much: they match word for word, found by an automaton of all of them.

Scale: one map-only pass over the documents for each block of items of at most `block_chars` characters; the block's
q-gram index (about 24 bytes a character, 50 while it is made) is built by each worker, so its size is bounded whatever the size of the
benchmark. A bitmap drops most q-grams of a document before the index is searched. Very long texts are taken in overlapping parts, and
the hits of a part in slices of `HITS`: a text and an item that repeat the same few q-grams hit one another everywhere.

Defined results: null or empty texts match nothing; null items, and those without more than white space, match nothing; very long texts
are searched whole, in overlapping parts; of equally good places the first is told; repeated rows give repeated matches; of repeated items
each is reported under its id; null ids are carried as null; no column but id and text is read, whatever their names; an empty table on
either side gives no match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diskloom.llm.common import scratch_path, text_batches
from diskloom.scratch import _drop

Q, ERROR, MIN_CHARS = 8, 0.1, 40
BLOCK_CHARS = 8_000_000
#: A text is searched in parts of this many characters.
PART = 1 << 18
#: Hits that are held at once.
HITS = 1 << 20
_BITS = 24


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hashes of the q-grams at each position."""
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = c.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(q):
            h = h * np.uint64(0x100000001B3) + x[j : j + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def budget(m: int, q: int = Q, error: float = ERROR) -> int:
    """Edits allowed for an item of m characters; at this many the lemma still asks for a shared q-gram."""
    return min(int(error * m), (m - q) // q)


class Index:
    """Sorted q-grams of a block of items, and an automaton of the short ones, whose numbers follow."""

    def __init__(self, items: list[tuple[object, str]], q: int = Q, error: float = ERROR, min_chars: int = 0):
        brief = [x for x in items if len(x[1]) < max(min_chars, q)]
        items = [x for x in items if len(x[1]) >= max(min_chars, q)]
        self.brief = None
        if brief:
            import ahocorasick

            self.brief = ahocorasick.Automaton()
            numbers: dict[str, list[int]] = {}
            for k, (_, t) in enumerate(brief, len(items)):
                numbers.setdefault(f" {t} ", []).append(k)
            for t, found in numbers.items():
                self.brief.add_word(t, found)
            self.brief.make_automaton()
        self.q, self.ids, self.texts = q, [i for i, _ in items], [t for _, t in items]
        self.m = np.array([len(t) for t in self.texts], np.int64)
        self.k = np.array([budget(int(m), q, error) for m in self.m], np.int64)
        n = np.maximum(self.m - q + 1, 0)
        key, item, pos = np.empty(n.sum(), np.uint64), np.repeat(np.arange(len(n), dtype=np.int32), n), np.empty(n.sum(), np.int32)
        for t, size, end in zip(self.texts, n, np.cumsum(n), strict=True):
            key[end - size : end] = qgrams(codes(t), q)
            pos[end - size : end] = np.arange(size)
        order = np.argsort(key, kind="stable")
        key = key[order]
        self.item, self.pos = item[order], pos[order]
        del order, item, pos
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        self.keys, self.first = key[new], np.append(np.flatnonzero(new), len(key))
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        self.ids += [i for i, _ in brief]

    def candidates(self, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(items, bands) that meet the lemma's bound, in slices of HITS hits.

        Hits come in the text's order and those of a band lie close together, so a band is told when the text has passed it; only open ones are kept.
        """
        h = qgrams(c, self.q)
        at = np.flatnonzero(self.seen[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        where = np.searchsorted(self.keys, h[at])
        ok = where < len(self.keys)
        at, where = at[ok], where[ok]
        ok = self.keys[where] == h[at]
        at, where = at[ok], where[ok]
        cum = np.append(0, np.cumsum(self.first[where + 1] - self.first[where]))
        key, hits = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for lo in range(0, int(cum[-1]), HITS):
            hi = min(lo + HITS, int(cum[-1]))
            # the places of the text with hits lo .. hi - 1, and how many of these each has
            a, b = int(np.searchsorted(cum, lo, "right")) - 1, int(np.searchsorted(cum, hi, "left"))
            place = np.repeat(np.arange(a, b), np.minimum(cum[a + 1 : b + 1], hi) - np.maximum(cum[a:b], lo))
            into = self.first[where[place]] + np.arange(lo, hi) - cum[place]
            item = self.item[into].astype(np.int64)
            band = (at[place] - self.pos[into] + self.m[item]) // (self.k[item] + 1)
            # band j: diagonals from j to j + 2 steps; a hit on step j counts for j and j - 1
            step, count = np.unique((item << np.int64(40)) | (band + 1), return_counts=True)
            key, back = np.unique(np.concatenate([key, step, step - 1]), return_inverse=True)
            hits = np.bincount(back, np.concatenate([hits, count, count])).astype(np.int64)
            item, band = key >> np.int64(40), (key & ((1 << 40) - 1)) - 1
            # of later hits none lies before this place, and a band has none from its last diagonal's end on
            passed = np.ones(len(key), bool) if hi == cum[-1] else (band + 2) * (self.k[item] + 1) <= at[np.searchsorted(cum, hi, "right") - 1]
            enough = passed & (hits >= self.m[item] - self.q + 1 - self.k[item] * self.q)
            yield item[enough], band[enough]
            key, hits = key[~passed], hits[~passed]


def align(a: np.ndarray, b: np.ndarray, lo: int, width: int, k: int) -> tuple[int, int]:
    """(edits, end) of the best place of a in b whose path stays on diagonals lo .. lo + width - 1, or (k + 1, -1)."""
    c = np.arange(width)
    base = np.full(len(a) + width, 0xFFFFFFFF, np.uint32)
    src = slice(max(0, lo), max(0, min(len(b), lo + len(base))))
    base[src.start - lo : src.start - lo + max(0, src.stop - src.start)] = b[src]
    # a place before the text or after it is no place
    at = lo + c
    inside = lo >= 0 and lo + len(a) + width <= len(b)
    d = np.where((at >= 0) & (at <= len(b)), 0, k + 1)
    far = np.full(width, k + 1)
    skip = far + 1
    for i in range(1, len(a) + 1):
        skip[:-1] = d[1:]
        skip[:-1] += 1
        d = d + (base[i - 1 : i - 1 + width] != a[i - 1])
        np.minimum(d, skip, out=d)
        if not inside:
            d[(at + i > len(b)) | (at + i < 0)] = k + 1
        d -= c
        np.minimum.accumulate(d, out=d)
        d += c
        np.minimum(d, far, out=d)
        if not i & 7 and d.min() > k:
            return k + 1, -1
    d[at + len(a) > len(b)] = k + 1
    best = int(d.argmin())
    return (int(d[best]), lo + len(a) + best) if d[best] <= k else (k + 1, -1)


def matches(text: str | None, index: Index) -> list[tuple[int, int, int]]:
    """(item number, end in the normalised text, edits): the best occurrence of each item, the first of equals."""
    if not text or not index.ids:
        return []
    norm = normalise(text)
    best: dict[int, tuple[int, int]] = {}
    if index.brief is not None:
        for end, found in index.brief.iter(f" {norm} "):
            for item in found:
                best.setdefault(item, (0, end - 1))
    if not len(index.m):
        return [(i, end, edits) for i, (edits, end) in sorted(best.items())]
    whole = codes(norm)
    reach = int((index.m + 4 * index.k + 8).max())
    for start in range(0, max(1, len(whole) - reach), PART):
        c = whole[start : start + PART + reach]
        verbatim: dict[int, int] = {}
        for item, band in (x for told in index.candidates(c) for x in zip(*told, strict=True)):
            # a verbatim item needs no alignment, and nothing is better than its first place
            place = verbatim.get(int(item))
            if place is None:
                place = verbatim[int(item)] = norm.find(index.texts[item], start, start + len(c))
            if place >= 0:
                best[int(item)] = min(best.get(int(item), (1, 0)), (0, place + len(index.texts[item])))
                continue
            m, k = int(index.m[item]), int(index.k[item])
            lo = int(band) * (k + 1) - m - k
            edits, end = align(codes(index.texts[item]), c, lo, 2 * (k + 1) + 2 * k, k)
            if edits <= k:
                best[int(item)] = min(best.get(int(item), (k + 1, 0)), (edits, start + end))
    return [(i, end, edits) for i, (edits, end) in sorted(best.items())]


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    block, chars = [], 0
    for row in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull()).toLocalIterator():
        text = normalise(row["t"])
        if not text:
            continue
        if block and chars + len(text) > block_chars:
            yield block
            block, chars = [], 0
        block.append((row["i"], text))
        chars += len(text)
    if block:
        yield block


def _with(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, q: int, error: float, block_chars: int, min_chars: int) -> list[DataFrame]:
    text_batches(docs.sparkSession)
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    id_kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = []
    for block in blocks(benchmark, item_col, item_text_col, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, q, error, min_chars)
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    rows, items, ends, edits = [], [], [], []
                    for r, text in enumerate(batch.column(1).to_pylist()):
                        for item, end, d in matches(text, index):
                            rows.append(r)
                            items.append(index.ids[item])
                            ends.append(end)
                            edits.append(d)
                    if rows:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items, names[1]), pa.array(ends, pa.int64()), pa.array(edits, pa.int32())], names=["_id", "item", "end", "edits"])

        names = (None, _arrow(item_kind))
        found.append(rows.mapInArrow(search, f"_id {id_kind}, item {item_kind}, end long, edits int"))
    return found


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = Q, error: float = ERROR, block_chars: int = BLOCK_CHARS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc id, item id, end, edits): one row for each item that a row of docs contains."""
    parts = _with(docs, benchmark, id_col, text_col, item_col, item_text_col, q, error, block_chars, min_chars)
    if not parts:
        return docs.where(F.lit(False)).select(F.col(id_col).alias(id_col), F.lit(None).cast(benchmark.schema[item_col].dataType).alias(item_col), F.lit(None).cast("long").alias("end"), F.lit(None).cast("int").alias("edits"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.select(F.col("_id").alias(id_col), F.col("item").alias(item_col), "end", "edits")


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that contain no item, unchanged. The row itself is the id that the search carries, so nothing is joined.

    Between blocks of items the rows left are written down, and the copy before goes: in one stage the workers of all blocks would run,
    with their indexes, at once.
    """
    text_batches(docs.sparkSession)
    out, before = docs, None
    q, error, min_chars = options.get("q", Q), options.get("error", ERROR), options.get("min_chars", MIN_CHARS)
    for k, block in enumerate(blocks(benchmark, options.get("item_col", "item_id"), options.get("item_text_col", "text"), options.get("block_chars", BLOCK_CHARS))):
        if k:
            path = scratch_path(docs.sparkSession, "decontam-left")
            out.write.parquet(path)
            if before:
                _drop(docs.sparkSession, before)
            before, out = path, docs.sparkSession.read.schema(docs.schema).parquet(path)
        shared = docs.sparkSession.sparkContext.broadcast(block)
        place = docs.columns.index(text_col)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, q, error, min_chars)
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    yield batch.filter(pa.array([not matches(t, index) for t in batch.column(place).to_pylist()], pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out
