"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected components.

A document's set is its distinct k-word shingles as 64-bit hashes. A sketch has t bins: in round i < t every shingle is
thrown into one bin by a hash of its own round, empty bins take the least value thrown in; round t + j fills bin j
directly, so every coordinate fills, and the first round that leaves no bin empty ends it. Equal coordinates estimate
the Jaccard similarity with Chernoff-type concentration. Bands of coordinates give bucket keys.

1. Documents with equal sets form a class, whose representative has the smallest id.
2. Representatives sharing a bucket are candidates. A bucket's leader is the member that shares most bucket places over
   all bands (the original of a group of copies). Each document is compared with the most shared of its leaders, then
   with its other leaders where they are in another component: a group of copies costs its size.
3. Buckets that still hold several components are compared across components only: the documents outside the bucket's largest component
   with all, in blocks of bounded size that a task multiplies as sparse matrices of shingles, so that only true links leave it and a crowd of
   documents just below the threshold makes no pairs. No partner is capped.
4. All links are confirmed on full sets; components come from alternating large-star and small-star steps.

Recall of banding: with 40 bands of 6 coordinates a pair of similarity 0.8 is missed with probability 5e-6, and higher
similarities far more rarely. Shuffled are 64-bit numbers and, once, the text of documents that share a bucket.
Hot keys (bucket, leader, class or component with a third of all rows) are met by common.spread_join or dealt out by salt.

Defined results: null or empty text, or text without words, has an empty set, is linked with nothing and kept; fewer
than k words make one shingle; texts of any length are taken whole; equally shared leaders are ordered by id; a null id cannot be
named, so such rows have a null component and are kept; rows that repeat an id are judged by their own text each; columns other
than id and text are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diskloom.llm.common import materialize, spread_join, text_batches

BANDS, ROWS = 40, 6
#: Pairs of one leader that are verified beside one copy of its set.
PAIRS_A_SALT = 500
#: Shingles, about, of the documents on each side of a block; events (a shingle in two documents) that are counted at once.
BLOCK_SHINGLES, EVENTS = 100_000, 4_000_000
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_P3 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _P2
    x = (x ^ (x >> np.uint64(27))) * _P3
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; A-Z are lower-cased, words are split at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(k, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - n + 1, n, np.uint64)
        for j in range(n):
            h = mix((h ^ w[j : len(w) - n + 1 + j]) * _P1 + np.uint64(j))
    return np.unique(h)


def sketch(h: np.ndarray, t: int = BANDS * ROWS) -> np.ndarray:
    """t coordinates of a set that is not empty."""
    top = np.iinfo(np.uint64).max
    out, empty = np.full(t, top, np.uint64), np.ones(t, bool)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            v = mix(h + _P1 * np.uint64(i + 1))
            if i >= t:
                if empty[i - t]:
                    out[i - t] = v.min()
                    empty[i - t] = False
                continue
            at = (v % np.uint64(t)).astype(np.int64)
            if i:
                free = empty[at]
                at, v = at[free], v[free]
            np.minimum.at(out, at, v)
            empty[at] = False
            if not empty.any():
                break
    return out


def band_keys(s: np.ndarray, bands: int = BANDS) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = s.reshape(bands, -1)
        key = np.arange(1, bands + 1, dtype=np.uint64) * _P1
        for j in range(parts.shape[1]):
            key = mix((key ^ parts[:, j]) * _P1)
    return key.view(np.int64)


def _signatures(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, th, n, fa, fb, bands) of every row; th: hash of the text; fa, fb: a 128-bit fingerprint of the set; bands: null for an empty set."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, fa, fb, bands = [], [], [], []
                for text in batch.column(2).to_pylist():
                    h = shingles(text, k)
                    f = xxhash.xxh3_128_intdigest(h.tobytes())
                    n.append(len(h))
                    fa.append((f >> 64) - (1 << 63))
                    fb.append((f & (2**64 - 1)) - (1 << 63))
                    bands.append(band_keys(sketch(h)) if len(h) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "th", "n", "fa", "fb", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).mapInArrow(make, f"id {kind}, th long, n long, fa long, fb long, bands array<long>")


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, h): full sets of the documents named in ids."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, k).view(np.int64) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["id", "h"])

    kind = docs.schema[id_col].dataType.simpleString()
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids.hint("shuffle_hash"), "id", "left_semi")
    return some.mapInArrow(make, f"id {kind}, h array<long>")


def _with_sets(pairs: DataFrame, sets: DataFrame, key: str, out: str) -> DataFrame:
    """pairs with the set of the document `key` as `out`. The set of a document in very many pairs is copied, its pairs are dealt over the copies."""
    load = pairs.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("w")).where(F.col("w") > PAIRS_A_SALT)
    load = materialize(load.withColumn("salts", F.ceil(F.col("w") / PAIRS_A_SALT).cast("int")), "near-load")
    total = load.agg(F.sum("w")).first()[0] or 0
    dealt = spread_join(pairs, load.withColumnRenamed("id", key), key, "w", total, "left")
    dealt = dealt.withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*pairs.columns), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    copies = sets.join(load.select("id", "salts"), "id", "left").select(F.col("id").alias(key), F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), F.col("h").alias(out))
    return dealt.join(copies, [key, "salt"]).drop("salt")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets reach the similarity."""
    both = _with_sets(_with_sets(pairs.select("a", "b"), sets, "b", "hb").select("a", "b", "hb"), sets, "a", "ha")
    common = F.size(F.array_intersect("ha", "hb"))
    return both.select("a", "b", common.alias("i"), F.size("ha").alias("na"), F.size("hb").alias("nb")).where(F.col("i") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b").distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of left shares with each of right: common ones by a matrix product, others by counting events."""
    nl, nr = len(left), len(right)
    out = np.zeros(nl * nr, np.int64)
    flat_l, flat_r = np.concatenate(left), np.concatenate(right)
    doc_l, doc_r = np.repeat(np.arange(nl), [len(x) for x in left]), np.repeat(np.arange(nr), [len(x) for x in right])
    shared = np.intersect1d(flat_l, flat_r)
    if not len(shared):
        return out.reshape(nl, nr)

    def columns(flat: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents sorted by shingle, and each shared shingle's first place and number."""
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        hit = shared[at] == flat
        at, doc = at[hit], doc[hit]
        order = np.argsort(at, kind="stable")
        n = np.bincount(at, minlength=len(shared))
        return at[order], doc[order], np.cumsum(n) - n, n

    col_l, by_l, at_l, n_l = columns(flat_l, doc_l)
    col_r, by_r, at_r, n_r = columns(flat_r, doc_r)
    events = n_l * n_r
    heavy = np.flatnonzero(events * 16 >= nl * nr)
    number = np.full(len(shared), -1)
    for k in range(0, len(heavy), 1024):
        some = heavy[k : k + 1024]
        number[:] = -1
        number[some] = np.arange(len(some))
        a, b = np.zeros((nl, len(some)), np.float32), np.zeros((nr, len(some)), np.float32)
        for table, col, by in ((a, col_l, by_l), (b, col_r, by_r)):
            held = number[col] >= 0
            table[by[held], number[col[held]]] = 1
        out += np.rint(a @ b.T).astype(np.int64).ravel()
    light = np.flatnonzero(events * 16 < nl * nr)
    ends = np.cumsum(events[light])
    start = 0
    while start < len(light):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + EVENTS, "right")))
        some = light[start:stop]
        # every document of left with the shingle meets every one of right
        of = np.repeat(some, n_l[some])
        one = by_l[np.repeat(at_l[some] - (np.cumsum(n_l[some]) - n_l[some]), n_l[some]) + np.arange(n_l[some].sum())]
        times = n_r[of]
        other = np.repeat(at_r[of] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        out += np.bincount(np.repeat(one, times) * nr + by_r[other], minlength=nl * nr)
        start = stop
    return out.reshape(nl, nr)


def _by_bucket(open_places: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of documents (key, rep, n, component) of one bucket and different components that have the similarity by the low halves of their shingles.

    Halves that are equal by chance can only add pairs, which full sets then refuse. The largest component of a bucket is not compared with itself. Documents are dealt into blocks of about BLOCK_SHINGLES; a task has a
    block of the others and a block of all.
    """
    sizes = open_places.groupBy("key", "component").agg(F.sum("n").alias("s"), F.count("*").alias("c"))
    most = sizes.groupBy("key").agg(F.max(F.struct("s", "component")).alias("m"), F.sum("s").alias("all"), F.sum("c").alias("w"))
    blocks = lambda c: F.ceil(c / BLOCK_SHINGLES).cast("int")
    told = materialize(most.select("key", "w", F.struct(F.col("m.component").alias("most"), blocks(F.col("all") - F.col("m.s")).alias("xs"), blocks(F.col("all")).alias("ys")).alias("b")), "near-blocks")
    met = spread_join(open_places, told, "key", "w", told.agg(F.sum("w")).first()[0] or 0)
    rows = met.select("key", "rep", "component", "b.xs", "b.ys", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("b.xs")).cast("int").alias("x"), F.pmod(F.xxhash64("rep", F.lit(2)), F.col("b.ys")).cast("int").alias("y"), (F.col("component") != F.col("b.most")).alias("minor"))
    # where all fit one block, a row stands on both sides
    one = rows.where("ys = 1").select("key", "rep", "component", "x", "y", F.col("minor").alias("left"), F.lit(True).alias("right"))
    left = rows.where("ys > 1 and minor").select("key", "rep", "component", "x", F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("y"), F.lit(True).alias("left"), F.lit(False).alias("right"))
    right = rows.where("ys > 1").select("key", "rep", "component", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("x"), "y", F.lit(False).alias("left"), F.lit(True).alias("right"))
    kind = open_places.schema["rep"].dataType.simpleString()

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        p = p.assign(h=[np.unique(h) for h in p["h"]])
        # shingles of one set that share their low half could only lower what it has in common, so they count as common
        p["twins"] = p["n"] - p["h"].map(len)
        mine, others = p[p["left"]], p[p["right"]]
        a, b = [], []
        if len(mine) and len(others):
            common = overlaps(mine["h"].tolist(), others["h"].tolist()) + np.minimum.outer(mine["twins"].to_numpy(), others["twins"].to_numpy())
            union = np.add.outer(mine["n"].to_numpy(), others["n"].to_numpy()) - common
            i, j = np.nonzero((common * 100 >= percent * union) & (mine["component"].to_numpy()[:, None] != others["component"].to_numpy()[None, :]))
            a, b = mine["rep"].to_numpy()[i], others["rep"].to_numpy()[j]
        return pd.DataFrame({"a": a, "b": b})

    halves = sets.select(F.col("id").alias("rep"), F.size("h").alias("n"), F.transform("h", lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int")).alias("h"))
    both = one.unionByName(left).unionByName(right).join(halves, "rep")
    found = both.groupBy("key", "x", "y").applyInPandas(compare, f"a {kind}, b {kind}")
    return materialize(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-cross")


def _across(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose ends have different components; a may be a key of very many pairs."""
    load = pairs.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("w")).join(label, "id", "left").select(F.col("id").alias("a"), "w", F.coalesce("component", "id").alias("ca"))
    load = materialize(load, "near-across")
    met = spread_join(pairs, load, "a", "w", load.agg(F.sum("w")).first()[0] or 0)
    both = met.join(label.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    return both.where(F.col("ca") != F.coalesce("cb", "b")).select("a", "b")


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) of all ids in edges (a, b); component: the smallest id reachable. Large-star, small-star."""

    def star(e: DataFrame, both_ways: bool) -> DataFrame:
        if both_ways:
            near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            near = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = materialize(near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("w")), "star-min").withColumn("m", F.least("m", "a"))
        total = least.agg(F.sum("w")).first()[0] or 0
        met = spread_join(near, least, "a", "w", total)
        if both_ways:
            out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return materialize(out.where(F.col("a") != F.col("b")).distinct(), "star-edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def flat(e: DataFrame) -> bool:
        """Whether all edges lead to nodes that lead nowhere, each node to one: then nothing changes any more."""
        inner = e.join(e.select(F.col("b").alias("r")).distinct().hint("shuffle_hash"), F.col("a") == F.col("r"), "left_semi")
        return not inner.head(1) and not e.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").head(1)

    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges")
    before = mark(edges)
    while before[0] and not flat(edges):
        edges = star(star(edges, True), False)
        after = mark(edges)
        if after == before:
            break
        before = after
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (id, component) after the links (a, b) have joined components: only these are walked again."""
    first, second = label.toDF("a", "ca"), label.toDF("b", "cb")
    ends = links.join(first, "a", "left").join(second, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = materialize(connected(ends.where(F.col("a") != F.col("b"))), "near-joined").toDF("id", "into")
    renamed = label.join(joined.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("into", "component").alias("component"))
    return renamed.unionByName(joined.join(label.select("id"), "id", "left_anti").select("id", F.col("into").alias("component")))


def _judge(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(id, th, n, fa, fb, component) of every row of docs."""
    text_batches(docs.sparkSession)
    marks = materialize(_signatures(docs, id_col, text_col, k), "near-signatures")
    named = marks.where(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = materialize(named.groupBy("fa", "fb").agg(F.min("id").alias("rep"), F.count("*").alias("w"), F.max("n").alias("n"), F.first("bands").alias("bands")), "near-classes")
    places = classes.select("rep", "n", F.explode("bands").alias("key"))
    sizes = materialize(places.groupBy("key").agg(F.count("*").alias("w")).where(F.col("w") > 1), "near-sizes").withColumn("size", F.col("w"))
    total = sizes.agg(F.sum("w")).first()[0] or 0
    shared = materialize(spread_join(places, sizes, "key", "w", total), "near-places")
    fame = shared.groupBy("rep").agg(F.sum("size").alias("fame"))
    leaders = materialize(shared.join(fame, "rep").groupBy("key").agg(F.count("*").alias("w"), F.max(F.struct("fame", "rep", "n")).alias("top")).select("key", "w", F.col("top.rep").alias("lead"), F.col("top.n").alias("lead_n"), F.col("top.fame").alias("lead_fame")), "near-leaders")
    close = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * percent)
    led = spread_join(shared, leaders, "key", "w", total).where((F.col("rep") != F.col("lead")) & close(F.col("n"), F.col("lead_n")))
    led = materialize(led.groupBy(F.col("lead").alias("a"), F.col("rep").alias("b")).agg(F.max("lead_fame").alias("fame")), "near-led")
    sets = materialize(_sets(docs, shared.select(F.col("rep").alias("id")).distinct(), id_col, text_col, k), "near-sets")
    # first each document with its most shared leader only: that joins a group of copies at one pair a copy
    first = materialize(led.groupBy("b").agg(F.max(F.struct("fame", "a")).alias("t")).select(F.col("t.a").alias("a"), "b"), "near-pairs")
    edges = materialize(_verify(first, sets, percent), "near-edges")
    label = materialize(connected(edges), "near-labels")
    # then with other leaders, where that could still join two components
    again = materialize(_across(led.select("a", "b").join(first, ["a", "b"], "left_anti"), label), "near-pairs")
    more = materialize(_verify(again, sets, percent), "near-edges")
    if more.head(1):
        label = materialize(_merged(label, more), "near-labels")
    # what is left: documents of buckets with several components
    lab = shared.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    open_keys = lab.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("w")).where("lo <> hi").select("key", "w", F.lit(True).alias("open"))
    open_keys = materialize(open_keys, "near-open")
    open_places = spread_join(lab, open_keys, "key", "w", open_keys.agg(F.sum("w")).first()[0] or 0).drop("open")
    last = materialize(_verify(_by_bucket(materialize(open_places, "near-rest"), sets, percent), sets, percent), "near-edges")
    if last.head(1):
        label = materialize(_merged(label, last), "near-labels")
    labelled = classes.select("fa", "fb", "w", "rep").join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    wanted = labelled.where((F.col("w") > 1) | (F.col("component") != F.col("rep")))
    by_fa = materialize(wanted.groupBy("fa").agg(F.sum("w").alias("w"), F.collect_list(F.struct("fb", "component")).alias("found")), "near-members")
    met = spread_join(marks.drop("bands"), by_fa, "fa", "w", by_fa.agg(F.sum("w")).first()[0] or 0, "left")
    mine = F.filter("found", lambda x: x["fb"] == F.col("fb"))
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce(F.element_at(F.when(F.size(mine) > 0, mine), 1)["component"], F.col("id"))).otherwise(F.col("id"))
    return met.select("id", "th", "n", "fa", "fb", component.alias("component"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of docs."""
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return _judge(docs, id_col, text_col, k, percent).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs without near duplicates: of each component the document with the smallest id stays, its columns unchanged under their names.

    Rows with a null id and rows without words stay. Of rows that repeat a kept id with the same set of shingles one stays, that with the
    smallest text hash; a kept id's rows with other sets stay.
    """
    judged = materialize(_judge(docs, id_col, text_col, k, percent), "near-judged")
    # the row travels as one column, so no name of docs can meet one of ours
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("i"), F.xxhash64(text_col).alias("t"))
    gone = judged.where(F.col("id") != F.col("component")).select(F.col("id").alias("gi"), F.col("th").alias("gt")).distinct()
    # the ids are hashed, the texts are not sorted, and the plan is the same at every size
    left = rows.join(gone.hint("shuffle_hash"), (F.col("i") == F.col("gi")) & (F.col("t") == F.col("gt")), "left_anti")
    stay = judged.where((F.col("id") == F.col("component")) & (F.col("n") > 0))
    repeated = materialize(stay.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("id").alias("ri")), "near-repeated")
    if not repeated.head(1):
        return left.select("row.*")
    sets = stay.join(repeated, F.col("id") == F.col("ri"), "left_semi").select(F.col("id").alias("ri"), F.col("th").alias("rt"), "fa", "fb").distinct()
    again = left.join(sets, (F.col("i") == F.col("ri")) & (F.col("t") == F.col("rt")))
    one = again.groupBy("i", "fa", "fb").agg(F.min_by("row", "t").alias("row")).select("row")
    return left.join(sets, (F.col("i") == F.col("ri")) & (F.col("t") == F.col("rt")), "left_anti").select("row").unionByName(one).select("row.*")
