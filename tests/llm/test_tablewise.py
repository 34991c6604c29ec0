"""Line dedup, decontamination, sharding, near duplicates, packing, WARC and the pipeline against brute force."""

import base64
import gzip
import hashlib
import os
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from diskloom.llm import decontam, linededup, neardup, packing, shards, warc

CLASHES = ["_id", "_gone", "_left", "_n_lines", "_n_removed", "_hit", "row", "th", "component", "shard", "size", "left", "gone", "i", "t", "block"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, a string, hub string, first long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def make(spark, rows):
    """Rows (doc_id, text, source) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z", 9, *(f"own {c}" for c in CLASHES)) for i, t, s in rows], DOCS)


def own_values(rows):
    """Every row still has the values of the columns that clash with names inside the operators."""
    return all(r["id"] == "x" and r["first"] == 9 and all(r[c] == f"own {c}" for c in CLASHES) for r in rows)


def rows_of(rnd, n, words=40, vocabulary=400):
    return [(k, " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.randint(0, words))), f"s{rnd.randrange(4)}") for k in range(n)]


# line dedup


def brute_lines(rows, sites=linededup.MIN_SITES, chars=linededup.MIN_CHARS):
    seen, first = defaultdict(set), {}
    for i, t, s in rows:
        for line in (t or "").split("\n") if t is not None else []:
            if len(line) >= chars:
                seen[line] |= {s} - {None}
                if i is not None:
                    first[line] = min(first.get(line, i), i)
    gone = {x for x, s in seen.items() if len(s) >= sites}
    out = []
    for i, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        left = [x for x in lines if i is None or x not in gone or first.get(x) == i]
        out.append((i, None if t is None else "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    rnd = random.Random(1)
    lines = [f"this is boilerplate line number {k} of the site" for k in range(30)] + ["short", "", "é" * 24]
    rows = [(k, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 6))), rnd.choice(["a", "b", "c", "d", None])) for k in range(80)]
    rows += [(100, None, "a"), (101, "", None), (None, lines[0] + "\n" + lines[1], "a"), (rows[3][0], rows[3][1], rows[3][2]), (102, "\n".join(lines * 400), "e")]
    got = linededup.remove_boilerplate(make(spark, rows))
    assert got.columns == [*make(spark, rows).columns, "__n_lines", "__n_removed"] and own_values(got.collect())
    assert sorted([(r["doc_id"], r["text"], r["__n_lines"], r["__n_removed"]) for r in got.collect()], key=repr) == brute_lines(rows)
    assert linededup.remove_boilerplate(make(spark, [])).collect() == []


def test_line_spread_far_above_the_threshold_uses_the_sketch(spark):
    rows = [(k, "a line that stands on very many different sites", f"s{k}") for k in range(300)]
    boiler, _ = linededup.spread(make(spark, rows))
    (found,) = boiler.collect()
    assert abs(found["sites"] - 300) < 30 and found["first"] == 0


def test_short_lines_on_many_sites_are_boilerplate(spark):
    texts = ["All rights reserved.\nMenu\n\nown line one", "Menu\n\nAll rights reserved.\nown line two", "Home\nAll rights reserved.\n\nMenu", "Home\n\nown line three"]
    got = {r["doc_id"]: (r["text"], r["__n_removed"]) for r in linededup.remove_boilerplate(make(spark, [(k, t, f"s{k}") for k, t in enumerate(texts)])).collect()}
    assert got == {0: (texts[0], 0), 1: ("\nown line two", 2), 2: ("Home\n", 2), 3: (texts[3], 0)}


# decontamination


def edits_in(item, text):
    """Least edits of item against any part of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def damaged(rnd, text, edits):
    out = list(text)
    for _ in range(edits):
        k = rnd.randrange(len(out))
        how = rnd.randrange(3)
        if how == 0:
            out[k] = rnd.choice("xyz")
        elif how == 1:
            del out[k]
        else:
            out.insert(k, rnd.choice("xyz"))
    return "".join(out)


def test_decontamination_finds_what_brute_force_finds(spark):
    rnd = random.Random(2)
    say = lambda n: " ".join(rnd.choice(["the", "of", "and", "ing", "ation", "er", "house", "river"]) for _ in range(n))
    items = [(k, say(rnd.randint(10, 30))) for k in range(8)] + [(8, "short"), (9, None), (10, ""), (11, " River HOUSE the "), (12, "short")]
    docs = []
    for k in range(60):
        text = say(rnd.randint(0, 30))
        if k % 2:
            item = items[rnd.randrange(8)][1]
            m = len(item)
            text += "  \n" + damaged(rnd, item, rnd.choice([0, 1, m // 20, m // 10, m // 8, m // 5])).upper() + " " + say(4)
        docs.append((k, text, "s"))
    docs += [(103, "one SHORT\nitem, then shortly", "s"), (104, "shortly", "s"), (105, "short", "s"), (100, None, "s"), (101, "", "s"), (None, items[0][1], "s"), (102, say(20_000) + items[1][1] + say(20_000), "s"), docs[1]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontam.search(make(spark, docs), benchmark).collect()]
    want = []
    for i, t, _ in docs:
        if i == 102:
            continue
        for item, text in items:
            norm = decontam.normalise(text or "")
            if t and len(norm) >= decontam.MIN_CHARS:
                d = edits_in(norm, decontam.normalise(t))
                if d <= decontam.budget(len(norm)):
                    want.append((i, item, d))
            elif norm and f" {norm} " in f" {decontam.normalise(t or '')} ":
                want.append((i, item, 0))
    assert Counter((i, item, d) for i, item, _, d in got if i != 102) == Counter(want)
    assert (102, 1, 0) in [(i, item, d) for i, item, _, d in got]
    blocks = [tuple(r) for r in decontam.search(make(spark, docs), benchmark, block_chars=100).collect()]
    assert Counter(blocks) == Counter(got)
    hit = {i for i, *_ in got}
    left = decontam.remove(make(spark, docs), benchmark)
    assert left.columns == make(spark, docs).columns and {r["doc_id"] for r in left.collect()} == {i for i, *_ in docs} - hit and own_values(left.collect())
    assert decontam.search(make(spark, docs), benchmark.where("false")).collect() == []
    assert decontam.search(make(spark, []), benchmark).collect() == []


def peak_of(f):
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_decontamination_holds_few_hits_at_once():
    items = [(1, "ab" * 200), (2, "ab" * 190 + "xyz" * 7), (3, "ba" * 150)]
    index = decontam.Index(items, min_chars=decontam.MIN_CHARS)
    # 60,000 places with about 250 hits each: as whole columns they took gigabytes
    found, peak = peak_of(lambda: decontam.matches("ab" * 30_000 + " " + items[1][1], index))
    assert [i for i, _, d in found if d == 0] == [0, 1, 2] and peak < 250 << 20


def test_decontamination_finds_the_same_in_small_slices(monkeypatch):
    rnd = random.Random(5)
    say = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    for letters in ("a", "ab", "ab c", "abcdefgh "):
        index = decontam.Index([(k, decontam.normalise(say(letters, 60 + 20 * k))) for k in range(4)], min_chars=decontam.MIN_CHARS)
        texts = [say(letters, 150) + damaged(rnd, index.texts[k % len(index.texts)], k) + say(letters, 50) for k in range(6)]
        whole = [decontam.matches(t, index) for t in texts]
        assert any(whole)
        for hits in (53, 700):
            monkeypatch.setattr(decontam, "HITS", hits)
            assert [decontam.matches(t, index) for t in texts] == whole
        monkeypatch.undo()


def test_decontamination_index_takes_few_bytes_a_character():
    rnd = random.Random(6)
    items = [(k, "".join(rnd.choices("abcdefghijkl", k=500))) for k in range(2_000)]
    index, peak = peak_of(lambda: decontam.Index(items))
    assert len(index.keys) > 900_000 and peak - index.seen.nbytes < 60 * 1_000_000


def test_decontamination_has_one_index_in_a_task(spark):
    benchmark = spark.createDataFrame([(k, f"the {k} item of a benchmark that is cut into blocks of its own") for k in range(4)], "item_id long, text string")
    docs = make(spark, [(k, f"before the {k} item of a benchmark that is cut into blocks of its own and after" if k < 3 else "free", "s") for k in range(6)])
    left = decontam.remove(docs, benchmark, block_chars=70)
    assert left._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 1
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5] and own_values(left.collect())


# sharding


def test_shards(spark):
    rnd = random.Random(3)
    texts = [f"text {k}" for k in range(40)]
    rows = [(k, rnd.choice(texts[:8]) if k % 3 else rnd.choice(texts) + str(k), "s") for k in range(500)]
    rows += [(1000 + k, None, "s") for k in range(5)] + [(2000, "", "s"), (None, "null id", "s"), (2001, "same", "s"), (2001, "same", "s"), (2002, "long " * 50_000, "s")]
    got = shards.assign(make(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) <= set(range(8)) and max(sizes.values()) - min(sizes[s] for s in range(8)) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    by = {i: t for i, t, _ in rows}
    for r in got:
        raw = (by[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    groups = defaultdict(set)
    for r in got:
        groups[by[r["doc_id"]]].add(r["shard"])
    count = Counter(t for _, t, _ in rows)
    split = [t for t, s in groups.items() if len(s) > 1 and count[t] <= len(rows) // 8]
    assert len(split) <= 7
    # the rounds did that, not the start
    cuts = []
    shards.assign(make(spark, rows), cuts=cuts)
    assert len(cuts) > 1 and min(cuts) * 2 < cuts[0]
    assert shards.assign(make(spark, [])).collect() == []
    assert [r["slot"] for r in shards.assign(make(spark, [(1, "one", "s")])).collect()] == [0]


def cut_by_pairs(place, links):
    """The weight of links between shards, one pair after another."""
    hubs = defaultdict(list)
    for rid, hub, share in links:
        hubs[hub].append((rid, share))
    total = 0.0
    for members in hubs.values():
        for x, (a, share) in enumerate(members):
            total += sum(share / (len(members) - 1) for b, _ in members[x + 1 :] if place[a] != place[b])
    return total


def test_propagation_against_pairs(spark):
    """Cuts are those of the pairs of a small graph with several hubs a row; no two rows could be exchanged for a much smaller one."""
    rnd = random.Random(16)
    links = [(k, f"g{k // 4}", 1.0) for k in range(48)] + [(k, f"c{k % 3}", 0.25) for k in range(0, 48, 2)] + [(k, f"big{k % 2}", 1.0) for k in range(100, 140)]
    ids = list(range(240))
    rnd.shuffle(ids)
    rows = spark.createDataFrame([(k,) for k in ids], "rid long")
    cuts = []
    found = {r["rid"]: r["shard"] for r in shards.propagate(rows, spark.createDataFrame(links, "rid long, hub string, share double"), 4, cuts=cuts).collect()}
    assert Counter(found.values()) == dict.fromkeys(range(4), 60)
    start = {r["rid"]: r["shard"] for r in shards._start(rows, 4, 240).collect()}
    assert abs(cut_by_pairs(start, links) - cuts[0]) < 1e-6 and abs(cut_by_pairs(found, links) - min(cuts)) < 1e-6
    assert min(cuts) * 3 < cuts[0]
    # groups of four that have no other link stand together
    assert sum(len({found[k] for k in range(4 * g, 4 * g + 4)}) == 1 for g in range(12)) >= 9


def test_a_hub_larger_than_a_shard(spark):
    rows = spark.createDataFrame([(k,) for k in range(800)], "rid long")
    links = spark.createDataFrame([(k, "hot", 1.0) for k in range(300)], "rid long, hub string, share double")
    found = Counter((r["rid"] < 300, r["shard"]) for r in shards.propagate(rows, links, 8).collect())
    assert sum(n for (hot, _), n in found.items() if hot) == 300 and all(found[True, s] + found[False, s] == 100 for s in range(8))
    assert sum(sorted((found[True, s] for s in range(8)), reverse=True)[:3]) >= 280


# near duplicates


def brute_components(rows, k, percent):
    sets = []
    for _, t, _ in rows:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set())
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    a, b = root(i), root(j)
                    label[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return {d: (len(sets[i]), low[root(i)]) for i, (d, _, _) in enumerate(rows)}


def near_rows(rnd, n):
    """Originals, chains of copies with growing edits, exact copies and mixed case, all under shuffled ids."""
    texts = []
    while len(texts) < n:
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(1, 90))]
        for _ in range(rnd.choice([1, 1, 2, 6, 15])):
            texts.append(rnd.choice([" ", "\n", "  \t"]).join(w.upper() if rnd.random() < 0.05 else w for w in words))
            for _ in range(rnd.choice([0, 0, 1, 2])):
                words[rnd.randrange(len(words))] = f"w{rnd.randrange(5000)}"
    ids = rnd.sample(range(10_000), len(texts))
    return [(i, t, "s") for i, t in zip(ids, texts, strict=True)]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_against_brute_force(spark, k):
    rows = near_rows(random.Random(k), 300) + [(20_001, "", "s"), (20_002, None, "s"), (20_003, " \n", "s"), (20_004, "two words", "s"), (20_005, "TWO  words", "s"), (20_006, "w " * 30_000, "s")]
    got = {r["doc_id"]: r for r in neardup.components(make(spark, rows), k=k).collect()}
    want = brute_components(rows, k, 80)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_near_duplicate_edges(spark):
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (None, "a b c d e f", "s"), (2, "A b c d E f", "s")]
    got = sorted([tuple(r) for r in neardup.components(make(spark, rows)).collect()], key=repr)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (None, 3, None, True), (2, 3, 1, False)], key=repr)
    left = neardup.keep_one(make(spark, rows), k=4)
    assert left.columns == make(spark, rows).columns and sorted([r["doc_id"] for r in left.collect()], key=repr) == [1, None]
    assert neardup.components(make(spark, [])).collect() == [] and neardup.keep_one(make(spark, [])).collect() == []


def test_keep_one_takes_one_of_each_group(spark):
    rnd = random.Random(10)
    say = lambda: " ".join(f"w{rnd.randrange(5000)}" for _ in range(40))
    a, b = say(), say()
    rows = [(5, a, "s"), (5, b, "s"), (3, b.upper(), "s"), (5, a, "s"), (7, a + " more", "s"), (8, None, "s"), (8, None, "s"), (9, " ", "s"), (None, a, "s"), (5, a.upper(), "s")]
    got = neardup.keep_one(make(spark, rows)).collect()
    assert own_values(got)
    # of 5 the row with b goes, as 3 has it; its equal sets count once
    assert Counter((r["doc_id"], (r["text"] or "").lower()) for r in got) == Counter([(5, a), (3, b), (8, ""), (8, ""), (9, " "), (None, a)])


@pytest.mark.parametrize("shingles", [100_000, 2_000])
def test_documents_that_share_a_passage_make_few_pairs(spark, monkeypatch, shingles):
    """A passage of half of each document puts them in common buckets; only true links leave the blocks, whatever their size."""
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
    rnd = random.Random(15)
    passage = [f"p{k}" for k in range(30)]
    rows = [(k, " ".join([f"w{rnd.randrange(10**6)}" for _ in range(22)] + passage), "s") for k in range(300)]
    rows += [(1000 + k, t.replace("p7 ", "q "), "s") for k, (_, t, _) in enumerate(rows[:20])]
    seen = []
    plain = neardup._by_bucket
    monkeypatch.setattr(neardup, "_by_bucket", lambda *a: seen.append(plain(*a).count()) or plain(*a))
    got = {r["doc_id"]: r["component_id"] for r in neardup.components(make(spark, rows)).collect()}
    assert got == {d: c for d, (_, c) in brute_components(rows, 4, 80).items()} and seen[0] <= len(rows)


def test_copies_linked_only_through_their_original(spark):
    """Copies with different edits are near the original, not near each other."""
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(40):
        words = list(base)
        for at in rnd.sample(range(0, 200, 5), 5):
            words[at] = f"x{k}_{at}"
        rows.append((k, " ".join(words), "s"))
    rows.append((500, " ".join(base), "s"))
    got = neardup.components(make(spark, rows)).collect()
    assert {r["component_id"] for r in got} == {v for _, v in brute_components(rows, 4, 80).values()} and len({r["component_id"] for r in got}) == 1


def test_sketch_estimates_similarity():
    rnd = np.random.default_rng(4)
    a = np.unique(rnd.integers(0, 2**63, 1000).astype(np.uint64))
    for keep in (0.5, 0.8, 0.95):
        n = int(1000 * keep)
        b = np.unique(np.concatenate([a[:n], rnd.integers(0, 2**63, len(a) - n).astype(np.uint64)]))
        want = n / (2 * len(a) - n)
        got = np.mean([(neardup.sketch(a + np.uint64(s * 7919)) == neardup.sketch(b + np.uint64(s * 7919))).mean() for s in range(20)])
        assert abs(got - want) < 0.03
    for n in (1, 2, 5):
        assert (neardup.sketch(a[:n]) != np.iinfo(np.uint64).max).all()


def test_overlaps_of_blocks(monkeypatch):
    rnd = np.random.default_rng(5)
    monkeypatch.setattr(neardup, "EVENTS", 50)
    for common in (0, 3, 40):
        draw = lambda: np.unique(np.concatenate([rnd.choice(60, 20), np.arange(100, 100 + common), rnd.integers(1000, 10**6, rnd.integers(1, 30))]))  # noqa: E731, B023
        left, right = [draw() for _ in range(25)], [draw() for _ in range(33)]
        want = [[len(np.intersect1d(x, y)) for y in right] for x in left]
        assert (neardup.overlaps(left, right) == want).all()
    assert neardup.overlaps([np.array([1])], [np.array([2]), np.array([3])]).tolist() == [[0, 0]]


def test_components_of_a_graph(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60) if k % 20] + [(100, 50), (100, 101), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in neardup.connected(edges).collect()}
    assert got[20] == 1 and got[40] == 21 and got[101] == 41 and got[60] == 41 and 7 in got


# packing


def test_packing(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["the", "Haus", "été", "x1", "\n", "  ", "<|endoftext|>", "😀"]) for _ in range(rnd.choice([0, 3, 50, 400, 3000]))) for _ in range(80)]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(100, None, "s"), (101, "", "s"), (None, "null id", "s"), (1, texts[1], "s"), (102, "a" * 20_000, "s")]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            want[i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = packing.pack(make(spark, rows)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 1024) + 2
    assert packing.pack(make(spark, [])).collect() == []


def test_local_search_only_improves():
    rnd = random.Random(6)
    for _ in range(30):
        lengths = [rnd.randint(1, 100) for _ in range(60)]
        start = [[i] for i in range(60)] if rnd.random() < 0.5 else packing.best_fit(lengths, 100)
        end = packing.improve([list(b) for b in start], lengths, 100)
        assert sorted(i for b in end for i in b) == list(range(60)) and all(sum(lengths[i] for i in b) <= 100 for b in end)
        score = lambda bins: sum(sum(lengths[i] for i in b) ** 2 for b in bins)  # noqa: E731, B023
        assert score(end) >= score(start) and len(end) <= len(start)
    # only an exchange of two for one empties the third bin
    assert len(packing.improve([[0, 1], [2, 3], [4]], [6, 3, 5, 4, 2], 10)) == 2


def fewest_bins(lengths, capacity):
    """The least number of bins, by trying every placement."""

    def fits(k, free):
        if k == len(order):
            return True
        for room in {r for r in free if r >= order[k]}:
            rest = list(free)
            rest[rest.index(room)] -= order[k]
            if fits(k + 1, rest):
                return True
        return False

    order = sorted(lengths, reverse=True)
    return next(n for n in range(1, len(lengths) + 1) if fits(0, [capacity] * n))


def test_small_bins_against_every_placement():
    rnd, extra = random.Random(11), 0
    for _ in range(60):
        lengths = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 11))]
        extra += len(packing.improve(packing.best_fit(lengths, 20), lengths, 20)) - fewest_bins(lengths, 20)
    assert extra <= 1


def exchanges(bins, lengths, capacity):
    """Gains of all moves and exchanges from a bin to one at least as full, one pair after another."""
    out = set()
    for x, source in enumerate(bins):
        for y, other in enumerate(bins):
            a, b = sum(lengths[i] for i in source), sum(lengths[i] for i in other)
            if x == y or b < a:
                continue
            singles = [[(i,) for i in p] for p in (source, other)]
            pairs = [[(i, j) for i in p for j in p if i < j] for p in (source, other)]
            for mine, theirs in [(s, t) for s in singles[0] for t in [(), *singles[1], *pairs[1]]] + [(s, t) for s in pairs[0] for t in singles[1]]:
                gain = sum(lengths[i] for i in mine) - sum(lengths[i] for i in theirs)
                if 0 < gain <= capacity - b:
                    out.add(gain)
    return out


def test_search_ends_where_no_exchange_is_left():
    rnd = random.Random(12)
    for _ in range(40):
        lengths = [rnd.choice([rnd.randint(1, 12), rnd.randint(30, 60)]) for _ in range(40)]
        end = packing.improve([[i] for i in range(40)] if rnd.random() < 0.5 else packing.best_fit(lengths, 100), lengths, 100)
        assert len(end) == -(-sum(lengths) // 100) or not exchanges(end, lengths, 100)


def test_many_small_pieces_are_packed_fast():
    import time

    rnd = random.Random(13)
    for lengths in ([rnd.randint(15, 25) for _ in range(20_000)], [rnd.randint(5, 15) for _ in range(20_000)], [20] * 20_000):
        began = time.time()
        end = packing.improve(packing.best_fit(lengths), lengths)
        assert time.time() - began < 20 and len(end) <= -(-sum(lengths) // 1024) + 2


def test_long_runs_of_blanks_and_blocks_that_meet(spark):
    rnd = random.Random(14)
    rows = [(0, " " * 1_000_000, "s"), (1, "a" + "\n" * 600_000 + "b", "s")] + [(k, "word " * rnd.randint(0, 700), "s") for k in range(2, 400)] + [(7, "word " * 90, "s")] * 200
    got = packing.pack(make(spark, rows), block_pieces=100).collect()
    tokens = Counter()
    for r in got:
        tokens[r["doc_id"]] += r["length"]
    assert tokens[0] == 1_000_001
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        ends = [0, *(a + n for a, n in sorted(held))]
        assert [a for a, _ in sorted(held)] == ends[:-1] and ends[-1] <= 1024
    # 17 or more blocks would leave about as many sequences too many
    assert len(bins) <= -(-sum(tokens.values()) // 1024) + 4


# WARC


def test_warc_round_trip(spark, tmp_path):
    rnd = random.Random(7)
    htmls = [f"<p>{k} {'é' * rnd.randint(0, 50)}</p>" for k in range(30)] + ["", None]
    rows = [(rnd.randrange(10**6), f"http://a.com/{k}\nx" if k % 7 else None, rnd.choice(htmls), "clash") for k in range(300)]
    rows += [(None, "u", htmls[0], "clash"), rows[0], (5_000_000, "u", "long " * 100_000, "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    count = Counter(h or "" for _, _, h, _ in rows)
    want = Counter()
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        f = first.get(h or "")
        revisit = count[h or ""] > 1 and f is not None and i != f
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", f if revisit else None] += 1
    outs = []
    for n, parts in enumerate((1, 5)):
        folder = f"{tmp_path}/w{n}"
        warc.write(pages.repartition(parts), folder, shard_bytes=20_000, roll_bytes=3_000)
        got = warc.read(spark, folder)
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()) == want
        outs.append({f: open(f"{folder}/{f}", "rb").read() for f in sorted(os.listdir(folder)) if f.endswith(".gz")})
    assert outs[0] == outs[1] and len(outs[0]) > 3
    # any gzip reader can read the files, and damage is found
    name, data = next(iter(outs[0].items()))
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    with open(f"{tmp_path}/w0/{name}", "wb") as f:
        f.write(data[:-30])
    with pytest.raises(Exception, match="archive ends|manifest|record"):
        warc.read(spark, f"{tmp_path}/w0").collect()
    assert warc.round_trip(pages.where("false")).collect() == []


def test_an_outlying_id_leaves_shards_even(spark, tmp_path):
    rows = [(k, f"http://a.com/{k}", f"<p>{k}</p>" * 20) for k in range(2000)] + [(1 << 40, "u", "far"), (-(1 << 50), "u", "low")]
    # a third of all rows have one id, or none
    rows += [(7, "u", f"seven {k}" * 30) for k in range(1000)] + [(None, "u", f"none {k % 3}" * 30) for k in range(1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    shards = Counter()
    for r in warc.write(pages, f"{tmp_path}/w", shard_bytes=100_000).collect():
        shards[r["file"].split("-")[1]] += r["records"]
    assert len(shards) > 20 and max(shards.values()) < 3 * len(rows) / len(shards)
    got = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read(spark, f"{tmp_path}/w").collect())
    assert got[None, "response", None] == 1000 and sum(got.values()) == len(rows) and got[1 << 40, "response", None] == 1


def test_a_failed_file_is_removed(tmp_path):
    with pytest.raises(ValueError), warc.creating(str(tmp_path), "x.gz") as f:
        f.write(b"half")
        raise ValueError
    assert os.listdir(tmp_path) == []


# pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    rnd = random.Random(8)
    words = {"en": "the of and with from that which house water river stone people mountain evening".split(), "fr": "le la les des avec pour dans maison rivière été où garçon montagne soir".split()}
    say = lambda lang, n: " ".join(rnd.choice(words[lang]) + str(rnd.randrange(9)) * (rnd.random() < 0.3) for _ in range(n))
    items = [(k, say("en", 25)) for k in range(3)]
    rows = []
    for k in range(80):
        lang = rnd.choice(["en", "fr"])
        rows.append((k, "\n".join(say(lang, rnd.randint(20, 40)) for _ in range(4)), lang))
    # copies on one site, so that their lines are no cross-site boilerplate
    rows[8] = (8, rows[3][1], rows[3][2])
    rows[18] = (18, rows[3][1].replace(" ", "  ", 2), rows[3][2])
    rows[12] = (12, rows[12][1] + "\n" + items[1][1], "en")
    rows[13] = (13, "12345 67890 !!!", None)
    for k in (20, 21, 22, 23):
        rows[k] = (k, rows[k][1] + "\nThis line of boilerplate is on every single site", rows[k][2])
    # null and empty texts, a repeated row, an id that is null, and names that clash with those inside the stages
    rows += [(90, None, "en"), (91, "", "en"), rows[30]]
    docs = spark.createDataFrame([(i, t, x, f"site{i % 5}", len(t or ""), "u", "v") for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long, _gone string, row string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(i, t, f"site{i % 5}") for i, t, _ in rows[:80] if i != 13]
    kept = [(i, t, f"site{i % 5}") for i, t, *_ in brute_lines(kept)]
    low = brute_components(kept, 5, 80)
    kept = [r for r in kept if low[r[0]][1] == r[0]]
    kept = [r for r in kept if all(edits_in(decontam.normalise(t), decontam.normalise(r[1])) > decontam.budget(len(t)) for _, t in items)]
    encoder = packing._encoder(packing.load_ranks(packing.default_vocabulary()), __import__("public_tokenizers").PATTERN, {})
    want = Counter((i, p, a, n) for i, t, _ in kept for p, (a, n) in enumerate(packing.cut(len(encoder.encode_ordinary(t)) + 1)))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got.collect()) == want
    assert not {8, 12, 13, 18} & {i for i, *_ in want} and 3 in {i for i, *_ in want}
    empty = f"{tmp_path}/empty"
    docs.where("false").write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "pack"]
