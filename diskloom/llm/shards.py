"""Sharding by balanced label propagation.

Links are given as hubs: rows of one hub are linked with each other, which stands for all pairs without listing them, and a row may
have several hubs. In the query documents with equal texts share a hub, and so do documents with one least line (the line of
smallest hash, which near copies keep more often than not); a link of the first kind weighs LINE_SHARE times less in the second.
Each hub's links are weighted so that a row's links within it sum to one. Shards hold equal numbers of rows (law `rows`: at most one apart) at every step:

1. start: rows are dealt by a hash of their number, whatever their links;
2. round: each hub's target is the shard that holds most of its members; hubs of more than a LARGE-th of a shard, of which there can't
   be many, divide the room of the shards among them first, and have as many targets as they need. A row's hubs vote for their
   targets with the weight of its links, and the row asks to move to the shard with most votes if that is not where it is; those that
   gain most votes go first. For each pair of shards as many rows move one way as the other: askers are exchanged
   for askers, then for rows without links, whose move cuts nothing. These quotas come from shards * shards counts;
3. rounds end when the cut (weight of links between shards) no longer falls; the placement with the least cut stays.

Scale: hub counts are aggregated before they are shuffled; hot hubs (a third of all rows) are met by broadcast in
common.spread_join; ranks within quotas are numbered in hash buckets (common.gapless_rank), so no task sees a whole
shard. Each round writes a table of numbers and shards; text is read once, for its size, checksum and hashes.

Defined results: null text has size 1 and checksum 0, and all null texts share one hub, as all empty ones do; texts of any length are
taken whole; ties go to the target with the larger hash of hub and shard; repeated
rows are rows of their own (they are told apart by their place); null ids are placed like others; no column but id
and text is read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diskloom.llm.common import gapless_rank, materialize, spread_join, utf8_bytes

ROUNDS = 6
#: What a link of documents that only share their least line weighs, against one of equal texts.
LINE_SHARE = 0.25
#: Hubs of room / LARGE members and more have their targets set together.
LARGE = 64
#: Rows that one hash bucket of a rank has, about.
BUCKET = 50_000


def _start(rows: DataFrame, shards: int, total: int) -> DataFrame:
    """(rid, shard): equal runs of rows in the order of a hash of their number."""
    ranked = gapless_rank(rows.select("rid"), [], ["rid"], "rank", max(16, total // BUCKET))
    return ranked.select("rid", F.floor(F.col("rank") * shards / total).cast("int").alias("shard"))


def _counts(links: DataFrame, state: DataFrame) -> DataFrame:
    """(hub, share, w, at: (n, tie, shard) by falling n): where the members of each hub are."""
    counts = links.join(state, "rid").groupBy("hub", "share", "shard").agg(F.count("*").alias("n"))
    held = F.collect_list(F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard"))
    return counts.groupBy("hub", "share").agg(F.sum("n").alias("w"), F.sort_array(held, False).alias("at"))


def cut_of(counts: DataFrame) -> float:
    """The weight of links between shards."""
    inside = F.aggregate("at", F.lit(0.0), lambda s, x: s + x["n"] * (x["n"] - 1) / 2)
    return counts.agg(F.sum(F.col("share") * (F.col("w") * (F.col("w") - 1) / 2 - inside) / (F.col("w") - 1))).first()[0] or 0.0


def _large_targets(counts: DataFrame, room: int, shards: int) -> list[tuple[str, list[int]]]:
    """(hub, targets) of the large hubs: the shard that holds most of it and has room for it all, or those with most room.

    A row has few links, so the large hubs are at most LARGE * shards times that many. A hub takes room by its share of its rows' links.
    """
    free, out = dict.fromkeys(range(shards), float(room)), []
    for r in sorted(counts.where(F.col("w") * LARGE >= room).collect(), key=lambda r: (-r["share"] * r["w"], r["hub"])):
        held = {x["shard"]: x["n"] for x in r["at"]}
        left = r["w"] * r["share"]
        fits = [b for b in range(shards) if free[b] >= left]
        if fits:
            targets = [max(fits, key=lambda b: (held.get(b, 0), free[b], -b))]
        else:
            ranked = sorted(range(shards), key=lambda b: (-free[b], -held.get(b, 0), b))
            targets = next((ranked[:k] for k in range(1, shards) if sum(free[b] for b in ranked[:k]) >= left), ranked)
        for b in targets:
            left, free[b] = left - min(left, free[b]), free[b] - min(left, free[b])
        out.append((r["hub"], targets))
    return out


def _asks(state: DataFrame, links: DataFrame, counts: DataFrame, targets: list[tuple[str, list[int]]], total: int) -> DataFrame:
    """state with the shard each row wants (`to`) and the weight it gains; `to` = shard for rows that are content, null for free rows."""
    large = state.sparkSession.createDataFrame(targets, "hub string, tops array<int>")
    there = F.transform("tops", lambda b: F.struct(F.coalesce(F.get(F.filter("at", lambda x: x["shard"] == b), F.lit(0))["n"], F.lit(0).cast("long")).alias("n"), F.lit(0).cast("long").alias("tie"), b.alias("shard")))
    top = F.when(F.col("tops").isNotNull(), there).otherwise(F.slice("at", F.lit(1), F.lit(1)))
    aims = counts.join(F.broadcast(large), "hub", "left").select("hub", "w", F.struct("share", F.col("w").alias("all"), "at", top.alias("top")).alias("t"))
    met = spread_join(links.join(state, "rid").select("rid", "shard", "hub"), aims, "hub", "w", total)
    stays = F.exists("t.top", lambda x: x["shard"] == F.col("shard"))
    picked = F.col("t.top")[F.pmod(F.xxhash64("rid", "hub"), F.size("t.top").cast("long")).cast("int")]["shard"]
    votes = met.select("rid", "shard", F.when(stays, F.col("shard")).otherwise(picked).alias("to"), F.col("t.share").alias("v"))
    sums = votes.groupBy("rid", "shard", "to").agg(F.sum("v").alias("v"))
    here = F.col("to") == F.col("shard")
    best = sums.groupBy("rid", "shard").agg(F.max(F.struct("v", here.alias("here"), F.xxhash64("to").alias("tie"), "to")).alias("b"), F.coalesce(F.sum(F.when(here, F.col("v"))), F.lit(0.0)).alias("o"))
    wish = best.select("rid", "b.to", F.when(~F.col("b.here"), F.greatest(F.col("b.v") - F.col("o"), F.lit(0.001))).alias("gain"))
    return state.join(wish, "rid", "left").select("rid", "shard", "to", "gain")


def _cycle(left: dict[tuple[int, int], int], shards: int) -> list[tuple[int, int]]:
    """The pairs of a shortest ring of shards along which rows still ask to move, or none."""
    best: list[tuple[int, int]] = []
    for start in range(shards):
        came, todo = {start: None}, [start]
        for a in todo:
            for b in range(shards):
                if left.get((a, b), 0) > 0:
                    if b == start:
                        ring, at = [(a, b)], a
                        while came[at] is not None:
                            ring.append((came[at], at))
                            at = came[at]
                        if not best or len(ring) < len(best):
                            best = ring
                        todo = todo[:0]
                        break
                    if b not in came:
                        came[b] = a
                        todo.append(b)
            else:
                continue
            break
    return best


def _quotas(asks: dict[tuple[int, int], int], free: dict[int, int], shards: int) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """How many askers move from a to b, and how many free rows move from b to a in exchange: rings of askers first, then free rows."""
    moves, fill = dict.fromkeys(asks, 0), {}
    left, idle = dict(asks), dict(free)
    while ring := _cycle(left, shards):
        n = min(left[e] for e in ring)
        for e in ring:
            left[e] -= n
            moves[e] += n
    for (a, b), n in sorted(left.items()):
        extra = min(n, idle.get(b, 0))
        if extra:
            moves[a, b] += extra
            idle[b] -= extra
            fill[b, a] = extra
    return moves, fill


def _moved(wish: DataFrame, moves: dict[tuple[int, int], int], fill: dict[tuple[int, int], int], buckets: int) -> DataFrame:
    """(rid, into) of the rows that move within the quotas."""
    spark = wish.sparkSession
    # askers: the quota of each (from, to) is met by descending powers of two of the gain
    askers = wish.where(F.col("gain").isNotNull()).withColumn("level", F.floor(F.log2("gain")).cast("int"))
    levels: dict[tuple[int, int, int], int] = {}
    left = dict(moves)
    for r in sorted(askers.groupBy("shard", "to", "level").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        take = min(r["n"], left.get((r["shard"], r["to"]), 0))
        if take > 0:
            levels[r["shard"], r["to"], r["level"]] = take
            left[r["shard"], r["to"]] -= take
    quota = spark.createDataFrame([(a, b, v, n) for (a, b, v), n in levels.items()], "shard int, to int, level int, quota long")
    ranked = gapless_rank(askers.join(F.broadcast(quota), ["shard", "to", "level"]), ["shard", "to", "level"], ["rid"], "rank", buckets)
    moved = ranked.where(F.col("rank") < F.col("quota")).select("rid", F.col("to").alias("into"))
    cuts, reach = [], {}
    for (b, a), n in sorted(fill.items()):
        if n:
            cuts.append((b, a, reach.get(b, 0), reach.get(b, 0) + n))
            reach[b] = reach.get(b, 0) + n
    if cuts:
        slices = spark.createDataFrame(cuts, "shard int, into int, lo long, hi long")
        free = gapless_rank(wish.where(F.col("to").isNull()).select("rid", "shard"), ["shard"], ["rid"], "rank", buckets)
        moved = moved.unionByName(free.join(F.broadcast(slices), "shard").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select("rid", "into"))
    return moved


def propagate(rows: DataFrame, links: DataFrame, shards: int, rounds: int = ROUNDS, cuts: list[float] | None = None) -> DataFrame:
    """(rid, shard) for rows (rid; distinct) with links (rid, hub, share). Counts of shards are at most one apart.

    cuts, if given, gets the cut at the start and after each round.
    """
    total = rows.count()
    if not total:
        return rows.select("rid", F.lit(0).alias("shard"))
    hubs = materialize(links.groupBy("hub").agg(F.count("*").alias("w")).where("w > 1"), "shard-hubs")
    linked = hubs.agg(F.sum("w")).first()[0] or 0
    links = materialize(spread_join(links, hubs.withColumn("many", F.lit(True)), "hub", "w", linked).drop("many"), "shard-links")
    buckets, room = max(16, total // BUCKET), -(-total // shards)
    state = best = materialize(_start(rows, shards, total), "shard-state")
    counts = materialize(_counts(links, state), "shard-counts")
    cut = cut_of(counts)
    cuts = [] if cuts is None else cuts
    cuts.append(cut)
    targets = _large_targets(counts, room, shards)
    for _ in range(rounds):
        wish = materialize(_asks(state, links, counts, targets, linked), "shard-wish")
        found = {(r["shard"], r["to"]): r["n"] for r in wish.groupBy("shard", "to").agg(F.count("*").alias("n")).collect()}
        asks = {(a, b): n for (a, b), n in found.items() if b is not None and a != b}
        moves, fill = _quotas(asks, {a: n for (a, b), n in found.items() if b is None}, shards)
        if not sum(moves.values()):
            break
        moved = materialize(_moved(wish, moves, fill, buckets), "shard-moves")
        state = materialize(state.join(moved, "rid", "left").select("rid", F.coalesce("into", "shard").alias("shard")), "shard-state")
        counts = materialize(_counts(links, state), "shard-counts")
        now = cut_of(counts)
        cuts.append(now)
        if now >= cut:
            break
        cut, best = now, state
    return best


def hubs_of(text: F.Column) -> F.Column:
    """array<struct<hub, share>> of a text: all of it, and its least line if it has one with more than white space."""
    whole = F.struct(F.coalesce(F.concat(F.lit("t"), F.md5(text.cast("binary"))), F.lit("null")).alias("hub"), F.lit(1.0).alias("share"))
    least = F.array_min(F.transform(F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0), lambda x: F.xxhash64(x)))
    line = F.struct(F.concat(F.lit("l"), F.hex(least)).alias("hub"), F.lit(LINE_SHARE).alias("share"))
    return F.when(least.isNull(), F.array(whole)).otherwise(F.array(whole, line))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, rounds: int = ROUNDS, cuts: list[float] | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs."""
    facts = docs.select(F.col(id_col).alias("id"), (utf8_bytes(F.col(text_col)) + 1).alias("size"), F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("crc"), hubs_of(F.col(text_col)).alias("hubs"))
    # a number of its own for each row, fixed by writing it down at once
    facts = materialize(facts.withColumn("rid", F.monotonically_increasing_id()), "shard-facts")
    placed = propagate(facts.select("rid"), facts.select("rid", F.explode("hubs").alias("h")).select("rid", "h.hub", "h.share"), shards, rounds, cuts)
    slots = gapless_rank(placed, ["shard"], ["rid"], "slot", max(16, facts.count() // BUCKET))
    return facts.join(slots, "rid").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
