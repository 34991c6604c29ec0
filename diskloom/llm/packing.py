"""Best-fit packing of token sequences with swap-based local search.

Documents become token ids plus an end token. Only documents longer than the capacity are cut, into pieces of exactly
the capacity with a shorter first piece. Pieces are dealt by hash into blocks of about `block_pieces`; each block is
packed best-fit decreasing and then improved: the emptiest underfull bin gives its pieces away by moving one into
another bin, by exchanging one for one smaller, two for one or one for two, each step raising the sum of
squared fills, until bins empty and no step is left. The sums that one or two pieces of a bin make are bit sets of lengths, joined
over all bins with the same room, so a step costs the capacity, not the number of bins or pieces. The underfull sequences
of all blocks then meet in fewer blocks, level by level, while their number falls by half.

Scale: text is tokenised once, in a map-only pass; what is dealt out is eight numbers a piece. A block is bounded, so no
task's memory follows the input. Each block's result is a function of its pieces alone.

Defined results: null text is empty and has the end token only; a text of any length is encoded whole (long runs
that one library can't split are given to the other) and only its pieces are held; equal lengths are placed in the order of checksum, id
and place; repeated rows are packed each; null ids are carried; columns but id and text are not read, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diskloom.llm.common import materialize, text_batches

CAPACITY, END = 1024, 2
BLOCK_PIECES = 20_000
#: Tasks that blocks are dealt over; a task takes its blocks one after another.
MAX_TASKS = 20_000


def default_vocabulary() -> str:
    """The ranks of byte_bpe_50k.json: the same vocabulary, read by a faster library (a test holds their ids together)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(ranks: dict[bytes, int], pattern: str, special: dict[str, int]):
    import tiktoken

    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


class Encoder:
    """Ids of whole texts. The fast library gives up on runs of blanks that its expressions can't go back over; such texts go to the other."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, other: str):
        self.fast, self.other, self.slow = _encoder(ranks, pattern, {"<|endoftext|>": 50256}), other, None

    def __call__(self, text: str) -> list[int]:
        try:
            return self.fast.encode(text, allowed_special="all")
        except ValueError:
            from tokenizers import Tokenizer

            self.slow = self.slow or Tokenizer.from_file(self.other)
            return self.slow.encode(text, add_special_tokens=False).ids


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece."""
    import public_tokenizers

    text_batches(docs.sparkSession)
    pattern = public_tokenizers.PATTERN
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary or default_vocabulary()))
    # the same vocabulary in the other library's form
    other = (vocabulary or default_vocabulary()).removesuffix(".tiktoken") + ".json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(shared.value, pattern, other)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows, piece, start, length, crc = [], [], [], [], []
                for r, text in enumerate(batch.column(1).to_pylist()):
                    ids = np.array([*(encode(text) if text else []), end], "<u4")
                    for k, (s, n) in enumerate(cut(len(ids), capacity)):
                        rows.append(r)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(ids[s : s + n].tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of piece numbers, best-fit decreasing; a bit set of free spaces finds the tightest bin at once."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = some >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                some &= ~(1 << free)
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if free > n:
            by_free[free - n].append(b)
            some |= 1 << (free - n)
    return bins


class _Bins:
    """Bins of pieces, and for each the sums that one or two of its pieces make, as bit sets of lengths."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.room = [0] * len(bins)
        self.one, self.two = [0] * len(bins), [0] * len(bins)
        self.shape: list[tuple[int, ...]] = [()] * len(bins)
        #: of each room the underfull bins that have it
        self.by_room: dict[int, set[int]] = {}
        #: of each room the unions of the sums of its bins, until one of them changes
        self.unions: dict[int, tuple[int, int]] = {}
        self.left = 0
        for b in range(len(bins)):
            self._look(b)

    def _look(self, b: int) -> None:
        held = sorted(self.lengths[i] for i in self.bins[b])
        self.room[b], self.shape[b] = self.capacity - sum(held), tuple(held)
        self.left += bool(held)
        if held and self.room[b]:
            one = two = seen = 0
            for n in held:
                two |= seen << n
                one |= 1 << n
                seen = one
            self.one[b], self.two[b] = one, two
            self.by_room.setdefault(self.room[b], set()).add(b)
            self.unions.pop(self.room[b], None)

    def change(self, b: int, out: list[int], back: list[int]) -> None:
        self.left -= bool(self.bins[b])
        if b in self.by_room.get(self.room[b], ()):
            self.by_room[self.room[b]].discard(b)
            self.unions.pop(self.room[b], None)
            if not self.by_room[self.room[b]]:
                del self.by_room[self.room[b]]
        for i in out:
            self.bins[b].remove(i)
        self.bins[b] += back
        self._look(b)

    def pieces(self, b: int, total: int, most: int) -> list[int] | None:
        """At most `most` pieces of a bin, the fewest and then the first, whose lengths make the total."""
        if not total:
            return []
        at: dict[int, list[int]] = {}
        for i in sorted(self.bins[b]):
            at.setdefault(self.lengths[i], []).append(i)
        if total in at:
            return at[total][:1]
        for n in sorted(at) if most > 1 else ():
            rest = at.get(total - n, ())
            if n < total - n and rest:
                return [at[n][0], rest[0]]
            if n == total - n and len(rest) > 1:
                return rest[:2]
        return None

    def _union(self, some: Iterable[int]) -> tuple[int, int]:
        """Sums of one piece, and of none, one or two pieces, that any of the bins has."""
        one = both = 0
        for b in some:
            one |= self.one[b]
            both |= self.two[b]
        return one, 1 | one | both

    def step(self, source: int) -> tuple[int, list[int], list[int]] | None:
        """The exchange that fills another, at least as full bin most: (other bin, pieces out, pieces back).

        Bins of one room are looked at together, by the union of their sums: gain g is possible if a sum of the source, less g,
        is a sum of a bin with room for g.
        """
        top = self.room[source]
        one = [0] * (top + 1)  # by gain: sums of one piece, of bins with at least that room
        any_ = [0] * (top + 1)  # sums of none, one or two pieces
        for room, some in self.by_room.items():
            if room < top:
                if room not in self.unions:
                    self.unions[room] = self._union(some)
                one[room], any_[room] = self.unions[room]
        # of bins as empty as the source all but itself
        equal = self.by_room[top] - {source}
        if equal:
            one[top], any_[top] = self._union({self.shape[b]: b for b in equal}.values())
        for g in range(top - 1, 0, -1):
            one[g] |= one[g + 1]
            any_[g] |= any_[g + 1]
        for g in range(top, 0, -1):
            single, pair = (self.one[source] >> g) & any_[g], (self.two[source] >> g) & one[g]
            if single or pair:
                m = ((single or pair) & -(single or pair)).bit_length() - 1
                out = self.pieces(source, m + g, 1 if single else 2)
                for room in sorted(r for r in self.by_room if g <= r <= top):
                    if room < top and not self.unions[room][1 if single else 0] >> m & 1:
                        continue
                    for b in sorted(self.by_room[room]):
                        if b != source and (m == 0 or (self.one[b] | (self.two[b] if single else 0)) >> m & 1):
                            return b, out, self.pieces(b, m, 2 if single else 1)
        return None


def improve(bins: list[list[int]], lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Moves and exchanges between underfull bins, each of which raises the sum of squared fills.

    The emptiest bin gives first. Bins of equal lengths stand for each other; a bin that found no step is looked at again once
    it, or any bin in a later pass, has changed. It ends when no bin has a step, or when no packing can have fewer bins.
    """
    held = _Bins([list(b) for b in bins], lengths, capacity)
    least = -(-sum(lengths[i] for b in bins for i in b) // capacity)
    found = True
    while found and held.left > least:
        found = False
        tried: set[tuple[int, ...]] = set()
        while held.left > least:
            rooms = sorted((r for r, some in held.by_room.items() if some), reverse=True)
            source = next((b for r in rooms for b in sorted(held.by_room[r]) if held.shape[b] not in tried), None)
            if source is None:
                break
            while held.left > least and held.bins[source]:
                step = held.step(source)
                if step is None:
                    break
                other, out, back = step
                held.change(source, out, back)
                held.change(other, back, out)
                found = True
            if held.bins[source]:
                tried.add(held.shape[source])
    return [p for p in held.bins if p]


def pack_block(pieces: pd.DataFrame, capacity: int = CAPACITY, level: int = 0) -> pd.DataFrame:
    """The pieces of one block with their places; full: whether the sequence is. From level 1 on pieces come in bins, and no bin is added."""
    pieces = pieces.sort_values(["length", "ids_crc32", "id", "piece", "start"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
    lengths = pieces["length"].tolist()
    bins = improve(best_fit(lengths, capacity), lengths, capacity)
    if level:
        given = improve([list(x) for x in pieces.groupby("sequence_id", sort=True).indices.values()], lengths, capacity)
        bins = min(bins, given, key=len)
    sequence, offset, full = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
    for b, held in enumerate(bins):
        at = 0
        for i in held:
            sequence[i], offset[i] = b, at
            at += lengths[i]
        full[held] = at == capacity
    block = pieces["block"].to_numpy(np.int64)
    return pieces.assign(sequence_id=(level << 58) + (block << 32) + sequence, offset=offset, full=full)


def _pack_blocks(dealt: DataFrame, blocks: int, capacity: int, level: int) -> DataFrame:
    """dealt (numbers of pieces, block) with sequence_id, offset and full; a task takes one block after another."""
    names = ["id", "piece", "start", "length", "ids_crc32", "block", "sequence_id", "offset", "full"]
    kind = dealt.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []

        def done() -> pa.RecordBatch:
            # None as an id must not turn the ids into floats
            one = pd.concat(held, ignore_index=True)
            return pa.RecordBatch.from_pandas(pack_block(one, capacity, level)[names], preserve_index=False)

        for batch in batches:
            rows = batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype(), pa.int16(): pd.Int16Dtype()}.get)
            for block, some in rows.groupby("block", sort=True):
                if held and held[0]["block"].iloc[0] != block:
                    yield done()
                    held = []
                held.append(some)
        if held:
            yield done()

    placed = dealt.repartitionById(min(blocks, MAX_TASKS), F.pmod("block", F.lit(min(blocks, MAX_TASKS))).cast("int")).sortWithinPartitions("block")
    return placed.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, block long, sequence_id long, offset long, full boolean")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    pieces = materialize(tokenise(docs, id_col, text_col, vocabulary, capacity, end), "pack-pieces")
    blocks = max(1, -(-pieces.count() // block_pieces))
    # the row's place tells rows apart that repeat id and text, so that they share no block
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(blocks)))
    level = 0
    packed = materialize(_pack_blocks(dealt, blocks, capacity, level), "packed")
    out = None
    while blocks > 1:
        # what is in underfull sequences meets that of other blocks, whole sequences together, while it grows less
        rest = packed.where(~F.col("full"))
        fewer = max(1, -(-rest.count() // block_pieces))
        if 2 * fewer > blocks:
            break
        whole = packed.where("full")
        out = whole if out is None else out.unionByName(whole)
        blocks, level = fewer, level + 1
        dealt = rest.select("id", "piece", "start", "length", "ids_crc32", "sequence_id", F.pmod(F.xxhash64("sequence_id"), F.lit(blocks)).alias("block"))
        packed = materialize(_pack_blocks(dealt, blocks, capacity, level), "packed")
    out = packed if out is None else out.unionByName(packed)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
