"""A deterministic sharded WARC writer, and a reader that verifies what it reads.

Records are range-sorted by (page id, payload digest). Shards hold equal shares of the bytes: narrow rows (id, digest, bytes) are
range-partitioned, and running sums of their bytes cut the order into shards, so shards do not depend on how the input is
partitioned, nor on how its ids lie. Each shard is written by one task, in order, into files that
roll when their compressed size passes `roll_bytes`; every record is a gzip member of its own with a fixed date, an
id derived from its content, and fresh lengths and digests. A file is written under a temporary name in the same
folder and renamed when complete, or removed on an error; a task that runs twice writes the same bytes under the same name. What counts
is the manifest (file, records, bytes, sha256), a Parquet table that is committed last: readers open only its files.

Of pages with equal payloads of at least `least_bytes` bytes, the smallest id is a response and the others are revisits of
it. Duplicates are found by digest on narrow rows, aggregated before the shuffle; hot payloads are met by
broadcast (common.spread_join). The html itself is shuffled once, together with the few rows that say "revisit".

Scale: there are at most MAX_SHARDS shards, so their bounds, the only table that is broadcast, have that many rows at any size.

Defined results: null html has an empty payload; a null url gives a record without target; null ids sort first, are
responses unless their payload has a smaller id that is not null, and are read back as null; repeated rows are written each, a repeated
response as a response again, and may be dealt over several shards; a payload of any length is one record; other columns are not read,
whatever their names; an empty table gives an empty manifest and no rows. Ids must be integers.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from diskloom.llm.common import materialize, scratch_path, spread_join, text_batches

DATE = "2020-01-01T00:00:00Z"
SHARD_BYTES, ROLL_BYTES = 32_000_000, 16_000_000
#: Larger inputs have larger shards, of as many files as it takes.
MAX_SHARDS = 20_000
_NAMES = uuid.UUID("6b1f0f4e-2a7e-5a38-9d0c-6d0c8a4e7f11")


def _local(path: str) -> str | None:
    """The path in the file system that is mounted everywhere, or None for other stores."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


@contextmanager
def creating(folder: str, name: str) -> Iterator[BinaryIO]:
    """A file that gets its name only when it is complete."""
    temp = f".tmp-{name}-{uuid.uuid4().hex}"
    here = _local(folder)
    if here is not None:
        os.makedirs(here, exist_ok=True)
        try:
            with open(f"{here}/{temp}", "wb") as f:
                yield f
                f.flush()
                os.fsync(f.fileno())
        except BaseException:
            os.unlink(f"{here}/{temp}")
            raise
        os.replace(f"{here}/{temp}", f"{here}/{name}")
        return
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    try:
        with store.open_output_stream(f"{base}/{temp}") as f:
            yield f
    except BaseException:
        store.delete_file(f"{base}/{temp}")
        raise
    store.move(f"{base}/{temp}", f"{base}/{name}")


@contextmanager
def opening(folder: str, name: str) -> Iterator[BinaryIO]:
    here = _local(folder)
    if here is not None:
        with open(f"{here}/{name}", "rb") as f:
            yield f
        return
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{base}/{name}") as f:
        yield f


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    """A gzip member without time or name: equal data gives equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return member(head.encode() + block + b"\r\n\r\n")


def urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, '|'.join(map(str, parts)))}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A response, or a revisit of page `first`. The HTTP headers of a revisit keep the payload's length."""
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", urn("record", page_id, digest)), ("WARC-Date", DATE)]
    if page_id is not None:
        fields.append(("WARC-Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if first is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", urn("record", first, digest)), ("WARC-Refers-To-Page-ID", str(first))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest32(block)}")]
    return _record(fields, block)


def info_record(name: str) -> bytes:
    block = b"software: diskloom\r\nformat: WARC File Format 1.1\r\n"
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", urn("info", name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", f"sha1:{digest32(block)}")], block)


def members(f: BinaryIO, sha: "hashlib._Hash", piece: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, decompressed, one at a time."""
    z, out, raw = zlib.decompressobj(31), bytearray(), b""
    while True:
        if not raw:
            raw = f.read(piece)
            sha.update(raw)
            if not raw:
                if out:
                    raise ValueError("the archive ends within a record")
                return
        out += z.decompress(raw)
        raw = z.unused_data
        if z.eof:
            yield bytes(out)
            z, out = zlib.decompressobj(31), bytearray()
        else:
            raw = b""


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    block = rest[:n]
    if fields["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
        raise ValueError("a block digest is wrong")
    return fields, block


KEY = ["i", "digest", "u", "r"]


def shard_bounds(sizes: DataFrame, shard_bytes: int) -> list[str]:
    """The least key of each shard but the first, as texts in their order (key_text), for sizes (KEY, b): equal shares of the sum of b.

    r, a random number of each row, parts rows that are equal in all else where these fill more than a shard. At most MAX_SHARDS - 1 keys.
    """
    total = sizes.agg(F.sum("b")).first()[0] or 0
    shards = min(MAX_SHARDS, max(1, -(-total // shard_bytes)))
    if shards == 1:
        return []
    parts = max(8, min(2000, total // (64 * shard_bytes)))
    order = [F.col(c).asc_nulls_first() for c in KEY]
    ranged = materialize(sizes.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "warc-ranges")
    # one row for each of at most 2,000 partitions
    sums = ranged.groupBy("part").agg(F.sum("b").alias("s")).withColumn("start", F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    at = F.coalesce("start", F.lit(0)) + F.sum("b").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("b")
    key = F.struct(F.col("i").isNotNull().alias("known"), F.coalesce("i", F.lit(0)).alias("i"), "digest", "u", "r").alias("key")
    placed = ranged.join(F.broadcast(sums), "part").select(F.floor(at * F.lit(shards).cast("decimal(10,0)") / total).cast("int").alias("shard"), key)
    least = materialize(placed.groupBy("shard").agg(F.min("key").alias("key")).where("shard > 0"), "warc-bounds")
    # a row that nothing equal precedes is a bound whatever its number, which another scan may draw anew
    same = F.struct("key.known", "key.i", "key.digest", "key.u")
    first = ranged.select(key).select(same.alias("g"), "key.r").join(F.broadcast(least.select(same.alias("g")).distinct()), "g").groupBy("g").agg(F.min("r").alias("least_r"))
    rows = least.select("shard", "key", same.alias("g")).join(first, "g").orderBy("shard").collect()
    bias = lambda v: f"{v + (1 << 63):016X}"
    return [f"{row['key']['known']:d}{bias(row['key']['i'])}{row['key']['digest']}{bias(row['key']['u'])}{bias(-(1 << 63) if row['key']['r'] == row['least_r'] else row['key']['r'])}" for row in rows]


def key_text(u: Column, r: Column) -> Column:
    """A row's key (id is known, id, digest, url hash, number) as a text of the same order."""
    digits = lambda v: F.lpad(F.hex(v.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.col("i").isNotNull().cast("int").cast("string"), digits(F.coalesce("i", F.lit(0).cast("long"))), F.col("digest"), digits(u), digits(r))


def _sharded(rows: DataFrame, revisits: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """rows (i, url, html, digest) and revisits (i, digest, first) with a column `shard`; a revisit goes to each shard that holds its pages."""
    numbered = rows.withColumn("u", F.coalesce(F.xxhash64("url"), F.lit(0))).withColumn("r", F.xxhash64(F.monotonically_increasing_id()))
    bounds = shard_bounds(numbered.select(*KEY, (F.coalesce(F.octet_length("html"), F.lit(0)) + 600).cast("long").alias("b")), shard_bytes)
    lo, hi = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)

    def place(u: Column, r: Column) -> Column:
        """How many bounds are at most the row's key, by halving."""
        if not bounds:
            return F.lit(0)
        halves = F.lit([1 << k for k in reversed(range(len(bounds).bit_length()))])
        table = F.lit(bounds)
        return F.element_at(F.transform(F.array(key_text(u, r)), lambda key: F.aggregate(halves, F.lit(0), lambda at, w: F.when((at + w <= len(bounds)) & (F.try_element_at(table, at + w) <= key), at + w).otherwise(at))), 1)

    pages = numbered.select(place(F.col("u"), F.col("r")).alias("shard"), "i", "url", "html", "digest", F.lit(None).cast("long").alias("first"), F.lit(1).alias("kind"))
    reach = revisits.select(F.explode(F.sequence(place(lo, lo), place(hi, hi))).alias("shard"), "i", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "first", F.lit(0).alias("kind"))
    return pages.unionByName(reach), len(bounds) + 1


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, prefix: str = "pages") -> DataFrame:
    """Write all pages into folder; returns the committed manifest."""
    text_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    narrow = rows.select("i", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes"))
    equal = materialize(narrow.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("i").alias("first"), F.count("*").alias("w")).where("w > 1"), "warc-equal")
    revisits = spread_join(narrow.select("i", "digest"), equal, "digest", "w", equal.agg(F.sum("w")).first()[0] or 0).where(F.col("first").isNotNull() & ~F.col("i").eqNullSafe(F.col("first"))).distinct()
    dealt, shards = _sharded(rows.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary"))), revisits, shard_bytes)
    ordered = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "i", "digest", "kind", "url").select("shard", "i", "url", "html", "digest", "first", "kind")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, said, entry, told = None, None, None, None
        f = sha = opened = None
        n = 0

        def finish() -> pa.RecordBatch:
            nonlocal f
            f = None
            opened.close()
            return pa.RecordBatch.from_pydict({"file": pa.array([entry["file"]]), "records": pa.array([entry["records"]], pa.int64()), "bytes": pa.array([entry["bytes"]], pa.int64()), "sha256": pa.array([sha.hexdigest()])})

        def put(data: bytes) -> None:
            f.write(data)
            sha.update(data)
            entry["bytes"] += len(data)

        # what fails while a file is open goes through its context, which removes it
        with ExitStack() as opened:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    part = whole.slice(at, 512)
                    for s, i, url, html, digest, first, kind in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        if kind == 0:
                            said, told = (i, digest), first
                            continue
                        if f is not None and (s != shard or entry["bytes"] >= roll_bytes):
                            yield finish()
                        if f is None:
                            n = n + 1 if s == shard else 0
                            shard = s
                            name = f"{prefix}-{s:06d}-{n:05d}.warc.gz"
                            entry, sha = {"file": name, "records": 0, "bytes": 0}, hashlib.sha256()
                            f = opened.enter_context(creating(folder, name))
                            put(info_record(name))
                        put(page_record(i, url, (html or "").encode("utf-8", "surrogatepass"), told if said == (i, digest) else None))
                        entry["records"] += 1
            if f is not None:
                yield finish()

    ordered.mapInArrow(save, "file string, records long, bytes long, sha256 string").write.mode("overwrite").parquet(f"{folder}/_manifest")
    return manifest(pages.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("file string, records long, bytes long, sha256 string").parquet(f"{folder}/_manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every page record.

    Lengths, record counts, all digests and each file's sha256 are checked; payload is null for revisits.
    """
    listed = manifest(spark, folder)
    files = listed.count()

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for name, records, want in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                out, seen, sha = [], 0, hashlib.sha256()
                with opening(folder, name) as f:
                    for raw in members(f, sha):
                        fields, block = parse(raw)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        seen += 1
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = fields["WARC-Type"] == "revisit"
                        if not revisit and (len(payload) != size or digest32(payload) != digest):
                            raise ValueError(f"{name}: a payload's digest or length is wrong")
                        page, first = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To-Page-ID")
                        out.append((page and int(page), fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"], first and int(first), None if revisit else payload))
                        if len(out) == 500:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                            out = []
                if seen != records or sha.hexdigest() != want:
                    raise ValueError(f"{name} is not the file of the manifest")
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return listed.repartition(max(1, min(files, MAX_SHARDS)), "file").mapInArrow(load, schema)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write pages to the scratch folder, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = scratch_path(pages.sparkSession, "warc")
    write(pages, folder, **options)
    return read(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
