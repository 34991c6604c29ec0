"""Bytes of the media: decoded chunks, sector ranges and whole-image hashes, as Arrow functions over planned ranges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diskloom.container.reader import Image
from diskloom.errors import EvidenceError
from diskloom.scratch import materialize
from diskloom.sources.evidence import load

SECTORS = "image_id string, chunk_no long, lba_start long, n_sectors int, data binary"
#: Decoded chunks that travel in one batch.
BATCH = 32


#: Rows of a plan (a range of 256 chunks, a share of a volume, an image) that one task takes at most, about.
ROWS_A_TASK = 64
#: Bytes of files that one task reads at most, about.
BYTES_A_TASK = 512 << 20


def tasks(spark: SparkSession, work: int = 0) -> int:
    """How many tasks share small rows that stand for much work: a number, as adaptive plans would join small partitions to one.

    At least three for each core, and as many as the work asks for, so that a task that is lost costs no more at any size.
    """
    return max(8, 3 * spark.sparkContext.defaultParallelism, work)


def spread(plan: DataFrame, keys: list[str]) -> DataFrame:
    """Deal the small rows of a plan evenly over tasks; each stands for much work."""
    plan = materialize(plan, "plan")
    return plan.repartition(tasks(plan.sparkSession, -(-plan.count() // ROWS_A_TASK)), *[F.col(k) for k in keys])


def in_order(rows: DataFrame, keys: list[str], total_bytes: int = 0) -> DataFrame:
    """Deal rows out by ranges of their place, sorted, so that a task's cache of chunks serves neighbours."""
    n = tasks(rows.sparkSession, -(-total_bytes // BYTES_A_TASK))
    return rows.repartitionByRange(n, *[F.col(k) for k in keys]).sortWithinPartitions(*keys)


def sectors(spark: SparkSession, path: str, lba_start: int | None = None, lba_end: int | None = None) -> DataFrame:
    """One row for each chunk, decoded and checked. A range of sectors prunes whole ranges before a byte is read."""
    ranges = load(spark, path, "ranges")
    if lba_start is not None:
        ranges = ranges.where(F.col("lba_end") > lba_start)
    if lba_end is not None:
        ranges = ranges.where(F.col("lba_start") < lba_end)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                image = Image.shared(path)
                per, size = image.geometry.chunk_sectors, image.geometry.sector_bytes
                # only the chunks under the asked sectors
                low = first if lba_start is None else max(first, lba_start // per)
                high = first + n if lba_end is None else min(first + n, -(-lba_end // per))
                rows: list[tuple] = []
                for k, data in enumerate(image.run(low, max(0, high - low)), low):
                    rows.append((path, k, k * per, len(data) // size, data))
                    if len(rows) == BATCH:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return spread(ranges, ["image_id", "first_chunk"]).select("image_id", "first_chunk", "chunks").mapInArrow(decode, SECTORS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["image_id", "chunk_no", "lba_start", "n_sectors", "data"])


def read_ranges(requests: DataFrame) -> DataFrame:
    """requests (image_id, lba, n, and more columns) with `data`: n sectors from lba on.

    A start at or past the end fails the query; what runs past the end is zero. Any number of requests; each task keeps a
    cache of decoded chunks, so requests are best sorted by image and sector.
    """
    schema = requests.schema
    names = [f.name for f in schema.fields]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lba, n = (batch.column(names.index(c)).to_pylist() for c in ("image_id", "lba", "n"))
            for k in range(0, len(at), BATCH):
                out = [Image.shared(path).read_sectors(start, count) for path, start, count in zip(at[k : k + BATCH], lba[k : k + BATCH], n[k : k + BATCH], strict=True)]
                part = batch.slice(k, BATCH)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*names, "data"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return requests.mapInArrow(read, f"{kinds}, data binary")


def image_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Stored and computed MD5 and SHA-1 of each image. A hash can't be merged, so one task streams one whole image."""
    stored = load(spark, path, "stored_hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, want_md5, want_sha1 in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                md5, sha1, n, error = hashlib.md5(), hashlib.sha1(), 0, None
                try:
                    with Image.open(path) as image:
                        for data in image.stream():
                            md5.update(data)
                            sha1.update(data)
                            n += len(data)
                except EvidenceError as e:
                    error = str(e)
                got = (md5.digest(), sha1.digest()) if error is None else (None, None)
                row = (path, want_md5, want_sha1, *got, None if want_md5 is None or error else want_md5 == got[0], None if want_sha1 is None or error else want_sha1 == got[1], n, error)
                kinds = (pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.bool_(), pa.int64(), pa.string())
                names = ["image_id", "stored_md5", "stored_sha1", "computed_md5", "computed_sha1", "md5_match", "sha1_match", "bytes_hashed", "error"]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

    schema = "image_id string, stored_md5 binary, stored_sha1 binary, computed_md5 binary, computed_sha1 binary, md5_match boolean, sha1_match boolean, bytes_hashed long, error string"
    return spread(stored, ["image_id"]).mapInArrow(run, schema)
