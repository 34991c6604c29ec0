"""Raw records of volumes as tables: allocation tables, tree items, object maps and extended attributes."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diskloom.container.reader import Image
from diskloom.errors import EvidenceError
from diskloom.fs.apfs import Apfs
from diskloom.fs.base import FileSystem
from diskloom.fs.btrfs import Btrfs
from diskloom.fs.exfat import ExFat
from diskloom.fs.fat import Fat
from diskloom.fs.registry import open_volume
from diskloom.operators.files import _arrow
from diskloom.operators.media import spread
from diskloom.sources.evidence import load

ROWS = 5000


def _clusters(fs: FileSystem) -> Iterator[tuple]:
    for k, after in enumerate(fs.table.tolist()):
        if k > 1 and after:
            yield k, after


def _items(fs: FileSystem) -> Iterator[tuple]:
    for (o, kind, offset), data in fs.items(fs.tree):
        # offsets are unsigned on the disk
        yield o, kind, struct.unpack("<q", struct.pack("<Q", offset))[0], data


def _objects(fs: FileSystem) -> Iterator[tuple]:
    for kind, table in (("container", fs.objects), ("volume", fs.names)):
        for oid, block in table.items():
            yield kind, oid, block


TABLES: dict[str, tuple[tuple[type, ...], str, Callable[[FileSystem], Iterator[tuple]]]] = {
    "fat": ((Fat, ExFat), "cluster long, next long", _clusters),
    "btree_items": ((Btrfs,), "objectid long, type int, offset long, data binary", _items),
    "omap": ((Apfs,), "map string, oid long, paddr long", _objects),
    "xattrs": ((Apfs,), "file_id long, name string, value binary, stream_id long, stream_size long", lambda fs: fs.attributes()),
}


def records(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of TABLES with image_id and part, over the volumes that have such records."""
    if table not in TABLES:
        raise EvidenceError(f"no table {table}; there are {', '.join(TABLES)}")
    kinds, columns, make = TABLES[table]
    ddl = f"image_id string, part int, {columns}"
    schema = _arrow(ddl)
    plan = load(spark, path, "volumes").where(F.col("error").isNull()).select("image_id", "part", "start_sector", "size_sectors", "fs_type")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, part, start, size, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs = open_volume(Image.shared(image_id), start, size, kind)
                if not isinstance(fs, kinds):
                    continue
                rows: list[tuple] = []
                for r in make(fs):
                    rows.append((image_id, part, *r))
                    if len(rows) == ROWS:
                        yield _batch(rows, schema)
                        rows = []
                if rows:
                    yield _batch(rows, schema)

    return spread(plan, ["image_id", "part"]).mapInArrow(run, ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
