"""The data source `evidence`: the metadata layers of containers as tables.

spark.read.format("evidence").option("table", name).load(path), where path is a container, a folder or a glob. One task reads
`images_per_task` images; nothing but their names is planned on the driver. Tables that hold bytes of the media are not
here: they are Arrow functions over the rows of `ranges` and `volumes` (diskloom.operators).
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from diskloom.container.reader import PAGE_ENTRIES, TAGS, Image, is_container
from diskloom.errors import EvidenceError
from diskloom.fs.detect import raid, summary
from diskloom.fs.registry import PARSERS, open_volume
from diskloom.partition.tables import partitions, probe, scheme
from diskloom.scratch import local

SCHEMAS = {
    "containers": "image_id string, is_container boolean",
    "segments": "image_id string, seg int, path string, size long, start_off long",
    "sections": "image_id string, seg int, idx int, type string, addr long, next long, size long, checksum long",
    "headers": "image_id string, ord int, kv map<string,string>, case_number string, evidence_number string, examiner string",
    "media": "image_id string, media_type short, chunk_count long, chunk_sectors long, sector_bytes long, sector_count long, chs string, compression_level short, set_guid binary",
    "stored_hashes": "image_id string, stored_md5 binary, stored_sha1 binary",
    "chunks": "image_id string, seg int, section_idx int, chunk_idx int, chunk_no long, file_off long, compressed boolean, valid_bytes int, lba_start long, lba_end long",
    "ranges": "image_id string, first_chunk long, chunks int, lba_start long, lba_end long",
    "heads": "image_id string, sector_bytes int, head binary",
    "probes": "image_id string, idx int, window binary",
    "partitions": "image_id string, idx int, start_sector long, size_sectors long, size_bytes long, type string, type_code short, type_name string, filesystem string",
    "schemes": "image_id string, scheme string",
    "volumes": "image_id string, part int, start_sector long, size_sectors long, fs_type string, shares int, root_id long, label string, block_size long, attrs map<string,string>, error string",
    "errors": "image_id string, error string",
}
CHUNKS_A_RANGE = 256
HEAD_SECTORS = 68


def _segments(i: Image) -> Iterator[tuple]:
    for k, s in enumerate(i.segments):
        yield i.path, k, s.path, s.size, s.start


def _sections(i: Image) -> Iterator[tuple]:
    for s in i.sections:
        yield i.path, s.seg, s.idx, s.type, s.addr, s.next, s.size, s.checksum


def _headers(i: Image) -> Iterator[tuple]:
    for k, h in enumerate(i.headers):
        yield i.path, k, {TAGS.get(t, t): v for t, v in h.items()}, h.get("c", ""), h.get("n", ""), h.get("e", "")


def _media(i: Image) -> Iterator[tuple]:
    m = i.geometry
    yield i.path, m.media_type, m.chunk_count, m.chunk_sectors, m.sector_bytes, m.sector_count, m.chs, m.compression_level, bytes(m.set_guid)


def _hashes(i: Image) -> Iterator[tuple]:
    yield i.path, i.stored_md5, i.stored_sha1


def _chunks(i: Image) -> Iterator[tuple]:
    per = i.geometry.chunk_sectors
    for t in i.tables:
        for k in range(t.count):
            if k % PAGE_ENTRIES == 0:
                page = i.entries(t, k, PAGE_ENTRIES).tolist()
            e, n = page[k % PAGE_ENTRIES], t.first_chunk + k
            yield i.path, t.seg, t.section_idx, k, n, t.base + (e & 0x7FFFFFFF), bool(e >> 31), i.valid_bytes(n), n * per, (n + 1) * per


def _ranges(i: Image) -> Iterator[tuple]:
    per = i.geometry.chunk_sectors
    for k in range(0, i.chunk_total, CHUNKS_A_RANGE):
        n = min(CHUNKS_A_RANGE, i.chunk_total - k)
        yield i.path, k, n, k * per, (k + n) * per


def _heads(i: Image) -> Iterator[tuple]:
    if i.coverage:
        yield i.path, i.geometry.sector_bytes, i.read_sectors(0, min(HEAD_SECTORS, i.coverage))


def _probes(i: Image) -> Iterator[tuple]:
    for p in partitions(i):
        yield i.path, p.index, probe(i, p.start_sector, p.size_sectors)


def _partitions(i: Image) -> Iterator[tuple]:
    for p in partitions(i):
        yield i.path, p.index, p.start_sector, p.size_sectors, p.size_bytes, p.type, p.type_code, p.type_name, p.filesystem


def _schemes(i: Image) -> Iterator[tuple]:
    yield i.path, scheme(i)


def _volumes(i: Image) -> Iterator[tuple]:
    for p in partitions(i):
        row = (i.path, p.index, p.start_sector, p.size_sectors, p.filesystem)
        window = probe(i, p.start_sector, p.size_sectors)
        if p.filesystem not in PARSERS:
            attrs = summary(p.filesystem, window) if len(window) >= 4096 else {}
            found = raid(window)
            yield (*row, 0, 0, "", 0, attrs | ({"raid": found} if found else {}), f"no reader for {p.filesystem}")
            continue
        try:
            fs = open_volume(i, p.start_sector, p.size_sectors, p.filesystem)
            yield (*row, fs.shares(), fs.root, fs.label(), fs.block_size(), {str(k): str(v) for k, v in fs.info().items()}, None)
        except (EvidenceError, ValueError, IndexError, KeyError, struct.error) as e:
            yield (*row, 0, 0, "", 0, {}, f"{type(e).__name__}: {e}")


MAKERS: dict[str, Callable[[Image], Iterator[tuple]]] = {
    "segments": _segments, "sections": _sections, "headers": _headers, "media": _media, "stored_hashes": _hashes, "chunks": _chunks,
    "ranges": _ranges, "heads": _heads, "probes": _probes, "partitions": _partitions, "schemes": _schemes, "volumes": _volumes,
}


def images(path: str) -> list[str]:
    """The first segments under a path: a file, a folder (its *.E01, at any depth) or a glob."""
    path = local(path)
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(f"{glob.escape(path)}/**/*", recursive=True) if p[-4:].lower() in (".e01", ".ex1", ".s01") and "/.tmp-" not in p)
    found = sorted(glob.glob(path)) if glob.has_magic(path) else [path]
    if not found or not os.path.exists(found[0]):
        raise EvidenceError(f"no container at {path}")
    return found


class Images(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class EvidenceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.table = options.get("table", "partitions")
        self.paths = images(options["path"])
        self.per_task = int(options.get("images_per_task", "8"))
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"

    def partitions(self) -> list[InputPartition]:
        return [Images(self.paths[k : k + self.per_task]) for k in range(0, len(self.paths), self.per_task)] or [Images([])]

    def read(self, partition: Images) -> Iterator[tuple]:
        for path in partition.paths:
            if self.table == "containers":
                yield path, is_container(path)
                continue
            if self.table == "errors":
                try:
                    with Image.open(path) as image:
                        for _ in image.stream(65536):
                            pass
                except (EvidenceError, OSError) as e:
                    yield path, f"{type(e).__name__}: {e}"
                continue
            try:
                with Image.open(path) as image:
                    rows = list(MAKERS[self.table](image)) if self.permissive else None
                    yield from rows if rows is not None else MAKERS[self.table](image)
            except (EvidenceError, OSError):
                # an image that can't be read is a row of `errors`, never a row of made-up values
                if not self.permissive:
                    raise


class PruningReader(EvidenceReader):
    """Takes filters on image_id, so that other images are never opened."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("image_id",):
                self.paths = [p for p in self.paths if p == f.value]
            elif isinstance(f, In) and f.attribute == ("image_id",):
                self.paths = [p for p in self.paths if p in set(f.value)]
            else:
                yield f


class EvidenceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evidence"

    def schema(self) -> str:
        table = self.options.get("table", "partitions")
        if table not in SCHEMAS:
            raise EvidenceError(f"no table {table}; there are {', '.join(SCHEMAS)}")
        return SCHEMAS[table]

    def reader(self, schema) -> DataSourceReader:
        kind = PruningReader if self.options.get("pushdown") == "true" else EvidenceReader
        return kind(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EvidenceSource)
    try:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    except Exception:  # a session that does not let us; readers then take all rows
        pass


def load(spark: SparkSession, path: str, table: str, **options):
    """A table of the containers under path."""
    register(spark)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("evidence").option("table", table).option("pushdown", pushed)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)
