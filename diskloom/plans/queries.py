"""The registered queries over evidence built from the tables, and the same answers in SQL over the tables themselves."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diskloom.build.apfs import build_apfs, lzvn_pack
from diskloom.build.btrfs import build_btrfs
from diskloom.build.disk import gpt_disk, mbr_disk
from diskloom.build.ext4 import build_ext4
from diskloom.build.fat import build_exfat, fat_parts
from diskloom.build.ntfs import build_ntfs
from diskloom.build.tree import File
from diskloom.build.xfs import build_xfs
from diskloom.functions import binary
from diskloom.operators import files as ops
from diskloom.operators import media, partitions
from diskloom.partition.tables import LINUX_GUID
from diskloom.plans.evidence import BASE_TIME, IMAGE_BYTES, images_of, raw_disks, raw_variants, shard_number, shards_of, table, volumes
from diskloom.scratch import materialize, text_batches
from diskloom.sources.evidence import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_bytes = "octet_length(encode(text))"
#: How many images the documents are dealt over, as plans.evidence.shards_of has it.
_shards = f"(SELECT greatest(4, ceil(sum(octet_length(encode(text))) / {IMAGE_BYTES}.0))::BIGINT FROM documents)"

# container


@query(f"SELECT doc_id, {_bytes} AS bytes, md5(text) AS md5 FROM documents WHERE text IS NOT NULL")
def sector_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document read back from its sectors."""
    _, plan = raw_disks(spark, table(spark, sf_dir, "documents"), "sectors")
    got = media.read_ranges(media.in_order(plan, ["image_id", "lba"]))
    return got.select("doc_id", "bytes", F.md5(F.expr("substring(data, 1, cast(bytes as int))")).alias("md5"))


VARIANTS = [
    ("encase1-zlib", {"layout": "encase1"}), ("encase1-raw", {"layout": "encase1", "compress": False}), ("encase25-zlib", {}), ("encase25-raw", {"compress": False}),
    ("encase25-zlib-slack", {"slack": 512}), ("encase25-sections2", {"groups": 2}), ("encase6-zlib", {"layout": "encase6"}), ("encase6-sections2", {"layout": "encase6", "groups": 2}),
    ("encase25-segments2", {"segments": 2}), ("encase25-short-final", {"short_final": True, "compress": False}),
]


@query("SELECT v.variant, count(*) AS docs, sum(" + _bytes + ") AS bytes, sum(hash_low)::BIGINT AS mark FROM (SELECT *, ('0x' || substr(md5(text), 1, 8))::BIGINT AS hash_low FROM documents WHERE text IS NOT NULL) CROSS JOIN (VALUES " + ", ".join(f"('{v}')" for v, _ in VARIANTS) + ") v(variant) GROUP BY v.variant")
def container_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents through every layout of the container. Their texts are dealt out once for all layouts."""
    _, plan = raw_variants(spark, table(spark, sf_dir, "documents"), "matrix", VARIANTS)
    total = plan.agg(F.sum("bytes")).first()[0] or 0
    got = media.read_ranges(media.in_order(plan.select("variant", "image_id", "lba", "n", "bytes"), ["image_id", "lba"], total))
    mark = F.conv(F.substring(F.md5(F.expr("substring(data, 1, cast(bytes as int))")), 1, 8), 16, 10).cast("long")
    return got.groupBy("variant").agg(F.count("*").alias("docs"), F.sum("bytes").alias("bytes"), F.sum(mark).alias("mark"))


_sectors = f"SELECT doc_id % {_shards} AS shard, sum(greatest(1, ceil({_bytes} / 512.0)))::BIGINT AS sectors FROM documents WHERE text IS NOT NULL GROUP BY 1"


@query(f"SELECT shard, true AS md5_match, true AS sha1_match, sectors * 512 AS bytes_hashed FROM ({_sectors})")
def image_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = raw_disks(spark, table(spark, sf_dir, "documents"), "verify")
    return media.image_hashes(spark, folder).select(shard_number().alias("shard"), "md5_match", "sha1_match", "bytes_hashed")


@query(f"SELECT shard, 'case-' || shard AS case_number, 'item-' || shard AS evidence_number, 'examiner' AS examiner, sectors AS sector_count, 512 AS sector_bytes, 64 AS chunk_sectors, ceil(sectors / 64.0)::BIGINT AS chunk_count FROM ({_sectors})")
def image_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = raw_disks(spark, table(spark, sf_dir, "documents"), "meta")
    heads = load(spark, folder, "headers").where("ord = 0")
    m = load(spark, folder, "media")
    return heads.join(m, "image_id").select(shard_number().alias("shard"), "case_number", "evidence_number", "examiner", "sector_count", F.col("sector_bytes").cast("int").alias("sector_bytes"), F.col("chunk_sectors").cast("int").alias("chunk_sectors"), "chunk_count")


@query(f"SELECT shard, ceil(sectors / 64.0)::BIGINT AS chunks, ceil(sectors / 64.0)::BIGINT AS compressed, ceil(sectors / 64.0)::BIGINT * 64 AS lba_end, CASE WHEN sectors % 64 = 0 THEN 32768 ELSE sectors % 64 * 512 END AS last_valid_bytes FROM ({_sectors})")
def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = raw_disks(spark, table(spark, sf_dir, "documents"), "chunks")
    c = load(spark, folder, "chunks").groupBy(shard_number().alias("shard"))
    return c.agg(F.count("*").alias("chunks"), F.sum(F.col("compressed").cast("long")).alias("compressed"), F.max("lba_end").alias("lba_end"), F.max_by("valid_bytes", "chunk_no").cast("long").alias("last_valid_bytes"))


_places = f"SELECT doc_id, text, shard, n, sum(n) OVER (PARTITION BY shard ORDER BY doc_id) - n AS lba FROM (SELECT doc_id, text, doc_id % {_shards} AS shard, greatest(1, ceil({_bytes} / 512.0))::BIGINT AS n FROM documents WHERE text IS NOT NULL)"


@query(f"SELECT doc_id, md5(text) AS md5 FROM ({_places}) WHERE lba >= 100 AND lba + n <= 200")
def sector_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents within sectors 100 to 199 of each image: only the chunks under them are decoded."""
    folder, plan = raw_disks(spark, table(spark, sf_dir, "documents"), "range")
    got = media.sectors(spark, folder, 100, 200).groupBy("image_id").agg(F.min("lba_start").alias("first"), F.array_sort(F.collect_list(F.struct("chunk_no", "data"))).alias("c"))
    held = got.select("image_id", "first", F.aggregate("c", F.lit(b""), lambda s, x: F.concat(s, x["data"])).alias("data"))
    inside = plan.where((F.col("lba") >= 100) & (F.col("lba") + F.col("n") <= 200)).join(held, "image_id")
    return inside.select("doc_id", F.md5(F.expr("substring(data, cast((lba - first) * 512 + 1 as int), cast(bytes as int))")).alias("md5"))


@query(f"SELECT type, n * {_shards} AS n FROM (VALUES ('header2', 1), ('header', 1), ('volume', 1), ('disk', 1), ('sectors', 1), ('table', 1), ('table2', 1), ('data', 1), ('digest', 1), ('hash', 1), ('done', 1)) t(type, n)")
def section_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = raw_disks(spark, table(spark, sf_dir, "documents"), "chain")
    return load(spark, folder, "sections").groupBy("type").agg(F.count("*").alias("n"))


# partition tables

_CODES = [0x07, 0x83, 0x82, 0x0C, 0x01, 0x8E, 0xFD, 0xEF, 0x27, 0x99]
_code_sql = "CASE n_nationkey % 10 " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(_CODES)) + " END"
_name_sql = "CASE n_nationkey % 10 WHEN 0 THEN 'NTFS/HPFS' WHEN 1 THEN 'Linux' WHEN 2 THEN 'Linux Swap' WHEN 3 THEN 'FAT32 LBA' WHEN 4 THEN 'FAT12' WHEN 5 THEN 'Linux LVM' WHEN 6 THEN 'Linux RAID' WHEN 7 THEN 'EFI' WHEN 8 THEN 'Windows RE' ELSE 'Type 0x99' END"
_guess_sql = "CASE n_nationkey % 10 WHEN 0 THEN 'NTFS' WHEN 1 THEN 'Unknown' WHEN 2 THEN 'Swap' WHEN 3 THEN 'FAT32' WHEN 4 THEN 'FAT12' WHEN 5 THEN 'LVM' WHEN 6 THEN 'RAID' WHEN 7 THEN 'EFI' WHEN 8 THEN 'NTFS' ELSE 'Unknown' END"
_mbr_sql = f"""WITH p AS (SELECT n_nationkey // 4 AS disk, n_nationkey % 4 AS idx, 12 + n_nationkey % 5 AS size, {_code_sql} AS code, {_name_sql} AS type_name, {_guess_sql} AS filesystem FROM nation)
SELECT disk, idx, 63 + coalesce(sum(size) OVER (PARTITION BY disk ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_sector, size::BIGINT AS size_sectors, code, type_name, filesystem FROM p"""


def _mbr(rows: pd.DataFrame) -> bytes:
    return mbr_disk([(_CODES[k % 10], b"\xaa" * (512 * (12 + k % 5))) for k in sorted(rows["n_nationkey"])])


def _nation_disks(spark: SparkSession, sf_dir: str) -> str:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.floor(F.col("n_nationkey") / 4).alias("disk"))
    return images_of(spark, rows, "disk", _mbr, "mbr")


@query(_mbr_sql)
def mbr_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as partitions, four a disk, through the Python scan."""
    p = load(spark, _nation_disks(spark, sf_dir), "partitions")
    return p.select(shard_number().cast("long").alias("disk"), "idx", "start_sector", "size_sectors", F.col("type_code").cast("int").alias("code"), "type_name", "filesystem")


@query(_mbr_sql)
def mbr_partitions_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by column expressions over the first sectors."""
    folder = _nation_disks(spark, sf_dir)
    p = partitions.scan(load(spark, folder, "heads"), load(spark, folder, "probes"))
    return p.select(shard_number().cast("long").alias("disk"), "idx", "start_sector", "size_sectors", F.col("type_code").cast("int").alias("code"), "type_name", "filesystem")


def _gpt(rows: pd.DataFrame) -> bytes:
    rows = rows.sort_values("r_regionkey")
    return gpt_disk([(LINUX_GUID, r.r_name, bytes(512 * (2 + r.r_regionkey))) for r in rows.itertuples()])


@query("SELECT r_regionkey AS slot, r_name AS name, (40 + coalesce(sum(2 + r_regionkey) OVER (ORDER BY r_regionkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start_lba, (2 + r_regionkey)::BIGINT AS sectors, 'af3dc60f838472478e793d69d8477de4' AS type_guid FROM region")
def gpt_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name", F.lit(0).alias("disk"))
    heads = load(spark, images_of(spark, rows, "disk", _gpt, "gpt"), "heads")
    return partitions.gpt_entries(heads).select("slot", "name", "start_lba", "sectors", binary.guid_hex(F.col("type_guid")).alias("type_guid"))


@query("SELECT r_regionkey::INT AS idx, 'GPT' AS type, 238 AS code, (2 + r_regionkey)::BIGINT AS size_sectors FROM region")
def gpt_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name", F.lit(0).alias("disk"))
    p = load(spark, images_of(spark, rows, "disk", _gpt, "gpt"), "partitions")
    return p.select("idx", "type", F.col("type_code").cast("int").alias("code"), "size_sectors")


_SIGNATURES = [
    ("NTFS", 3, b"NTFS    "), ("FAT32", 0x52, b"FAT32   "), ("FAT16", 0x36, b"FAT16   "), ("FAT12", 0x36, b"FAT12   "), ("exFAT", 3, b"EXFAT   "), ("HFS+", 1024, b"H+\0\4"),
    ("APFS", 0x20, b"NXSB"), ("ext4", 1080, b"\x53\xef"), ("XFS", 0, b"XFSB\0\0\x10\0"), ("SquashFS", 0, b"hsqs"), ("F2FS", 1024, b"\x10\x20\xf5\xf2"), ("Btrfs", 0x10040, b"_BHRfS_M"),
    ("ReFS", 3, b"ReFS"), ("LUKS", 0, b"LUKS\xba\xbe"), ("ZFS", 0x84, b"ZFS "), ("JFS", 0x8000, b"JFS1"), ("BitLocker", 3, b"-FVE-FS-"), ("Unknown", 0, b"nothing"),
]


def _signed(rows: pd.DataFrame) -> bytes:
    k = int(rows["k"].iloc[0])
    volume = bytearray(140 * 512)
    _, at, magic = _SIGNATURES[k]
    volume[at : at + len(magic)] = magic
    return mbr_disk([(0x83, bytes(volume))])


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, '{name}', '{name}')" for k, (name, _, _) in enumerate(_SIGNATURES)) + ") t(k, filesystem, native)")
def fs_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small volume for each signature: the scan's answer and the native one."""
    folder = images_of(spark, spark.range(len(_SIGNATURES)).select(F.col("id").alias("k")), "k", _signed, "signatures")
    scanned = load(spark, folder, "partitions").select("image_id", "idx", "filesystem")
    native = partitions.detected(load(spark, folder, "probes")).withColumnRenamed("filesystem", "native")
    return scanned.join(native, ["image_id", "idx"]).select(shard_number().alias("k"), "filesystem", "native")


# file systems

BUILDERS: dict[str, tuple[Callable[[list[File]], bytes | list[bytes]], int]] = {
    "fat12": (partial(fat_parts, bits=12, per=16), 0x01),
    "fat16": (partial(fat_parts, bits=16, per=8), 0x06),
    "fat32": (partial(fat_parts, bits=32, scatter=True), 0x0C),
    "exfat": (build_exfat, 0x07),
    "ntfs": (partial(build_ntfs, fragment=True), 0x07),
    "ext4": (build_ext4, 0x83),
    "xfs": (build_xfs, 0x83),
    "btrfs": (build_btrfs, 0x83),
    "apfs": (build_apfs, 0xAF),
}
_path_sql = "'/' || lang || '/' || source || '/doc_' || doc_id || '.txt'"


def _found(spark: SparkSession, sf_dir: str, kind: str, docs: DataFrame | None = None, **options) -> DataFrame:
    build, code = BUILDERS[kind]
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    if kind == "fat12":
        # 4,084 clusters of 8 KiB are all that such a volume has
        options["shards"] = max(4 * shards_of(docs), -(-docs.count() // 1500))
    return ops.nodes(spark, volumes(spark, docs, build, kind, code, **options))


def _list(kind: str, has_time: bool):
    sql = f"SELECT {_path_sql} AS path, '/' || lang || '/' || source AS parent_path, 'doc_' || doc_id || '.txt' AS name, {_bytes} AS size, {f'{BASE_TIME} + 2 * doc_id' if has_time else '0::BIGINT'} AS mod_time_s FROM documents WHERE text IS NOT NULL"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        listed = ops.regular(ops.files(_found(spark, sf_dir, kind)))
        quiet = F.lit(0).cast("long") if not has_time else F.col("mod_time_s")
        return listed.where("name not like '$%'").select("path", "parent_path", "name", "size", quiet.alias("mod_time_s"))

    run.__name__ = f"{kind}_list"
    run.__doc__ = f"Documents as files of {kind} volumes: paths, sizes and the times that listings carry."
    return query(sql)(run)


def register_lists() -> None:
    from diskloom.fs.registry import PARSERS

    names = {"fat12": "FAT12", "fat16": "FAT16", "fat32": "FAT32", "exfat": "exFAT", "ntfs": "NTFS", "ext4": "ext4", "xfs": "XFS", "btrfs": "Btrfs", "apfs": "APFS"}
    for kind in BUILDERS:
        if f"{kind}_list" not in QUERIES:
            _list(kind, PARSERS[names[kind]].list_times)
            _content(kind)


def _content(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        listed = ops.files(_found(spark, sf_dir, kind), with_extents=True).where("name not like '$%'")
        return ops.content(listed).select("path", F.octet_length("data").cast("long").alias("bytes"), F.md5("data").alias("md5"))

    run.__name__ = f"{kind}_content"
    run.__doc__ = f"Whole files of {kind} volumes."
    return query(f"SELECT {_path_sql} AS path, {_bytes} AS bytes, md5(text) AS md5 FROM documents WHERE text IS NOT NULL")(run)


@query(f"SELECT {_path_sql} AS path, {_bytes} AS size, md5(text) AS md5 FROM documents WHERE text IS NOT NULL")
def file_md5_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every file's MD5, streamed from its extents."""
    return ops.manifest(ops.files(_found(spark, sf_dir, "ext4"), with_extents=True)).select("path", "size", "md5")


@query(f"SELECT {_path_sql} AS path, md5(encode(text)[101:300]) AS md5 FROM documents WHERE text IS NOT NULL")
def file_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes 100 to 299 of each file."""
    listed = ops.files(_found(spark, sf_dir, "ext4"), with_extents=True)
    return ops.file_ranges(listed, F.lit(100), F.lit(200)).select("path", F.md5("data").alias("md5"))


@query(f"SELECT path, block_no, md5(encode(text)[block_no * 4096 + 1 : block_no * 4096 + 4096]) AS md5 FROM (SELECT {_path_sql} AS path, text, unnest(range(0, ({_bytes} + 4095) // 4096)) AS block_no FROM documents WHERE text IS NOT NULL)")
def file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in blocks of 4 KiB, as files of any size are read."""
    listed = ops.files(_found(spark, sf_dir, "fat32"), with_extents=True)
    return ops.blocks(listed, 4096).where(F.octet_length("data") > 0).select("path", "block_no", F.md5("data").alias("md5"))


@query(f"SELECT doc_id, {_bytes} AS size, md5(text) AS md5 FROM documents WHERE text IS NOT NULL")
def open_by_handle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content by file id alone: paths serve only to name the result."""
    found = _found(spark, sf_dir, "ntfs")
    wanted = found.select("image_id", "part", "file_id", F.explode("names").alias("n")).withColumn("doc_id", F.regexp_extract("n.name", r"^doc_(\d+)\.txt$", 1)).where("doc_id <> ''").withColumn("doc_id", F.col("doc_id").try_cast("long")).select("image_id", "part", "file_id", "doc_id")
    opened = found.join(wanted, ["image_id", "part", "file_id"])
    return ops.content(opened).select("doc_id", "size", F.md5("data").alias("md5"))


@query(f"SELECT {_path_sql} AS path, {_bytes} AS size FROM documents WHERE text IS NOT NULL AND lang = 'de' AND {_bytes} > 2000 AND doc_id::VARCHAR LIKE '%7%'")
def search_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = ops.files(_found(spark, sf_dir, "ntfs"))
    return ops.search(listed, "\\de", (F.col("size") > 2000) & F.col("name").like("doc_%7%.txt") & ~ops.is_dir(F.col("mode"))).select("path", "size")


@query(f"SELECT 'doc_' || doc_id || '.txt' AS name, {_bytes} AS size, false AS is_dir FROM documents WHERE text IS NOT NULL AND lang = 'fr' AND source = 'src3'")
def list_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One directory, named with backslashes."""
    return ops.list_dir(ops.files(_found(spark, sf_dir, "exfat")), "fr\\src3").select("name", "size", "is_dir")


@query(f"SELECT {_path_sql} AS path, {_bytes} AS size, 33188 AS mode, {BASE_TIME} + 2 * doc_id AS mod_time_s FROM documents WHERE text IS NOT NULL")
def stat_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = ops.files(_found(spark, sf_dir, "ext4"))
    wanted = table(spark, sf_dir, "documents").where("text is not null").select(F.concat_ws("/", F.lit(""), "lang", "source", F.concat(F.lit("doc_"), "doc_id", F.lit(".txt"))).alias("path"))
    return listed.join(wanted, "path").select("path", "size", "mode", "mod_time_s")


@query(f"SELECT lang, source, count(*) AS files, sum({_bytes})::BIGINT AS bytes FROM documents WHERE text IS NOT NULL GROUP BY ROLLUP (lang, source)")
def usage_by_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = ops.regular(ops.files(_found(spark, sf_dir, "fat32")))
    parts = binary.split_path(F.col("path"))
    return listed.select(parts[0].alias("lang"), parts[1].alias("source"), "size").rollup("lang", "source").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(f"SELECT {_path_sql} AS path, {_bytes} AS size FROM documents WHERE text IS NOT NULL ORDER BY size DESC, path LIMIT 20")
def largest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-20 report."""
    listed = ops.regular(ops.files(_found(spark, sf_dir, "exfat")))
    return listed.select("path", "size").orderBy(F.desc("size"), "path").limit(20)


@query(f"SELECT md5(text) AS md5, count(*) AS copies, min({_path_sql}) AS first_path, (count(*) - 1) * any_value({_bytes}) AS wasted FROM documents WHERE text IS NOT NULL GROUP BY md5(text) HAVING count(*) > 1")
def dup_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ops.manifest(ops.files(_found(spark, sf_dir, "ntfs"), with_extents=True)).where("path not like '/$%'")
    return m.groupBy("md5").agg(F.count("*").alias("copies"), F.min("path").alias("first_path"), ((F.count("*") - 1) * F.max("size")).alias("wasted")).where("copies > 1")


@query(f"SELECT doc_id, lag({BASE_TIME} + 2 * doc_id) OVER (PARTITION BY lang ORDER BY doc_id) AS previous, sum({_bytes}) OVER (PARTITION BY lang ORDER BY doc_id)::BIGINT AS running FROM documents WHERE text IS NOT NULL")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each top directory in order of their times, with a running total of bytes.

    Directories are few and large, so rows are range-partitioned by directory and time, numbered within a partition, and shifted by
    what the earlier partitions hold.
    """
    from pyspark.sql import Window

    listed = ops.regular(ops.files(_found(spark, sf_dir, "ntfs"))).where("name like 'doc_%'")
    rows = listed.select(binary.split_path(F.col("path"))[0].alias("top"), F.col("mod_time_s").alias("t"), "path", "size", F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("doc_id"))
    ranged = materialize(rows.repartitionByRange(media.tasks(spark), "top", "t", "path").withColumn("task", F.spark_partition_id()), "timeline")
    # a row for each directory and task
    earlier = Window.partitionBy("top").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    held = ranged.groupBy("top", "task").agg(F.sum("size").alias("bytes"), F.max("t").alias("latest"))
    held = held.select("top", "task", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("before"), F.last("latest").over(earlier).alias("last"))
    by = Window.partitionBy("top", "task").orderBy("t", "path")
    return ranged.join(F.broadcast(held), ["top", "task"]).select("doc_id", F.coalesce(F.lag("t").over(by), F.col("last")).alias("previous"), (F.col("before") + F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0))).alias("running"))


@query("SELECT 'ntfs' AS fs, 'FIXTURE' AS label, 4096::BIGINT AS block_size UNION ALL SELECT 'ext4', 'FIXTURE', 4096 UNION ALL SELECT 'fat32', 'FIXTURE', 512 UNION ALL SELECT 'exfat', 'FIXTURE', 1024 UNION ALL SELECT 'fat16', 'FIXTURE', 4096 UNION ALL SELECT 'xfs', 'FIXTURE', 4096 UNION ALL SELECT 'btrfs', 'FIXTURE', 4096 UNION ALL SELECT 'apfs', 'FIXTURE', 4096")
def volume_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = None
    for kind in ("ntfs", "ext4", "fat32", "exfat", "fat16", "xfs", "btrfs", "apfs"):
        build, code = BUILDERS[kind]
        v = load(spark, volumes(spark, docs, build, "labels", code), "volumes").select(F.lit(kind).alias("fs"), "label", "block_size").distinct()
        out = v if out is None else out.unionByName(v)
    return out


def _sparse(rows: pd.DataFrame) -> bytes:
    made = [File(f"sparse/f{r.c_custkey}.bin", parts=[(8192, b"x" * (1 + r.c_custkey % 4096)), (65536, b"tail")], size=65540) for r in rows.itertuples()]
    return mbr_disk([(0x83, build_ext4(made))])


@query("SELECT '/sparse/f' || c_custkey || '.bin' AS path, md5(repeat(chr(0), 8192) || repeat('x', (1 + c_custkey % 4096)::INT) || repeat(chr(0), (65536 - 8192 - 1 - c_custkey % 4096)::INT) || 'tail') AS md5 FROM customer")
def sparse_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes on the disk read as zeros."""
    rows = table(spark, sf_dir, "customer")
    rows = rows.select("c_custkey", F.pmod("c_custkey", F.lit(max(4, rows.count() // 2000))).alias("k"))
    found = ops.nodes(spark, images_of(spark, rows, "k", _sparse, "sparse"))
    return ops.manifest(ops.files(found, with_extents=True)).select("path", "md5")


def _links(rows: pd.DataFrame) -> bytes:
    return mbr_disk([(0x83, build_ext4([File(f"l/s{r.s_suppkey}", link=f"../target/{r.s_name}" * (1 + 4 * (r.s_suppkey % 2))) for r in rows.itertuples()]))])


@query("SELECT '/l/s' || s_suppkey AS path, repeat('../target/' || s_name, (1 + 4 * (s_suppkey % 2))::INT) AS target, length(repeat('../target/' || s_name, (1 + 4 * (s_suppkey % 2))::INT))::BIGINT AS size FROM supplier")
def symlink_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short links lie in the inode, long ones in a block; their content is the target."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    rows = rows.withColumn("k", F.pmod("s_suppkey", F.lit(max(4, rows.count() // 2000))))
    found = ops.nodes(spark, images_of(spark, rows, "k", _links, "links"))
    return ops.content(ops.files(found, with_extents=True)).select("path", F.decode("data", "UTF-8").alias("target"), "size")


_PACKED = [3, 4, 7, 8, 9, 10, 13, 14]


def _decmpfs(rows: pd.DataFrame) -> bytes:
    made = [File(f"p/d{r.doc_id}.txt", r.text.encode()) for r in rows.itertuples()]
    # an attribute holds little, so odd types take short texts only
    kinds = {f.path: k if k % 2 == 0 or len(f.data) <= 1500 else k + 1 for r, f in zip(rows.itertuples(), made, strict=True) for k in (_PACKED[r.doc_id // 4 % 8],)}
    return mbr_disk([(0xAF, build_apfs(made, packed=kinds))])


@query(f"SELECT '/p/d' || doc_id || '.txt' AS path, {_bytes} AS size, md5(text) AS md5 FROM documents WHERE text IS NOT NULL AND {_bytes} > 0")
def decmpfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed files of all kinds: zlib, LZVN and stored, in attributes and in resource streams."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.where("octet_length(text) > 0").select("doc_id", "text", F.pmod("doc_id", F.lit(shards_of(docs))).alias("k"))
    found = ops.nodes(spark, images_of(spark, rows, "k", _decmpfs, "decmpfs"))
    return ops.content(ops.files(found, with_extents=True)).select("path", "size", F.md5("data").alias("md5"))


@query(f"SELECT doc_id, {_bytes} AS bytes, md5(text) AS md5 FROM documents WHERE text IS NOT NULL")
def lzvn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts packed with LZVN and decoded again, as one Arrow function that holds few texts at a time."""
    from diskloom.fs.codecs import lzvn as unpack

    text_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 32):
                some = batch.slice(k, 32)
                sizes = some.column(1).to_pylist()
                back = [unpack(lzvn_pack(t), n) for t, n in zip(some.column(2).cast(pa.binary()).to_pylist(), sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(back, pa.binary())], names=["doc_id", "bytes", "data"])

    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, bytes long, data binary").select("doc_id", "bytes", F.md5("data").alias("md5"))


def _looped(rows: pd.DataFrame) -> bytes:
    made = [File(f"data/f{r.n_nationkey}", r.n_name.encode()) for r in rows.itertuples()]
    made += [File(f"links/l{r.n_nationkey}", link=f"../data/f{r.n_nationkey}" if r.n_nationkey % 2 else f"/hop/h{r.n_nationkey}") for r in rows.itertuples()]
    made += [File(f"hop/h{r.n_nationkey}", link=f"../data/./f{r.n_nationkey}") for r in rows.itertuples() if r.n_nationkey % 2 == 0]
    return mbr_disk([(0x83, build_xfs(made))])


@query("SELECT '/links/l' || n_nationkey AS link, '/data/f' || n_nationkey AS target, md5(n_name) AS md5 FROM nation")
def symlink_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to links, followed over the listing of a volume."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.lit(0).alias("k"))
    listed = ops.files(ops.nodes(spark, images_of(spark, rows, "k", _looped, "follow")), with_extents=True)
    followed = ops.follow(listed).where("link like '/links/%'")
    return ops.content(listed.join(followed, ["image_id", "part", "path"])).select("link", F.col("path").alias("target"), F.md5("data").alias("md5"))


@query("SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS ntfs, (epoch(o_orderdate)::BIGINT // 2) * 2 AS dos, epoch(o_orderdate)::BIGINT AS xfs, epoch(o_orderdate)::BIGINT AS apfs FROM orders")
def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On-disk times of four kinds and back to Unix seconds, in column expressions."""
    t = F.unix_timestamp("o_orderdate")
    d = F.col("o_orderdate")
    date = F.shiftleft(F.year(d) - 1980, 9).bitwiseOR(F.shiftleft(F.month(d), 5)).bitwiseOR(F.dayofmonth(d))
    time = F.shiftleft(F.hour(d), 11).bitwiseOR(F.shiftleft(F.minute(d), 5)).bitwiseOR(F.floor(F.second(d) / 2).cast("int"))
    big = "decimal(20,0)"
    return table(spark, sf_dir, "orders").select("o_orderkey", binary.filetime_seconds(((t + 11_644_473_600) * 10_000_000).cast(big)).alias("ntfs"), binary.dos_seconds(date, time).alias("dos"), binary.xfs_seconds((t + 2_147_483_648).cast(big) * F.lit(1_000_000_000).cast("decimal(10,0)"), True).alias("xfs"), binary.apfs_seconds((t * 1_000_000_000).cast(big)).alias("apfs"))


@query("SELECT c_custkey, CASE WHEN n >= 1099511627776 THEN printf('%.2f TB', n / 1099511627776.0) WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0) ELSE n || ' bytes' END AS size FROM (SELECT c_custkey, c_custkey * c_custkey * c_custkey * 1021 AS n FROM customer)")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the cubes of larger keys don't fit 64 bits
    key = F.col("c_custkey").cast("decimal(38,0)")
    n = key * key * key * F.lit(1021).cast("decimal(38,0)")
    return table(spark, sf_dir, "customer").select("c_custkey", binary.human_size(n).alias("size"))


register_lists()
from diskloom.plans import access  # noqa: E402, F401 its queries register themselves
