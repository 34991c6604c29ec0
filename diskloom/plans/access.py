"""Registered queries over partition schemes, detection-only file systems, links of APFS, handles and servers."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diskloom.build.apfs import build_apfs
from diskloom.build.disk import gpt_disk, mbr_disk
from diskloom.build.tree import File
from diskloom.functions import binary
from diskloom.operators import files as ops
from diskloom.operators import partitions, serving
from diskloom.operators.media import in_order
from diskloom.partition.tables import APFS_GUID, BSD_MAGIC, EFI_GUID, LINUX_GUID
from diskloom.plans.evidence import images_of, raw_disks, shard_number, shards_of, table, volumes
from diskloom.plans.queries import BUILDERS, _bytes, _path_sql, _sectors, _shards, query
from diskloom.sources.evidence import load


def _nations(spark: SparkSession, sf_dir: str, per: int = 1) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.floor(F.col("n_nationkey") / per).alias("disk"))


# containers


def _probe(rows: pd.DataFrame) -> bytes:
    return b"nation" * 100


@query("SELECT n_nationkey AS disk, n_nationkey % 3 <> 0 AS is_container FROM nation")
def container_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a container's name, every third of them damaged in its signature."""
    folder = images_of(spark, _nations(spark, sf_dir), "disk", _probe, "probe")

    def damage(rows: pd.DataFrame) -> pd.DataFrame:
        for path in rows["path"]:
            with open(path, "r+b") as f:
                f.write(b"DAMAGED")
        return rows

    found = load(spark, folder, "containers")
    hit = found.where(shard_number() % 3 == 0).select(F.col("image_id").alias("path"), shard_number().alias("disk"))
    hit.groupBy("disk").applyInPandas(lambda rows: damage(rows[["path"]]), "path string").write.format("noop").mode("overwrite").save()
    return load(spark, folder, "containers").select(shard_number().cast("long").alias("disk"), "is_container")


# partition schemes


def _apm(rows: pd.DataFrame) -> bytes:
    """One map a disk: an entry for the map and one for each nation, one after another."""
    rows = rows.sort_values("n_nationkey")
    entries = [("Apple", "Apple_partition_map", 1, 63), *((r.n_name, "Apple_HFS", 64 + 10 * k, 10 + r.n_nationkey) for k, r in enumerate(rows.itertuples()))]
    disk = bytearray(512 * 200)
    for k, (name, kind, start, size) in enumerate(entries, 1):
        disk[512 * k : 512 * k + 16] = struct.pack(">2sHIII", b"PM", 0, len(entries), start, size)
        disk[512 * k + 16 : 512 * k + 16 + len(name)] = name.encode()
        disk[512 * k + 48 : 512 * k + 48 + len(kind)] = kind.encode()
    return bytes(disk)


@query("SELECT n_nationkey // 4 AS disk, (1 + n_nationkey % 4)::INT AS slot, 64 + 10 * (n_nationkey % 4) AS start_lba, 10 + n_nationkey AS sectors, n_name AS name, 'Apple_HFS' AS type FROM nation UNION ALL SELECT DISTINCT n_nationkey // 4, 0, 1, 63, 'Apple', 'Apple_partition_map' FROM nation")
def apm_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in Apple maps, decoded by column expressions."""
    heads = load(spark, images_of(spark, _nations(spark, sf_dir, 4), "disk", _apm, "apm"), "heads")
    return partitions.apm_entries(heads).select(shard_number().cast("long").alias("disk"), "slot", "start_lba", "sectors", "name", "type")


def _bsd(rows: pd.DataFrame) -> bytes:
    rows = rows.sort_values("n_nationkey")
    disk = bytearray(512 * 80)
    struct.pack_into("<I", disk, 512, BSD_MAGIC)
    struct.pack_into("<IHH", disk, 512 + 132, BSD_MAGIC, 0, len(rows))
    for k, r in enumerate(rows.itertuples()):
        # a partition of no size is no partition
        struct.pack_into("<IIIBBH", disk, 512 + 148 + 16 * k, 100 * (r.n_nationkey % 5), 63 + k, 0, r.n_nationkey, 8, 0)
    return bytes(disk)


@query("SELECT n_nationkey // 4 AS disk, (n_nationkey % 4)::INT AS slot, 63 + n_nationkey % 4 AS start_lba, 100 * (n_nationkey % 5) AS sectors, n_nationkey AS type_code FROM nation WHERE n_nationkey % 5 > 0")
def bsd_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in BSD disklabels."""
    heads = load(spark, images_of(spark, _nations(spark, sf_dir, 4), "disk", _bsd, "bsd"), "heads")
    return partitions.bsd_entries(heads).select(shard_number().cast("long").alias("disk"), "slot", "start_lba", "sectors", F.col("type_code").cast("long").alias("type_code"))


def _lvm(rows: pd.DataFrame) -> bytes:
    k = int(rows["n_nationkey"].iloc[0])
    disk = bytearray(512 * 80)
    at = 512 * (k % 4)
    disk[at : at + 8], disk[at + 24 : at + 32] = b"LABELONE", b"LVM2 001"
    struct.pack_into("<I", disk, at + 20, 32)
    disk[at + 32 : at + 64] = f"uuid-of-nation-{k:017d}".encode()
    return bytes(disk)


@query("SELECT n_nationkey AS disk, (n_nationkey % 4)::INT AS sector, 'uuid-of-nation-' || lpad(n_nationkey::VARCHAR, 17, '0') AS uuid FROM nation")
def lvm2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of physical volumes in any of the first four sectors."""
    heads = load(spark, images_of(spark, _nations(spark, sf_dir), "disk", _lvm, "lvm"), "heads")
    return partitions.lvm2_labels(heads).select(shard_number().cast("long").alias("disk"), "sector", "uuid")


def _scheme(rows: pd.DataFrame) -> bytes:
    k = int(rows["n_nationkey"].iloc[0]) % 6
    return [lambda: _apm(rows), lambda: _bsd(rows), lambda: _lvm(rows), lambda: gpt_disk([(LINUX_GUID, "x", bytes(1024))]), lambda: mbr_disk([(0x83, bytes(1024))]), lambda: bytes(512 * 80)][k]()


@query("SELECT n_nationkey AS disk, CASE n_nationkey % 6 WHEN 0 THEN 'Apple Partition Map (APM)' WHEN 1 THEN 'BSD Disklabel' WHEN 2 THEN 'LVM2' WHEN 3 THEN 'GPT' WHEN 4 THEN 'MBR' ELSE 'Unknown' END AS scheme FROM nation")
def partition_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disks of every scheme, named."""
    folder = images_of(spark, _nations(spark, sf_dir), "disk", _scheme, "schemes")
    return load(spark, folder, "schemes").select(shard_number().cast("long").alias("disk"), "scheme")


_GUIDS = [("EFI", EFI_GUID), ("APFS", APFS_GUID), ("Unknown", LINUX_GUID), ("Unknown", bytes(range(16)))]


def _guids(rows: pd.DataFrame) -> bytes:
    rows = rows.sort_values("n_nationkey")
    return gpt_disk([(_GUIDS[r.n_nationkey % 4][1], r.n_name, b"\xaa" * 512 * (12 + r.n_nationkey)) for r in rows.itertuples()])


@query("SELECT n_nationkey // 5 AS disk, (n_nationkey % 5)::INT AS idx, n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN 'EFI' WHEN 1 THEN 'APFS' ELSE 'Unknown' END AS filesystem, 12 + n_nationkey AS size_sectors FROM nation")
def gpt_guid_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the type GUID names where the partition itself says nothing."""
    folder = images_of(spark, _nations(spark, sf_dir, 5), "disk", _guids, "guids")
    named = partitions.gpt_entries(load(spark, folder, "heads")).select("image_id", F.col("slot").alias("idx"), "name")
    return load(spark, folder, "partitions").join(named, ["image_id", "idx"]).select(shard_number().cast("long").alias("disk"), "idx", "name", "filesystem", "size_sectors")


# what superblocks say


def _superblock(rows: pd.DataFrame) -> bytes:
    """A superblock of a file system that is only recognised, with facts that are functions of the nation's number."""
    k = int(rows["n_nationkey"].iloc[0])
    v = bytearray(140 * 512)
    kind = k % 9
    if kind == 0:
        struct.pack_into(">2sH", v, 1024, b"H+", 4)
        struct.pack_into(">III", v, 1024 + 40, 4096, 1000 + k, 10 + k)
        struct.pack_into(">Q", v, 1024 + 104, 7000 + k)
    elif kind == 1:
        struct.pack_into("<4sIII", v, 0, b"hsqs", 50 + k, 1_600_000_000 + k, 131072)
    elif kind == 2:
        struct.pack_into("<IHH", v, 1024, 0xF2F52010, 1, k)
        struct.pack_into("<II", v, 1024 + 16, 12, 9)
        v[1024 + 108 : 1024 + 124] = bytes([k] * 16)
        struct.pack_into("<I", v, 1024 + 2180, 16 + k)
    elif kind == 3:
        v[3:7], v[0x28], v[0x29] = b"ReFS", 3, k
        struct.pack_into("<Q", v, 0x38, 9000 + k)
    elif kind == 4:
        struct.pack_into(">6sH32s", v, 0, b"LUKS\xba\xbe", 1, f"aes-{k}".encode())
    elif kind == 5:
        v[3:11] = b"-FVE-FS-"
        struct.pack_into("<H", v, 11, 512)
    elif kind == 6:
        v[0x84:0x88] = b"ZFS "
    elif kind == 7:
        v[16384 : 16384 + 4] = b"\xfc\x4e\x2b\xa9"
    else:
        v[0x8000:0x8004] = b"JFS1"
        struct.pack_into("<I", v, 0x8004, k)
        struct.pack_into("<I", v, 0x8010, 4096)
    return mbr_disk([(0x83, bytes(v))])


_facts_sql = """SELECT n_nationkey AS disk, CASE k WHEN 0 THEN 'HFS+' WHEN 1 THEN 'SquashFS' WHEN 2 THEN 'F2FS' WHEN 3 THEN 'ReFS' WHEN 4 THEN 'LUKS' WHEN 5 THEN 'BitLocker' WHEN 6 THEN 'ZFS' WHEN 7 THEN 'Unknown' ELSE 'JFS' END AS fs_type,
CASE k WHEN 0 THEN 'block_size=4096,free_blocks=' || (10 + n_nationkey) || ',total_blocks=' || (1000 + n_nationkey) || ',uuid=' || printf('%016x', 7000 + n_nationkey) || ',version=4'
WHEN 1 THEN 'block_size=131072,created=' || (1600000000 + n_nationkey) || ',inodes=' || (50 + n_nationkey)
WHEN 2 THEN 'block_size=4096,blocks_a_segment=512,features=' || printf('0x%08x', 16 + n_nationkey) || ',uuid=' || repeat(printf('%02x', n_nationkey), 16) || ',version=1.' || n_nationkey
WHEN 3 THEN 'serial=' || printf('%016x', 9000 + n_nationkey) || ',version=3.' || n_nationkey
WHEN 4 THEN 'cipher=aes-' || n_nationkey || ',version=1' WHEN 5 THEN 'sector_bytes=512' WHEN 6 THEN 'label=ZFS' WHEN 7 THEN 'raid=Linux MD'
ELSE 'block_size=4096,version=' || n_nationkey END AS facts,
'no reader for ' || CASE k WHEN 0 THEN 'HFS+' WHEN 1 THEN 'SquashFS' WHEN 2 THEN 'F2FS' WHEN 3 THEN 'ReFS' WHEN 4 THEN 'LUKS' WHEN 5 THEN 'BitLocker' WHEN 6 THEN 'ZFS' WHEN 7 THEN 'Unknown' ELSE 'JFS' END AS error
FROM (SELECT n_nationkey::BIGINT AS n_nationkey, n_nationkey % 9 AS k FROM nation)"""


@query(_facts_sql)
def detected_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superblocks of file systems without a reader: what they say, and the error that opening them gives."""
    v = load(spark, images_of(spark, _nations(spark, sf_dir), "disk", _superblock, "facts"), "volumes")
    pairs = F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return v.select(shard_number().cast("long").alias("disk"), "fs_type", F.array_join(pairs, ",").alias("facts"), "error")


_kinds = {"fat12": "FAT12", "fat16": "FAT16", "fat32": "FAT32", "exfat": "exFAT", "ntfs": "NTFS", "ext4": "ext4", "xfs": "XFS", "btrfs": "Btrfs", "apfs": "APFS"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _kinds.items()) + ") t(fs, fs_type)")
def volume_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type that a parser of the registry gives a volume of its family."""
    out = None
    for kind in _kinds:
        build, code = BUILDERS[kind]
        few = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.lit("x").alias("lang"), F.lit("y").alias("source"), F.col("n_name").alias("text"))
        v = serving.handle_facts(spark, volumes(spark, few, build, "types", code)).select(F.lit(kind).alias("fs"), "fs_type").distinct()
        out = v if out is None else out.unionByName(v)
    return out


_fat_sql = "SELECT bits, 512 AS sector_bytes, CASE bits WHEN 32 THEN 1 WHEN 16 THEN 8 ELSE 16 END AS sectors_a_cluster, 'FIXTURE' AS boot_label, CASE bits WHEN 32 THEN true ELSE false END AS has_root_cluster FROM (VALUES (12), (16), (32)) t(bits)"


@query(_fat_sql)
def fat_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the boot sectors of FAT volumes say."""
    few = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.lit("x").alias("lang"), F.lit("y").alias("source"), F.col("n_name").alias("text"))
    out = None
    for bits in (12, 16, 32):
        build, code = BUILDERS[f"fat{bits}"]
        v = load(spark, volumes(spark, few, build, "fat-facts", code), "volumes")
        row = v.select(F.lit(bits).alias("bits"), *[F.col("attrs")[c].cast("int").alias(c) for c in ("sector_bytes", "sectors_a_cluster")], F.col("attrs")["boot_label"].alias("boot_label"), (F.col("attrs")["root_cluster"].cast("int") >= 2).alias("has_root_cluster")).distinct()
        out = row if out is None else out.unionByName(row)
    return out


# links of APFS


def _by_field(path: str) -> bool:
    return int(path.rpartition("s")[2]) % 2 == 0


def _apfs_links(rows: pd.DataFrame) -> bytes:
    made = [File(f"l/s{r.s_suppkey}", link=f"../target/{r.s_name}") for r in rows.itertuples()]
    # the target of one in seven is empty: an error, not an empty link
    made = [f if int(f.path[3:]) % 7 else File(f.path, link="") for f in made]
    return mbr_disk([(0xAF, build_apfs(made, link_field=_by_field))])


@query("SELECT '/l/s' || s_suppkey AS path, CASE WHEN s_suppkey % 7 > 0 THEN '../target/' || s_name END AS target, s_suppkey % 7 = 0 AS broken FROM supplier")
def apfs_symlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets in the inode's field or in an attribute; a link without one carries an error."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    rows = rows.withColumn("k", F.pmod("s_suppkey", F.lit(max(4, rows.count() // 2000))))
    found = ops.files(ops.nodes(spark, images_of(spark, rows, "k", _apfs_links, "apfs-links")))
    return found.where(F.col("mode").bitwiseAND(0xF000) == 0xA000).select("path", F.col("symlink_target").alias("target"), F.col("error").isNotNull().alias("broken"))


# names


@query("SELECT c_custkey, c_custkey % 3 = 0 AS plausible FROM customer")
def printable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a slash or a control character are not plausible."""
    name = F.concat(F.lit("file"), F.when(F.col("c_custkey") % 3 == 0, "é ok.txt").when(F.col("c_custkey") % 3 == 1, "a/b").otherwise("x\x07y"))
    return table(spark, sf_dir, "customer").select("c_custkey", binary.printable(name).alias("plausible"))


# handles and servers


def _lazy(kind: str):
    sql = f"SELECT {_path_sql} AS path, {_bytes} AS size, md5(encode(text)[101:300]) AS md5, true AS ends FROM documents WHERE text IS NOT NULL"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        build, code = BUILDERS[kind]
        docs = table(spark, sf_dir, "documents")
        options = {"shards": max(4 * shards_of(docs), -(-docs.count() // 1500))} if kind == "fat12" else {}
        got = serving.lazy_slices(spark, volumes(spark, docs, build, f"{kind}-lazy", code, **options), 100, 200)
        return got.where("path like '%/doc_%'").select("path", "size", F.md5("data").alias("md5"), "ends")

    run.__name__ = f"{kind}_lazy"
    run.__doc__ = f"Bytes 100 to 299 of each file of {kind} volumes through lazy streams, and reads at their ends."
    return query(sql)(run)


for _kind in _kinds:
    _lazy(_kind)


@query(f"SELECT doc_id, md5(text) AS md5 FROM documents WHERE text IS NOT NULL")
def block_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document read from its image through a network block device."""
    _, plan = raw_disks(spark, table(spark, sf_dir, "documents"), "served")
    asked = in_order(plan, ["image_id", "lba"]).select("image_id", "doc_id", (F.col("lba") * 512).alias("offset"), F.col("bytes").alias("length"))
    return serving.served_slices(asked).select("doc_id", F.md5("data").alias("md5"))


@query(f"SELECT shard, 'case-' || shard AS case_number, 'examiner' AS examiner, true AS md5_match, true AS sha1_match, 'ext4' AS fs_type, 'FIXTURE' AS label FROM (SELECT DISTINCT doc_id % {_shards} AS shard FROM documents WHERE text IS NOT NULL)")
def handle_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and verification through a handle on a volume."""
    build, code = BUILDERS["ext4"]
    got = serving.handle_facts(spark, volumes(spark, table(spark, sf_dir, "documents"), build, "handles", code))
    return got.select(shard_number().cast("long").alias("shard"), F.col("metadata")["case_number"].alias("case_number"), F.col("metadata")["examiner"].alias("examiner"), "md5_match", "sha1_match", "fs_type", "label")


@query(f"SELECT shard, 'md5 True, sha1 True, ' || (sectors * 512) || ' bytes' AS said FROM ({_sectors})")
def command_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line's verify prints: a line for each image."""
    import contextlib
    import io

    from diskloom import cli

    folder, _ = raw_disks(spark, table(spark, sf_dir, "documents"), "command")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        code = cli.main(["verify", folder])
    lines = [(int(line.partition(".E01: ")[0][-5:]), line.partition(".E01: ")[2]) for line in out.getvalue().splitlines()]
    return spark.createDataFrame(lines if code == 0 else [], "shard long, said string")
