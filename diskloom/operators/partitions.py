"""Partition tables as DataFrames: native decoding of the first sectors of each image (table `heads`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diskloom.fs.detect import detect_column
from diskloom.functions.binary import be, c_string, u8, u16le, u32le, u64le, utf16_name
from diskloom.partition.tables import APFS_GUID, BSD_MAGIC, EFI_GUID, GUESSES, MAX_ENTRIES, NAMES


def type_name(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code.cast("int")), F.format_string("Type 0x%02X", code.cast("int")))


def guess(code: Column) -> Column:
    out = F.lit("Unknown")
    for name, codes in GUESSES.items():
        out = F.when(code.isin(list(codes)), name).otherwise(out)
    return out


def mbr_entries(heads: DataFrame) -> DataFrame:
    """The four primary entries of each image; the boot signature is not asked for."""
    b = F.col("head")
    entry = lambda k: F.struct(F.lit(k).alias("slot"), u8(b, 446 + 16 * k).alias("boot_flag"), u8(b, 450 + 16 * k).alias("type_code"), u32le(b, 454 + 16 * k).alias("start_lba"), u32le(b, 458 + 16 * k).alias("sectors"))
    e = heads.where(F.octet_length(b) >= 512).select("image_id", F.explode(F.array(*[entry(k) for k in range(4)])).alias("e")).select("image_id", "e.*")
    return e.withColumn("type_name", type_name(F.col("type_code")))


def gpt_header(heads: DataFrame) -> DataFrame:
    at = F.col("sector_bytes")
    h = heads.withColumn("h", F.substring(F.col("head"), at + 1, F.lit(512))).where(F.substring("h", 1, 8) == F.lit(bytearray(b"EFI PART")))
    b = F.col("h")
    table, size = u64le(b, 72).cast("long"), u32le(b, 84)
    return h.select("image_id", "sector_bytes", "head", u32le(b, 8).alias("version"), u64le(b, 40).cast("long").alias("first_lba"), u64le(b, 48).cast("long").alias("last_lba"), F.when(table < 2, 2).otherwise(table).alias("table_lba"), u32le(b, 80).alias("number"), F.when(size == 0, 128).otherwise(size).alias("entry_bytes"))


def gpt_entries(heads: DataFrame) -> DataFrame:
    """Used entries of tables that lie within the head, as those of up to MAX_ENTRIES entries do; a larger table fails the query. Start 0 and all ones are unused."""
    h = gpt_header(heads).withColumn("number", F.when(F.col("number") <= MAX_ENTRIES, F.col("number")).otherwise(F.raise_error(F.lit("a partition table has more entries than its head holds; read the table partitions")).cast("long"))).where((F.col("number") > 0) & (F.col("entry_bytes") >= 80))
    e = h.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("number") - 1)))
    e = e.withColumn("e", F.substring(F.col("head"), (F.col("table_lba") * F.col("sector_bytes") + F.col("slot") * F.col("entry_bytes") + 1).cast("int"), F.col("entry_bytes").cast("int")))
    b = F.col("e")
    first, last = u64le(b, 32), u64le(b, 40)
    used = e.where((first > 0) & (first < F.lit(str(2**64 - 1)).cast("decimal(20,0)")))
    return used.select("image_id", F.col("slot").cast("int").alias("slot"), F.substring(b, 1, 16).alias("type_guid"), F.substring(b, 17, 16).alias("guid"), first.cast("long").alias("start_lba"), last.cast("long").alias("end_lba"), (last - first + 1).cast("long").alias("sectors"), utf16_name(F.substring(b, 57, 72)).alias("name"))


def apm_entries(heads: DataFrame) -> DataFrame:
    """Entries of an Apple partition map: up to the first sector that is none of the map's."""
    e = heads.select("image_id", "head", F.explode(F.sequence(F.lit(1), F.lit(63))).alias("k")).withColumn("e", F.substring(F.col("head"), F.col("k") * 512 + 1, F.lit(512)))
    b = F.col("e")
    found = e.where((F.substring(b, 1, 2) == F.lit(bytearray(b"PM"))) & (F.col("k") <= be(b, 4, 4)))
    return found.select("image_id", (F.col("k") - 1).alias("slot"), be(b, 8, 4).alias("start_lba"), be(b, 12, 4).alias("sectors"), c_string(F.substring(b, 17, 32)).alias("name"), c_string(F.substring(b, 49, 32)).alias("type"))


def bsd_entries(heads: DataFrame) -> DataFrame:
    b = F.col("head")
    ok = heads.where((u32le(b, 512) == BSD_MAGIC) & (u32le(b, 512 + 132) == BSD_MAGIC))
    e = ok.select("image_id", "head", F.explode(F.sequence(F.lit(0).cast("long"), F.least(u16le(b, 512 + 138), F.lit(16)) - 1)).alias("slot")).withColumn("e", F.substring(F.col("head"), (F.col("slot") * 16 + 512 + 148 + 1).cast("int"), F.lit(16)))
    return e.where(u32le(F.col("e"), 0) > 0).select("image_id", F.col("slot").cast("int").alias("slot"), u32le(F.col("e"), 4).alias("start_lba"), u32le(F.col("e"), 0).alias("sectors"), u8(F.col("e"), 12).alias("type_code"))


def lvm2_labels(heads: DataFrame) -> DataFrame:
    e = heads.select("image_id", "head", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("sector")).withColumn("e", F.substring(F.col("head"), F.col("sector") * 512 + 1, F.lit(512)))
    b = F.col("e")
    return e.where((F.substring(b, 1, 8) == F.lit(bytearray(b"LABELONE"))) & (F.substring(b, 25, 8) == F.lit(bytearray(b"LVM2 001")))).select("image_id", "sector", c_string(F.substring(b, u32le(b, 20).cast("int") + 1, F.lit(32))).alias("uuid"))


def detected(probes: DataFrame) -> DataFrame:
    """File systems by signature, from the first sectors of each partition (table `probes`)."""
    return probes.select("image_id", "idx", detect_column(F.col("window")).alias("filesystem"))


def scan(heads: DataFrame, probes: DataFrame) -> DataFrame:
    """Partitions of images with a GPT or MBR, from native decoding: GPT where it is announced and has entries, else MBR."""
    from pyspark.sql import Window

    mbr = mbr_entries(heads)
    announced = mbr.where((F.col("type_code") == 0xEE) | ((F.col("type_code") == 0x9C) & (F.col("sectors") > 2_000_000))).select("image_id").distinct()
    gpt = gpt_entries(heads).join(announced, "image_id", "left_semi").select("image_id", "slot", F.col("start_lba").alias("start_sector"), F.col("sectors").alias("size_sectors"), F.lit("GPT").alias("type"), F.lit(0xEE).cast("long").alias("type_code"), F.lit("GPT").alias("type_name"), F.when(F.col("type_guid") == F.lit(bytearray(EFI_GUID)), "EFI").when(F.col("type_guid") == F.lit(bytearray(APFS_GUID)), "APFS").otherwise("Unknown").alias("fallback"))
    primary = mbr.where((F.col("sectors") > 0) & (F.col("type_code") != 0)).join(gpt.select("image_id").distinct(), "image_id", "left_anti").select("image_id", "slot", F.col("start_lba").alias("start_sector"), F.col("sectors").alias("size_sectors"), F.format_string("0x%02X", F.col("type_code")).alias("type"), "type_code", "type_name", guess(F.col("type_code")).alias("fallback"))
    both = gpt.unionByName(primary)
    both = both.withColumn("idx", F.row_number().over(Window.partitionBy("image_id").orderBy("slot")) - 1)
    found = both.join(detected(probes).withColumnRenamed("filesystem", "seen"), ["image_id", "idx"], "left")
    return found.select("image_id", "idx", "start_sector", "size_sectors", "type", F.col("type_code").cast("short").alias("type_code"), "type_name", F.when(F.col("seen").isNull() | (F.col("seen") == "Unknown"), F.col("fallback")).otherwise(F.col("seen")).alias("filesystem"))
