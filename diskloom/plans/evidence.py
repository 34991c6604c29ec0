"""Rows turned into evidence: documents as files of volumes in containers, written by executors into scratch space."""

from __future__ import annotations

import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diskloom.build.tree import File
from diskloom.container.writer import header_text, write
from diskloom.scratch import local, scratch_path

#: About so many bytes of text go into one image, so images stay small whatever the table's size.
IMAGE_BYTES = 4_000_000
BASE_TIME = 1_500_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shards_of(docs: DataFrame, least: int = 4) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, -(-total // IMAGE_BYTES))


def doc_path(lang: str, source: str, doc_id: int) -> str:
    return f"{lang}/{source}/doc_{doc_id}.txt"


def volumes(spark: SparkSession, docs: DataFrame, build: Callable[[list[File]], bytes | list[bytes]], tag: str, code: int = 0x83, shards: int | None = None, **options) -> str:
    """A folder of containers, one a shard of documents (doc_id modulo shards), each with one MBR partition."""
    from diskloom.build.disk import mbr_parts

    folder = local(scratch_path(spark, tag))
    n = shards or shards_of(docs)

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        os.makedirs(folder, exist_ok=True)
        rows = rows.sort_values("doc_id")
        made = [File(doc_path(r.lang, r.source, r.doc_id), r.text.encode(), BASE_TIME + 2 * r.doc_id) for r in rows.itertuples()]
        k = int(rows["shard"].iloc[0])
        volume = build(made)
        written = write(f"{folder}/case-{k:05d}.E01", mbr_parts([(code, volume if isinstance(volume, list) else [volume])]), header=header_text(f"case-{k}", f"item-{k}", "examiner"), **options)
        return pd.DataFrame({"path": written})

    some = docs.where("text is not null").select("doc_id", "lang", "source", "text", F.pmod("doc_id", F.lit(n)).alias("shard"))
    some.groupBy("shard").applyInPandas(make, "path string").write.mode("overwrite").parquet(f"{scratch_path(spark, tag)}-written")
    return folder


def raw_disks(spark: SparkSession, docs: DataFrame, tag: str, shards: int | None = None, **options) -> tuple[str, DataFrame]:
    """Documents laid out sector by sector; returns the folder and where each document lies (image_id, doc_id, lba, n, bytes)."""
    folder, plan = raw_variants(spark, docs, tag, [("", options)], shards)
    return folder, plan.drop("variant")


def raw_variants(spark: SparkSession, docs: DataFrame, tag: str, variants: list[tuple[str, dict]], shards: int | None = None) -> tuple[str, DataFrame]:
    """raw_disks for several (name, options) of the writer, each in a folder of its name; the texts are dealt out once. The plan has `variant`."""
    folder = local(scratch_path(spark, tag))
    n = shards or shards_of(docs)

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        disk, places = bytearray(), []
        k = int(rows["shard"].iloc[0])
        for r in rows.itertuples():
            data = r.text.encode()
            size = max(1, -(-len(data) // 512))
            places.append((k, int(r.doc_id), len(disk) // 512, size, len(data)))
            disk += data.ljust(size * 512, b"\0")
        out = []
        for name, options in variants:
            own = f"{folder}/{name}" if name else folder
            os.makedirs(own, exist_ok=True)
            path = f"{own}/case-{k:05d}.E01"
            write(path, disk, header=header_text(f"case-{k}", f"item-{k}", "examiner"), **options)
            out += [(name, path, *p) for p in places]
        return pd.DataFrame(out, columns=["variant", "image_id", "shard", "doc_id", "lba", "n", "bytes"])

    some = docs.where("text is not null").select("doc_id", "text", F.pmod("doc_id", F.lit(n)).alias("shard"))
    plan = f"{local(scratch_path(spark, tag))}-plan"
    schema = "variant string, image_id string, shard int, doc_id long, lba long, n long, bytes long"
    some.groupBy("shard").applyInPandas(make, schema).write.mode("overwrite").parquet(plan)
    return folder, spark.read.schema(schema).parquet(plan)


def images_of(spark: SparkSession, rows: DataFrame, key: str, make_disk: Callable[[pd.DataFrame], bytes], tag: str, **options) -> str:
    """A folder of containers, one for each value of an integer key."""
    folder = local(scratch_path(spark, tag))

    def make(part: pd.DataFrame) -> pd.DataFrame:
        os.makedirs(folder, exist_ok=True)
        k = int(part[key].iloc[0])
        return pd.DataFrame({"path": write(f"{folder}/case-{k:05d}.E01", make_disk(part), **options)})

    rows.groupBy(key).applyInPandas(make, "path string").write.mode("overwrite").parquet(f"{scratch_path(spark, tag)}-written")
    return folder


def shard_number(image_id: str = "image_id") -> F.Column:
    return F.regexp_extract(image_id, r"case-(\d+)\.", 1).cast("int")
