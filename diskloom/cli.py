"""Command line: python -m diskloom.cli info|parts|fs|ls|manifest|metadata|verify|serve|version IMAGE [partition] [path]."""

from __future__ import annotations

import sys

VERSION = "0.1.0"
SHOWN = 20


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("diskloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def info(path: str) -> None:
    from diskloom.sources.evidence import load

    spark = _session()
    load(spark, path, "media").show(SHOWN, False)
    load(spark, path, "headers").select("image_id", "ord", "case_number", "evidence_number", "examiner").show(SHOWN, False)
    load(spark, path, "schemes").show(SHOWN, False)


def parts(path: str) -> None:
    from pyspark.sql import functions as F

    from diskloom.functions.binary import human_size
    from diskloom.sources.evidence import load

    load(_session(), path, "partitions").withColumn("shown_size", human_size(F.col("size_bytes"))).show(128, False)


def fs(path: str) -> None:
    from diskloom.sources.evidence import load

    load(_session(), path, "volumes").show(128, False)


def ls(path: str, part: str = "0", folder: str = "/") -> None:
    from pyspark.sql import functions as F

    from diskloom.operators import files as ops

    listed = ops.list_dir(ops.files(ops.nodes(_session(), path, int(part))), folder).select(F.when(F.col("is_dir"), "dir").otherwise("file").alias("kind"), "name", "size", "mod_time_s")
    count = listed.count()
    listed.orderBy("name").show(SHOWN, False)
    if count > SHOWN:
        print(f"... and {count - SHOWN} more")


def manifest(path: str) -> None:
    from diskloom.operators import files as ops

    found = ops.files(ops.nodes(_session(), path), with_extents=True)
    for r in ops.manifest(found).orderBy("path").toLocalIterator():
        print(f"{r['md5']}  {r['path']}")


def metadata(path: str) -> None:
    from diskloom.sources.evidence import load

    spark = _session()
    load(spark, path, "media").join(load(spark, path, "stored_hashes"), "image_id").show(SHOWN, False)


def verify(path: str) -> None:
    from diskloom.operators.media import image_hashes

    rows = image_hashes(_session(), path).collect()
    for r in rows:
        print(f"{r['image_id']}: md5 {r['md5_match']}, sha1 {r['sha1_match']}, {r['bytes_hashed']} bytes{', ' + r['error'] if r['error'] else ''}")
    if any(r["md5_match"] is False or r["sha1_match"] is False or r["error"] for r in rows):
        sys.exit(1)


def serve(path: str, address: str = "127.0.0.1:10809", part: str | None = None) -> None:
    from diskloom.container.reader import Image
    from diskloom.serving.handle import image_stream, partition_stream
    from diskloom.serving.nbd import Server

    image = Image.open(path)
    stream = image_stream(image) if part is None else partition_stream(image, int(part))
    host, _, port = address.rpartition(":")
    server = Server(stream, "disk", (host, int(port)) if port.isdigit() else address).start()
    print(f"serving {stream.size} bytes at {server.address}", flush=True)
    server.thread.join()


COMMANDS = {f.__name__: f for f in (info, parts, fs, ls, manifest, metadata, verify, serve)}


def main(args: list[str]) -> int:
    if args[:1] in (["version"], ["-version"], ["--version"]):
        print(VERSION)
        return 0
    if len(args) < 2 or args[0] not in COMMANDS:
        print(__doc__, file=sys.stderr)
        return 2
    from diskloom.errors import EvidenceError

    try:
        COMMANDS[args[0]](*args[1:])
    except (EvidenceError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
