"""The interactive handles as Arrow functions: one task opens a volume, or serves an image, and reads through that."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diskloom.container.reader import Image
from diskloom.fs.registry import PARSERS
from diskloom.operators.media import spread
from diskloom.serving.handle import Opened, image_stream, partition_stream
from diskloom.serving.nbd import Client, Server
from diskloom.sources.evidence import load

ROWS = 256


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def lazy_slices(spark: SparkSession, path: str, offset: int, length: int) -> DataFrame:
    """(image_id, part, path, size, data, ends): a slice of every plain file through its lazy stream.

    ends: whether a read at the end is short, one past it empty and one before the start refused. Links and packed files, which can't be
    opened lazily, have no row. Made for many volumes of moderate size: one task indexes a volume.
    """
    schema = pa.schema([("image_id", pa.string()), ("part", pa.int32()), ("path", pa.string()), ("size", pa.int64()), ("data", pa.binary()), ("ends", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                opened, rows = Opened(Image.shared(image_id), part), []
                for name, node in opened.walk():
                    if node.is_dir or node.link is not None or node.codec or node.error:
                        continue
                    stream = opened.open(name)
                    stream.seek(max(0, stream.size - 3))
                    ends = stream.read(10) == stream.read_at(max(0, stream.size - 3), 3) and stream.read(1) == b"" == stream.read_at(stream.size + 5, 1)
                    try:
                        stream.read_at(-1, 1)
                        ends = False
                    except ValueError:
                        pass
                    rows.append((image_id, part, name, stream.size, stream.read_at(offset, length), ends))
                    if len(rows) == ROWS:
                        yield _out(rows, schema)
                        rows = []
                if rows:
                    yield _out(rows, schema)

    plan = load(spark, path, "volumes").where(F.col("fs_type").isin(list(PARSERS))).select("image_id", "part")
    return spread(plan, ["image_id", "part"]).mapInArrow(run, "image_id string, part int, path string, size long, data binary, ends boolean")


def served_slices(requests: DataFrame) -> DataFrame:
    """requests (image_id, offset, length and more columns, best sorted by image) with `data`, read through a network block device.

    Each task serves the image it reads on a local port and reads it as a client does.
    """
    names = requests.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = server = client = None

        def close() -> None:
            if client is not None:
                client.close()
                server.close()

        try:
            for whole in batches:
                for k in range(0, whole.num_rows, ROWS):
                    batch, out = whole.slice(k, ROWS), []
                    for image_id, offset, length in zip(*(batch.column(names.index(c)).to_pylist() for c in ("image_id", "offset", "length")), strict=True):
                        if image_id != now:
                            close()
                            server = Server(image_stream(Image.shared(image_id))).start()
                            client, now = Client(server.address), image_id
                        out.append(client.read(offset, length))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "data"])
        finally:
            close()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.mapInArrow(run, f"{kinds}, data binary")


def handle_facts(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, part, fs_type, label, block_size, metadata, md5_match, sha1_match, stream_bytes) through a handle on each volume."""
    ddl = "image_id string, part int, fs_type string, label string, block_size long, metadata map<string,string>, md5_match boolean, sha1_match boolean, stream_bytes long"
    schema = pa.schema([("image_id", pa.string()), ("part", pa.int32()), ("fs_type", pa.string()), ("label", pa.string()), ("block_size", pa.int64()), ("metadata", pa.map_(pa.string(), pa.string())), ("md5_match", pa.bool_()), ("sha1_match", pa.bool_()), ("stream_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with Image.open(image_id) as image:
                    opened = Opened(image, part)
                    row = (image_id, part, opened.fs.type, opened.fs.label(), opened.fs.block_size(), list(opened.metadata().items()), *opened.verify(), partition_stream(image, part).size)
                yield _out([row], schema)

    plan = load(spark, path, "volumes").where(F.col("fs_type").isin(list(PARSERS))).select("image_id", "part")
    return spread(plan, ["image_id", "part"]).mapInArrow(run, ddl)
