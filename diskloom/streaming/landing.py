"""New containers that land in a folder, as a stream of their partition tables and volumes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diskloom.container.reader import Image
from diskloom.errors import EvidenceError
from diskloom.partition.tables import partitions
from diskloom.scratch import local

SCHEMA = "image_id string, landed timestamp, size long, idx int, start_sector long, size_sectors long, type_name string, filesystem string, error string"


def landing(spark: SparkSession, folder: str, pattern: str = "*.E01", files_per_batch: int = 100) -> DataFrame:
    """A streaming DataFrame with a row for each partition of each container, as its first segment appears.

    The file source only names files (their bytes are not read by it): each is opened by the task that gets it. A container that
    can't be read gives one row that carries the error. Use a watermark on `landed` for windowed counts.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            rows: list[tuple] = []
            for path, landed, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = local(path)
                try:
                    with Image.open(name) as image:
                        rows += [(name, landed, size, p.index, p.start_sector, p.size_sectors, p.type_name, p.filesystem, None) for p in partitions(image)]
                except EvidenceError as e:
                    rows.append((name, landed, size, None, None, None, None, None, str(e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return found.select("path", F.col("modificationTime"), "length").mapInArrow(scan, SCHEMA)
