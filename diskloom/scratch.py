"""Scratch tables and images in the folder that the cluster names, small batches of texts, and shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Rows that travel to a Python worker at once where each row holds a whole text.
TEXT_ROWS = 1024
_own: dict[str, str] = {}
_shipped: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset a local session gets a temporary folder; on a cluster it is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="diskloom-"))


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone; the cluster cleans its folder
        pass


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{scratch_dir(spark)}/diskloom/{tag}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df in the shared folder and read it back: lineage is cut, and lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local(path: str) -> str:
    """A mounted path for plain file access. Images are read by offset, so their store must be mounted on executors."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"images must lie in a mounted folder, not at {path}")
    return path


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small in this session: their buffers lie outside the heap and in the workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="diskloom-ship-"), "diskloom.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("diskloom", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(out)
