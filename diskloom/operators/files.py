"""Files of volumes: nodes, directory entries, paths, listing, search, stat, content, ranges and hashes."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diskloom.container.reader import Image
from diskloom.errors import EvidenceError
from diskloom.fs.codecs import decode as decode_codec
from diskloom.fs.registry import PARSERS, open_volume
from diskloom.operators.media import in_order, spread
from diskloom.partition.tables import Volume
from diskloom.scratch import materialize
from diskloom.sources.evidence import load

EXTENT = "struct<logical_off:long,length:long,phys_off:long,kind:string,inline:binary>"
NODES = (
    "image_id string, part int, start_sector long, size_sectors long, fs_type string, root_id long, file_id long, mode int, size long, mod_time_s long, access_time_s long, create_time_s long, "
    f"is_hidden boolean, is_system boolean, is_readonly boolean, symlink_target string, codec string, extents array<{EXTENT}>, "
    "entries array<struct<name:string,name_raw:binary,child_id:long,is_dir:boolean>>, names array<struct<parent_id:long,name:string>>, error string"
)
KEY = ["image_id", "part"]
#: A file is one cell only up to this size; larger ones are read in blocks.
MAX_CELL = 256 << 20


def nodes(spark: SparkSession, path: str, partition: int | None = None, mode: str = "FAILFAST") -> DataFrame:
    """One row for each directory, file and link of each volume. Volumes are scanned in shares, one task each.

    mode FAILFAST: a volume that can't be parsed fails the query. PERMISSIVE: it gives one row that carries the error.
    """
    plan = load(spark, path, "volumes").where(F.col("fs_type").isin(list(PARSERS)))
    if partition is not None:
        plan = plan.where(F.col("part") == max(partition, 0))
    shares = plan.withColumn("share", F.explode(F.sequence(F.lit(0), F.greatest(F.col("shares"), F.lit(1)) - 1))).select("image_id", "part", "start_sector", "size_sectors", "fs_type", "root_id", "share")

    schema = _arrow(NODES)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, part, start, size, kind, root, share in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[dict] = []
                head = {"image_id": path, "part": part, "start_sector": start, "size_sectors": size, "fs_type": kind, "root_id": root}
                try:
                    for n in open_volume(Image.shared(path), start, size, kind).nodes(share):
                        rows.append(head | _row(n))
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                except (EvidenceError, ValueError, IndexError, KeyError, struct.error) as e:
                    if mode.upper() != "PERMISSIVE":
                        raise EvidenceError(f"{path}, partition {part}: {e}") from e
                    rows.append(head | {"error": f"{type(e).__name__}: {e}"})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    # written down, as entries, paths and facts are all taken from it: a volume is parsed once
    return materialize(spread(shares, ["image_id", "part", "share"]).mapInArrow(parse, NODES), "nodes")


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _row(n) -> dict:
    return {
        "file_id": n.id, "mode": n.mode, "size": n.size, "mod_time_s": n.mtime, "access_time_s": n.atime, "create_time_s": n.ctime,
        "is_hidden": n.hidden, "is_system": n.system, "is_readonly": n.readonly, "symlink_target": n.link, "codec": n.codec, "error": n.error,
        "extents": [{"logical_off": e.logical, "length": e.length, "phys_off": e.phys, "kind": e.kind, "inline": e.inline} for e in n.extents],
        "entries": [{"name": e.name, "name_raw": e.raw, "child_id": e.child, "is_dir": e.is_dir} for e in n.entries],
        "names": [{"parent_id": p, "name": name} for p, name in n.names],
    }


def is_dir(mode: Column) -> Column:
    return mode.bitwiseAND(0xF000) == 0x4000


def dirents(found: DataFrame) -> DataFrame:
    """(image_id, part, parent_id, entry_ordinal, name, name_raw, child_id, is_dir)."""
    listed = found.select(*KEY, F.col("file_id").alias("parent_id"), F.posexplode("entries").alias("entry_ordinal", "e")).select(*KEY, "parent_id", "entry_ordinal", "e.name", "e.name_raw", "e.child_id", "e.is_dir")
    named = found.select(*KEY, F.col("file_id").alias("child_id"), is_dir(F.col("mode")).alias("is_dir"), F.explode("names").alias("n")).select(*KEY, "n.parent_id", F.lit(0).alias("entry_ordinal"), "n.name", F.lit(None).cast("binary").alias("name_raw"), "child_id", "is_dir")
    return listed.unionByName(named)


def inodes(found: DataFrame) -> DataFrame:
    return found.select(*KEY, "fs_type", "file_id", "size", "mode", "mod_time_s", "access_time_s", "create_time_s", "is_hidden", "is_system", "is_readonly", "symlink_target", "error")


def extents(found: DataFrame) -> DataFrame:
    return found.select(*KEY, "file_id", F.explode("extents").alias("e")).select(*KEY, "file_id", "e.*")


def paths(found: DataFrame) -> DataFrame:
    """(image_id, part, parent_path, path, name, entry_ordinal, file_id, is_dir) of all entries reachable from the roots.

    One equi-join a level of the tree, each level written down before the next; the loop ends below the deepest
    directory, however deep. An entry that leads back to a directory above it is left out, as it is damage.
    """
    entries = materialize(dirents(found), "dirents")
    level = found.select(*KEY, "root_id").distinct().select(*KEY, F.col("root_id").alias("parent_id"), F.lit("").alias("parent_path"), F.array("root_id").alias("above"))
    levels: list[DataFrame] = []
    while True:
        below = level.join(entries, [*KEY, "parent_id"]).where(~(F.col("is_dir") & F.array_contains("above", F.col("child_id"))))
        below = materialize(below.select(*KEY, F.when(F.col("parent_path") == "", "/").otherwise(F.col("parent_path")).alias("parent_path"), F.concat("parent_path", F.lit("/"), "name").alias("path"), "name", "entry_ordinal", F.col("child_id").alias("file_id"), "is_dir", F.when(F.col("is_dir"), F.concat("above", F.array("child_id"))).alias("above")), "paths")
        levels.append(below.drop("above"))
        level = below.where("is_dir").select(*KEY, F.col("file_id").alias("parent_id"), F.col("path").alias("parent_path"), "above")
        if not level.head(1):
            break
    out = levels[0]
    for below in levels[1:]:
        out = out.unionByName(below)
    return out


def files(found: DataFrame, with_extents: bool = False) -> DataFrame:
    """Paths with the facts of their nodes. Listings of some file systems carry no time; stat does."""
    facts = found.select(*KEY, "start_sector", "size_sectors", "fs_type", "file_id", "size", "mode", "mod_time_s", "access_time_s", "create_time_s", "is_hidden", "is_system", "is_readonly", "symlink_target", "codec", "error", *(["extents"] if with_extents else []))
    return paths(found).join(facts, [*KEY, "file_id"])


def normalise(path: str) -> str:
    parts = [p for p in path.replace("\\", "/").split("/") if p and p != "."]
    return "/" + "/".join(parts)


def list_dir(listed: DataFrame, path: str) -> DataFrame:
    """Entries of one directory, with backslashes taken as slashes; listings of ext4, XFS, Btrfs and exFAT have time 0."""
    quiet = F.col("fs_type").isin([k for k, p in PARSERS.items() if not p.list_times])
    return listed.where(F.col("parent_path") == normalise(path)).withColumn("mod_time_s", F.when(quiet, F.lit(0)).otherwise(F.col("mod_time_s")))


def stat(listed: DataFrame, path: str) -> DataFrame:
    return listed.where(F.col("path") == normalise(path))


def search(listed: DataFrame, root: str, predicate: Column, max_results: int | None = None) -> DataFrame:
    """All entries below root that meet the predicate, directories too. More than max_results is an error, not a cut."""
    root = normalise(root)
    below = F.lit(True) if root == "/" else F.startswith(F.col("path"), F.lit(root + "/"))
    found = listed.where(below & predicate)
    if max_results is not None and found.limit(max_results + 1).count() > max_results:
        raise EvidenceError(f"a search has more than {max_results} results")
    return found


MAX_HOPS = 40


def follow(listed: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """(image_id, part, link, path) of all links whose target exists: links are followed at every component.

    All links advance together: in each round a path is split at its first component that is a link, which an
    equi-join of prefixes finds, so the number of joins is that of the longest chain, not of links. Links that
    loop, or point nowhere, have no row.
    """
    links = materialize(listed.where(F.col("symlink_target").isNotNull()).select(*KEY, F.col("path").alias("lp"), "parent_path", "symlink_target"), "links")
    real = materialize(listed.where(F.col("symlink_target").isNull()).select(*KEY, "path"), "real")
    absolute = F.when(F.col("symlink_target").startswith("/"), F.col("symlink_target")).otherwise(F.concat(F.col("parent_path"), F.lit("/"), F.col("symlink_target")))
    state = links.select(*KEY, F.col("lp").alias("link"), resolved(absolute).alias("path"))
    out: DataFrame | None = None
    for _ in range(hops):
        state = materialize(state, "follow")
        done = state.join(real, [*KEY, "path"], "left_semi").select(*KEY, "link", "path")
        out = done if out is None else out.unionByName(done)
        left = state.join(real, [*KEY, "path"], "left_anti")
        if not left.head(1):
            break
        parts = F.split("path", "/")
        prefixes = left.withColumn("n", F.explode(F.sequence(F.lit(2), F.size(parts)))).withColumn("lp", F.array_join(F.slice(parts, F.lit(1), F.col("n")), "/"))
        hit = prefixes.join(links, [*KEY, "lp"])
        first = hit.groupBy(*KEY, "link", "path").agg(F.min_by(F.struct("lp", "parent_path", "symlink_target"), "n").alias("h")).select(*KEY, "link", "path", "h.*")
        rest = F.expr("substring(path, length(lp) + 1)")
        state = first.select(*KEY, "link", resolved(F.concat(absolute, rest)).alias("path"))
    return out


def resolved(path: Column) -> Column:
    """A path without empty, `.` and `..` components; `..` at the root stays there."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


_ZEROS = memoryview(bytes(1 << 20))


def _pieces(volume: Volume, found: list[dict], start: int, end: int) -> Iterator[bytes | memoryview]:
    """Bytes start to end of a file from its extents."""
    at = start
    for e in found:
        first, last = max(at, e["logical_off"]), min(end, e["logical_off"] + e["length"])
        while first < last:
            n = min(last - first, 1 << 20)
            skip = first - e["logical_off"]
            if e["kind"] == "data":
                yield volume.read(e["phys_off"] + skip, n)
            elif e["kind"] == "inline":
                yield e["inline"][skip : skip + n]
            else:
                yield _ZEROS[:n]
            first += n
            at = first
    if at < end:
        raise EvidenceError(f"a file is mapped up to {at}, not {end}")


def read_slices(rows: DataFrame, hashes: tuple[str, ...] = ()) -> DataFrame:
    """rows (files with extents, plus `offset` and `length`) with `data`, or with hashes of the slice (md5, sha1) instead.

    Each task opens an image once for the rows that follow each other and keeps its decoded chunks in a bounded cache; only
    the chunks under a slice are decoded. Rows with an error, and directories, fail the query.
    """
    names = rows.columns
    carried = [c for c in names if c not in ("extents",)]
    added = ", ".join(f"{h} string" for h in hashes) if hashes else "data binary"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in carried) + ", " + added

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                got = {c: batch.column(names.index(c)).to_pylist() for c in ("image_id", "start_sector", "size_sectors", "offset", "length", "extents", "size", "codec", "error", "mode")}
                out: list[tuple] = []
                for r in range(batch.num_rows):
                    row = {c: v[r] for c, v in got.items()}
                    if row["error"]:
                        raise EvidenceError(row["error"])
                    if row["mode"] & 0xF000 == 0x4000:
                        raise EvidenceError("a directory has no content")
                    volume = Volume(Image.shared(row["image_id"]), row["start_sector"], row["size_sectors"])
                    end = min(row["size"], row["offset"] + row["length"])
                    if row["codec"]:
                        packed = b"".join(_pieces(volume, row["extents"], 0, sum(e["length"] for e in row["extents"])))
                        parts: Iterator[bytes] = iter([decode_codec(row["codec"], packed, row["size"])[row["offset"] : end]])
                    else:
                        parts = _pieces(volume, row["extents"], min(row["offset"], end), end)
                    if hashes:
                        sums = [hashlib.new(h) for h in hashes]
                        for p in parts:
                            for s in sums:
                                s.update(p)
                        out.append(tuple(s.hexdigest() for s in sums))
                    else:
                        out.append((b"".join(parts),))
                kinds = [pa.string()] * len(hashes) or [pa.binary()]
                new = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in carried), *new], names=[*carried, *(hashes or ["data"])])

    return rows.mapInArrow(run, schema)


def _near(rows: DataFrame) -> DataFrame:
    """Rows in the order of their place on the disk, so that a task's cache of chunks serves neighbours.

    They are written down first, as their bytes decide how many tasks there are and their places are sampled.
    """
    first = F.coalesce(F.try_element_at(F.filter("extents", lambda e: e["kind"] == "data"), F.lit(1))["phys_off"], F.lit(-1))
    placed = materialize(rows.withColumn("_at", first), "places")
    total = placed.agg(F.sum(F.least("size", "length"))).first()[0] or 0
    return in_order(placed, ["image_id", "part", "_at"], total).drop("_at")


def regular(listed: DataFrame) -> DataFrame:
    return listed.where(~is_dir(F.col("mode")))


def content(listed: DataFrame, max_cell: int = MAX_CELL, strict: bool = True) -> DataFrame:
    """Whole files as cells; a larger file than max_cell fails the query (use blocks). listed: files(..., with_extents=True).

    strict: a whole ext4 file with a hole is an error, as usual readers have it; blocks, ranges and hashes give zeros.
    """
    if strict:
        holes = F.exists("extents", lambda e: e["kind"] == "hole") & (F.col("fs_type") == "ext4")
        listed = listed.withColumn("error", F.when(holes & F.col("error").isNull(), F.concat(F.lit("a hole in "), F.col("file_id").cast("string"))).otherwise(F.col("error")))
    sized = regular(listed).withColumn("offset", F.lit(0).cast("long")).withColumn("length", F.when(F.col("size") <= max_cell, F.col("size")).otherwise(F.raise_error(F.lit("a file is too large for one cell; read it in blocks")).cast("long")))
    return read_slices(_near(sized)).drop("offset", "length")


def blocks(listed: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """Files in blocks (path, block_no, data): the form for files of any size."""
    some = regular(listed).where("size > 0")
    cut = some.withColumn("block_no", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block_bytes)))).withColumn("offset", F.col("block_no") * block_bytes).withColumn("length", F.lit(block_bytes).cast("long"))
    return read_slices(_near(cut))


def file_ranges(listed: DataFrame, offset: Column, length: Column) -> DataFrame:
    """A slice of each file: extents, then chunks, outside the slice are never read."""
    some = regular(listed).withColumn("offset", offset.cast("long")).withColumn("length", length.cast("long"))
    kept = F.filter("extents", lambda e: (e["logical_off"] < F.col("offset") + F.col("length")) & (e["logical_off"] + e["length"] > F.col("offset")))
    return read_slices(_near(some.withColumn("extents", F.when(F.col("codec") == "", kept).otherwise(F.col("extents")))))


def hashes(listed: DataFrame, kinds: tuple[str, ...] = ("md5", "sha1")) -> DataFrame:
    """MD5 and SHA-1 of each file, or those asked for, streamed: no file is held whole."""
    some = regular(listed).withColumn("offset", F.lit(0).cast("long")).withColumn("length", F.col("size"))
    return read_slices(_near(some), hashes=kinds).drop("offset", "length")


def manifest(listed: DataFrame) -> DataFrame:
    return hashes(listed, ("md5",)).select("image_id", "part", "path", "size", "md5")
