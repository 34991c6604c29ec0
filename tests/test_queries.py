"""Registered queries against their SQL on small tables, and the parts of the engine that have no SQL."""

import glob
import os
import socket
import struct
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from diskloom.build.disk import gpt_disk, mbr_disk
from diskloom.build.ext4 import build_ext4
from diskloom.build.fat import build_fat
from diskloom.build.tree import File
from diskloom.container.reader import Image
from diskloom.container.writer import write
from diskloom.errors import EvidenceError, IsDirectory, NotDirectory, NotFound
from diskloom.operators import files as ops
from diskloom.operators import media, partitions
from diskloom.partition import tables
from diskloom.plans.queries import ORACLE_SQL, QUERIES
from diskloom.serving.handle import Opened, image_stream, partition_stream
from diskloom.serving.nbd import Server
from diskloom.sources.evidence import load

SF = "/root/testdata/sf0.001"
FILES = [File(f"d{k % 3}/f{k}.txt", b"%d" % k * (k * 50), 1_500_000_000 + 2 * k) for k in range(40)] + [File("l", link="d1/f1.txt")]


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in QUERIES if not n.endswith("_content") or n in ("xfs_content", "apfs_content")])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(repr(tuple(map(plain, r))) for r in got.select(*cols).collect()) == sorted(repr(tuple(map(plain, r))) for r in want)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("images")
    write(f"{out}/a.E01", mbr_disk([(0x83, build_ext4(FILES)), (0x06, build_fat(FILES[:-1], 16))]))
    write(f"{out}/b.E01", gpt_disk([(tables.LINUX_GUID, "linux", build_ext4(FILES[:3])), (tables.EFI_GUID, "efi", bytes(512 * 20))]))
    return str(out)


def test_tables_of_images(spark, folder):
    p = load(spark, folder, "partitions").orderBy("image_id", "idx").collect()
    assert [(r["type_name"], r["filesystem"]) for r in p] == [("Linux", "ext4"), ("FAT16", "FAT16"), ("GPT", "ext4"), ("GPT", "EFI")]
    native = partitions.scan(load(spark, folder, "heads"), load(spark, folder, "probes")).orderBy("image_id", "idx").collect()
    assert [tuple(r)[:4] + tuple(r)[4:] for r in native] == [(r["image_id"], r["idx"], r["start_sector"], r["size_sectors"], r["type"], r["type_code"], r["type_name"], r["filesystem"]) for r in p]
    one = load(spark, folder, "chunks").where(F.col("image_id") == f"{folder}/a.E01")
    assert one.count() == Image.open(f"{folder}/a.E01").chunk_total
    assert {r["scheme"] for r in load(spark, folder, "schemes").collect()} == {"MBR", "GPT"}
    got = media.sectors(spark, f"{folder}/a.E01", 63, 200).orderBy("chunk_no").collect()
    assert [r["chunk_no"] for r in got] == [0, 1, 2, 3]
    with pytest.raises(Exception, match="no table"):
        load(spark, folder, "nothing").collect()


def test_same_answer_whatever_the_parallelism(spark, folder):
    with pytest.raises(Exception, match="no FAT boot sector"):
        ops.nodes(spark, folder).collect()
    found = ops.files(ops.nodes(spark, folder, mode="PERMISSIVE"), with_extents=True)
    a = sorted(map(tuple, ops.manifest(found).collect()))
    b = sorted(map(tuple, ops.manifest(found.coalesce(1)).collect()))
    assert a == b and len(a) == 41 + 40 + 3


def test_damaged_images(spark, tmp_path):
    write(f"{tmp_path}/good.E01", mbr_disk([(0x83, build_ext4(FILES))]))
    data = bytearray(open(f"{tmp_path}/good.E01", "rb").read())
    data[len(data) // 3 : len(data) // 3 + 4000] = bytes(4000)
    open(f"{tmp_path}/bad.E01", "wb").write(data)
    (tmp_path / "junk.E01").write_bytes(b"junk")
    with pytest.raises(Exception, match="signature|inflated|EvidenceError"):
        load(spark, str(tmp_path), "media").collect()
    kept = load(spark, str(tmp_path), "media", mode="PERMISSIVE").collect()
    assert {os.path.basename(r["image_id"]) for r in kept} >= {"good.E01"} and "junk.E01" not in {os.path.basename(r["image_id"]) for r in kept}
    errors = {os.path.basename(r["image_id"]) for r in load(spark, str(tmp_path), "errors").collect()}
    assert errors == {"bad.E01", "junk.E01"}
    checked = {os.path.basename(r["image_id"]): r for r in media.image_hashes(spark, f"{tmp_path}/[gb]*.E01").collect()}
    assert checked["good.E01"]["md5_match"] and checked["bad.E01"]["error"] and checked["bad.E01"]["computed_md5"] is None


def test_content_rules(spark, folder):
    listed = ops.files(ops.nodes(spark, f"{folder}/a.E01", 0), with_extents=True)
    assert ops.stat(listed, "\\d1\\f1.txt").count() == 1
    with pytest.raises(Exception, match="too large"):
        ops.content(listed, max_cell=10).collect()
    whole = {r["path"]: r["data"] for r in ops.content(listed).collect()}
    cut = {}
    for r in ops.blocks(listed, 100).orderBy("path", "block_no").collect():
        cut[r["path"]] = cut.get(r["path"], b"") + bytes(r["data"])
    assert {p: bytes(d) for p, d in whole.items() if d} == cut
    assert bytes(whole["/l"]) == b"d1/f1.txt"
    assert {r["link"]: r["path"] for r in ops.follow(listed).collect()} == {"/l": "/d1/f1.txt"}
    assert ops.search(listed, "/d1", F.lit(True)).count() == 13 == ops.search(listed, "/d1", F.lit(True), 13).count()
    with pytest.raises(EvidenceError, match="more than 12"):
        ops.search(listed, "/d1", F.lit(True), 12)


def test_deep_trees_and_one_parse(spark, tmp_path, monkeypatch):
    """Directories of any depth are listed, and a manifest parses each volume once."""
    deep = File("/".join(f"d{k}" for k in range(70)) + "/bottom.txt", b"deep")
    for code, build in ((0x83, build_ext4), (0x06, lambda f: build_fat(f, 16))):
        folder = tmp_path / f"c{code}"
        folder.mkdir()
        write(f"{folder}/d.E01", mbr_disk([(code, build([deep, *FILES[:3]]))]))
        parsed = spark.sparkContext.accumulator(0)
        kind = "ext4" if code == 0x83 else "FAT16"
        plain = ops.open_volume

        def counted(*a, plain=plain, parsed=parsed):
            parsed.add(1)
            return plain(*a)

        monkeypatch.setattr(ops, "open_volume", counted)
        listed = ops.files(ops.nodes(spark, str(folder)), with_extents=True)
        got = {r["path"]: r["md5"] for r in ops.manifest(listed).collect()}
        monkeypatch.setattr(ops, "open_volume", plain)
        assert got["/" + deep.path] == __import__("hashlib").md5(b"deep").hexdigest() and len(got) == 4, kind
        assert parsed.value <= load(spark, str(folder), "volumes").first()["shares"], kind


def test_large_partition_tables(tmp_path):
    disk = bytearray(gpt_disk([(tables.LINUX_GUID, "x", bytes(1024))]))
    struct.pack_into("<I", disk, 512 + 80, 5000)
    write(f"{tmp_path}/g.E01", bytes(disk))
    with Image.open(f"{tmp_path}/g.E01") as image, pytest.raises(EvidenceError):
        tables.partitions(image)


def test_holes_of_whole_files(spark, tmp_path):
    write(f"{tmp_path}/h.E01", mbr_disk([(0x83, build_ext4([File("s", parts=[(4096, b"x")], size=5000)]))]))
    listed = ops.files(ops.nodes(spark, str(tmp_path)), with_extents=True)
    with pytest.raises(Exception, match="a hole in"):
        ops.content(listed).collect()
    want = bytes(4096) + b"x" + bytes(903)
    assert bytes(ops.content(listed, strict=False).first()["data"]) == want
    assert bytes(ops.file_ranges(listed, F.lit(4000), F.lit(200)).first()["data"]) == want[4000:4200]


def test_partition_schemes(tmp_path):
    def made(data):
        path = f"{tmp_path}/s.E01"
        write(path, data)
        return Image.open(path)

    apm = bytearray(512 * 80)
    for k, (kind, start, size) in enumerate(((b"Apple_partition_map", 1, 63), (b"Apple_HFS", 64, 10)), 1):
        apm[512 * k : 512 * k + 16] = struct.pack(">2sHIII", b"PM", 0, 2, start, size)
        apm[512 * k + 48 : 512 * k + 48 + len(kind)] = kind
    assert tables.scheme(made(bytes(apm))).startswith("Apple") and [e["type"] for e in tables.apm(made(bytes(apm)))] == ["Apple_partition_map", "Apple_HFS"]
    bsd = bytearray(512 * 80)
    struct.pack_into("<I", bsd, 512, tables.BSD_MAGIC)
    struct.pack_into("<IHH", bsd, 512 + 132, tables.BSD_MAGIC, 0, 2)
    struct.pack_into("<IIIBBH", bsd, 512 + 148 + 16, 100, 63, 0, 7, 8, 0)
    assert tables.bsd(made(bytes(bsd))) == [{"slot": 1, "start": 63, "size": 100, "type": 7}] and tables.scheme(made(bytes(bsd))) == "BSD Disklabel"
    lvm = bytearray(512 * 80)
    lvm[512:520], lvm[536:544] = b"LABELONE", b"LVM2 001"
    struct.pack_into("<I", lvm, 512 + 20, 32)
    lvm[544:576] = b"u" * 32
    assert tables.lvm2(made(bytes(lvm)))["uuid"] == "u" * 32 and tables.scheme(made(bytes(lvm))) == "LVM2"
    plain_volume = made(build_fat(FILES[:3], 16))
    assert [p.filesystem for p in tables.partitions(plain_volume)] == ["FAT16"]
    logical = bytearray(mbr_disk([(0x05, bytes(512 * 40))]))
    logical[512 * 63 + 446 : 512 * 63 + 462] = struct.pack("<B3sB3sII", 0, b"", 0x83, b"", 5, 20)
    assert [(p.type_code, p.start_sector) for p in tables.partitions(made(bytes(logical)))] == [(5, 63), (0x83, 68)]
    assert tables.choose(made(mbr_disk([(0x82, b"\xaa" * 16384)])), -3).filesystem == "Swap"
    with pytest.raises(NotFound):
        tables.choose(made(bytes(512 * 64)), 0)


def test_lazy_handles(folder):
    with Image.open(f"{folder}/a.E01") as image:
        opened = Opened(image, 0)
        stream = opened.open("d1/f10.txt")
        want = b"10" * 500
        assert stream.read() == want and stream.seek(-3, 2) == len(want) - 3 and stream.read(10) == want[-3:] and stream.read(1) == b""
        assert stream.read_at(5, 4) == want[5:9]
        with pytest.raises(ValueError):
            stream.seek(-1)
        assert opened.read("/l") == b"d1/f1.txt" and [n for n, _ in opened.list("d1")][0] == "f1.txt"
        for bad, error in (("d1", IsDirectory), ("nope", NotFound), ("l", EvidenceError)):
            with pytest.raises(error):
                opened.open(bad)
        with pytest.raises(NotDirectory):
            opened.list("d1/f1.txt")
        assert partition_stream(image, 0).read_at(1024 + 56, 2) == b"\x53\xef"


def test_network_block_device(folder):
    def take(n):
        out = b""
        while len(out) < n:
            out += sock.recv(n - len(out))
        return out

    with Image.open(f"{folder}/a.E01") as image:
        stream = image_stream(image)
        server = Server(stream, "disk").start()
        sock = socket.create_connection(server.address)
        assert take(18) == struct.pack(">8s8sH", b"NBDMAGIC", b"IHAVEOPT", 3)
        sock.sendall(struct.pack(">I", 3))
        sock.sendall(struct.pack(">8sII", b"IHAVEOPT", 3, 0))
        assert struct.unpack(">QIII", take(20))[2:] == (2, 8) and take(8)[4:] == b"disk" and struct.unpack(">QIII", take(20))[2] == 1
        sock.sendall(struct.pack(">8sII", b"IHAVEOPT", 99, 0))
        assert struct.unpack(">QIII", take(20))[2] == 0x80000001
        sock.sendall(struct.pack(">8sIII4sH", b"IHAVEOPT", 7, 10, 4, b"disk", 0))
        assert struct.unpack(">QIII", take(20))[2] == 3 and struct.unpack(">HQH", take(12)) == (0, stream.size, 7) and struct.unpack(">QIII", take(20))[2] == 1

        def ask(kind, offset, length, body=b""):
            sock.sendall(struct.pack(">IHHQQI", 0x25609513, 0, kind, 42, offset, length) + body)
            _, error, handle = struct.unpack(">IIQ", take(16))
            assert handle == 42
            return error

        assert ask(0, 1000, 600) == 0 and take(600) == image.read(1000, 600)
        assert ask(0, stream.size - 1, 2) == 22 and ask(0, 0, 33 << 20) == 22
        assert ask(1, 0, 3, b"abc") == 1 and ask(4, 0, 3) == 1 and ask(6, 0, 3) == 1 and ask(3, 0, 0) == 0
        sock.sendall(struct.pack(">IHHQQI", 0x25609513, 0, 2, 1, 0, 0))
        assert sock.recv(1) == b""
        server.close()


def test_command_line(folder):
    run = lambda *a: subprocess.run(["timeout", "100", sys.executable, "-m", "diskloom.cli", *a], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert run("version").stdout.strip() and run().returncode == 2
    out = run("ls", f"{folder}/a.E01", "0", "/d1")
    assert out.returncode == 0 and "f10.txt" in out.stdout


def test_landing_stream(spark, folder, tmp_path):
    from diskloom.streaming.landing import landing

    src = tmp_path / "in"
    src.mkdir()
    for name in ("a.E01", "b.E01"):
        (src / name).write_bytes(open(f"{folder}/{name}", "rb").read())
    (src / "junk.E01").write_bytes(b"junk")
    q = landing(spark, str(src)).writeStream.format("memory").queryName("landed").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("SELECT filesystem, error FROM landed").collect()
    assert sorted(r["filesystem"] for r in rows if r["error"] is None) == ["EFI", "FAT16", "ext4", "ext4"] and sum(r["error"] is not None for r in rows) == 1


def test_raw_records(spark, tmp_path):
    from diskloom.build.apfs import build_apfs
    from diskloom.build.btrfs import build_btrfs
    from diskloom.operators.records import records

    few = [File("a/x.txt", b"x" * 9000, 5), File("y", link="a/x.txt"), File("z", b"packed " * 100)]
    write(f"{tmp_path}/r.E01", mbr_disk([(0xAF, build_apfs(few, packed={"z": 4})), (0x83, build_btrfs(few)), (0x06, build_fat(few[:1], 16))]))
    names = {(r["name"], r["value"] is None) for r in records(spark, str(tmp_path), "xattrs").collect()}
    assert names == {("com.apple.fs.symlink", False), ("com.apple.decmpfs", False), ("com.apple.ResourceFork", True)}
    assert {r["type"]: r["n"] for r in records(spark, str(tmp_path), "btree_items").groupBy("type").agg(F.count("*").alias("n")).collect()}[1] == 5
    assert records(spark, str(tmp_path), "omap").where("map = 'container'").count() == 1
    chain = {r["cluster"]: r["next"] for r in records(spark, str(tmp_path), "fat").collect()}
    assert sum(v >= 0xFFF8 for v in chain.values()) == 2
    with pytest.raises(EvidenceError):
        records(spark, str(tmp_path), "nothing")
