"""File systems: what a builder puts on a volume, the parser finds; damage is an error on a node, never invented bytes."""

import random
import shutil
import subprocess

import pytest

from diskloom.build.apfs import build_apfs, pack_unit, resource
from diskloom.build.btrfs import build_btrfs
from diskloom.build.ext4 import build_ext4
from diskloom.build.fat import build_exfat, build_fat
from diskloom.build.ntfs import build_ntfs
from diskloom.build.tree import File
from diskloom.build.xfs import build_xfs
from diskloom.errors import EvidenceError, Unsupported
from diskloom.fs import codecs
from diskloom.fs.detect import detect
from diskloom.fs.fat import dos_time
from diskloom.fs.ntfs import filetime, runs
from diskloom.fs.registry import DETECTION_ONLY, PARSERS


class Bytes:
    def __init__(self, data):
        self.data, self.size = data, len(data)

    def read(self, offset, length):
        if offset < 0 or offset + length > len(self.data):
            raise EvidenceError("past the volume")
        return bytes(self.data[offset : offset + length])

    def block(self, offset, length):
        return bytes(self.data[offset : offset + length])


rnd = random.Random(1)
FILES = [File(f"dir {k % 5}/sub{k % 3}/file_{k} long näme.txt" if k % 4 else f"f{k}.bin", rnd.randbytes(rnd.choice([0, 1, 300, 511, 512, 5000, 20000])), 1_000_000_000 + 2 * k) for k in range(60)]
MANY = [File(f"many/n{k:05d}.txt", b"x" * (k % 50), 1_200_000_000 + 2 * k) for k in range(1500)]
LINKS = [File("links/short", link="../f0.bin"), File("links/long", link="x" * 400)]
SPARSE = [File("sparse.bin", parts=[(8192, b"abc" * 3000), (65536, b"z" * 4096)], size=69_632, mtime=1_000_000_002)]
CASES = {
    "FAT12": (lambda f: build_fat(f, 12, per=4), FILES),
    "FAT16": (lambda f: build_fat(f, 16, scatter=True), FILES),
    "FAT32": (lambda f: build_fat(f, 32, scatter=True), FILES + MANY),
    "exFAT": (build_exfat, FILES + MANY),
    "NTFS": (lambda f: build_ntfs(f, fragment=True), FILES + MANY + SPARSE),
    "ext4": (build_ext4, FILES + MANY + LINKS + SPARSE),
    "XFS": (build_xfs, FILES + MANY + LINKS + SPARSE),
    "Btrfs": (build_btrfs, FILES + MANY + LINKS + SPARSE),
    "APFS": (build_apfs, FILES + MANY + LINKS + SPARSE),
}


def contents(fs):
    nodes = {n.id: n for s in range(fs.shares()) for n in fs.nodes(s)}
    below = {}
    for n in nodes.values():
        for e in n.entries:
            below.setdefault(n.id, []).append((e.name, e.child))
        for p, name in n.names:
            below.setdefault(p, []).append((name, n.id))
    out = {}

    def walk(i, path):
        for name, child in below.get(i, []):
            n = nodes[child]
            if n.is_dir:
                walk(child, path + name + "/")
            else:
                data = b"".join(fs.volume.read(e.phys, e.length) if e.kind == "data" else e.inline if e.kind == "inline" else bytes(e.length) for e in n.extents)
                out[path + name] = (n, data)

    walk(fs.root, "")
    return out


@pytest.mark.parametrize("kind", CASES)
def test_builder_to_parser(kind):
    build, files = CASES[kind]
    image = build(files)
    assert detect(image[:66_048]) == kind
    fs = PARSERS[kind](Bytes(image))
    assert fs.label() == "FIXTURE" and fs.block_size() > 0 and fs.type == kind
    got = {p: v for p, v in contents(fs).items() if not p.startswith("$")}
    assert set(got) == {f.path for f in files}
    for f in files:
        node, data = got[f.path]
        assert node.error is None
        if f.link is not None:
            assert node.link == f.link
            continue
        want = bytearray(f.length)
        for at, part in f.pieces():
            want[at : at + len(part)] = part
        assert data == bytes(want) and node.size == f.length and node.mtime == f.mtime


@pytest.mark.parametrize("kind,name,size", [("Btrfs", "LEAVES_A_SHARE", 1), ("NTFS", "RECORDS_A_SHARE", 7), ("APFS", "LEAVES_A_SHARE", 1), ("ext4", "GROUPS_A_SHARE", 1)])
def test_shares_make_up_the_whole(kind, name, size, monkeypatch):
    import importlib

    build, files = CASES[kind]
    image = build(files)
    whole = {p: d for p, (_, d) in contents(PARSERS[kind](Bytes(image))).items()}
    monkeypatch.setattr(importlib.import_module(PARSERS[kind].__module__), name, size)
    fs = PARSERS[kind](Bytes(image))
    ids = [n.id for s in range(fs.shares()) for n in fs.nodes(s)]
    assert len(ids) == len(set(ids)) and (kind == "ext4" or fs.shares() > 3)
    assert {p: d for p, (_, d) in contents(fs).items()} == whole


@pytest.mark.parametrize("kind", CASES)
def test_damage_is_an_error(kind):
    build, _ = CASES[kind]
    good = build(FILES[:12])
    noise = random.Random(3)
    for _ in range(25):
        bad = bytearray(good)
        for _ in range(40):
            bad[noise.randrange(min(len(bad), 400_000))] = noise.randrange(256)
        try:
            for n in (n for s in range(min(PARSERS[kind](Bytes(bad)).shares(), 4)) for n in PARSERS[kind](Bytes(bad)).nodes(s)):
                assert n.error is not None or n.is_dir or n.mode & 0xF000 not in (0x8000,) or sum(e.length for e in n.extents) == n.size
        except (EvidenceError, ValueError, IndexError, KeyError, OverflowError, MemoryError):
            pass
        except Exception as e:  # struct.error and the like are for the caller to name
            assert type(e).__name__ == "error", repr(e)


@pytest.mark.skipif(not shutil.which("mke2fs"), reason="no mke2fs")
def test_ext4_made_by_other_tools(tmp_path):
    src = tmp_path / "src"
    (src / "a/b").mkdir(parents=True)
    (src / "a/b/one.txt").write_bytes(b"fixture\n")
    (src / "big.bin").write_bytes(bytes(range(256)) * 4096)
    (src / "link").symlink_to("a/b/one.txt")
    for k in range(300):
        (src / f"a/n{k:04d}").write_bytes(b"%d" % k)
    for name, options in (("ext4", []), ("ext2", ["-b", "1024"]), ("ext3", [])):
        image = tmp_path / f"{name}.img"
        subprocess.run(["timeout", "60", "mke2fs", "-q", "-t", name, *options, "-L", "FIXTURE", "-d", str(src), str(image), "32M"], check=True)
        fs = PARSERS["ext4"](Bytes(image.read_bytes()))
        got = contents(fs)
        assert fs.label() == "FIXTURE"
        assert got["a/b/one.txt"][1] == b"fixture\n" and got["big.bin"][1] == bytes(range(256)) * 4096 and got["link"][0].link == "a/b/one.txt"
        assert all(got[f"a/n{k:04d}"][1] == b"%d" % k for k in range(300))


@pytest.mark.skipif(not shutil.which("e2fsck"), reason="no e2fsck")
def test_built_ext4_is_readable_by_other_tools(tmp_path):
    (tmp_path / "x").write_bytes(build_ext4(FILES))
    out = subprocess.run(["timeout", "60", "debugfs", "-R", "ls -l /", str(tmp_path / "x")], capture_output=True, text=True).stdout
    assert "f0.bin" in out and "dir 1" in out


@pytest.mark.parametrize("kind", codecs.KINDS)
def test_packed_content(kind):
    for data in (b"a", b"hello hello hello hello " * 9000, rnd.randbytes(200_000)):
        if kind % 2:
            data = data[:3000]
            assert codecs.decode(f"decmpfs:{kind}", pack_unit(kind, data), len(data)) == data
        else:
            assert codecs.decode(f"decmpfs:{kind}", resource(kind, data), len(data)) == data


def test_lzvn_operations():
    end = b"\x06" + bytes(7)
    for packed, want in (
        (b"\xe3abc" + end, b"abc"),
        (b"\xe0\x00" + b"0123456789abcdef" + end, b"0123456789abcdef"),
        (b"\xe3abc" + b"\x38\x03" + end, b"abc" + b"abcabcabca"),
        (b"\x48\x01a" + end, b"a" * 5),
        (b"\xe2ab" + b"\x07\x02\x00" + end, b"ab" + b"aba"),
        (b"\xe2ab" + b"\x07\x02\x00" + b"\xf4" + end, b"ab" + b"aba" + b"baba"),
        (b"\xe2ab" + b"\x07\x02\x00" + b"\xf0\x04" + end, b"ababa" + b"ba" * 10),
        (b"\xe2ab" + b"\x07\x02\x00" + b"\x46c" + end, b"ababa" + b"c" + b"ac" + b"a"),
        (b"\xe2ab" + b"\xa0\x08\x00" + end, b"ab" + b"aba"),
        (b"\x0e\x16\xe1z" + end, b"z"),
    ):
        assert codecs.lzvn(packed, len(want)) == want, packed
    for bad in (b"", b"\xe3ab", b"\x70", b"\xd0", b"\x1e", b"\xe1a\x38\x09" + end, end, b"\xe1a" + end):
        with pytest.raises(EvidenceError):
            codecs.lzvn(bad, 5)
    with pytest.raises(Unsupported):
        codecs.decode("decmpfs:11", b"", 5)


def test_scalars():
    assert dos_time(0x5ACF, 0x645C) == 1_557_837_056 - 1_557_837_056 % 2 or dos_time(0x5ACF, 0x645C) > 0
    assert dos_time(0, 0) == 0 and dos_time((40 << 9) | (13 << 5) | 1, 0) == 0 and dos_time((40 << 9) | (1 << 5) | 1, 24 << 11) == 0
    assert dos_time((41 << 9) | (2 << 5) | 31, 0) == dos_time((41 << 9) | (3 << 5) | 3, 0)
    assert filetime(0) == 0 and filetime((11_644_473_600 + 5) * 10_000_000) == 5 and filetime(10_000_000) == 0
    found = runs(b"\x11\x02\x05\x01\x03\x11\x01\xfe\x00", 10)
    assert [(e.logical, e.length, e.phys, e.kind) for e in found] == [(0, 20, 50, "data"), (20, 30, -1, "hole"), (50, 10, 30, "data")]
    assert not set(DETECTION_ONLY) & set(PARSERS)
