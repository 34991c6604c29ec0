"""Containers: every layout round trips, damage is an error, reads keep to their rules."""

import hashlib
import itertools
import os
import random
import struct
import zlib

import pytest

from diskloom.container.reader import DESCRIPTOR, Image, decode, is_container, segments
from diskloom.container.writer import LAYOUTS, write
from diskloom.errors import EvidenceError

DISK = bytes((17 * i + 7 * j) % 256 for i in range(300) for j in range(512))


@pytest.mark.parametrize("layout,compress,slack,groups,parts,short", list(itertools.product(LAYOUTS, (True, False), (0, 512), (1, 2), (1, 2), (False, True))))
def test_round_trip(tmp_path, layout, compress, slack, groups, parts, short):
    path = f"{tmp_path}/x.E01"
    write(path, DISK, layout, compress, slack=slack, groups=groups, segments=parts, short_final=short)
    with Image.open(path) as image:
        assert b"".join(image.stream(7)) == DISK
        assert (image.stored_md5, image.stored_sha1) == (hashlib.md5(DISK).digest(), hashlib.sha1(DISK).digest())
        assert image.read_sectors(63, 3) == DISK[63 * 512 : 66 * 512]


def test_reads_past_the_end(tmp_path):
    path = f"{tmp_path}/x.E01"
    write(path, DISK)
    with Image.open(path) as image:
        assert image.coverage == 320 and image.geometry.sector_count == 300
        assert image.read_sectors(319, 5) == bytes(5 * 512)
        assert image.read_sectors(299, 2) == DISK[299 * 512 :] + bytes(512)
        for lba, n in ((320, 1), (-1, 1), (0, 1 << 22)):
            with pytest.raises(EvidenceError):
                image.read_sectors(lba, n)


def test_headers_and_media(tmp_path):
    from diskloom.container.writer import header_text

    path = f"{tmp_path}/x.E01"
    write(path, DISK, header=header_text("case", "evidence", "Zoë", "text"))
    with Image.open(path) as image:
        assert [h["e"] for h in image.headers] == ["Zoë", "Zoë"] and image.headers[0]["c"] == "case"
        assert image.geometry.chs == "1/16/63" and len(image.media) == 2


def test_segments(tmp_path):
    path = f"{tmp_path}/x.E01"
    assert len(write(path, DISK, segments=3)) == 3
    assert [s.number for s in segments(path)] == [1, 2, 3] and is_container(path)
    os.rename(f"{tmp_path}/x.E02", f"{tmp_path}/x.E04")
    assert not is_container(path)
    with pytest.raises(EvidenceError):
        Image.open(path)
    os.remove(f"{tmp_path}/x.E03")
    with open(f"{tmp_path}/x.E04", "wb") as f:
        f.write(b"garbage garbage garbage")
    with pytest.raises(EvidenceError):
        Image.open(path)


def test_raw_range_spans_segments(tmp_path):
    path = f"{tmp_path}/x.E01"
    whole = b"".join(open(p, "rb").read() for p in write(path, DISK, segments=2))
    with Image.open(path) as image:
        cut = image.segments[1].start
        assert image.raw(cut - 10, 30) == whole[cut - 10 : cut + 20]
        assert image.raw(len(whole) - 5, 50) == whole[-5:]


def test_malformed(tmp_path):
    path = f"{tmp_path}/x.E01"
    write(path, DISK, skip_table=True)
    with pytest.raises(EvidenceError, match="tables"):
        Image.open(path)
    with open(path, "wb") as f:
        f.write(b"not a container")
    assert not is_container(path)
    write(path, DISK)
    good = bytearray(open(path, "rb").read())
    for at, value in ((13 + 24, struct.pack("<Q", 1 << 40)), (13 + 16, struct.pack("<Q", 1 << 50))):
        bad = bytearray(good)
        bad[at : at + 8] = value
        open(path, "wb").write(bad)
        with pytest.raises(EvidenceError):
            Image.open(path)


def test_hostile_bytes_never_crash(tmp_path):
    path, rnd = f"{tmp_path}/x.E01", random.Random(1)
    write(path, DISK[: 512 * 70])
    good = open(path, "rb").read()
    for _ in range(150):
        bad = bytearray(good)
        for _ in range(rnd.randint(1, 4)):
            bad[rnd.randrange(8, len(bad))] = rnd.randrange(256)
        open(path, "wb").write(bad[: rnd.choice([len(bad), rnd.randrange(20, len(bad))])])
        try:
            with Image.open(path) as image:
                for lba in range(0, min(image.coverage, 256), 64):
                    image.read_sectors(lba, 1)
        except EvidenceError:
            pass
        except (ValueError, UnicodeError) as e:
            pytest.fail(f"{type(e).__name__}: {e}")


def test_chunk_decoding():
    data = os.urandom(1000) + bytes(31768)
    assert decode(zlib.compress(data), True, 32768, 32768) == data
    raw = zlib.compressobj(wbits=-15)
    assert decode(raw.compress(data) + raw.flush(), True, 32768, 32768) == data
    broken = bytearray(zlib.compress(data))
    broken[20] ^= 0xFF
    for bad, compressed in ((bytes(broken), True), (b"", True), (zlib.compress(data[:5]), True), (data + b"\0\0\0\0", False), (data[:10], False)):
        with pytest.raises(EvidenceError):
            decode(bad, compressed, 32768, 32768)
    assert decode(data + struct.pack("<I", zlib.adler32(data)), False, 32768, 32768) == data
    assert DESCRIPTOR == 76


def test_cache_is_bounded(tmp_path, monkeypatch):
    from diskloom.container import reader

    monkeypatch.setattr(reader, "CACHE_BYTES", 70_000)
    path = f"{tmp_path}/x.E01"
    write(path, DISK)
    with Image.open(path) as image:
        assert b"".join(image.read_sectors(k, min(64, 300 - k)) for k in range(0, 300, 64)) == DISK
        assert len(image._cache) == 2 and image._held == sum(map(len, image._cache.values()))


def test_tables_are_read_in_pages_once(tmp_path, monkeypatch):
    from diskloom.container import reader

    monkeypatch.setattr(reader, "PAGE_ENTRIES", 3)
    monkeypatch.setattr(reader, "RUN_BYTES", 40_000)
    for layout, groups, parts in itertools.product(LAYOUTS, (1, 2), (1, 2)):
        path = f"{tmp_path}/{layout}{groups}{parts}.E01"
        write(path, DISK, layout, groups=groups, segments=parts, chunk_sectors=16)
        with Image.open(path) as image:
            assert image.pages_read == 0 and image.chunk_total == 19
            assert b"".join(image.run(0, 19))[: len(DISK)] == DISK
            read = image.pages_read
            assert read == sum(-(-t.count // 3) for t in image.tables)
            assert b"".join(image.run(5, 4)) == DISK[5 * 8192 : 9 * 8192] and image.chunk(17) == DISK[17 * 8192 : 18 * 8192]
            assert image.pages_read == read
            assert [int(e) for t in image.tables for e in image.entries(t)] == [int(e) for t in image.tables for k in range(t.count) for e in image.entries(t, k, 1)]
    with pytest.raises(EvidenceError), Image.open(path) as image:
        image.chunk(19)


def test_a_medium_without_chunks_for_its_sectors_is_an_error(tmp_path):
    path = f"{tmp_path}/x.E01"
    write(path, DISK)
    data = bytearray(open(path, "rb").read())
    at = data.index(b"volume\0") + DESCRIPTOR
    data[at + 16 : at + 24] = struct.pack("<Q", 5000)
    open(path, "wb").write(data)
    with Image.open(path) as image, pytest.raises(EvidenceError):
        list(image.stream())


def test_images_stay_open_until_they_change(tmp_path):
    from diskloom.container import reader

    paths = [f"{tmp_path}/{k}.E01" for k in "abc"]
    for p in paths:
        write(p, DISK)
    one = Image.shared(paths[0])
    assert Image.shared(paths[0]) is one and Image.shared(paths[1]) is not one
    write(paths[0], DISK[512:])
    assert Image.shared(paths[0]) is not one and Image.shared(paths[0]).read_sectors(0, 1) == DISK[512:1024]
    Image.shared(paths[2])
    assert len(reader._SHARED) == reader.OPEN_IMAGES
