"""A writer of Expert Witness containers: how rows become evidence in tests and registered queries."""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator

from diskloom.container.reader import DESCRIPTOR, FILE_HEADER, SIGNATURE

LAYOUTS = ("encase1", "encase25", "encase6")


def _section(kind: str, addr: int, body: bytes, after: int | None = None, size: int | None = None) -> bytes:
    size = DESCRIPTOR + len(body) if size is None else size
    head = struct.pack("<16sQQ40x", kind.encode(), addr + DESCRIPTOR + len(body) if after is None else after, size)
    return head + struct.pack("<I", zlib.adler32(head)) + body


def _volume(chunks: int, per: int, sector_bytes: int, sectors: int, level: int) -> bytes:
    body = bytearray(1052)
    struct.pack_into("<B3xIIIQIII", body, 0, 1, chunks, per, sector_bytes, sectors, sectors // (16 * 63) or 1, 16, 63)
    body[36], body[52] = 1, level
    struct.pack_into("<I", body, 56, per)
    body[64:80] = hashlib.md5(struct.pack("<QII", sectors, per, chunks)).digest()
    struct.pack_into("<I", body, 1048, zlib.adler32(bytes(body[:1048])))
    return bytes(body)


def header_text(case: str = "", evidence: str = "", examiner: str = "", description: str = "") -> str:
    return "1\nmain\nc\tn\ta\te\tt\n" + "\t".join((case, evidence, description, examiner, "")) + "\n\n"


def _chunks(parts: list[bytes], size: int) -> Iterator[bytes]:
    """Parts that follow each other, cut into chunks of one size; the last may be shorter."""
    held = bytearray()
    for p in parts:
        at, view = 0, memoryview(p)
        while at < len(view):
            n = min(size - len(held), len(view) - at)
            held += view[at : at + n]
            at += n
            if len(held) == size:
                yield bytes(held)
                held.clear()
    if held:
        yield bytes(held)


def write(path: str, disk: bytes | list[bytes], layout: str = "encase25", compress: bool = True, chunk_sectors: int = 64, sector_bytes: int = 512, slack: int = 0, groups: int = 1, segments: int = 1, hashes: bool = True, short_final: bool = False, table2: bool = True, skip_table: bool = False, header: str | None = None, level: int = 1) -> list[str]:
    """Write the bytes of a disk, or parts of it that follow each other, as a container; returns the files written, each under its final name only when whole.

    The disk is coded and hashed a chunk at a time, and never copied.

    layout: encase1 keeps chunks behind the table in the table section; encase25 has sectors sections and absolute offsets;
    encase6 has offsets relative to a base. groups: pairs of sectors and table sections. segments: files, each with a
    chain of its own. skip_table leaves the tables out (malformed, for tests).
    """
    size = chunk_sectors * sector_bytes
    parts = disk if isinstance(disk, list) else [disk]
    length = sum(map(len, parts))
    sectors = -(-length // sector_bytes)
    md5, sha1, coded = hashlib.md5(), hashlib.sha1(), []
    empty, packed = bytes(size), None
    for p in _chunks([*parts, bytes(sectors * sector_bytes - length)], size):
        md5.update(p)
        sha1.update(p)
        p = p if short_final else p.ljust(size, b"\0")
        if compress and p == empty:
            # most chunks of a sparse disk are this one
            packed = packed or (zlib.compress(p, level), True)
            coded.append(packed)
            continue
        coded.append((zlib.compress(p, level), True) if compress else (p + struct.pack("<I", zlib.adler32(p)), False))
    segments = max(1, min(segments, max(1, len(coded))))
    per_file = -(-len(coded) // segments) if coded else 0
    text = zlib.compress(b"\xff\xfe" + (header or header_text()).encode("utf-16-le"))
    plain = zlib.compress((header or header_text()).encode())
    written = []
    for k in range(segments):
        out = bytearray(SIGNATURE + struct.pack("<BHH", 1, k + 1, 0))
        assert len(out) == FILE_HEADER
        if not k:
            out += _section("header2", len(out), text)
            out += _section("header", len(out), plain)
            out += _section("volume", len(out), _volume(len(coded), chunk_sectors, sector_bytes, sectors, level if compress else 0))
            out += _section("disk", len(out), _volume(len(coded), chunk_sectors, sector_bytes, sectors, level if compress else 0))
        mine = coded[k * per_file : (k + 1) * per_file]
        n = -(-len(mine) // groups) if mine else 0
        for g in range(0, len(mine), n or 1):
            _group(out, mine[g : g + n], layout, slack, table2, skip_table)
        if k + 1 < segments:
            out += _section("next", len(out), b"", after=len(out))
        else:
            out += _section("data", len(out), b"")
            if hashes:
                digest = md5.digest() + sha1.digest() + bytes(40)
                out += _section("digest", len(out), digest + struct.pack("<I", zlib.adler32(digest)))
                body = md5.digest() + bytes(16)
                out += _section("hash", len(out), body + struct.pack("<I", zlib.adler32(body)))
            out += _section("done", len(out), b"", after=len(out))
        stem, ext = os.path.splitext(path)
        name = path if not k else f"{stem}{ext[:-2]}{int(ext[-2:]) + k:02d}"
        temp = f"{os.path.dirname(name)}/.tmp-{os.path.basename(name)}-{os.getpid()}"
        with open(temp, "wb") as f:
            f.write(out)
        os.replace(temp, name)
        written.append(name)
    return written


def _group(out: bytearray, chunks: list[tuple[bytes, bool]], layout: str, slack: int, table2: bool, skip_table: bool) -> None:
    data = b"".join(c for c, _ in chunks)
    room = 24 + 4 * len(chunks) + 4
    if layout == "encase1":
        start = len(out) + DESCRIPTOR + room + slack
    else:
        start = len(out) + DESCRIPTOR + slack
    base = start if layout == "encase6" else 0
    entries, at = bytearray(), start - base
    for c, compressed in chunks:
        entries += struct.pack("<I", at | (0x80000000 if compressed else 0))
        at += len(c)
    head = struct.pack("<I4xQ4x", len(chunks), base)
    table = head + struct.pack("<I", zlib.adler32(head)) + bytes(entries) + struct.pack("<I", zlib.adler32(bytes(entries)))
    if layout == "encase1":
        if not skip_table:
            out += _section("table", len(out), table, after=len(out) + DESCRIPTOR + room + slack + len(data), size=DESCRIPTOR + room)
            out += bytes(slack) + data
        return
    out += _section("sectors", len(out), bytes(slack) + data)
    if not skip_table:
        out += _section("table", len(out), table)
    if table2:
        out += _section("table2", len(out), table)
