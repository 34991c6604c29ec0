"""Disks with partition tables around volumes."""

from __future__ import annotations

import struct
import zlib

CODES = {"NTFS": 0x07, "exFAT": 0x07, "FAT12": 0x01, "FAT16": 0x06, "FAT32": 0x0C}


def mbr_entry(code: int, start: int, size: int) -> bytes:
    return struct.pack("<B3sB3sII", 0, b"\xfe\xff\xff", code, b"\xfe\xff\xff", start, size)


def mbr_disk(volumes: list[tuple[int, bytes]], first: int = 63) -> bytes:
    """(type code, volume) in up to four primary partitions, and a last empty sector."""
    return b"".join(mbr_parts([(code, [v]) for code, v in volumes], first))


def mbr_parts(volumes: list[tuple[int, list[bytes]]], first: int = 63) -> list[bytes]:
    """The disk of mbr_disk in parts that follow each other, from volumes in parts; no volume is copied."""
    at, entries, body = first, b"", []
    for code, parts in volumes:
        size = sum(map(len, parts))
        n = -(-size // 512)
        entries += mbr_entry(code, at, n)
        body += [*parts, bytes(n * 512 - size)]
        at += n
    head = bytes(446) + entries.ljust(64, b"\0") + b"\x55\xaa"
    return [head, bytes((first - 1) * 512), *body, bytes(512)]


def gpt_disk(volumes: list[tuple[bytes, str, bytes]]) -> bytes:
    """(type GUID, name, volume) after a protective entry."""
    at, entries, body = 40, bytearray(), bytearray()
    for k, (guid, name, v) in enumerate(volumes):
        n = max(1, -(-len(v) // 512))
        entries += struct.pack("<16s16sQQQ72s", guid, bytes([k + 1] * 16), at, at + n - 1, 0, name.encode("utf-16-le")[:72])
        body += v.ljust(n * 512, b"\0")
        at += n
    table = bytes(entries).ljust(128 * 128, b"\0")
    head = bytearray(struct.pack("<8sIIIIQQQQ16sQIII", b"EFI PART", 0x10000, 92, 0, 0, 1, at, 40, at - 1, b"disk-guid-000001", 2, 128, 128, zlib.crc32(table)))
    struct.pack_into("<I", head, 16, zlib.crc32(bytes(head)))
    first = bytes(446) + mbr_entry(0xEE, 1, at - 1).ljust(64, b"\0") + b"\x55\xaa"
    return (first + bytes(head).ljust(512, b"\0") + table).ljust(40 * 512, b"\0") + bytes(body) + bytes(512)
