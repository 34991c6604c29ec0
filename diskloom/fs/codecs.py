"""Content packed by decmpfs: zlib, LZVN or stored, in an attribute or in 64 KiB units of a resource stream."""

from __future__ import annotations

import struct
import zlib

from diskloom.errors import EvidenceError, Unsupported

UNIT = 65536


def lzvn(src: bytes, size: int) -> bytes:
    """Decode LZVN; done as soon as size bytes are out, with or without an end mark."""
    out, at, distance = bytearray(), 0, 0

    def literals(n: int) -> None:
        nonlocal at
        if at + n >= len(src):
            raise EvidenceError("LZVN literals run out")
        out.extend(src[at : at + n])
        at += n

    def match(n: int) -> None:
        if not 0 < distance <= len(out):
            raise EvidenceError("an LZVN distance is out of range")
        for _ in range(min(n, size - len(out))):
            out.append(out[-distance])

    while len(out) < size:
        if at >= len(src):
            raise EvidenceError("LZVN data ends early")
        op = src[at]
        low = op & 7
        if op == 0x06:
            break
        if op in (0x0E, 0x16):
            at += 1
        elif op >= 0xF0:
            n = op & 15
            if not n:
                n = src[at + 1] + 16 if at + 1 < len(src) else 0
                at += 1
            at += 1
            match(n)
        elif op >= 0xE0:
            n = op & 15
            if not n:
                n = src[at + 1] + 16 if at + 1 < len(src) else 0
                at += 1
            at += 1
            literals(n)
        elif 0xA0 <= op < 0xC0:
            if at + 3 > len(src):
                raise EvidenceError("LZVN data ends early")
            pair = src[at + 1] | src[at + 2] << 8
            at += 3
            literals((op >> 3) & 3)
            distance = pair >> 2
            match(((op & 7) << 2 | (pair & 3)) + 3)
        elif 0x70 <= op < 0x80 or op >= 0xD0 or (low == 6 and op < 0x40):
            raise EvidenceError(f"LZVN operation {op:#x}")
        else:
            width = {6: 1, 7: 3}.get(low, 2)
            if at + width > len(src):
                raise EvidenceError("LZVN data ends early")
            if low == 7:
                distance_new = src[at + 1] | src[at + 2] << 8
            elif low == 6:
                distance_new = distance
            else:
                distance_new = low << 8 | src[at + 1]
            at += width
            literals(op >> 6)
            distance = distance_new
            match(((op >> 3) & 7) + 3)
    if len(out) < size:
        raise EvidenceError(f"LZVN gives {len(out)} of {size} bytes")
    return bytes(out[:size])


def _unit(kind: str, data: bytes, size: int) -> bytes:
    if kind == "zlib":
        if data[:1] and data[0] & 15 == 15:
            return data[1 : 1 + size]
        try:
            return zlib.decompress(data)[:size]
        except zlib.error as e:
            raise EvidenceError(f"a packed unit can't be inflated: {e}") from e
    if kind == "lzvn":
        return data[1 : 1 + size] if data[:1] == b"\x06" else lzvn(data, size)
    if kind == "marked":
        if data[:1] != b"\xff":
            raise Unsupported("LZBITMAP data")
        return data[1 : 1 + size]
    return data[1 : 1 + size]


KINDS = {3: "zlib", 4: "zlib", 7: "lzvn", 8: "lzvn", 9: "raw", 10: "raw", 13: "marked", 14: "marked"}


def decode(codec: str, packed: bytes, size: int) -> bytes:
    """codec: decmpfs:N. Odd types hold one unit, even ones a resource stream of units."""
    kind = int(codec.partition(":")[2])
    if kind not in KINDS:
        raise Unsupported(f"decmpfs type {kind}")
    if kind % 2:
        out = _unit(KINDS[kind], packed, size)
    else:
        if kind == 4:
            start = struct.unpack_from(">I", packed, 0)[0] + 4
            n = struct.unpack_from("<I", packed, start)[0]
            places = [struct.unpack_from("<II", packed, start + 4 + 8 * k) for k in range(n)]
            units = [packed[start + o : start + o + length] for o, length in places]
        else:
            n = struct.unpack_from("<I", packed, 0)[0] // 4 - 1
            ends = struct.unpack_from(f"<{n + 1}I", packed, 0)
            units = [packed[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        out = b"".join(_unit(KINDS[kind], u, min(UNIT, size - k * UNIT)) for k, u in enumerate(units))
    if len(out) != size:
        raise EvidenceError(f"a packed file gives {len(out)} of {size} bytes")
    return out
