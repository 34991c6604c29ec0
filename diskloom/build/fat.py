"""Builders of FAT12, FAT16, FAT32 and exFAT volumes."""

from __future__ import annotations

import struct
import time

from diskloom.build.tree import Dir, File, aligned, tree, zeros


def dos(t: int) -> tuple[int, int]:
    """(date, time) of Unix seconds, which DOS keeps from 1980 on to two seconds."""
    y, mo, d, h, mi, s = time.gmtime(t)[:6]
    return ((y - 1980) << 9 | mo << 5 | d, h << 11 | mi << 5 | s // 2) if y >= 1980 else (0, 0)


def _short(name: str, k: int) -> bytes:
    ext = "".join(c for c in name.rpartition(".")[2].upper() if c.isalnum() and c.isascii())[:3] if "." in name else ""
    return f"{f'F{k:06d}~'[:8]:<8}{ext:<3}".encode("ascii")


def _slots(name: str, k: int, attr: int, cluster: int, size: int, mtime: int) -> bytes:
    """Long-name slots and the short one."""
    short = _short(name, k)
    total = 0
    for c in short:
        total = ((total >> 1 | total << 7) + c) & 0xFF
    units = name.encode("utf-16-le")
    if len(units) % 26:
        units += b"\0\0"
        units += b"\xff" * (-len(units) % 26)
    n = len(units) // 26
    out = b""
    for i in range(n, 0, -1):
        u = units[26 * (i - 1) : 26 * i]
        out += bytes([i | (0x40 if i == n else 0)]) + u[:10] + b"\x0f\0" + bytes([total]) + u[10:22] + b"\0\0" + u[22:]
    date, clock = dos(mtime)
    return out + short + struct.pack("<BBBHHHHHHHI", attr, 0, 0, clock, date, date, cluster >> 16, clock, date, cluster & 0xFFFF, size)


def build_fat(files: list[File], bits: int = 32, label: str = "FIXTURE", sector: int = 512, per: int = 1, scatter: bool = False, clusters: int = 0) -> bytes:
    """A volume that holds the files. scatter: file chains step over every other cluster, so no file is contiguous."""
    return b"".join(fat_parts(files, bits, label, sector, per, scatter, clusters))


def fat_parts(files: list[File], bits: int = 32, label: str = "FIXTURE", sector: int = 512, per: int = 1, scatter: bool = False, clusters: int = 0) -> list[bytes | bytearray]:
    """The volume of build_fat in parts that follow each other: its free end, most of a small FAT32 volume, is one block of zeros again and again."""
    root, size = tree(files), sector * per
    need = sum(-(-f.length // size) for f in files) * (2 if scatter else 1)
    slot_bytes = lambda d: sum(32 * (2 + len(x) // 13) for x in (*d.dirs, *d.files)) + 96
    need += sum(-(-slot_bytes(d) // size) for d in root.walk()) + 16
    count = max(need, clusters, {12: 64, 16: 4200, 32: 66_000}[bits])
    if (bits == 12 and count >= 4085) or (bits == 16 and count >= 65525):
        raise ValueError(f"{count} clusters don't fit FAT{bits}")
    entries = [0] * (count + 2)
    end = {12: 0xFFF, 16: 0xFFFF, 32: 0x0FFFFFFF}[bits]
    entries[0], entries[1] = end & ~7, end
    data = bytearray()
    free = 2

    def store(content: bytes, step: int = 1) -> int:
        nonlocal free
        n = -(-len(content) // size)
        if not n:
            return 0
        first = free
        data.extend(bytes(max(0, (first - 2 + (n - 1) * step + 1) * size - len(data))))
        for k in range(n):
            c = first + k * step
            data[(c - 2) * size : (c - 2) * size + len(content[k * size : (k + 1) * size])] = content[k * size : (k + 1) * size]
            entries[c] = end if k == n - 1 else c + step
        free = first + (n - 1) * step + step
        return first

    root_entries = 0 if bits == 32 else aligned(slot_bytes(root) // 32 + 16, sector // 32)
    serial = 0

    def folder(d: Dir, parent: int, top: bool) -> bytes | int:
        nonlocal serial, free
        own = 0
        room = aligned(slot_bytes(d), size)
        if not top or bits == 32:
            own = store(bytes(room))
        out = (f"{label:<11}"[:11].encode() + struct.pack("<B20x", 8)) if top else b""
        if not top:
            out += b".          " + struct.pack("<BBBHHHHHHHI", 16, 0, 0, 0, 0, 0, own >> 16, 0, 0, own & 0xFFFF, 0)
            out += b"..         " + struct.pack("<BBBHHHHHHHI", 16, 0, 0, 0, 0, 0, parent >> 16, 0, 0, parent & 0xFFFF, 0)
        for name, child in d.dirs.items():
            serial += 1
            k = serial
            out += _slots(name, k, 16, folder(child, 0 if top else own, False), 0, 0)
        for name, f in d.files.items():
            serial += 1
            out += _slots(name, serial, 32, store(f.data, 2 if scatter else 1), len(f.data), f.mtime)
        if own:
            at = own
            for k in range(0, len(out), size):
                data[(at - 2) * size : (at - 2) * size + len(out[k : k + size])] = out[k : k + size]
                at = entries[at]
            return own
        return out

    got = folder(root, 0, True)
    del folder  # it refers to itself and to the volume, which would stay until garbage is collected
    if bits == 12:
        table = bytearray()
        for k in range(0, len(entries), 2):
            pair = entries[k] | (entries[k + 1] if k + 1 < len(entries) else 0) << 12
            table += struct.pack("<I", pair)[:3]
    else:
        table = bytearray(struct.pack(f"<{len(entries)}{'H' if bits == 16 else 'I'}", *entries))
    each = -(-len(table) // sector)
    table += bytes(each * sector - len(table))
    reserved = 32 if bits == 32 else 1
    total = reserved + 2 * each + root_entries * 32 // sector + count * per
    boot = bytearray(sector)
    boot[:11] = b"\xeb\x58\x90DISKLOOM"
    struct.pack_into("<HBHBHHBHHHII", boot, 11, sector, per, reserved, 2, root_entries, total if total < 65536 and bits != 32 else 0, 0xF8, each if bits != 32 else 0, 63, 255, 0, total if total >= 65536 or bits == 32 else 0)
    if bits == 32:
        struct.pack_into("<IHHIHH", boot, 36, each, 0, 0, got, 1, 6)
        struct.pack_into("<BBBI11s8s", boot, 64, 0x80, 0, 0x29, 0x1234, f"{label:<11}"[:11].encode(), b"FAT32   ")
    else:
        struct.pack_into("<BBBI11s8s", boot, 36, 0x80, 0, 0x29, 0x1234, f"{label:<11}"[:11].encode(), f"FAT{bits}   ".encode())
    boot[510:512] = b"\x55\xaa"
    fixed = b"" if bits == 32 else got + bytes(root_entries * 32 - len(got))
    return [boot, bytes((reserved - 1) * sector), table, table, fixed, data, *zeros(count * size - len(data))]


def _checksum16(data: bytes, skip: tuple[int, ...] = ()) -> int:
    total = 0
    for k, b in enumerate(data):
        if k not in skip:
            total = ((total >> 1 | (total & 1) << 15) + b) & 0xFFFF
    return total


def entry_set(name: str, is_dir: bool, cluster: int, size: int, mtime: int, contiguous: bool) -> bytes:
    units = name.encode("utf-16-le")
    n = -(-len(units) // 30)
    date, clock = dos(mtime)
    stamp = date << 16 | clock
    head = struct.pack("<BBHHHIIIBBBBB7x", 0x85, 1 + n, 0, 16 if is_dir else 32, 0, stamp, stamp, stamp, 0, 0, 0, 0, 0)
    stream = struct.pack("<BBBBHHQIIQ", 0xC0, 1 | (2 if contiguous else 0), 0, len(units) // 2, _checksum16(name.upper().encode("utf-16-le")), 0, size, 0, cluster, size)
    out = bytearray(head + stream)
    for k in range(n):
        out += b"\xc1\0" + units[30 * k : 30 * k + 30].ljust(30, b"\0")
    struct.pack_into("<H", out, 2, _checksum16(bytes(out), (2, 3)))
    return bytes(out)


def build_exfat(files: list[File], label: str = "FIXTURE", shift: int = 1, contiguous: bool = True) -> bytes:
    """contiguous: files carry the flag that their clusters need no chain; every third one has a chain all the same."""
    root, size = tree(files), 512 << shift
    set_bytes = lambda d: sum(32 * (2 + -(-len(x) // 15)) for x in (*d.dirs, *d.files)) + 64
    count = sum(-(-f.length // size) for f in files) + sum(-(-set_bytes(d) // size) for d in root.walk()) + 16
    table, data, free = [0] * (count + 2), bytearray(count * size), 2
    table[0], table[1] = 0xFFFFFFF8, 0xFFFFFFFF

    def store(content: bytes, chain: bool) -> int:
        nonlocal free
        n = -(-len(content) // size)
        if not n:
            return 0
        first, free = free, free + n
        data[(first - 2) * size : (first - 2) * size + len(content)] = content
        if chain:
            for k in range(n):
                table[first + k] = 0xFFFFFFFF if k == n - 1 else first + k + 1
        return first

    serial = 0

    def folder(d: Dir, top: bool) -> tuple[int, int]:
        nonlocal serial
        room = aligned(set_bytes(d), size)
        own = store(bytes(room), True)
        text = label.encode("utf-16-le")[:22]
        out = (b"\x83" + bytes([len(text) // 2]) + text.ljust(30, b"\0")) if top else b""
        for name, child in d.dirs.items():
            at, n = folder(child, False)
            out += entry_set(name, True, at, n, 0, False)
        for name, f in d.files.items():
            serial += 1
            flat = contiguous and serial % 3 != 0
            out += entry_set(name, False, store(f.data, not flat), len(f.data), f.mtime, flat and bool(f.data))
        data[(own - 2) * size : (own - 2) * size + len(out)] = out
        return own, room

    at, _ = folder(root, True)
    del folder  # it refers to itself and to the volume, which would stay until garbage is collected
    fat_at, fat_len = 24, -(-4 * len(table) // 512)
    heap = aligned(fat_at + fat_len, 1 << shift)
    boot = bytearray(512)
    boot[:11] = b"\xeb\x76\x90EXFAT   "
    struct.pack_into("<QQIIIIIIHHBBBBB", boot, 64, 0, heap + (count << shift), fat_at, fat_len, heap, count, at, 0x5678, 0x100, 0, 9, shift, 1, 0x80, 0)
    boot[510:512] = b"\x55\xaa"
    out = bytearray(bytes(boot) + bytes((heap - 1) * 512) + bytes(data))
    struct.pack_into(f"<{len(table)}I", out, fat_at * 512, *table)
    return bytes(out)
