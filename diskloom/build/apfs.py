"""A builder of APFS containers: checkpoints, object maps, a catalog of several levels, and packed files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

from diskloom.build.tree import Dir, Disk, File, tree
from diskloom.fs.apfs import DREC, FILE_EXTENT, INODE, SYMLINK_FIELD, XATTR

BLOCK = 4096


def lzvn_pack(data: bytes) -> bytes:
    """A plain LZVN encoder: literals, runs by distance, an end mark."""
    out, at, held = bytearray(), 0, bytearray()

    def flush() -> None:
        k = 0
        while len(held) - k:
            n = min(len(held) - k, 271)
            out.extend(bytes([0xE0 | n]) if n < 16 else bytes([0xE0, n - 16]))
            out.extend(held[k : k + n])
            k += n
        held.clear()

    last: dict[bytes, int] = {}
    while at < len(data):
        key = data[at : at + 4]
        seen = last.get(key)
        if len(key) == 4 and seen is not None and at - seen < 65536:
            n = 4
            while at + n < len(data) and n < 10 and data[seen + n] == data[at + n]:
                n += 1
            flush()
            out.extend(bytes([(n - 3) << 3 | 7]) + struct.pack("<H", at - seen))
            more = 0
            while at + n < len(data) and more < 271 and data[seen + n] == data[at + n]:
                n, more = n + 1, more + 1
            if more:
                out.extend(bytes([0xF0 | more]) if more < 16 else bytes([0xF0, more - 16]))
            last[key] = at
            at += n
        else:
            last[key] = at
            held.append(data[at])
            at += 1
    flush()
    return bytes(out) + b"\x06" + bytes(7)


def pack_unit(kind: int, data: bytes) -> bytes:
    if kind in (3, 4):
        return zlib.compress(data)
    if kind in (7, 8):
        return lzvn_pack(data)
    return (b"\xff" if kind in (13, 14) else b"\xcc") + data


def resource(kind: int, data: bytes) -> bytes:
    """The resource stream of a packed file."""
    units = [pack_unit(kind, data[k : k + 65536]) for k in range(0, len(data), 65536)]
    if kind == 4:
        table, at = b"", 4 + 8 * len(units)
        for u in units:
            table += struct.pack("<II", at, len(u))
            at += len(u)
        body = struct.pack("<I", len(units)) + table + b"".join(units)
        return struct.pack(">IIII", 256, 256 + 4 + len(body), 4 + len(body), 50).ljust(256, b"\0") + struct.pack(">I", len(body)) + body + bytes(50)
    at = 4 * (len(units) + 1)
    ends = struct.pack("<I", at)
    for u in units:
        at += len(u)
        ends += struct.pack("<I", at)
    return ends + b"".join(units)


def _fixed(block_size: int, records: list[tuple[bytes, bytes]], level: int, top: bool) -> bytes:
    toc = b"".join(struct.pack("<HH", 16 * k, 16 * (k + 1) if level == 0 else 8 * (k + 1)) for k in range(len(records)))
    flags = 4 | (1 if top else 0) | (2 if not level else 0)
    head = bytes(32) + struct.pack("<HHIHH12x", flags, level, len(records), 0, len(toc))
    out = bytearray((head + toc + b"".join(k for k, _ in records)).ljust(block_size, b"\0"))
    end = block_size - (40 if top else 0)
    width = 16 if level == 0 else 8
    for k, (_, v) in enumerate(records):
        out[end - width * (k + 1) : end - width * k] = v
    return bytes(out)


def _omap(disk: Disk, entries: list[tuple[int, int, int]]) -> int:
    """An object map of (oid, xid, block); returns its block."""
    records = [(struct.pack("<QQ", o, x), struct.pack("<IIQ", 0, BLOCK, b)) for o, x, b in sorted(entries)]
    per = (BLOCK - 56 - 40) // 36 - 1
    if len(records) <= per:
        top = disk.put(_fixed(BLOCK, records, 0, True))
    else:
        below = [(records[k][0], struct.pack("<Q", disk.put(_fixed(BLOCK, records[k : k + per], 0, False)))) for k in range(0, len(records), per)]
        top = disk.put(_fixed(BLOCK, below, 1, True))
    return disk.put((bytes(32) + struct.pack("<IIIIQ", 0, 0, 0, 0, top)).ljust(BLOCK, b"\0"))


def build_apfs(files: list[File], label: str = "FIXTURE", packed: dict[str, int] | None = None, link_field: Callable[[str], bool] = lambda _: False) -> bytes:
    """packed: decmpfs type by path; link_field: whether a link's target is in its inode rather than in an attribute."""
    root = tree(files)
    ids = iter(range(16, 1 << 40))
    root.id = 2
    for d in list(root.walk())[1:]:
        d.id = next(ids)
    numbers = {id(f): next(ids) for d in root.walk() for f in d.files.values()}
    disk = Disk(BLOCK, 10)
    records: list[tuple[tuple, bytes, bytes]] = []

    def key(oid: int, kind: int, rest: bytes = b"") -> bytes:
        return struct.pack("<Q", oid | kind << 60) + rest

    def inode(oid: int, parent: int, private: int, mode: int, t: int, size: int | None, link: bytes | None = None) -> None:
        ns = t * 1_000_000_000
        value = struct.pack("<QQQQQQQiIIIIIHHQ", parent, private, ns, ns, ns, ns, 0, 1, 0, 0, 0, 0, 0, mode, 0, 0)
        if size is not None:
            value += struct.pack("<HH", 1, 40) + struct.pack("<BBH", 8, 0, 40) + struct.pack("<QQQQQ", size, -(-size // BLOCK) * BLOCK, 0, 0, 0)
        if link is not None:
            value += struct.pack("<HH", 1, len(link)) + struct.pack("<BBH", SYMLINK_FIELD, 0, len(link)) + link.ljust(-(-len(link) // 8) * 8, b"\0")
        records.append(((oid, INODE, 0), key(oid, INODE), value))

    def attribute(oid: int, name: str, flags: int, data: bytes) -> None:
        raw = name.encode() + b"\0"
        records.append(((oid, XATTR, raw), key(oid, XATTR, struct.pack("<H", len(raw)) + raw), struct.pack("<HH", flags, len(data)) + data))

    def extent(stream: int, at: int, data: bytes) -> None:
        n = -(-len(data) // BLOCK) * BLOCK
        records.append(((stream, FILE_EXTENT, at), key(stream, FILE_EXTENT, struct.pack("<Q", at)), struct.pack("<QQQ", n, disk.put(data), 0)))

    def folder(d: Dir, parent: int) -> None:
        inode(d.id, parent, d.id, 0x41ED, 0, None)
        children = [(n, c.id, 4) for n, c in d.dirs.items()] + [(n, numbers[id(f)], 10 if f.link is not None else 8) for n, f in d.files.items()]
        for name, child, kind in children:
            raw = name.encode() + b"\0"
            records.append(((d.id, DREC, raw), key(d.id, DREC, struct.pack("<I", len(raw)) + raw), struct.pack("<QQH", child, 0, kind)))
        for c in d.dirs.values():
            folder(c, d.id)
        for f in d.files.values():
            oid, kind = numbers[id(f)], (packed or {}).get(f.path)
            if f.link is not None and link_field(f.path):
                inode(oid, d.id, oid, 0xA1ED, f.mtime, None, f.link.encode() + b"\0")
            elif f.link is not None:
                inode(oid, d.id, oid, 0xA1ED, f.mtime, None)
                attribute(oid, "com.apple.fs.symlink", 2, f.link.encode() + b"\0")
            elif kind:
                inode(oid, d.id, oid, 0x81A4, f.mtime, None)
                head = struct.pack("<4sIQ", b"fpmc", kind, len(f.data))
                attribute(oid, "com.apple.decmpfs", 2, head + (pack_unit(kind, f.data) if kind % 2 else b""))
                if kind % 2 == 0:
                    stream, data = next(ids), resource(kind, f.data)
                    attribute(oid, "com.apple.ResourceFork", 1, struct.pack("<QQQQQQ", stream, len(data), -(-len(data) // BLOCK) * BLOCK, 0, 0, 0))
                    extent(stream, 0, data)
            else:
                inode(oid, d.id, oid, 0x81A4, f.mtime, f.length)
                for at, data in f.pieces():
                    extent(oid, at, data)

    folder(root, 1)
    del folder  # it refers to itself and to the volume, which would stay until garbage is collected
    mapping: list[tuple[int, int, int]] = []
    oids = iter(range(1 << 20, 1 << 40))

    def node(part: list[tuple[bytes, bytes]], level: int, top: bool) -> int:
        toc, keys, values = b"", bytearray(), bytearray()
        for k, v in part:
            values += v
            toc += struct.pack("<HHHH", len(keys), len(k), len(values), len(v))
            keys += k
        head = bytes(32) + struct.pack("<HHIHH12x", (1 if top else 0) | (0 if level else 2), level, len(part), 0, len(toc))
        out = bytearray((head + toc + bytes(keys)).ljust(BLOCK, b"\0"))
        end = BLOCK - (40 if top else 0)
        at = 0
        for _, v in part:
            at += len(v)
            out[end - at : end - at + len(v)] = v
        oid = next(oids)
        mapping.append((oid, 1, disk.put(bytes(out))))
        return oid

    level, rows = 0, [(k, v) for _, k, v in sorted(records, key=lambda r: (r[0][0], r[0][1], r[0][2] if isinstance(r[0][2], bytes) else struct.pack(">Q", r[0][2])))]
    while True:
        parts: list[list[tuple[bytes, bytes]]] = [[]]
        room = BLOCK - 56 - 40
        for k, v in rows:
            need = 8 + len(k) + len(v)
            if need > room and parts[-1]:
                parts.append([])
                room = BLOCK - 56 - 40
            parts[-1].append((k, v))
            room -= need
        top = len(parts) == 1
        made = [(p[0][0] if p else key(0, 0), struct.pack("<Q", node(p, level, top))) for p in parts]
        if top:
            break
        rows, level = made, level + 1
    tree_oid = struct.unpack("<Q", made[0][1])[0]
    # an older mapping of the same object points at nothing useful
    names = _omap(disk, [*mapping, (tree_oid, 0, 1)])
    apsb = bytearray(BLOCK)
    apsb[32:36] = b"APSB"
    struct.pack_into("<QQ", apsb, 128, names, tree_oid)
    apsb[704 : 704 + len(label)] = label.encode()
    objects = _omap(disk, [(1026, 1, disk.put(bytes(apsb)))])
    blocks = disk.next + 1
    image = disk.image(blocks)
    nx = bytearray(BLOCK)
    struct.pack_into("<QQQII", nx, 0, 0, 1, 1, 0x80000001, 0)
    struct.pack_into("<4sIQ", nx, 32, b"NXSB", BLOCK, blocks)
    struct.pack_into("<II QQ", nx, 104, 4, 4, 1, 5)
    struct.pack_into("<QQQIIQ", nx, 152, 0, 0, 0, 0, 100, 0)
    old = bytes(nx)
    struct.pack_into("<Q", nx, 16, 7)
    struct.pack_into("<Q", nx, 160, objects)
    struct.pack_into("<I", nx, 180, 100)
    struct.pack_into("<Q", nx, 184, 1026)
    image[:BLOCK] = old
    image[2 * BLOCK : 3 * BLOCK] = nx
    return bytes(image)
