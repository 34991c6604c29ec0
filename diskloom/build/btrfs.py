"""A builder of Btrfs volumes: a mapped chunk, a file tree of several levels, inline and disk extents."""

from __future__ import annotations

import struct

from diskloom.build.tree import Dir, File, aligned, tree
from diskloom.fs.btrfs import CHUNK, DATA, DIR_INDEX, DIR_ITEM, INODE, ROOT

NODE, SECTOR, SHIFT = 16384, 4096, 0x4000000
Item = tuple[tuple[int, int, int], bytes]


def build_btrfs(files: list[File], label: str = "FIXTURE", inline: int = 1024) -> bytes:
    root = tree(files)
    ids = iter(range(257, 1 << 40))
    root.id = 256
    for d in list(root.walk())[1:]:
        d.id = next(ids)
    numbers = {id(f): next(ids) for d in root.walk() for f in d.files.values()}
    body = bytearray()
    start = 0x20000

    def store(data: bytes) -> int:
        """Logical address of data placed in the chunk."""
        at = start + len(body)
        body.extend(data.ljust(aligned(len(data), SECTOR), b"\0"))
        return at + SHIFT

    items: list[Item] = []

    def inode(number: int, mode: int, size: int, t: int) -> None:
        raw = bytearray(160)
        struct.pack_into("<QQQQ", raw, 0, 1, 1, size, size)
        struct.pack_into("<III I", raw, 40, 1, 0, 0, mode)
        for at in (112, 124, 136, 148):
            struct.pack_into("<qI", raw, at, t, 0)
        items.append(((number, INODE, 0), bytes(raw)))

    def extent(number: int, at: int, data: bytes) -> None:
        where = store(data)
        n = aligned(len(data), SECTOR)
        items.append(((number, DATA, at), struct.pack("<QQBBHBQQQQ", 1, n, 0, 0, 0, 1, where, n, 0, n)))

    def folder(d: Dir) -> None:
        inode(d.id, 0x41ED, 0, 0)
        children = [(n, c.id, 2) for n, c in d.dirs.items()] + [(n, numbers[id(f)], 7 if f.link is not None else 1) for n, f in d.files.items()]
        for k, (name, child, kind) in enumerate(children):
            raw = name.encode()
            entry = struct.pack("<QBQQHHB", child, INODE, 0, 1, 0, len(raw), kind) + raw
            items.append(((d.id, DIR_INDEX, k + 2), entry))
            items.append(((d.id, DIR_ITEM, (child * 2654435761) & 0xFFFFFFFF), entry))
        for c in d.dirs.values():
            folder(c)
        for f in d.files.values():
            number = numbers[id(f)]
            data = f.link.encode() if f.link is not None else f.data
            inode(number, 0x81A4 if f.link is None else 0xA1FF, len(data) if f.parts is None else f.size, f.mtime)
            if f.parts is None and (len(data) <= inline or f.link is not None):
                if data:
                    items.append(((number, DATA, 0), struct.pack("<QQBBHB", 1, len(data), 0, 0, 0, 0) + data))
                continue
            for at, part in f.pieces():
                extent(number, at, part)

    folder(root)
    del folder  # it refers to itself and to the volume, which would stay until garbage is collected

    def leaf(part: list[Item], logical: int, owner: int) -> bytes:
        head, tail = bytearray(), bytearray(NODE - 101)
        end = NODE - 101
        for key, data in part:
            end -= len(data)
            tail[end : end + len(data)] = data
            head += struct.pack("<QBQII", *key, end, len(data))
        tail[: len(head)] = head
        return _header(logical, owner, len(part), 0) + bytes(tail)

    def grow(found: list[Item], owner: int) -> tuple[int, int]:
        """Write a tree; returns (logical address, level) of its root."""
        found = sorted(found, key=lambda i: i[0])
        parts: list[list[Item]] = [[]]
        room = NODE - 101
        for item in found:
            need = 25 + len(item[1])
            if need > room:
                parts.append([])
                room = NODE - 101
            parts[-1].append(item)
            room -= need
        nodes = []
        for part in parts:
            at = start + len(body) + SHIFT
            store(leaf(part, at, owner))
            nodes.append((part[0][0], at))
        level = 0
        while len(nodes) > 1:
            level += 1
            above = []
            for k in range(0, len(nodes), 400):
                part = nodes[k : k + 400]
                at = start + len(body) + SHIFT
                raw = _header(at, owner, len(part), level) + b"".join(struct.pack("<QBQQQ", *key, where, 1) for key, where in part)
                store(raw.ljust(NODE, b"\0"))
                above.append((part[0][0], at))
            nodes = above
        return nodes[0][1], level

    fs_root, fs_level = grow(items, 5)
    entry = bytearray(439)
    struct.pack_into("<QQQ", entry, 160, 1, 256, fs_root)
    entry[238] = fs_level
    root_at, root_level = grow([((5, ROOT, 0), bytes(entry))], 1)
    total = aligned(start + len(body) + NODE + SECTOR, SECTOR)
    chunk = struct.pack("<QQQQIIIHH", total, 2, 65536, 7, 4096, 4096, 4096, 1, 0) + struct.pack("<QQ16s", 1, 0, b"device-uuid-0001")
    chunk_at, chunk_level = grow([((256, CHUNK, SHIFT), chunk)], 3)
    image = bytearray(total)
    image[start : start + len(body)] = body
    sb = bytearray(4096)
    struct.pack_into("<16sQQ8sQQQQ", sb, 32, b"fsid-diskloom-01", 0x10000, 0, b"_BHRfS_M", 1, root_at, chunk_at, 0)
    struct.pack_into("<QQQQ", sb, 112, total, len(body), 6, 1)
    array = struct.pack("<QBQ", 256, CHUNK, SHIFT) + chunk
    struct.pack_into("<IIIII", sb, 144, SECTOR, NODE, NODE, 4096, len(array))
    sb[198], sb[199] = root_level, chunk_level
    sb[299 : 299 + len(label)] = label.encode()
    sb[811 : 811 + len(array)] = array
    image[0x10000:0x11000] = sb
    return bytes(image)


def _header(logical: int, owner: int, n: int, level: int) -> bytes:
    return bytes(32) + struct.pack("<16sQQ16sQQIB", b"fsid-diskloom-01", logical, 0, b"chunk-tree-uuid1", 1, owner, n, level)
