"""A builder of XFS version 5 volumes: short, block and multi-block directories, extent and tree forks."""

from __future__ import annotations

import struct

from diskloom.build.tree import Dir, Disk, File, tree

BLOCK, INODE, PER = 4096, 512, 8


def build_xfs(files: list[File], label: str = "FIXTURE", bigtime: bool = True) -> bytes:
    root = tree(files)
    dirs = list(root.walk())
    total = len(dirs) + sum(len(d.files) for d in dirs)
    chunks = -(-(total + 3) // 64)
    first_block = 8
    first = first_block * PER
    ids = iter(range(first + 3, 1 << 30))
    root.id = first
    for d in dirs[1:]:
        d.id = next(ids)
    numbers = {id(f): next(ids) for d in dirs for f in d.files.values()}
    disk = Disk(BLOCK, first_block + chunks * 8)
    inodes: dict[int, bytes] = {}

    def packed(at: int, block: int, n: int) -> bytes:
        return struct.pack(">QQ", at << 9 | block >> 43, (block & ((1 << 43) - 1)) << 21 | n)

    def inode(number: int, mode: int, size: int, t: int, form: int, fork: bytes, n: int) -> None:
        raw = bytearray(INODE)
        stamp = (t + (1 << 31)) * 1_000_000_000 if bigtime else t << 32
        struct.pack_into(">2sHBBHIIIHHQ", raw, 0, b"IN", mode, 3, form, 0, 0, 0, 1, 0, 0, 0)
        struct.pack_into(">QQQQQII", raw, 32, stamp, stamp, stamp, size, 0, 0, n)
        struct.pack_into(">QQ", raw, 120, 8 if bigtime else 0, 0)
        raw[176 : 176 + len(fork)] = fork
        inodes[number] = bytes(raw)

    def mapped(number: int, mode: int, size: int, t: int, parts: list[tuple[int, bytes]]) -> None:
        records = []
        for at, data in parts:
            n = -(-len(data) // BLOCK)
            records.append(packed(at // BLOCK, disk.put(data), n))
        if len(records) * 16 <= INODE - 176:
            inode(number, mode, size, t, 2, b"".join(records), len(records))
            return
        leaf = struct.pack(">4sHHQQ", b"BMA3", 0, len(records), (1 << 64) - 1, (1 << 64) - 1).ljust(72, b"\0") + b"".join(records)
        if len(leaf) > BLOCK:
            raise ValueError("too many extents for one leaf")
        where = disk.put(leaf)
        room = (INODE - 176 - 4) // 16
        fork = struct.pack(">HHQ", 1, 1, 0).ljust(4 + 8 * room, b"\0") + struct.pack(">Q", where)
        inode(number, mode, size, t, 3, fork, len(records))

    def folder(d: Dir, parent: int) -> None:
        entries = [(n.encode(), c.id, 2) for n, c in d.dirs.items()] + [(n.encode(), numbers[id(f)], 7 if f.link is not None else 1) for n, f in d.files.items()]
        short = struct.pack(">BBI", min(len(entries), 255), 0, parent) + b"".join(struct.pack(">BH", len(n), k) + n + struct.pack(">BI", t, i) for k, (n, i, t) in enumerate(entries[:255]))
        if len(short) <= INODE - 176 and len(entries) < 256:
            inode(d.id, 0x41ED, len(short), 0, 1, short, 0)
        else:
            every = [(b".", d.id, 2), (b"..", parent, 2), *entries]
            sized = [(n, i, t, -(-(12 + len(n)) // 8) * 8) for n, i, t in every]
            one = 64 + sum(s for *_, s in sized) + 8 * len(every) + 8 <= BLOCK
            blocks: list[bytearray] = []
            for n, i, t, s in sized:
                if not blocks or len(blocks[-1]) + s > BLOCK - (8 * len(every) + 8 if one else 0):
                    blocks.append(bytearray((b"XDB3" if one else b"XDD3").ljust(64, b"\0")))
                at = len(blocks[-1])
                blocks[-1] += (struct.pack(">QB", i, len(n)) + n + bytes([t])).ljust(s - 2, b"\0") + struct.pack(">H", at)
            out = bytearray()
            for b in blocks:
                tail = b"" if not one else bytes(8 * len(every)) + struct.pack(">II", len(every), 0)
                free = BLOCK - len(b) - len(tail)
                if free:
                    b += (struct.pack(">HH", 0xFFFF, free).ljust(free - 2, b"\0") + struct.pack(">H", len(b))) if free >= 8 else bytes(free)
                out += b + tail
            # beyond the data region lies an index that a reader of names passes over
            parts = [(0, bytes(out))] + ([] if one else [(32 << 30, b"\0\0\0\0\0\0\0\0\x3d\xf1".ljust(BLOCK, b"\0"))])
            mapped(d.id, 0x41ED, len(out), 0, parts)
        for c in d.dirs.values():
            folder(c, d.id)
        for f in d.files.values():
            number = numbers[id(f)]
            if f.link is not None:
                target = f.link.encode()
                if len(target) <= INODE - 176:
                    inode(number, 0xA1FF, len(target), f.mtime, 1, target, 0)
                else:
                    mapped(number, 0xA1FF, len(target), f.mtime, [(0, b"XSLM".ljust(56, b"\0") + target)])
            else:
                mapped(number, 0x81A4, f.length, f.mtime, f.pieces())

    folder(root, root.id)
    del folder  # it refers to itself and to the volume, which would stay until garbage is collected
    records = []
    for k in range(chunks):
        free = sum(1 << j for j in range(64) if first + 64 * k + j not in inodes)
        records.append(struct.pack(">IIQ", first + 64 * k, bin(free).count("1"), free))
    leaves = [records[k : k + 250] for k in range(0, len(records), 250)]
    block_of = []
    for part in leaves:
        block_of.append(disk.put(struct.pack(">4sHHII", b"IAB3", 0, len(part), 0xFFFFFFFF, 0xFFFFFFFF).ljust(56, b"\0") + b"".join(part)))
    top, level = block_of[0], 1
    if len(leaves) > 1:
        room = (BLOCK - 56) // 8
        keys = b"".join(p[0][:4] for p in leaves).ljust(4 * room, b"\0")
        top, level = disk.put(struct.pack(">4sHHII", b"IAB3", 1, len(leaves), 0xFFFFFFFF, 0xFFFFFFFF).ljust(56, b"\0") + keys + b"".join(struct.pack(">I", b) for b in block_of)), 2
    blocks = max(disk.next + 1, 128)
    image = disk.image(blocks)
    for number, raw in inodes.items():
        image[number * INODE : (number + 1) * INODE] = raw
    agi = struct.pack(">4sIIIIIII", b"XAGI", 1, 0, blocks, total, top, level, 0).ljust(512, b"\0")
    image[1024:1536] = agi
    sb = bytearray(512)
    struct.pack_into(">4sIQQQ", sb, 0, b"XFSB", BLOCK, blocks, 0, 0)
    struct.pack_into(">QQ", sb, 48, 4, first)
    struct.pack_into(">IIII", sb, 80, 1, blocks, 1, 0)
    struct.pack_into(">HHHH12sBBBBB", sb, 100, 0xB4A5, 512, INODE, PER, label.encode()[:12], 12, 9, 9, 3, (blocks - 1).bit_length())
    struct.pack_into(">III", sb, 208, 0, 0, 1)
    image[:512] = sb
    return bytes(image)
