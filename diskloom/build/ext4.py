"""A builder of ext4 volumes: extents, linear directories, several block groups."""

from __future__ import annotations

import struct

from diskloom.build.tree import Dir, Disk, File, tree

BLOCK, INODE = 4096, 256


def build_ext4(files: list[File], label: str = "FIXTURE", per_group: int = 8192) -> bytes:
    root = tree(files)
    dirs = list(root.walk())
    ids = iter(range(12, 1 << 30))
    root.id = 2
    for d in dirs[1:]:
        d.id = next(ids)
    numbers = {id(f): next(ids) for d in dirs for f in d.files.values()}
    total_inodes = next(ids)
    data_blocks = sum(-(-len(p) // BLOCK) for f in files for _, p in f.pieces()) + sum(1 + sum(8 + len(n.encode()) + 4 for n in (*d.dirs, *d.files)) // (BLOCK - 300) for d in dirs) + 8
    groups = 1
    while True:
        inodes_group = -(-max(16, total_inodes) // (16 * groups)) * 16
        table = -(-inodes_group * INODE // BLOCK)
        gdt = -(-groups * 64 // BLOCK)
        if groups * (per_group - 2 - table - 1 - gdt) >= data_blocks and inodes_group <= 8 * BLOCK and inodes_group * groups >= total_inodes:
            break
        groups += 1
    starts = [g * per_group + 1 + gdt for g in range(groups)]
    used: set[int] = set()
    for g in range(groups):
        used |= set(range(g * per_group, starts[g] + 2 + table))
    disk, blocks = Disk(BLOCK, 0), groups * per_group
    free = iter(b for b in range(blocks) if b not in used)
    pending = next(free)

    def place(data: bytes) -> list[tuple[int, int, int]]:
        """(file block, length, block) runs, cut where groups' own blocks stand between."""
        nonlocal pending
        out: list[list[int]] = []
        for k in range(-(-len(data) // BLOCK)):
            b, pending = pending, next(free)
            disk.held[b] = data[k * BLOCK : (k + 1) * BLOCK]
            used.add(b)
            if out and out[-1][2] + out[-1][1] == b and out[-1][1] < 32768:
                out[-1][1] += 1
            else:
                out.append([k, 1, b])
        return [tuple(x) for x in out]

    inodes: dict[int, bytes] = {}

    def inode(number: int, mode: int, size: int, mtime: int, links: int, found: list[tuple[int, int, int]], inline: bytes | None = None) -> None:
        raw = bytearray(INODE)
        struct.pack_into("<HHIiiiiHHII", raw, 0, mode, 0, size & 0xFFFFFFFF, mtime, mtime, mtime, 0, 0, links, sum(n for _, n, _ in found) * 8, 0 if inline is not None else 0x80000)
        struct.pack_into("<I", raw, 108, size >> 32)
        if inline is not None:
            raw[40 : 40 + len(inline)] = inline
        elif len(found) <= 4:
            struct.pack_into("<HHHHI", raw, 40, 0xF30A, len(found), 4, 0, 0)
            for k, (at, n, b) in enumerate(found):
                struct.pack_into("<IHHI", raw, 52 + 12 * k, at, n, b >> 32, b & 0xFFFFFFFF)
        else:
            leaf = bytearray(struct.pack("<HHHHI", 0xF30A, len(found), 340, 0, 0))
            for at, n, b in found:
                leaf += struct.pack("<IHHI", at, n, b >> 32, b & 0xFFFFFFFF)
            where = place(bytes(leaf))[0][2]
            struct.pack_into("<HHHHI", raw, 40, 0xF30A, 1, 4, 1, 0)
            struct.pack_into("<IIHH", raw, 52, found[0][0], where & 0xFFFFFFFF, where >> 32, 0)
        inodes[number] = bytes(raw)

    def folder(d: Dir, parent: int) -> None:
        entries = [(b".", d.id, 2), (b"..", parent, 2)]
        entries += [(n.encode(), c.id, 2) for n, c in d.dirs.items()] + [(n.encode(), numbers[id(f)], 7 if f.link is not None else 1) for n, f in d.files.items()]
        out, block = bytearray(), bytearray()
        last = 0
        for name, number, kind in entries:
            need = 8 + -(-len(name) // 4) * 4
            if len(block) + need > BLOCK:
                struct.pack_into("<H", block, last + 4, BLOCK - last)
                out += block.ljust(BLOCK, b"\0")
                block = bytearray()
            last = len(block)
            block += struct.pack("<IHBB", number, need, len(name), kind) + name.ljust(need - 8, b"\0")
        struct.pack_into("<H", block, last + 4, BLOCK - last)
        out += block.ljust(BLOCK, b"\0")
        inode(d.id, 0x41ED, len(out), 0, 2 + len(d.dirs), place(bytes(out)))
        for c in d.dirs.values():
            folder(c, d.id)
        for f in d.files.values():
            if f.link is not None and len(f.link.encode()) < 60:
                inode(numbers[id(f)], 0xA1FF, len(f.link.encode()), f.mtime, 1, [], f.link.encode())
                continue
            found = [(at // BLOCK + k, n, b) for at, data in (f.pieces() if f.link is None else [(0, f.link.encode())]) for k, n, b in place(data)]
            inode(numbers[id(f)], 0x81A4 if f.link is None else 0xA1FF, f.length if f.link is None else len(f.link.encode()), f.mtime, 1, found)

    folder(root, 2)
    del folder  # it refers to itself and to the volume, which would stay until garbage is collected
    image = disk.image(blocks)
    sb = bytearray(1024)
    struct.pack_into("<IIIIIIIIIII", sb, 0, inodes_group * groups, blocks, 0, 0, 0, 0, 2, 2, per_group, per_group, inodes_group)
    struct.pack_into("<HHHHHHIIIIHHIHHIII", sb, 52, 0, 20, 0xEF53, 1, 1, 0, 0, 0, 0, 1, 0, 0, 11, INODE, 0, 0, 0x2 | 0x40, 0x1 | 0x2)
    sb[104:120] = b"diskloom-volume!"
    sb[120:136] = label.encode()[:16].ljust(16, b"\0")
    for g in range(groups):
        at = starts[g]
        struct.pack_into("<IIIHHH", image, (BLOCK if not g else BLOCK) + g * 32, at, at + 1, at + 2, 0, 0, 0)
        own = bytearray(BLOCK)
        for b in range(g * per_group, (g + 1) * per_group):
            if b in used:
                own[(b - g * per_group) >> 3] |= 1 << (b & 7)
        own[per_group // 8 :] = b"\xff" * (BLOCK - per_group // 8)
        image[at * BLOCK : (at + 1) * BLOCK] = own
        bits = bytearray(b"\xff" * BLOCK)
        for i in range(inodes_group):
            number = g * inodes_group + i + 1
            if number in inodes:
                where = (at + 2) * BLOCK + i * INODE
                image[where : where + INODE] = inodes[number]
            elif number > 10:
                bits[i >> 3] &= ~(1 << (i & 7)) & 0xFF
        image[(at + 1) * BLOCK : (at + 2) * BLOCK] = bits
    image[1024:2048] = sb
    return bytes(image)
