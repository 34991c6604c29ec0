"""Btrfs: the chunk map, then all items of the file tree."""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator

from diskloom.errors import EvidenceError, Unsupported
from diskloom.fs.base import DIRECTORY, SYMLINK, Entry, Extent, FileSystem, Node, fit

MAX_LEVEL = 8
#: Leaves of the file tree that one task scans.
LEAVES_A_SHARE = 1024
INODE, DIR_ITEM, DIR_INDEX, DATA, ROOT, CHUNK = 1, 84, 96, 108, 132, 228


class Btrfs(FileSystem):
    type = "Btrfs"
    root = 256
    list_times = False

    def __init__(self, volume):
        super().__init__(volume)
        s = volume.read(0x10000, 4096)
        if s[64:72] != b"_BHRfS_M":
            raise EvidenceError("no Btrfs superblock")
        root, chunk = struct.unpack_from("<QQ", s, 80)
        self.total, self.used = struct.unpack_from("<QQ", s, 112)
        self.sector, self.node_size = struct.unpack_from("<II", s, 144)
        if not 4096 <= self.node_size <= 65536:
            raise EvidenceError("a Btrfs node size is out of range")
        self.name = s[299:555].split(b"\0")[0].decode("utf-8", "replace")
        self.map: list[tuple[int, int, int]] = []
        at, end = 811, 811 + struct.unpack_from("<I", s, 160)[0]
        while at + 17 < end:
            logical = struct.unpack_from("<Q", s, at + 9)[0]
            at += 17 + self._chunk(logical, s[at + 17 :])
        for (_, kind, offset), data in self.items(chunk):
            if kind == CHUNK:
                self._chunk(offset, data)
        self.tree = next((struct.unpack_from("<Q", d, 176)[0] for (o, kind, _), d in self.items(root) if o == 5 and kind == ROOT), None)
        if self.tree is None:
            raise EvidenceError("no file tree")

    def _chunk(self, logical: int, data: bytes) -> int:
        length, stripes = struct.unpack_from("<Q", data, 0)[0], struct.unpack_from("<H", data, 44)[0]
        if (logical, length, struct.unpack_from("<Q", data, 56)[0]) not in self.map:
            self.map.append((logical, length, struct.unpack_from("<Q", data, 56)[0]))
            self.map.sort()
        return 48 + 32 * stripes

    def label(self) -> str:
        return self.name

    def block_size(self) -> int:
        return self.sector

    def info(self) -> dict[str, str]:
        return {"total_bytes": str(self.total), "used_bytes": str(self.used)}

    def place(self, logical: int, length: int) -> list[tuple[int, int]]:
        """(offset, length) pieces of a logical range: first stripes."""
        out = []
        while length:
            k = bisect_right(self.map, (logical, 1 << 63, 0)) - 1
            if k < 0 or logical >= self.map[k][0] + self.map[k][1]:
                raise EvidenceError(f"address {logical} is not mapped")
            start, size, phys = self.map[k]
            n = min(length, start + size - logical)
            out.append((phys + logical - start, n))
            logical, length = logical + n, length - n
        return out

    def _node_bytes(self, logical: int) -> tuple[bytes, int, int]:
        """(bytes, entries, level) of a tree node."""
        b = b"".join(self.volume.read(o, n) for o, n in self.place(logical, self.node_size))
        if struct.unpack_from("<Q", b, 48)[0] != logical:
            raise EvidenceError(f"a tree node at {logical} is damaged")
        return b, *struct.unpack_from("<IB", b, 96)

    def leaves(self, logical: int, level: int = 0) -> list[int]:
        """Addresses of a tree's leaves in key order, from its inner nodes alone."""
        if level > MAX_LEVEL:
            raise EvidenceError("a tree is too deep")
        b, n, depth = self._node_bytes(logical)
        below = [struct.unpack_from("<Q", b, 101 + 33 * k + 17)[0] for k in range(n)] if depth else [logical]
        return below if depth <= 1 else [x for p in below for x in self.leaves(p, level + 1)]

    def shares(self) -> int:
        return max(1, -(-len(self.leaves(self.tree)) // LEAVES_A_SHARE))

    def items(self, logical: int, level: int = 0) -> Iterator[tuple[tuple[int, int, int], bytes]]:
        if level > MAX_LEVEL:
            raise EvidenceError("a tree is too deep")
        b, n, depth = self._node_bytes(logical)
        for k in range(n):
            if depth:
                yield from self.items(struct.unpack_from("<Q", b, 101 + 33 * k + 17)[0], level + 1)
            else:
                o, kind, offset, at, size = struct.unpack_from("<QBQII", b, 101 + 25 * k)
                if 101 + at + size > len(b):
                    raise EvidenceError("an item is out of range")
                yield (o, kind, offset), b[101 + at : 101 + at + size]

    def nodes(self, share: int = 0) -> Iterator[Node]:
        """Nodes whose first item lies in the share's leaves; the last one's items are followed into the next leaves."""
        node: Node | None = None
        found: list[Extent] = []
        names: set[bytes] = set()
        leaves = self.leaves(self.tree)
        own = (share + 1) * LEAVES_A_SHARE
        walk = ((k, i) for k in range(share * LEAVES_A_SHARE, len(leaves)) for i in self.items(leaves[k]))
        for k, ((o, kind, offset), d) in walk:
            if node is not None and o != node.id:
                yield self._finish(node, found)
                node = None
            if node is None and k >= own:
                return
            if kind == INODE:
                size, mode = struct.unpack_from("<Q", d, 16)[0], struct.unpack_from("<I", d, 52)[0]
                a, c, m = (struct.unpack_from("<q", d, at)[0] for at in (112, 124, 136))
                node, found, names = Node(o, mode & 0xFFFF, size, m, a, c), [], set()
            elif node is None:
                continue
            elif kind in (DIR_ITEM, DIR_INDEX):
                at = 0
                while at + 30 <= len(d):
                    child, what = struct.unpack_from("<QB", d, at)
                    extra, length, t = struct.unpack_from("<HHB", d, at + 25)
                    name = d[at + 30 : at + 30 + length]
                    at += 30 + length + extra
                    if name not in names and what == INODE:
                        names.add(name)
                        node.entries.append(Entry(name.decode("utf-8", "replace"), child, t == 2, name))
            elif kind == DATA:
                try:
                    found += self._data(offset, d)
                except EvidenceError as e:
                    node.error = str(e)
        if node is not None:
            yield self._finish(node, found)

    def _data(self, offset: int, d: bytes) -> list[Extent]:
        packed, secret, kind = d[16], d[17], d[20]
        if packed or secret:
            raise Unsupported("compressed or encrypted Btrfs data")
        if kind == 0:
            return [Extent(offset, len(d) - 21, -1, "inline", d[21:])]
        disk, _, skip, n = struct.unpack_from("<QQQQ", d, 21)
        # preallocated and absent data read as zeros
        if kind == 2 or not disk:
            return [Extent(offset, n, -1, "hole")]
        out, at = [], offset
        for phys, length in self.place(disk + skip, n):
            out.append(Extent(at, length, phys))
            at += length
        return out

    @staticmethod
    def _finish(node: Node, found: list[Extent]) -> Node:
        if node.mode & 0xF000 != DIRECTORY and not node.error:
            # a trailing hole without an item is not part of the file
            end = max((e.logical + e.length for e in found), default=0)
            node.size = min(node.size, end)
            node.extents = fit(found, node.size)
            if node.mode & 0xF000 == SYMLINK:
                node.link = b"".join(e.inline for e in node.extents).decode("utf-8", "replace")
        return node
