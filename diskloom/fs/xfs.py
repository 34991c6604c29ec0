"""XFS, versions 4 and 5."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from diskloom.errors import EvidenceError, Unsupported
from diskloom.fs.base import DIRECTORY, MAX_EXTENTS, REGULAR, SYMLINK, Entry, Extent, FileSystem, Node, fit

DATA_END = 32 << 30
MAX_LEVEL = 8


class Xfs(FileSystem):
    type = "XFS"
    list_times = False

    def __init__(self, volume):
        super().__init__(volume)
        s = volume.read(0, 512)
        self.size, = struct.unpack_from(">I", s, 4)
        if s[:4] != b"XFSB" or not 512 <= self.size <= 65536 or self.size & (self.size - 1):
            raise EvidenceError("no XFS superblock")
        self.root = struct.unpack_from(">Q", s, 56)[0]
        self.ag_blocks, self.ag_count = struct.unpack_from(">II", s, 84)
        self.v5 = struct.unpack_from(">H", s, 100)[0] & 15 == 5
        self.sector, self.inode_size = struct.unpack_from(">HH", s, 102)
        self.name = s[108:120].split(b"\0")[0].decode("utf-8", "replace")
        self.inode_log, self.per_block_log, self.ag_log = s[122], s[123], s[124]
        if not self.inode_size or not self.ag_blocks or self.inode_size != 1 << self.inode_log or not self.sector:
            raise EvidenceError("an XFS superblock is out of range")
        incompat = struct.unpack_from(">I", s, 216)[0] if self.v5 else 0
        self.file_types = bool(incompat & 1) if self.v5 else bool(struct.unpack_from(">I", s, 200)[0] & 0x200)
        self.sparse = bool(incompat & 2)

    def label(self) -> str:
        return self.name

    def block_size(self) -> int:
        return self.size

    def shares(self) -> int:
        return self.ag_count

    def place(self, fsblock: int) -> int:
        return ((fsblock >> self.ag_log) * self.ag_blocks + (fsblock & ((1 << self.ag_log) - 1))) * self.size

    def nodes(self, share: int = 0) -> Iterator[Node]:
        """All allocated inodes of one allocation group."""
        base = share * self.ag_blocks * self.size
        agi = self.volume.read(base + 2 * self.sector, self.sector)
        if agi[:4] != b"XAGI":
            raise EvidenceError(f"allocation group {share} has no inode header")
        _, root, level = struct.unpack_from(">III", agi, 16)
        for start, holes, free in self._records(base, root, level):
            for k in range(64):
                if free >> k & 1 or holes >> (k // 4) & 1:
                    continue
                number = share << (self.ag_log + self.per_block_log) | (start + k)
                block, slot = divmod(start + k, 1 << self.per_block_log)
                raw = self.volume.read(base + block * self.size + slot * self.inode_size, self.inode_size)
                node = self.node(number, raw)
                if node:
                    yield node

    def _records(self, base: int, block: int, level: int) -> Iterator[tuple[int, int, int]]:
        if level > MAX_LEVEL:
            raise EvidenceError("an inode tree is too deep")
        b = self.volume.read(base + block * self.size, self.size)
        head = 56 if self.v5 else 16
        if b[:4] != (b"IAB3" if self.v5 else b"IABT"):
            raise EvidenceError("an inode tree block is damaged")
        depth, n = struct.unpack_from(">HH", b, 4)
        if depth:
            room = (self.size - head) // 8
            for p in struct.unpack_from(f">{n}I", b, head + 4 * room):
                yield from self._records(base, p, level + 1)
            return
        for k in range(n):
            start, mid, free = struct.unpack_from(">IIQ", b, head + 16 * k)
            yield start, mid >> 16 if self.sparse else 0, free

    def _times(self, raw: bytes) -> list[int]:
        if self.v5 and struct.unpack_from(">Q", raw, 120)[0] & 8:
            return [struct.unpack_from(">Q", raw, at)[0] // 1_000_000_000 - (1 << 31) for at in (32, 40, 48)]
        return [struct.unpack_from(">I", raw, at)[0] for at in (32, 40, 48)]

    def node(self, number: int, raw: bytes) -> Node | None:
        if raw[:2] != b"IN":
            return None
        mode, version, form = struct.unpack_from(">HBB", raw, 2)
        if not mode:
            return None
        a, m, c = self._times(raw)
        node = Node(number, mode, struct.unpack_from(">Q", raw, 56)[0], m, a, c)
        kind = mode & 0xF000
        if kind not in (DIRECTORY, REGULAR, SYMLINK):
            return node
        start = 176 if version >= 3 else 100
        end = start + raw[82] * 8 if raw[82] else self.inode_size
        fork = raw[start:end]
        try:
            if form == 1:
                data = fork[: node.size]
                if kind == DIRECTORY:
                    node.entries = list(self._short(data))
                else:
                    node.link = data.decode("utf-8", "replace") if kind == SYMLINK else None
                    node.extents = [Extent(0, len(data), -1, "inline", data)] if data else []
                return node
            if form == 2:
                found = [self._extent(fork[16 * k : 16 * k + 16]) for k in range(struct.unpack_from(">I", raw, 76)[0])]
            elif form == 3:
                found = self._tree(fork)
            else:
                raise Unsupported(f"XFS fork format {form}")
            if kind == DIRECTORY:
                node.entries = [e for x in found if x.logical < DATA_END and x.kind == "data" for e in self._blocks(x, node.size)]
            elif kind == SYMLINK:
                head = 56 if self.v5 else 0
                node.link = b"".join(self.volume.read(x.phys + k, min(self.size, x.length - k))[head:] for x in found for k in range(0, x.length, self.size))[: node.size].decode("utf-8", "replace")
                node.extents = [Extent(0, node.size, -1, "inline", node.link.encode())]
            else:
                node.extents = fit(found, node.size)
        except (EvidenceError, struct.error) as e:
            node.error = str(e)
        return node

    def _extent(self, raw: bytes) -> Extent:
        high, low = struct.unpack(">QQ", raw)
        unwritten, offset = high >> 63, (high & ((1 << 63) - 1)) >> 9
        block, count = (high & 511) << 43 | low >> 21, low & ((1 << 21) - 1)
        return Extent(offset * self.size, count * self.size, -1 if unwritten else self.place(block), "hole" if unwritten else "data")

    def _tree(self, fork: bytes, level: int = 0) -> list[Extent]:
        depth, n = struct.unpack_from(">HH", fork, 0)
        room = (len(fork) - 4) // 16
        if not depth or n > room:
            raise EvidenceError("an extent tree is damaged")
        return [e for p in struct.unpack_from(f">{n}Q", fork, 4 + 8 * room) for e in self._below(p, level + 1)]

    def _below(self, block: int, level: int) -> list[Extent]:
        b = self.volume.read(self.place(block), self.size)
        head = 72 if self.v5 else 24
        if level > MAX_LEVEL or b[:4] != (b"BMA3" if self.v5 else b"BMAP"):
            raise EvidenceError("an extent tree is damaged")
        depth, n = struct.unpack_from(">HH", b, 4)
        if not depth:
            if n > MAX_EXTENTS:
                raise EvidenceError("too many extents")
            return [self._extent(b[head + 16 * k : head + 16 * k + 16]) for k in range(n)]
        room = (self.size - head) // 16
        return [e for p in struct.unpack_from(f">{n}Q", b, head + 8 * room) for e in self._below(p, level + 1)]

    def _short(self, data: bytes) -> Iterator[Entry]:
        count, wide = data[0], data[1]
        n = 8 if wide else 4
        at = 2 + n
        for _ in range(wide if wide else count):
            length = data[at]
            name = data[at + 3 : at + 3 + length]
            at += 3 + length
            kind = data[at] if self.file_types else 0
            at += 1 if self.file_types else 0
            yield Entry(name.decode("utf-8", "replace"), int.from_bytes(data[at : at + n], "big"), kind == 2, name)
            at += n

    def _blocks(self, extent: Extent, size: int) -> Iterator[Entry]:
        for k in range(0, extent.length, self.size):
            b = self.volume.read(extent.phys + k, self.size)
            magic = b[:4]
            if magic not in (b"XDB3", b"XDD3", b"XD2B", b"XD2D"):
                continue
            at, end = (64 if magic in (b"XDB3", b"XDD3") else 16), self.size
            if magic in (b"XDB3", b"XD2B"):
                end = self.size - 8 - 8 * struct.unpack_from(">I", b, self.size - 8)[0]
            while at < end:
                if b[at : at + 2] == b"\xff\xff":
                    step = struct.unpack_from(">H", b, at + 2)[0]
                    if step < 8:
                        raise EvidenceError("a directory block is damaged")
                    at += step
                    continue
                number, length = struct.unpack_from(">QB", b, at)
                name = b[at + 9 : at + 9 + length]
                kind = b[at + 9 + length] if self.file_types else 0
                at += -(-(9 + length + (1 if self.file_types else 0) + 2) // 8) * 8
                if name not in (b".", b".."):
                    yield Entry(name.decode("utf-8", "replace"), number, kind == 2, name)
