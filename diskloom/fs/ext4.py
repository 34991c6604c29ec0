"""ext4, and the ext2 and ext3 volumes that share its layout."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from diskloom.errors import EvidenceError, Unsupported
from diskloom.fs.base import DIRECTORY, MAX_EXTENTS, REGULAR, SYMLINK, Entry, Extent, FileSystem, Node, fit

GROUPS_A_SHARE = 16
MAX_LEVEL = 5


class Ext4(FileSystem):
    type = "ext4"
    root = 2
    list_times = False

    def __init__(self, volume):
        super().__init__(volume)
        s = volume.read(1024, 1024)
        if s[56:58] != b"\x53\xef":
            raise EvidenceError("no ext superblock")
        self.sb = s
        inodes, blocks = struct.unpack_from("<II", s, 0)
        self.first_block, log = struct.unpack_from("<II", s, 20)
        if log > 6:
            raise EvidenceError("an ext block size is out of range")
        self.size = 1024 << log
        self.per_group, _, self.inodes_group = struct.unpack_from("<III", s, 32)
        self.incompat = struct.unpack_from("<I", s, 96)[0]
        self.inode_size = struct.unpack_from("<H", s, 88)[0] if struct.unpack_from("<I", s, 76)[0] else 128
        self.desc = struct.unpack_from("<H", s, 254)[0] or 32 if self.incompat & 0x80 else 32
        if self.incompat & 0x80:
            blocks |= struct.unpack_from("<I", s, 336)[0] << 32
        if not self.per_group or not self.inodes_group or self.inode_size < 128:
            raise EvidenceError("an ext superblock is out of range")
        self.groups = -(-(blocks - self.first_block) // self.per_group)
        if self.incompat & 0x10:
            raise Unsupported("ext4 with meta block groups")
        self.inodes = inodes
        self._table = volume.read((self.first_block + 1) * self.size, self.groups * self.desc)

    def label(self) -> str:
        return self.sb[120:136].split(b"\0")[0].decode("utf-8", "replace")

    def block_size(self) -> int:
        return self.size

    def info(self) -> dict[str, str]:
        return {"uuid": self.sb[104:120].hex(), "inodes": str(self.inodes)}

    def shares(self) -> int:
        return -(-self.groups // GROUPS_A_SHARE)

    def nodes(self, share: int = 0) -> Iterator[Node]:
        for g in range(share * GROUPS_A_SHARE, min(self.groups, (share + 1) * GROUPS_A_SHARE)):
            d = self._table[g * self.desc : (g + 1) * self.desc]
            at = struct.unpack_from("<I", d, 8)[0] | (struct.unpack_from("<I", d, 40)[0] << 32 if self.desc >= 64 else 0)
            flags = struct.unpack_from("<H", d, 18)[0]
            unused = struct.unpack_from("<H", d, 28)[0] if not flags & 1 and struct.unpack_from("<I", self.sb, 100)[0] & 0x410 else 0
            count = 0 if flags & 1 and g else self.inodes_group - unused
            step = 4096
            for k in range(0, count, step):
                n = min(step, count - k)
                raw = self.volume.read(at * self.size + k * self.inode_size, n * self.inode_size)
                for i in range(n):
                    number = g * self.inodes_group + k + i + 1
                    inode = raw[i * self.inode_size : (i + 1) * self.inode_size]
                    mode, links = struct.unpack_from("<H", inode, 0)[0], struct.unpack_from("<H", inode, 26)[0]
                    if not mode or not links or (number < 11 and number != 2):
                        continue
                    yield self.node(number, inode)

    def node(self, number: int, inode: bytes) -> Node:
        mode = struct.unpack_from("<H", inode, 0)[0]
        size = struct.unpack_from("<I", inode, 4)[0] | struct.unpack_from("<I", inode, 108)[0] << 32
        a, c, m = struct.unpack_from("<iii", inode, 8)
        flags = struct.unpack_from("<I", inode, 32)[0]
        node = Node(number, mode, size, m, a, c)
        kind = mode & 0xF000
        try:
            if kind == SYMLINK and size < 60 and not flags & 0x80000:
                node.link = inode[40 : 40 + size].decode("utf-8", "replace")
                node.extents = [Extent(0, size, -1, "inline", inode[40 : 40 + size])]
                return node
            if kind not in (DIRECTORY, REGULAR, SYMLINK):
                return node
            if flags & 0x800:
                raise Unsupported("an encrypted ext4 file")
            if flags & 0x10000000:
                raise Unsupported("ext4 inline data")
            extents = self._extents(inode[40:100]) if flags & 0x80000 else self._mapped(inode[40:100], size)
            node.extents = fit(extents, size)
            if kind == DIRECTORY:
                node.entries = list(self._entries(self._bytes(node.extents)))
            elif kind == SYMLINK:
                node.link = self._bytes(node.extents).decode("utf-8", "replace")
        except EvidenceError as e:
            node.error = str(e)
        return node

    def _bytes(self, extents: list[Extent]) -> bytes:
        if sum(e.length for e in extents) > 1 << 30:
            raise EvidenceError("a directory is too large")
        return b"".join(self.volume.read(e.phys, e.length) if e.kind == "data" else bytes(e.length) for e in extents)

    def _extents(self, raw: bytes, level: int = 0) -> list[Extent]:
        magic, count, _, depth = struct.unpack_from("<HHHH", raw, 0)
        if magic != 0xF30A or level > MAX_LEVEL or 12 + 12 * count > len(raw):
            raise EvidenceError("an extent tree is damaged")
        out: list[Extent] = []
        for k in range(count):
            block, length, high, low = struct.unpack_from("<IHHI", raw, 12 + 12 * k)
            if depth:
                low, high = struct.unpack_from("<IH", raw, 16 + 12 * k)
                out += self._extents(self.volume.read((high << 32 | low) * self.size, self.size), level + 1)
            elif length > 32768:
                out.append(Extent(block * self.size, (length - 32768) * self.size, -1, "hole"))
            else:
                out.append(Extent(block * self.size, length * self.size, (high << 32 | low) * self.size))
            if len(out) > MAX_EXTENTS:
                raise EvidenceError("too many extents")
        return out

    def _mapped(self, raw: bytes, size: int) -> list[Extent]:
        """Direct and indirect block pointers."""
        want = -(-size // self.size)
        blocks: list[int] = list(struct.unpack_from("<12I", raw, 0))

        def below(block: int, depth: int) -> None:
            span = (self.size // 4) ** depth
            if len(blocks) >= want:
                return
            if not block:
                blocks.extend([0] * min(span, want - len(blocks)))
                return
            for p in struct.unpack(f"<{self.size // 4}I", self.volume.read(block * self.size, self.size)):
                if depth == 1:
                    blocks.append(p)
                else:
                    below(p, depth - 1)
                if len(blocks) >= want:
                    return

        if want > MAX_EXTENTS:
            raise EvidenceError("too many blocks")
        for k, p in enumerate(struct.unpack_from("<3I", raw, 48), 1):
            below(p, k)
        return [Extent(k * self.size, self.size, b * self.size) for k, b in enumerate(blocks[:want]) if b]

    def _entries(self, data: bytes) -> Iterator[Entry]:
        at = 0
        while at + 8 <= len(data):
            inode, length, n, kind = struct.unpack_from("<IHBB", data, at)
            if length < 8 or at + length > len(data):
                raise EvidenceError("a directory entry is out of range")
            name = data[at + 8 : at + 8 + n]
            if inode and n and name not in (b".", b"..") and kind != 0xDE:
                yield Entry(name.decode("utf-8", "replace"), inode, kind == 2, name)
            at += length
