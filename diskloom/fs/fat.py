"""FAT12, FAT16 and FAT32."""

from __future__ import annotations

import struct
from calendar import timegm
from collections.abc import Iterator

import numpy as np

from diskloom.errors import EvidenceError
from diskloom.fs.base import DIRECTORY, REGULAR, Entry, Extent, FileSystem, Node, fit

MAX_CHAIN = 1 << 22
MAX_DIRECTORY = 1 << 30


def dos_time(date: int, time: int) -> int:
    """Unix seconds of a DOS date and time in UTC; out of range gives 0, an impossible day rolls over."""
    month, day = date >> 5 & 15, date & 31
    hour, minute, second = time >> 11, time >> 5 & 63, (time & 31) * 2
    if not 1 <= month <= 12 or not day or hour > 23 or minute > 59 or second > 59:
        return 0
    return timegm((1980 + (date >> 9), month, 1, hour, minute, second)) + (day - 1) * 86400


def follow(table: np.ndarray, first: int, end: int, bad: int) -> list[int]:
    """The clusters of a chain. Loops, free or bad clusters and absurd lengths are errors."""
    chain, seen, at = [], set(), first
    while at < end:
        if at < 2 or at >= len(table) or at == bad:
            raise EvidenceError(f"a cluster chain runs into cluster {at}")
        if at in seen or len(chain) >= MAX_CHAIN:
            raise EvidenceError(f"a cluster chain from {first} loops")
        seen.add(at)
        chain.append(at)
        at = int(table[at])
    return chain


class Fat(FileSystem):
    def __init__(self, volume):
        super().__init__(volume)
        self.base = 0
        head = volume.block(0, 64 * 512)
        for at in range(0, len(head) - 511, 512):
            b = head[at : at + 512]
            size, per, reserved, copies, root = struct.unpack_from("<HBHBH", b, 11)
            if size in (512, 1024, 2048, 4096) and per and not per & (per - 1) and reserved and copies in (1, 2, 3, 4) and b[21] >= 0xF0:
                break
        else:
            raise EvidenceError("no FAT boot sector")
        self.base = at
        self.sector, self.per, self.root_entries, self.boot = size, per, root, b
        total = struct.unpack_from("<H", b, 19)[0] or struct.unpack_from("<I", b, 32)[0]
        each = struct.unpack_from("<H", b, 22)[0] or struct.unpack_from("<I", b, 36)[0]
        self.cluster = size * per
        self.fat_at = at + reserved * size
        self.root_at = self.fat_at + copies * each * size
        self.data_at = self.root_at + -(-root * 32 // size) * size
        count = (total - (self.data_at - at) // size) // per
        wide = not struct.unpack_from("<H", b, 22)[0]
        self.bits = 32 if wide else 12 if count < 4085 else 16
        self.type = f"FAT{self.bits}"
        raw = volume.block(self.fat_at, min(each * size, (count + 2) * self.bits // 8 + 2))
        if self.bits == 12:
            x = np.frombuffer(raw + b"\0\0", np.uint8).astype(np.uint32)
            k = np.arange(min(count + 2, len(raw) * 2 // 3))
            pair = x[k * 3 // 2] | x[k * 3 // 2 + 1] << 8
            self.table = np.where(k & 1, pair >> 4, pair & 0xFFF)
        elif self.bits == 16:
            self.table = np.frombuffer(raw[: len(raw) // 2 * 2], "<u2")[: count + 2]
        else:
            self.table = np.frombuffer(raw[: len(raw) // 4 * 4], "<u4")[: count + 2] & 0x0FFFFFFF
        self.end = {12: 0xFF8, 16: 0xFFF8, 32: 0x0FFFFFF8}[self.bits]
        self.first_root = struct.unpack_from("<I", b, 44)[0] if wide else 0

    def block_size(self) -> int:
        return self.cluster

    def info(self) -> dict[str, str]:
        """What the boot sector says; a volume without a name is called NO NAME there."""
        b, wide = self.boot, self.bits == 32
        total = struct.unpack_from("<H", b, 19)[0] or struct.unpack_from("<I", b, 32)[0]
        each = struct.unpack_from("<H", b, 22)[0] or struct.unpack_from("<I", b, 36)[0]
        at = 67 if wide else 39
        told = {"sector_bytes": self.sector, "sectors_a_cluster": self.per, "reserved": struct.unpack_from("<H", b, 14)[0], "copies": b[16], "root_entries": self.root_entries, "total_sectors": total, "sectors_a_fat": each, "root_cluster": self.first_root, "serial": f"{struct.unpack_from('<I', b, at)[0]:08x}", "boot_label": b[at + 4 : at + 15].rstrip(b" \0").decode("cp437") or "NO NAME"}
        return {k: str(v) for k, v in told.items()}

    def place(self, cluster: int) -> int:
        return self.data_at + (cluster - 2) * self.cluster

    def chain(self, first: int) -> list[int]:
        return follow(self.table, first, self.end, self.end - 1)

    def _runs(self, first: int) -> list[tuple[int, int]]:
        """(offset, length) of a directory's pieces; the root of FAT12 and FAT16 is one fixed piece."""
        if not first:
            return [(self.root_at, self.root_entries * 32)] if self.bits < 32 else [(self.place(c), self.cluster) for c in self.chain(self.first_root)]
        return [(self.place(c), self.cluster) for c in self.chain(first)]

    def slots(self, first: int) -> Iterator[tuple[int, bytes, str]]:
        """(offset, slot, name) of each short entry, labels included. Long names may straddle clusters."""
        long: list[bytes] = []
        total = 0
        for at, length in self._runs(first):
            total += length
            if total > MAX_DIRECTORY:
                raise EvidenceError("a directory is too large")
            data = self.volume.read(at, length)
            for k in range(0, length, 32):
                s = data[k : k + 32]
                if s[0] == 0:
                    return
                if s[0] == 0xE5:
                    long = []
                    continue
                if s[11] & 0x3F == 0x0F:
                    if s[0] & 0x40:
                        long = []
                    long.insert(0, s[1:11] + s[14:26] + s[28:32])
                    continue
                short = (b"\xe5" + s[1:8] if s[0] == 5 else s[:8]).rstrip(b" ").decode("cp437")
                ext = s[8:11].rstrip(b" ").decode("cp437")
                short = short.lower() if s[12] & 8 else short
                ext = ext.lower() if s[12] & 16 else ext
                name = short + ("." + ext if ext else "")
                if long:
                    units = b"".join(long)
                    end = next((u for u in range(0, len(units), 2) if units[u : u + 2] == b"\0\0"), len(units))
                    name = units[:end].decode("utf-16-le", "replace")
                long = []
                yield at + k, s, name

    def label(self) -> str:
        for _, s, _ in self.slots(0):
            if s[11] & 0x18 == 8:
                return s[:11].rstrip(b" ").decode("cp437")
        at = 71 if self.bits == 32 else 43
        return self.boot[at : at + 11].rstrip(b" \0").decode("cp437")

    def nodes(self, share: int = 0) -> Iterator[Node]:
        todo, seen = [(0, 0, None)], {0}
        while todo:
            ident, first, slot = todo.pop()
            node = Node(ident, DIRECTORY)
            if slot:
                self._facts(node, slot)
            try:
                for at, s, name in self.slots(first):
                    if s[11] & 8 or name in (".", ".."):
                        continue
                    is_dir = bool(s[11] & 16)
                    node.entries.append(Entry(name, at, is_dir, s[:11]))
                    start = struct.unpack_from("<H", s, 20)[0] << 16 | struct.unpack_from("<H", s, 26)[0]
                    start = start if self.bits == 32 else start & 0xFFFF
                    if is_dir:
                        if start and start not in seen:
                            seen.add(start)
                            todo.append((at, start, s))
                        else:
                            yield Node(at, DIRECTORY, error=f"a directory at cluster {start} that is another's")
                        continue
                    yield self._file(at, s, start)
            except EvidenceError as e:
                node.error = str(e)
            yield node

    @staticmethod
    def _facts(node: Node, s: bytes) -> None:
        node.hidden, node.system, node.readonly = bool(s[11] & 2), bool(s[11] & 4), bool(s[11] & 1)
        node.mtime = dos_time(*reversed(struct.unpack_from("<HH", s, 22)))
        node.ctime = dos_time(struct.unpack_from("<H", s, 16)[0], struct.unpack_from("<H", s, 14)[0])
        node.atime = dos_time(struct.unpack_from("<H", s, 18)[0], 0)

    def _file(self, at: int, s: bytes, start: int) -> Node:
        node = Node(at, REGULAR, struct.unpack_from("<I", s, 28)[0])
        self._facts(node, s)
        try:
            if node.size:
                chain = self.chain(start)
                if len(chain) * self.cluster < node.size:
                    raise EvidenceError("a cluster chain ends before the file does")
                node.extents = fit([Extent(k * self.cluster, self.cluster, self.place(c)) for k, c in enumerate(chain)], node.size)
        except EvidenceError as e:
            node.error = str(e)
        return node
