"""APFS: the newest container superblock, object maps, and the catalog of the first volume."""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Callable, Iterator

from diskloom.errors import EvidenceError, Unsupported
from diskloom.fs.base import DIRECTORY, SYMLINK, Entry, Extent, FileSystem, Node, fit

MAX_LEVEL = 12
LOW = (1 << 60) - 1
INODE, XATTR, DSTREAM, FILE_EXTENT, DREC = 3, 4, 6, 8, 9
#: Extended fields of an inode.
DSTREAM_FIELD, SYMLINK_FIELD = 8, 32
LEAVES_A_SHARE = 1024


class Apfs(FileSystem):
    type = "APFS"
    root = 2

    def __init__(self, volume):
        super().__init__(volume)
        s = volume.read(0, 4096)
        self.size = struct.unpack_from("<I", s, 36)[0]
        if s[32:36] != b"NXSB" or not 4096 <= self.size <= 65536:
            raise EvidenceError("no APFS container superblock")
        count, base = struct.unpack_from("<I", s, 104)[0] & 0x7FFFFFFF, struct.unpack_from("<Q", s, 112)[0]
        best, xid = s, struct.unpack_from("<Q", s, 16)[0]
        for k in range(min(count, 4096)):
            b = volume.block((base + k) * self.size, self.size)
            if b[32:36] == b"NXSB" and struct.unpack_from("<Q", b, 16)[0] > xid:
                best, xid = b, struct.unpack_from("<Q", b, 16)[0]
        self.xid = xid
        self.objects = self._omap(struct.unpack_from("<Q", best, 160)[0])
        for k in range(min(100, struct.unpack_from("<I", best, 180)[0])):
            oid = struct.unpack_from("<Q", best, 184 + 8 * k)[0]
            if oid:
                v = self._block(self._look(self.objects, oid))
                if v[32:36] == b"APSB":
                    break
        else:
            raise EvidenceError("no APFS volume")
        self.name = v[704:960].split(b"\0")[0].decode("utf-8", "replace")
        omap, self.tree = struct.unpack_from("<QQ", v, 128)
        self.names = self._omap(omap)
        self._held: tuple[list[int], list[int]] | None = None

    def label(self) -> str:
        return self.name

    def block_size(self) -> int:
        return self.size

    def info(self) -> dict[str, str]:
        return {"xid": str(self.xid)}

    def _block(self, n: int) -> bytes:
        return self.volume.read(n * self.size, self.size)

    def _omap(self, block: int) -> dict[int, int]:
        """Object to block: for each the entry of the latest transaction up to the container's."""
        best: dict[int, tuple[int, int]] = {}
        for key, value in self._records(struct.unpack_from("<Q", self._block(block), 48)[0], None):
            oid, xid = struct.unpack_from("<QQ", key, 0)
            if xid <= self.xid and xid >= best.get(oid, (-1, 0))[0]:
                best[oid] = (xid, struct.unpack_from("<Q", value, 8)[0])
        return {o: p for o, (_, p) in best.items()}

    @staticmethod
    def _look(table: dict[int, int], oid: int) -> int:
        if oid not in table:
            raise EvidenceError(f"object {oid} is not mapped")
        return table[oid]

    def _items(self, b: bytes) -> tuple[int, list[tuple[bytes, bytes]]]:
        """(depth, (key, value) pairs) of a tree node."""
        flags, depth, n, toc, toc_len = struct.unpack_from("<HHIHH", b, 32)
        keys = 56 + toc + toc_len
        end = self.size - (40 if flags & 1 else 0)
        out = []
        for k in range(n):
            if flags & 4:
                ko, vo = struct.unpack_from("<HH", b, 56 + toc + 4 * k)
                out.append((b[keys + ko : keys + ko + 16], b[end - vo : end - vo + 16]))
            else:
                ko, kl, vo, vl = struct.unpack_from("<HHHH", b, 56 + toc + 8 * k)
                out.append((b[keys + ko : keys + ko + kl], b[end - vo : end - vo + vl]))
        return depth, out

    def _records(self, at: int, table: dict[int, int] | None, level: int = 0) -> Iterator[tuple[bytes, bytes]]:
        """(key, value) of all leaf records of a tree; table: object map of a tree of virtual objects."""
        if level > MAX_LEVEL:
            raise EvidenceError("a tree is too deep")
        depth, items = self._items(self._block(at if table is None else self._look(table, at)))
        for key, value in items:
            if depth:
                yield from self._records(struct.unpack_from("<Q", value, 0)[0], table, level + 1)
            else:
                yield key, value

    def _leaves(self) -> tuple[list[int], list[int]]:
        """(least object id, node) of the catalog's leaves in order; only the nodes above them are read."""
        if self._held is None:
            firsts, nodes = [], []

            def walk(node: int, first: int, level: int) -> None:
                if level > MAX_LEVEL:
                    raise EvidenceError("a tree is too deep")
                depth, items = self._items(self._block(self._look(self.names, node)))
                if not depth:
                    firsts.append(struct.unpack_from("<Q", items[0][0], 0)[0] & LOW if items else first)
                    nodes.append(node)
                for key, value in items if depth else ():
                    child, least = struct.unpack_from("<Q", value, 0)[0], struct.unpack_from("<Q", key, 0)[0] & LOW
                    if depth == 1:
                        firsts.append(least)
                        nodes.append(child)
                    else:
                        walk(child, least, level + 1)

            walk(self.tree, 0, 0)
            self._held = firsts, nodes
        return self._held

    def shares(self) -> int:
        return max(1, -(-len(self._leaves()[1]) // LEAVES_A_SHARE))

    def _between(self, low: int, high: int | None) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(object id, kind, key, value) of the catalog's records of objects from low on, below high."""
        firsts, nodes = self._leaves()
        # records of low may begin in the leaf before the first that starts with it
        for k in range(max(0, bisect_left(firsts, low) - 1), len(nodes)):
            if high is not None and firsts[k] >= high:
                return
            for key, value in self._items(self._block(self._look(self.names, nodes[k])))[1]:
                head = struct.unpack_from("<Q", key, 0)[0]
                oid = head & LOW
                if oid >= low and (high is None or oid < high):
                    yield oid, head >> 60, key, value

    def _extent(self, key: bytes, value: bytes) -> Extent:
        length, block = struct.unpack_from("<QQ", value, 0)
        return Extent(struct.unpack_from("<Q", key, 8)[0], length & ((1 << 56) - 1), block * self.size if block else -1, "data" if block else "hole")

    def nodes(self, share: int = 0) -> Iterator[Node]:
        """The inodes of a share: those from the first object of its leaves on, below the first of the next share's."""
        firsts, _ = self._leaves()
        low = firsts[share * LEAVES_A_SHARE] if share else 0
        last = (share + 1) * LEAVES_A_SHARE
        high = firsts[last] if last < len(firsts) else None
        inodes: dict[int, bytes] = {}
        entries: dict[int, list[Entry]] = {}
        attributes: dict[int, dict[str, tuple[int, bytes]]] = {}
        extents: dict[int, list[Extent]] = {}
        for oid, kind, key, value in self._between(low, high):
            if kind == INODE:
                inodes[oid] = value
            elif kind == DREC:
                length = struct.unpack_from("<I", key, 8)[0] & 0x3FF
                raw = key[12 : 12 + length]
                if len(raw) != length or not raw.endswith(b"\0"):
                    raw = key[10 : 10 + struct.unpack_from("<H", key, 8)[0]]
                raw = raw.rstrip(b"\0")
                child, _, flags = struct.unpack_from("<QQH", value, 0)
                entries.setdefault(oid, []).append(Entry(raw.decode("utf-8", "replace"), child, flags & 15 == 4, raw))
            elif kind == XATTR:
                name = key[10 : 10 + struct.unpack_from("<H", key, 8)[0]].rstrip(b"\0").decode("utf-8", "replace")
                flags, length = struct.unpack_from("<HH", value, 0)
                attributes.setdefault(oid, {})[name] = (flags, value[4 : 4 + length])
            elif kind == FILE_EXTENT:
                extents.setdefault(oid, []).append(self._extent(key, value))

        def stream(oid: int) -> list[Extent]:
            """Extents of a stream, which may lie in another share."""
            if low <= oid and (high is None or oid < high):
                return extents.get(oid, [])
            return [self._extent(key, value) for _, kind, key, value in self._between(oid, oid + 1) if kind == FILE_EXTENT]

        for oid, value in inodes.items():
            yield self._node(oid, value, entries.get(oid, []), attributes.get(oid, {}), stream)

    def attributes(self) -> Iterator[tuple[int, str, bytes | None, int | None, int | None]]:
        """(file id, name, value, stream id, stream size) of all extended attributes; streamed ones have no value here."""
        for key, value in self._records(self.tree, self.names):
            head = struct.unpack_from("<Q", key, 0)[0]
            if head >> 60 == XATTR:
                name = key[10 : 10 + struct.unpack_from("<H", key, 8)[0]].rstrip(b"\0").decode("utf-8", "replace")
                flags, length = struct.unpack_from("<HH", value, 0)
                body = value[4 : 4 + length]
                if flags & 1:
                    yield head & LOW, name, None, *struct.unpack_from("<QQ", body, 0)
                else:
                    yield head & LOW, name, body, None, None

    @staticmethod
    def _fields(value: bytes) -> dict[int, bytes]:
        if len(value) < 96:
            return {}
        n = struct.unpack_from("<H", value, 92)[0]
        out, at = {}, 96 + 4 * n
        for k in range(n):
            kind, _, size = struct.unpack_from("<BBH", value, 96 + 4 * k)
            out[kind] = value[at : at + size]
            at += -(-size // 8) * 8
        return out

    @staticmethod
    def _target(oid: int, fields: dict[int, bytes], attributes: dict[str, tuple[int, bytes]]) -> bytes:
        """A link's target, from the inode's field or else the attribute. None, or an empty one, is an error."""
        raw = fields.get(SYMLINK_FIELD, b"").split(b"\0")[0] or attributes.get("com.apple.fs.symlink", (0, b""))[1].split(b"\0")[0]
        if not raw:
            raise EvidenceError(f"link {oid} has no target")
        return raw

    def _node(self, oid: int, value: bytes, entries: list[Entry], attributes: dict[str, tuple[int, bytes]], stream: Callable[[int], list[Extent]]) -> Node:
        private, made, changed, _, read = struct.unpack_from("<QQQQQ", value, 8)
        seconds = lambda ns: ns // 1_000_000_000 if ns >= 1_000_000_000 else 0
        node = Node(oid, struct.unpack_from("<H", value, 80)[0], 0, seconds(changed), seconds(read), seconds(made), entries=entries)
        kind = node.mode & 0xF000
        fields = self._fields(value)
        try:
            if kind == SYMLINK:
                raw = self._target(oid, fields, attributes)
                node.link, node.size = raw.decode("utf-8", "replace"), len(raw)
                node.extents = [Extent(0, node.size, -1, "inline", raw)]
            elif kind != DIRECTORY:
                if "com.apple.decmpfs" in attributes:
                    self._packed(node, attributes, stream)
                else:
                    node.size = struct.unpack_from("<Q", fields[DSTREAM_FIELD], 0)[0] if DSTREAM_FIELD in fields else 0
                    node.extents = fit(stream(private), node.size) if node.size else []
        except (EvidenceError, struct.error) as e:
            node.error = str(e)
        return node

    def _packed(self, node: Node, attributes: dict[str, tuple[int, bytes]], stream: Callable[[int], list[Extent]]) -> None:
        flags, raw = attributes["com.apple.decmpfs"]
        if flags & 1:
            raise Unsupported("a decmpfs header in a stream")
        magic, kind, node.size = struct.unpack_from("<4sIQ", raw, 0)
        if magic != b"fpmc":
            raise EvidenceError("a decmpfs header is damaged")
        node.codec = f"decmpfs:{kind}"
        if kind % 2:
            node.extents = [Extent(0, len(raw) - 16, -1, "inline", raw[16:])]
            return
        if "com.apple.ResourceFork" not in attributes:
            raise EvidenceError("a packed file has no resource stream")
        how, body = attributes["com.apple.ResourceFork"]
        if how & 2:
            node.extents = [Extent(0, len(body), -1, "inline", body)]
        else:
            number, size = struct.unpack_from("<QQ", body, 0)
            node.extents = fit(stream(number), size)
