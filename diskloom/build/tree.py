"""Files to put on a volume, as a tree of directories."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass
class File:
    path: str
    data: bytes = b""
    mtime: int = 0
    link: str | None = None
    #: (logical offset, bytes) parts of a sparse file of `size` bytes; data is then not used.
    parts: list[tuple[int, bytes]] | None = None
    size: int = 0

    def pieces(self) -> list[tuple[int, bytes]]:
        return self.parts if self.parts is not None else [(0, self.data)] if self.data else []

    @property
    def length(self) -> int:
        return self.size if self.parts is not None else len(self.data)


@dataclass
class Dir:
    name: str = ""
    dirs: dict[str, "Dir"] = field(default_factory=dict)
    files: dict[str, File] = field(default_factory=dict)
    id: int = 0

    def walk(self) -> Iterator["Dir"]:
        yield self
        for d in self.dirs.values():
            yield from d.walk()


def tree(files: list[File]) -> Dir:
    root = Dir()
    for f in files:
        at = root
        *folders, name = f.path.strip("/").split("/")
        for p in folders:
            at = at.dirs.setdefault(p, Dir(p))
        at.files[name] = f
    return root


def aligned(n: int, size: int) -> int:
    return -(-n // size) * size


_ZEROS = bytes(1 << 20)


def zeros(n: int) -> list[bytes]:
    """n zero bytes in parts, most of which are one object."""
    return [_ZEROS] * (n // len(_ZEROS)) + [bytes(n % len(_ZEROS))]


class Disk:
    """Blocks of a growing volume."""

    def __init__(self, block: int, reserved: int):
        self.block, self.next, self.held = block, reserved, {}

    def put(self, data: bytes, blocks: int | None = None) -> int:
        """Place data in fresh blocks; returns the first."""
        n = max(1, -(-len(data) // self.block)) if blocks is None else blocks
        at, self.next = self.next, self.next + n
        if data:
            self.held[at] = data
        return at

    def image(self, blocks: int) -> bytearray:
        out = bytearray(blocks * self.block)
        for at, data in self.held.items():
            out[at * self.block : at * self.block + len(data)] = data
        return out
