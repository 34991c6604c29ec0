"""What every file system parser gives: its label and facts, and one node for each directory, file and link."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

DIRECTORY, REGULAR, SYMLINK = 0x4000, 0x8000, 0xA000
MAX_FILE = 1 << 40
MAX_EXTENTS = 1 << 22


@dataclass
class Extent:
    """kind: data (bytes at phys of the volume), hole (zeros) or inline (bytes carried here)."""

    logical: int
    length: int
    phys: int = -1
    kind: str = "data"
    inline: bytes = b""


@dataclass
class Entry:
    """A name in a directory."""

    name: str
    child: int
    is_dir: bool
    raw: bytes = b""


@dataclass
class Node:
    id: int
    mode: int
    size: int = 0
    mtime: int = 0
    atime: int = 0
    ctime: int = 0
    hidden: bool = False
    system: bool = False
    readonly: bool = False
    link: str | None = None
    codec: str = ""
    extents: list[Extent] = field(default_factory=list)
    entries: list[Entry] = field(default_factory=list)
    #: (parent, name) where a file system keeps names with the file rather than in directories.
    names: list[tuple[int, str]] = field(default_factory=list)
    error: str | None = None

    @property
    def is_dir(self) -> bool:
        return self.mode & 0xF000 == DIRECTORY


class FileSystem:
    """A parsed volume. nodes() may be asked for a share of the volume, so that several tasks can scan it."""

    type = "Unknown"
    root = 0
    #: Listing order: by name, or as on the disk.
    sorted_names = False
    #: Whether listings carry times.
    list_times = True

    def __init__(self, volume):
        self.volume = volume

    def label(self) -> str:
        return ""

    def block_size(self) -> int:
        return 0

    def info(self) -> dict[str, str]:
        return {}

    def shares(self) -> int:
        return 1

    def nodes(self, share: int = 0) -> Iterator[Node]:
        raise NotImplementedError


def merge(extents: list[Extent]) -> list[Extent]:
    """Neighbouring extents that go on in both the file and the volume are one."""
    out: list[Extent] = []
    for e in extents:
        last = out[-1] if out else None
        if last and e.kind == last.kind and e.logical == last.logical + last.length and (e.kind == "hole" or e.kind == "data" and e.phys == last.phys + last.length):
            last.length += e.length
        else:
            out.append(Extent(e.logical, e.length, e.phys, e.kind, e.inline))
    return out


def fit(extents: list[Extent], size: int) -> list[Extent]:
    """Extents cut to the file's size, with holes where nothing is mapped."""
    out, at = [], 0
    for e in sorted(extents, key=lambda e: e.logical):
        if e.logical >= size:
            break
        if e.logical > at:
            out.append(Extent(at, e.logical - at, -1, "hole"))
        length = min(e.length, size - e.logical)
        out.append(Extent(e.logical, length, e.phys, e.kind, e.inline[:length]))
        at = e.logical + length
    if at < size:
        out.append(Extent(at, size - at, -1, "hole"))
    return merge(out)
