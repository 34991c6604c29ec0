"""Expert Witness containers: segment files, section chains, chunk tables and chunk decoding.

Plain Python without Spark, used on the driver to plan scans and on executors to read bytes.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from diskloom.errors import EvidenceError, NotFound

SIGNATURE = bytes.fromhex("455646090d0aff00")
FILE_HEADER, DESCRIPTOR = 13, 76
MAX_CHUNK_BYTES = 64 << 20
MAX_REQUEST_BYTES = 1 << 30
MAX_SECTION_BYTES = 1 << 32
CACHE_BYTES = 64 << 20
#: Entries of a chunk table that are read at once, and pages of entries that are kept.
PAGE_ENTRIES, PAGES = 16_384, 64
#: Stored bytes that a run of chunks reads at once.
RUN_BYTES = 4 << 20
#: Images that a worker keeps open from one row, or one task, to the next.
OPEN_IMAGES = 2
TAGS = {"c": "case_number", "n": "evidence_number", "a": "description", "e": "examiner", "t": "notes", "av": "version", "ov": "platform", "m": "acquired", "u": "system_date", "p": "password_hash", "r": "compression", "md": "model", "sn": "serial", "l": "device", "pid": "process", "dc": "unknown_dc", "ext": "extents"}


@dataclass
class Segment:
    path: str
    number: int
    size: int
    start: int


@dataclass
class Section:
    seg: int
    idx: int
    type: str
    addr: int
    next: int
    size: int
    checksum: int


@dataclass
class Table:
    """A chunk table: entry k is at base + (entry & 0x7fffffff) in its segment; bit 31: compressed."""

    seg: int
    section_idx: int
    base: int
    #: Entries lie at this place of the segment's file; they are read in pages when a chunk is asked for.
    at: int
    count: int
    data_end: int
    first_chunk: int = 0


@dataclass
class Media:
    media_type: int = 0
    chunk_count: int = 0
    chunk_sectors: int = 64
    sector_bytes: int = 512
    sector_count: int = 0
    cylinders: int = 0
    heads: int = 0
    sectors: int = 0
    compression_level: int = 0
    set_guid: bytes = b"\0" * 16

    @property
    def chs(self) -> str:
        return f"{self.cylinders}/{self.heads}/{self.sectors}"


def is_container(path: str) -> bool:
    """True if the file, and each sibling segment, carries the signature."""
    try:
        segments(path)
        return True
    except (EvidenceError, OSError):
        return False


def _file_header(path: str) -> tuple[int, int]:
    with open(path, "rb") as f:
        head = f.read(FILE_HEADER)
    if len(head) < FILE_HEADER or head[:8] != SIGNATURE:
        raise EvidenceError(f"{path} has no container signature")
    return struct.unpack_from("<H", head, 9)[0], os.path.getsize(path)


def segments(path: str) -> list[Segment]:
    """The image's files in order. `x.E01` goes on with x.E02, x.E03 ...; numbers must follow without a gap."""
    number, size = _file_header(path)
    found = [Segment(path, number, size, 0)]
    m = re.fullmatch(r"(.*\.)([A-Za-z]?)(\d\d)", path)
    if not m:
        return found
    folder, stem = os.path.split(m[1])
    siblings = {}
    for name in os.listdir(folder or "."):
        s = re.fullmatch(re.escape(stem) + r"([A-Za-z]?)(\d\d)", name)
        if s and s[1].lower() == m[2].lower() and int(s[2]) > int(m[3]):
            siblings[int(s[2])] = os.path.join(folder, name)
    for k, name in sorted(siblings.items()):
        at = found[-1]
        got, size = _file_header(name)
        if k != at.number + 1 or got != k:
            raise EvidenceError(f"{name} is not segment {at.number + 1}")
        found.append(Segment(name, got, size, at.start + at.size))
    return found


def parse_header(data: bytes) -> dict[str, str]:
    """Tags of line 3 with the values of line 4. A count mismatch gives none; fewer than four lines is an error."""
    raw = zlib.decompress(data)
    if raw[:2] == b"\xff\xfe":
        text = raw[2:].decode("utf-16-le", "replace")
    elif raw[:2] == b"\xfe\xff":
        text = raw[2:].decode("utf-16-be", "replace")
    else:
        text = raw.decode("utf-8", "replace")
    lines = text.replace("\r\n", "\n").split("\n")
    if len(lines) < 4:
        raise EvidenceError("a header section has fewer than four lines")
    tags, values = lines[2].split("\t"), lines[3].split("\t")
    return dict(zip(tags, values, strict=True)) if len(tags) == len(values) else {}


def parse_media(data: bytes) -> Media:
    kind, chunks, per, size = struct.unpack_from("<B3xIII", data, 0)
    count, c, h, s = struct.unpack_from("<QIII", data, 16)
    if per * size > MAX_CHUNK_BYTES or not per or not size:
        raise EvidenceError(f"chunks of {per} sectors of {size} bytes")
    return Media(kind, chunks, per, size, count, c, h, s, data[52], data[64:80])


@dataclass
class Image:
    """An opened container."""

    path: str
    segments: list[Segment] = field(default_factory=list)
    sections: list[Section] = field(default_factory=list)
    headers: list[dict[str, str]] = field(default_factory=list)
    media: list[Media] = field(default_factory=list)
    tables: list[Table] = field(default_factory=list)
    stored_md5: bytes | None = None
    stored_sha1: bytes | None = None

    @staticmethod
    def open(path: str) -> "Image":
        image = Image(path, segments(path))
        image._files: dict[int, object] = {}
        image._cache: OrderedDict[int, bytes] = OrderedDict()
        image._held = 0
        image._pages: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()
        image.pages_read = 0
        try:
            image._walk()
        except BaseException:
            image.close()
            raise
        return image

    @staticmethod
    def shared(path: str) -> "Image":
        """An image that this process keeps open, so that ranges and volumes of one image walk its sections once. Not to be closed."""
        told = os.stat(path)
        mark = (told.st_mtime_ns, told.st_size, told.st_ino)
        held = _SHARED.get(path)
        if held is not None and held[0] == mark:
            _SHARED.move_to_end(path)
            return held[1]
        if held is not None:
            _SHARED.pop(path)[1].close()
        image = Image.open(path)
        _SHARED[path] = (mark, image)
        while len(_SHARED) > OPEN_IMAGES:
            _SHARED.popitem(last=False)[1][1].close()
        return image

    def __enter__(self) -> "Image":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        for f in self._files.values():
            f.close()
        self._files.clear()

    def _bytes(self, seg: int, offset: int, length: int) -> bytes:
        """Up to length bytes of a segment file; none past its end."""
        if not 0 <= offset < self.segments[seg].size:
            return b""
        if seg not in self._files:
            self._files[seg] = open(self.segments[seg].path, "rb")
        f = self._files[seg]
        f.seek(offset)
        return f.read(length)

    def raw(self, offset: int, length: int) -> bytes:
        """Bytes of the concatenated segments; a range may span files, and what lies past the end is missing."""
        out = []
        for s in self.segments:
            if offset < s.start + s.size and length > 0 and offset >= s.start:
                part = self._bytes(self.segments.index(s), offset - s.start, min(length, s.start + s.size - offset))
                out.append(part)
                offset, length = offset + len(part), length - len(part)
        return b"".join(out)

    def _walk(self) -> None:
        pairs: list[Section] = []
        tables: list[Table] = []
        for seg, file in enumerate(self.segments):
            addr, idx = FILE_HEADER, 0
            while True:
                d = self._bytes(seg, addr, DESCRIPTOR)
                if len(d) < DESCRIPTOR:
                    raise EvidenceError(f"section {idx} of {file.path} is cut off")
                kind = d[:16].split(b"\0")[0].decode("latin-1")
                after, size, checksum = struct.unpack_from("<QQ", d, 16) + struct.unpack_from("<I", d, 72)
                if size > MAX_SECTION_BYTES or size > file.size:
                    raise EvidenceError(f"section {kind} claims {size} bytes")
                s = Section(seg, idx, kind, addr, after, size, checksum)
                self.sections.append(s)
                self._dispatch(s, pairs, tables)
                idx += 1
                if kind == "done" or not after or after <= addr:
                    break
                addr = after
        if pairs and len(tables) < len(pairs):
            raise EvidenceError(f"{len(pairs)} sectors sections, but {len(tables)} tables")
        if pairs:
            for s, t in zip(pairs, tables, strict=False):
                t.data_end = s.addr + max(s.size, DESCRIPTOR) if s.seg == t.seg else self.segments[t.seg].size
            tables = tables[: len(pairs)]
        first = 0
        for t in tables:
            t.first_chunk = first
            first += t.count
        self.tables = tables
        self.chunk_total = first
        self._firsts = [t.first_chunk for t in tables]

    def _dispatch(self, s: Section, pairs: list[Section], tables: list[Table]) -> None:
        body = s.size - DESCRIPTOR
        at = s.addr + DESCRIPTOR
        if s.type in ("header", "header2") and body > 0:
            try:
                self.headers.append(parse_header(self._bytes(s.seg, at, body)))
            except zlib.error as e:
                raise EvidenceError(f"a header section can't be inflated: {e}") from e
        elif s.type in ("volume", "disk", "data") and body == 1052 and s.type != "data":
            data = self._bytes(s.seg, at, 1052)
            if len(data) < 1052:
                raise EvidenceError("a volume section is cut off")
            self.media.append(parse_media(data))
        elif s.type == "sectors":
            pairs.append(s)
        elif s.type == "table":
            if body < 24:
                raise EvidenceError("a table section has no room for its header")
            head = self._bytes(s.seg, at, 24)
            if len(head) < 24:
                raise EvidenceError("a table section is cut off")
            told, base = struct.unpack_from("<I", head, 0)[0], struct.unpack_from("<Q", head, 8)[0]
            room = (body - 24) // 4
            count = told if 0 < told <= room else max(0, (body - 28) // 4)
            if at + 24 + 4 * count > self.segments[s.seg].size:
                raise EvidenceError("a table section is cut off")
            if base > self.segments[s.seg].size:
                raise EvidenceError(f"a table's base offset {base} is past its file")
            end = s.next if s.next > s.addr else self.segments[s.seg].size
            tables.append(Table(s.seg, s.idx, base, at + 24, count, end))
        elif s.type == "digest" and body >= 36:
            d = self._bytes(s.seg, at, 36)
            if len(d) < 36:
                raise EvidenceError("a digest section is cut off")
            self.stored_md5, self.stored_sha1 = d[:16], d[16:36]
        elif s.type == "hash" and body >= 16:
            self.stored_md5 = self._bytes(s.seg, at, 16)

    @property
    def geometry(self) -> Media:
        return self.media[0] if self.media else Media()

    @property
    def chunk_bytes(self) -> int:
        return self.geometry.chunk_sectors * self.geometry.sector_bytes

    def entries(self, table: Table, first: int = 0, n: int | None = None) -> np.ndarray:
        """Entries first to first + n of a table, as they are stored."""
        n = table.count - first if n is None else min(n, table.count - first)
        data = self._bytes(table.seg, table.at + 4 * first, 4 * n)
        if len(data) < 4 * n:
            raise EvidenceError("a table section is cut off")
        return np.frombuffer(data, "<u4")

    def _page(self, k: int, page: int) -> np.ndarray:
        """A page of table k's entries, and the entry after it if there is one."""
        if (k, page) in self._pages:
            self._pages.move_to_end((k, page))
            return self._pages[k, page]
        found = self._pages[k, page] = self.entries(self.tables[k], page * PAGE_ENTRIES, PAGE_ENTRIES + 1)
        self.pages_read += 1
        if len(self._pages) > PAGES:
            self._pages.popitem(last=False)
        return found

    @property
    def coverage(self) -> int:
        """Sectors that the tables hold, whatever the volume section says."""
        return self.chunk_total * self.geometry.chunk_sectors

    def valid_bytes(self, chunk: int) -> int:
        """What a chunk must hold: all of it, but for the last as the volume's sector count says."""
        g = self.geometry
        if chunk == self.chunk_total - 1 and g.sector_count:
            rest = g.sector_count * g.sector_bytes - chunk * self.chunk_bytes
            if 0 < rest < self.chunk_bytes:
                return rest
        return self.chunk_bytes

    def place(self, chunk: int) -> tuple[int, int, int, bool]:
        """(segment, offset, limit, compressed): limit is where the next chunk, or the data, begins."""
        k = bisect_right(self._firsts, chunk) - 1
        # empty tables share their first chunk with the next
        if k < 0 or not 0 <= chunk - self._firsts[k] < self.tables[k].count:
            raise NotFound(f"chunk {chunk}")
        t = self.tables[k]
        page, j = divmod(chunk - t.first_chunk, PAGE_ENTRIES)
        entries = self._page(k, page)
        entry = int(entries[j])
        offset = t.base + (entry & 0x7FFFFFFF)
        limit = t.data_end
        if j + 1 < len(entries):
            after = t.base + (int(entries[j + 1]) & 0x7FFFFFFF)
            limit = after if after > offset else limit
        return t.seg, offset, limit, bool(entry >> 31)

    def _stored(self, offset: int, limit: int, compressed: bool) -> int:
        """How many bytes a chunk can have: no more than lie before the next, and no more than its data and checksum."""
        most = self.chunk_bytes + (1024 if compressed else 4)
        return min(most, limit - offset) if limit > offset else most

    def run(self, first: int, n: int) -> Iterator[bytes]:
        """Chunks first to first + n, decoded; their stored bytes are read many at a time, and nothing is cached."""
        places, size = [], self.chunk_bytes
        for number in range(first, first + n):
            seg, offset, limit, compressed = self.place(number)
            want = self._stored(offset, limit, compressed)
            if places and (seg != places[0][1] or offset < places[-1][2] or offset + want - places[0][2] > RUN_BYTES):
                yield from self._decoded(places, size)
                places = []
            places.append((number, seg, offset, want, limit - offset, compressed))
        yield from self._decoded(places, size)

    def _decoded(self, places: list[tuple[int, int, int, int, int, bool]], size: int) -> Iterator[bytes]:
        if not places:
            return
        start = places[0][2]
        raw = memoryview(self._bytes(places[0][1], start, places[-1][2] + places[-1][3] - start))
        for number, _, offset, want, stored, compressed in places:
            yield decode(raw[offset - start : offset - start + want], compressed, size, self.valid_bytes(number), stored)

    def chunk(self, number: int) -> bytes:
        """The decoded bytes of a chunk, through a cache bounded in bytes."""
        if number in self._cache:
            self._cache.move_to_end(number)
            return self._cache[number]
        seg, offset, limit, compressed = self.place(number)
        data = decode(self._bytes(seg, offset, self._stored(offset, limit, compressed)), compressed, self.chunk_bytes, self.valid_bytes(number), limit - offset)
        self._cache[number] = data
        self._held += len(data)
        while self._held > CACHE_BYTES and len(self._cache) > 1:
            self._held -= len(self._cache.popitem(last=False)[1])
        return data

    def read_sectors(self, lba: int, n: int) -> bytes:
        """n sectors from lba on. A start at or past the end is an error; what runs past the end is zero."""
        size = self.geometry.sector_bytes
        if lba < 0 or n < 0 or n * size > MAX_REQUEST_BYTES:
            raise EvidenceError(f"a request for {n} sectors at {lba}")
        if lba >= self.coverage:
            raise EvidenceError(f"sector {lba} is past the end at {self.coverage}")
        return self.read(lba * size, n * size)

    def read(self, offset: int, length: int) -> bytes:
        """Bytes of the acquired disk; past the last chunk they are zero."""
        out, per = bytearray(), self.chunk_bytes
        while len(out) < length:
            at = offset + len(out)
            number, skip = divmod(at, per)
            if number >= self.chunk_total:
                out += bytes(length - len(out))
                break
            data = self.chunk(number)
            part = data[skip : skip + length - len(out)]
            if not part:
                # the rest of a short last chunk
                part = bytes(min(per - skip, length - len(out)))
            out += part
        return bytes(out)

    def stream(self, step_sectors: int = 1 << 20) -> Iterator[bytes]:
        """The whole medium in order, a chunk or step_sectors at a time: as many sectors as the volume section counts, or all that are covered."""
        g, at = self.geometry, 0
        total = (g.sector_count or self.coverage) * g.sector_bytes
        if total > self.coverage * g.sector_bytes:
            raise EvidenceError(f"{g.sector_count} sectors, but chunks for {self.coverage}")
        step, size = step_sectors * g.sector_bytes, self.chunk_bytes
        for data in self.run(0, -(-total // size)):
            want = min(size, total - at)
            data = data[:want] if len(data) >= want else data + bytes(want - len(data))
            at += want
            if step >= want:
                yield data
            else:
                yield from (data[k : k + step] for k in range(0, want, step))


_SHARED: OrderedDict[str, tuple[tuple, Image]] = OrderedDict()


def decode(raw: bytes | memoryview, compressed: bool, chunk_bytes: int, valid: int, stored: int | None = None) -> bytes:
    """A chunk's data. Damage, a wrong checksum or too few bytes are errors."""
    if not compressed:
        size = min(chunk_bytes, len(raw) - 4, stored - 4 if stored is not None and stored > 4 else chunk_bytes)
        if size < valid:
            raise EvidenceError(f"a raw chunk has {max(size, 0)} of {valid} bytes")
        data = bytes(raw[:size])
        if zlib.adler32(data) != struct.unpack_from("<I", raw, size)[0]:
            raise EvidenceError("a raw chunk's checksum is wrong")
        return data
    # a valid two-byte head commits to zlib; only a bad head makes it raw deflate
    with_head = len(raw) >= 2 and raw[0] & 15 == 8 and raw[0] >> 4 <= 7 and (raw[0] << 8 | raw[1]) % 31 == 0 and not raw[1] & 32
    z = zlib.decompressobj(15 if with_head else -15)
    try:
        data = z.decompress(raw, chunk_bytes)
        if with_head and not z.eof and len(data) == chunk_bytes:
            z.decompress(z.unconsumed_tail, 1)  # reads the checksum behind the data
    except zlib.error as e:
        raise EvidenceError(f"a chunk can't be inflated: {e}") from e
    if len(data) < valid:
        raise EvidenceError(f"a chunk inflates to {len(data)} of {valid} bytes")
    return data
