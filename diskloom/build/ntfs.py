"""A builder of NTFS volumes: a master file table with resident and non-resident data."""

from __future__ import annotations

import struct

from diskloom.build.tree import Dir, Disk, File, tree

CLUSTER, RECORD, RESIDENT = 4096, 1024, 400


def filetime(t: int) -> int:
    return (t + 11_644_473_600) * 10_000_000


def _attribute(kind: int, body: bytes, number: int) -> bytes:
    size = -(-(24 + len(body)) // 8) * 8
    return struct.pack("<IIBBHHHIHBB", kind, size, 0, 0, 24, 0, number, len(body), 24, 0, 0) + body.ljust(size - 24, b"\0")


def _run(length: int, step: int | None) -> bytes:
    n = length.to_bytes((length.bit_length() + 8) // 8, "little")
    if step is None:
        return bytes([len(n)]) + n
    o = step.to_bytes((step.bit_length() + 8) // 8, "little", signed=True)
    return bytes([len(n) | len(o) << 4]) + n + o


def _away(kind: int, size: int, runs: list[tuple[int, int | None]], number: int) -> bytes:
    raw, last, total = b"", 0, 0
    for length, lcn in runs:
        raw += _run(length, None if lcn is None else lcn - last)
        last = last if lcn is None else lcn
        total += length
    raw += b"\0"
    length = -(-(64 + len(raw)) // 8) * 8
    head = struct.pack("<IIBBHHHQQHHIQQQ", kind, length, 1, 0, 64, 0, number, 0, total - 1 if total else 0, 64, 0, 0, total * CLUSTER, size, size)
    return head + raw.ljust(length - 64, b"\0")


def _record(number: int, flags: int, attributes: list[bytes]) -> bytes:
    body = b"".join(attributes) + b"\xff\xff\xff\xff\0\0\0\0"
    head = struct.pack("<4sHHQHHHHIIQHHI", b"FILE", 48, 3, 0, 1, 1, 56, flags, 56 + len(body), RECORD, 0, len(attributes), 0, number)
    raw = bytearray((head.ljust(56, b"\0") + body).ljust(RECORD, b"\0"))
    if len(raw) > RECORD:
        raise ValueError("a record is too large")
    mark = struct.pack("<H", 1)
    raw[48:54] = mark + raw[510:512] + raw[1022:1024]
    raw[510:512] = raw[1022:1024] = mark
    return bytes(raw)


def _name(parent: int, name: str, t: int, size: int, is_dir: bool, space: int) -> bytes:
    return struct.pack("<QQQQQQQIIBB", parent | 1 << 48, t, t, t, t, size, size, 0x10000000 if is_dir else 0x20, 0, len(name), space) + name.encode("utf-16-le")


def build_ntfs(files: list[File], label: str = "FIXTURE", fragment: bool = False) -> bytes:
    """fragment: large files lie in two runs, the later one earlier on the disk."""
    root = tree(files)
    root.id = 5
    ids = iter(range(24, 1 << 30))
    for d in list(root.walk())[1:]:
        d.id = next(ids)
    numbers = {id(f): next(ids) for d in root.walk() for f in d.files.values()}
    count = next(ids)
    mft_clusters = -(-count * RECORD // CLUSTER)
    disk = Disk(CLUSTER, 4 + mft_clusters)
    records: dict[int, bytes] = {}

    def si(t: int, attr: int = 0x20) -> bytes:
        return _attribute(0x10, struct.pack("<QQQQI12x", t, t, t, t, attr), 0)

    def data(f: File) -> bytes:
        if f.parts is None and len(f.data) <= RESIDENT:
            return _attribute(0x80, f.data, 2)
        runs: list[tuple[int, int | None]] = []
        at = 0
        for start, part in f.pieces():
            if start // CLUSTER > at:
                runs.append((start // CLUSTER - at, None))
            n = -(-len(part) // CLUSTER)
            if fragment and n > 1:
                half = n // 2
                late = disk.put(part[half * CLUSTER :])
                runs += [(half, disk.put(part[: half * CLUSTER])), (n - half, late)]
            else:
                runs.append((n, disk.put(part)))
            at = start // CLUSTER + n
        end = -(-f.length // CLUSTER)
        if end > at:
            runs.append((end - at, None))
        return _away(0x80, f.length, runs, 2)

    def folder(d: Dir, parent: int) -> None:
        t = filetime(0)
        names = [_attribute(0x30, _name(parent, d.name or ".", t, 0, True, 3), 1)]
        records[d.id] = _record(d.id, 3, [si(t, 0x10), *names])
        for c in d.dirs.values():
            folder(c, d.id)
        for name, f in d.files.items():
            t = filetime(f.mtime)
            short = f"F{numbers[id(f)]:06d}~1"
            names = [_attribute(0x30, _name(d.id, short, t, f.length, False, 2), 3), _attribute(0x30, _name(d.id, name, t, f.length, False, 1), 1)]
            records[numbers[id(f)]] = _record(numbers[id(f)], 1, [si(t), *names, data(f)])

    folder(root, 5)
    del folder  # it refers to itself and to the volume, which would stay until garbage is collected
    records[0] = _record(0, 1, [si(0, 6), _attribute(0x30, _name(5, "$MFT", 0, 0, False, 3), 1), _away(0x80, count * RECORD, [(mft_clusters, 4)], 2)])
    records[3] = _record(3, 1, [si(0, 6), _attribute(0x30, _name(5, "$Volume", 0, 0, False, 3), 1), _attribute(0x60, label.encode("utf-16-le"), 2)])
    image = disk.image(disk.next + 1)
    for number, raw in records.items():
        image[4 * CLUSTER + number * RECORD : 4 * CLUSTER + (number + 1) * RECORD] = raw
    boot = bytearray(512)
    boot[:11] = b"\xeb\x52\x90NTFS    "
    struct.pack_into("<HB", boot, 11, 512, CLUSTER // 512)
    boot[21] = 0xF8
    struct.pack_into("<QQQb3xb3xQ", boot, 40, len(image) // 512, 4, 4, -10, 1, 0x1122334455667788)
    boot[510:512] = b"\x55\xaa"
    image[:512] = boot
    return bytes(image)
