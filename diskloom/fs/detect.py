"""File system detection by signatures, one rule list for Python windows and for SQL expressions."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (type, offset, bytes) in order: the first hit decides. Where common tools place a signature elsewhere than the
#: format does, both places are rules.
RULES: list[tuple[str, int, bytes]] = [
    ("BitLocker", 3, b"-FVE-FS-"),
    ("NTFS", 3, b"NTFS"),
    ("FAT32", 0x52, b"FAT32   "),
    ("FAT16", 0x36, b"FAT16   "),
    ("FAT12", 0x36, b"FAT1"),
    ("exFAT", 3, b"EXFAT   "),
    ("HFS+", 1024, b"H+\0\4"),
    ("HFS+", 1024, b"HX\0\5"),
    ("APFS", 0x20, b"NXSB"),
    ("ext4", 1080, b"\x53\xef"),
    ("XFS", 0, b"XFSB"),
    ("SquashFS", 96, b"hsqs"),
    ("SquashFS", 0, b"hsqs"),
    ("F2FS", 0, b"F2FS"),
    ("F2FS", 1024, struct.pack("<I", 0xF2F52010)),
    ("Btrfs", 0x10040, b"_BHRfS_M"),
    ("ReFS", 3, b"ReFS"),
    ("LUKS", 0, b"LUKS\xba\xbe"),
    ("ZFS", 0x84, b"ZFS "),
    ("JFS", 0x8000, b"JFS1"),
]
PROBE_SECTORS = 129


def detect(window: bytes) -> str:
    if len(window) < 512:
        return "Unknown"
    for kind, at, magic in RULES:
        if window[at : at + len(magic)] == magic:
            if kind == "XFS":
                size = int.from_bytes(window[4:8], "big")
                return "XFS" if 512 <= size <= 65536 and not size & (size - 1) else "Unknown"
            return kind
    return "Unknown"


def detect_column(window: Column) -> Column:
    """The same, as one CASE expression over a binary column."""
    size = F.conv(F.hex(F.substring(window, 5, 4)), 16, 10).cast("long")
    powers = [1 << k for k in range(9, 17)]
    out = F.lit("Unknown")
    for kind, at, magic in reversed(RULES):
        value = F.when(size.isin(powers), "XFS").otherwise("Unknown") if kind == "XFS" else F.lit(kind)
        out = F.when(F.substring(window, at + 1, len(magic)) == F.lit(bytearray(magic)), value).otherwise(out)
    return F.when(F.octet_length(window) < 512, "Unknown").otherwise(out)


def summary(kind: str, w: bytes) -> dict[str, str]:
    """What the superblock of a detection-only file system says."""
    if kind == "HFS+":
        size, total, free = struct.unpack_from(">III", w, 1024 + 40)
        # the last eight bytes of the Finder's information name the volume
        return {"block_size": str(size), "total_blocks": str(total), "free_blocks": str(free), "version": str(struct.unpack_from(">H", w, 1026)[0]), "uuid": w[1024 + 104 : 1024 + 112].hex()}
    if kind == "SquashFS":
        at = 0 if w[:4] == b"hsqs" else 96
        inodes, made, block = struct.unpack_from("<III", w, at + 4)
        return {"inodes": str(inodes), "created": str(made), "block_size": str(block)}
    if kind == "F2FS":
        at = 1024 if w[:4] != b"F2FS" else 0
        major, minor = struct.unpack_from("<HH", w, at + 4)
        out = {"version": f"{major}.{minor}"}
        if at:
            # sizes as powers of two, counts, then identity, as the format's superblock has them
            block, segment = struct.unpack_from("<II", w, at + 16)
            out |= {"block_size": str(1 << block) if block < 32 else "", "blocks_a_segment": str(1 << segment) if segment < 32 else "", "uuid": w[at + 108 : at + 124].hex(), "features": f"0x{struct.unpack_from('<I', w, at + 2180)[0]:08x}"}
        return out
    if kind == "ZFS":
        return {"label": w[0x84:0x8C].split(b"\0")[0].decode("latin-1").strip()}
    if kind == "JFS":
        return {"version": str(struct.unpack_from("<I", w, 0x8004)[0]), "block_size": str(struct.unpack_from("<I", w, 0x8010)[0])}
    if kind == "ReFS":
        return {"serial": f"{struct.unpack_from('<Q', w, 0x38)[0]:016x}", "version": f"{w[0x28]}.{w[0x29]}"}
    if kind == "LUKS":
        return {"version": str(struct.unpack_from(">H", w, 6)[0]), "cipher": w[8:40].split(b"\0")[0].decode("latin-1")}
    if kind == "BitLocker":
        return {"sector_bytes": str(struct.unpack_from("<H", w, 11)[0])}
    return {}


#: Where the superblocks of software RAID lie: the start of the newer forms, then the places other tools look at.
RAID_PLACES = (0, 512, 1024, 2048, 4096, 8192, 16384)


def raid(window: bytes) -> str | None:
    """Software or firmware RAID metadata in a window, or None. Beside the superblock's number its name in plain text counts."""
    for at in RAID_PLACES:
        if window[at : at + 4] == b"\xfc\x4e\x2b\xa9" or window[at : at + 32].strip(b"\0") == b"Linux RAID":
            return "Linux MD"
    if b"Intel Raid ISM Cfg Sig." in window or window[:13] == b"IntelRaidMgmt":
        return "Intel RST"
    return "Storage Spaces" if b"SPACEDB " in window[:8192] or window[:13] == b"StorageSpaces" else None
