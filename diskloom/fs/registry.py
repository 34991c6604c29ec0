"""File system parsers by type name. register() adds one; the names without a parser are detection only."""

from __future__ import annotations

from diskloom.container.reader import Image
from diskloom.errors import Unsupported
from diskloom.fs.apfs import Apfs
from diskloom.fs.base import FileSystem
from diskloom.fs.btrfs import Btrfs
from diskloom.fs.exfat import ExFat
from diskloom.fs.ext4 import Ext4
from diskloom.fs.fat import Fat
from diskloom.fs.ntfs import Ntfs
from diskloom.fs.xfs import Xfs
from diskloom.partition.tables import Volume

PARSERS: dict[str, type[FileSystem]] = {"FAT12": Fat, "FAT16": Fat, "FAT32": Fat, "EFI": Fat, "exFAT": ExFat, "NTFS": Ntfs, "ext4": Ext4, "ext3": Ext4, "ext2": Ext4, "XFS": Xfs, "Btrfs": Btrfs, "APFS": Apfs}
DETECTION_ONLY = ("HFS+", "F2FS", "SquashFS", "ReFS", "BitLocker", "LUKS", "ZFS", "RAID", "JFS", "UFS", "LVM", "Swap", "GPT", "Unknown")


def register(name: str, parser: type[FileSystem]) -> None:
    PARSERS[name] = parser


def registered() -> list[str]:
    return sorted(PARSERS)


def open_volume(image: Image, start: int, size: int, kind: str) -> FileSystem:
    if kind not in PARSERS:
        raise Unsupported(f"no reader for {kind}")
    return PARSERS[kind](Volume(image, start, size))
