"""Column functions over binary: bounded integers, times, names and sizes. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(b: Column, n: int) -> Column:
    return F.conv(F.hex(b), 16, 10).cast("long" if n < 8 else "decimal(20,0)")


def be(b: Column, offset: int | Column, n: int) -> Column:
    """Big-endian unsigned integer of n bytes at a zero-based offset; null past the end."""
    part = F.substring(b, offset + 1, n) if isinstance(offset, int) else F.substring(b, offset.cast("int") + 1, F.lit(n))
    return F.when(F.octet_length(part) == n, _int(part, n))


def le(b: Column, offset: int | Column, n: int) -> Column:
    """Little-endian unsigned integer; eight bytes give a decimal, as longs are signed."""
    part = F.substring(b, offset + 1, n) if isinstance(offset, int) else F.substring(b, offset.cast("int") + 1, F.lit(n))
    return F.when(F.octet_length(part) == n, _int(F.unhex(F.concat(*[F.substring(F.hex(part), 2 * k + 1, 2) for k in reversed(range(n))])), n))


def u8(b: Column, offset: int | Column) -> Column:
    return le(b, offset, 1)


def u16le(b: Column, offset: int | Column) -> Column:
    return le(b, offset, 2)


def u32le(b: Column, offset: int | Column) -> Column:
    return le(b, offset, 4)


def u64le(b: Column, offset: int | Column) -> Column:
    return le(b, offset, 8)


def c_string(b: Column) -> Column:
    """Bytes up to the first zero, as text."""
    text = F.decode(b, "ISO-8859-1")
    return F.element_at(F.split(text, "\\x00"), 1)


def utf16_name(b: Column) -> Column:
    return F.element_at(F.split(F.decode(b, "UTF-16LE"), "\\x00"), 1)


def printable(name: Column) -> Column:
    """A plausible file name: not empty, no slash, no control characters."""
    return name.rlike(r"^[^/\x00-\x1f\x7f]+$")


def filetime_seconds(t: Column) -> Column:
    """Hundreds of nanoseconds since 1601 to Unix seconds; nothing before 1970 gives 0."""
    s = F.floor(t / F.lit(10_000_000).cast("decimal(20,0)")).cast("long") - 11_644_473_600
    return F.when((t > 0) & (s > 0), s).otherwise(F.lit(0).cast("long"))


def dos_seconds(date: Column, time: Column) -> Column:
    """DOS date and time to Unix seconds in UTC; out of range gives 0, an impossible day rolls over."""
    year = 1980 + F.shiftright(date, 9)
    month, day = F.shiftright(date, 5).bitwiseAND(15), date.bitwiseAND(31)
    hour, minute, second = F.shiftright(time, 11), F.shiftright(time, 5).bitwiseAND(63), time.bitwiseAND(31) * 2
    ok = month.between(1, 12) & (day > 0) & (hour <= 23) & (minute <= 59) & (second <= 59)
    first = F.make_date(year.cast("int"), F.when(ok, month).otherwise(1).cast("int"), F.lit(1))
    days = F.unix_date(first) + day - 1
    return F.when(ok, days.cast("long") * 86400 + hour * 3600 + minute * 60 + second).otherwise(F.lit(0).cast("long"))


def xfs_seconds(raw: Column, bigtime: bool) -> Column:
    """Classic times hold unsigned seconds and nanoseconds in halves; big times count nanoseconds from 1901."""
    if bigtime:
        return F.floor(raw / F.lit(1_000_000_000).cast("decimal(20,0)")).cast("long") - 2_147_483_648
    return F.floor(raw / F.lit(1 << 32).cast("decimal(20,0)")).cast("long")


def apfs_seconds(ns: Column) -> Column:
    return F.when(ns < 1_000_000_000, F.lit(0).cast("long")).otherwise(F.floor(ns / F.lit(1_000_000_000).cast("decimal(20,0)")).cast("long"))


def split_path(path: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: (p != "") & (p != "."))


def join_path(parts: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def human_size(n: Column) -> Column:
    """Bytes as TB, GB or MB with two decimals, smaller ones as bytes."""
    out = F.concat(n.cast("string"), F.lit(" bytes"))
    for unit, power in (("MB", 2), ("GB", 3), ("TB", 4)):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.2f", F.bround(n / float(1024**power), 2)), F.lit(f" {unit}"))).otherwise(out)
    return out


def guid_hex(b: Column) -> Column:
    return F.lower(F.hex(b))
