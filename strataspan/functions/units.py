"""Numbers for people and back: sizes, speeds, durations, block sizes, file-system names.

Rounding is that of the exact binary value, which the JVM's formatter doesn't give, so texts with decimals are made in Arrow batches.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Names that people use for those of blkid.
FS_NAMES = {
    "vfat": "FAT", "msdos": "FAT", "fat": "FAT", "exfat": "exFAT", "ntfs": "NTFS", "ntfs3": "NTFS", "refs": "ReFS", "ReFS": "ReFS", "btrfs": "Btrfs", "xfs": "XFS",
    "f2fs": "F2FS", "LVM2_member": "LVM", "lvm2": "LVM", "swap": "swap", "swsuspend": "hibernation", "iso9660": "ISO 9660", "udf": "UDF", "apfs": "APFS",
    "hfsplus": "HFS+", "hfs": "HFS", "crypto_LUKS": "LUKS", "BitLocker": "BitLocker", "squashfs": "SquashFS", "squashfs3": "SquashFS", "linux_raid_member": "Linux RAID",
    "zfs_member": "ZFS", "jfs": "JFS", "reiserfs": "ReiserFS", "reiser4": "Reiser4", "nilfs2": "NILFS2", "erofs": "EROFS", "cramfs": "cramfs", "romfs": "romfs",
    "minix": "Minix", "ufs": "UFS", "vxfs": "VxFS", "gfs": "GFS", "gfs2": "GFS2", "ocfs2": "OCFS2", "VMFS": "VMFS", "vmfs": "VMFS", "VMFS_volume_member": "VMFS",
    "bcache": "bcache", "bcachefs": "bcachefs", "oracleasm": "Oracle ASM", "hpfs": "HPFS", "ubifs": "UBIFS", "ubi": "UBI", "bfs": "BFS", "zonefs": "zonefs",
    "LVM1_member": "LVM1", "DM_integrity": "dm-integrity", "DM_verity_hash": "dm-verity", "DM_snapshot_cow": "LVM snapshot", "vdo": "VDO", "stratis": "Stratis",
    "ceph_bluestore": "Ceph BlueStore",
}


def bytes_text(n: int) -> str:
    """1500 -> 1.50 kB: SI units, three digits."""
    if n < 1000:
        return f"{n} B"
    value, unit = float(n), "B"
    for larger in ("kB", "MB", "GB", "TB", "PB"):
        if value < 999.5:
            break
        value, unit = value / 1000, larger
    digits = 2 if value < 9.995 else 1 if value < 99.95 else 0
    return f"{value:.{digits}f} {unit}"


def duration_text(seconds: float) -> str:
    """3900 -> 1h 05m."""
    if 0 < seconds < 0.5:
        return "<1s"
    s = math.floor(max(seconds, 0.0) + 0.5)
    if s < 60:
        return f"{s}s"
    return f"{s // 60}m {s % 60:02d}s" if s < 3600 else f"{s // 3600}h {s // 60 % 60:02d}m"


@F.pandas_udf(StringType())
def human_bytes(n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else bytes_text(int(x)) for x in n], dtype=object)


@F.pandas_udf(StringType())
def human_speed(n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else bytes_text(int(max(x, 0))) + "/s" for x in n], dtype=object)


def human_duration(seconds: Column) -> Column:
    """All of it in integers, so in the JVM."""
    s = F.floor(F.greatest(seconds, F.lit(0.0)) + 0.5)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    minutes = F.concat(F.floor(s / 60).cast("string"), F.lit("m "), two(F.pmod(s, F.lit(60))), F.lit("s"))
    hours = F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), two(F.pmod(F.floor(s / 60), F.lit(60))), F.lit("m"))
    return F.when((seconds > 0) & (seconds < 0.5), "<1s").when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, minutes).otherwise(hours)


def block_size(n: Column) -> Column:
    """4194304 -> 4M; exact multiples only."""
    out = None
    for unit, size in (("G", 1 << 30), ("M", 1 << 20), ("K", 1 << 10)):
        text = F.concat(F.floor(n / size).cast("string"), F.lit(unit))
        fits = (n >= size) & (F.pmod(n, F.lit(size)) == 0)
        out = F.when(fits, text) if out is None else out.when(fits, text)
    return out.otherwise(n.cast("string"))


def parse_size(text: Column) -> Column:
    """4M, 512K, 1GiB -> bytes; null if it isn't a size or doesn't fit 64 bits."""
    ok = F.regexp_extract(text, "^([0-9]+)(K|k|KiB|M|MiB|G|GiB|T|TiB|)$", 1)
    unit = F.regexp_extract(text, "^([0-9]+)(K|k|KiB|M|MiB|G|GiB|T|TiB|)$", 2)
    power = F.when(unit == "", 1).otherwise(F.element_at(F.create_map(*[F.lit(x) for pair in (("k", 1 << 10), ("K", 1 << 10), ("M", 1 << 20), ("G", 1 << 30), ("T", 1 << 40)) for x in pair]), F.substring(unit, 1, 1)))
    return F.when(ok != "", F.try_multiply(ok.try_cast("bigint"), power.cast("bigint")))


def fs_name(name: Column) -> Column:
    """vfat -> FAT; unknown names pass through."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in FS_NAMES.items() for x in pair]), name), name)


def tidy(text: Column) -> Column:
    """Underscores to spaces, runs of spaces to one, trimmed."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("_"), F.lit(" ")), r"\s+", " "))
