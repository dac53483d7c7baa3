"""Sizes, percentages, speeds and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = ("KiB", "MiB", "GiB", "TiB")


def _whole(n: Column, by: Column) -> Column:
    """n / by cut off, of decimals without a fraction.  The rest goes first: a decimal quotient is rounded to
    six places, so that one just under a whole number would reach it."""
    return F.floor((n - n % by) / by)


def format_bytes(n: Column) -> Column:
    """In steps of 1,024 up to TiB, with two decimals, cut off and not rounded."""
    n = n.cast("decimal(38,0)")
    hundredths = lambda i: _whole(n * 100, F.lit(1024**i).cast("decimal(20,0)"))
    shown = lambda i: F.concat(F.floor(hundredths(i) / 100).cast("string"), F.lit("."), F.lpad((hundredths(i) % 100).cast("string"), 2, "0"), F.lit(f" {_UNITS[i - 1]}"))
    out = shown(4)
    for i in (3, 2, 1):
        out = F.when(n < 1024 ** (i + 1), shown(i)).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def bytes_text(n: int) -> str:
    if n < 1024:
        return f"{n} B"
    i = min(4, (n.bit_length() - 1) // 10)
    h = n * 100 // 1024**i
    return f"{h // 100}.{h % 100:02d} {_UNITS[i - 1]}"


def format_speed(n: Column) -> Column:
    return F.concat(format_bytes(n), F.lit("/s"))


def percent(done_bytes: Column, total_bytes: Column, done_files: Column, total_files: Column) -> Column:
    """Whole percent by bytes if there are any to do, else by files, else 100."""
    part = lambda d, t: _whole(F.least(d, t).cast("decimal(30,0)") * 100, F.nullif(t.cast("decimal(20,0)"), F.lit(0)))
    return F.when(total_bytes > 0, part(done_bytes, total_bytes)).when(total_files > 0, part(done_files, total_files)).otherwise(100).cast("int")


def speed(done_bytes: Column, elapsed_ns: Column) -> Column:
    """Bytes a second."""
    return F.when(elapsed_ns > 0, _whole(done_bytes.cast("decimal(28,0)") * 1_000_000_000, elapsed_ns.cast("decimal(20,0)")).cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)"))


def parse_md5(text: Column) -> Column:
    """16 bytes from 32 hex digits in either case; null for anything else."""
    return F.when(text.rlike(r"\A[0-9A-Fa-f]{32}\z"), F.unhex(text))
