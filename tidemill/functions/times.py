"""Time arithmetic on timestamps without a zone that no session zone can shift."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 00:00 of the clock time of ``ts``."""
    seconds = F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def clock(micro: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of such microseconds."""
    second = F.floor(micro / 1_000_000).cast("long")
    day, rest = F.floor(second / 86400).cast("int"), F.pmod(second, F.lit(86400))
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws("", F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string"), F.lit(" "), part(F.floor(rest / 3600)), F.lit(":"), part(F.floor(rest % 3600 / 60)), F.lit(":"), part(rest % 60))
