"""Times as Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The offset of times that state none.
NAIVE_OFFSET = "+08:00"


def parsed(c: Column, naive_offset: str = NAIVE_OFFSET) -> Column:
    """A timestamp from ISO forms with 'T' or a space, 'Z', an offset or none; null if it is no time."""
    has_offset = c.rlike(r"(Z|[+-]\d{2}:?\d{2})\s*$") & c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d")
    return F.try_to_timestamp(F.when(has_offset, c).otherwise(F.concat(F.trim(c), F.lit(naive_offset))))


def centred(c: Column, at: Column, minutes: int) -> Column:
    """Within half of ``minutes`` (at least one) before and after a moment."""
    half = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(max(1, minutes // 2)))
    return (c >= at - half) & (c <= at + half)


def trailing(c: Column, now: Column, minutes: int) -> Column:
    """Within ``minutes`` before a moment, both ends included."""
    return (c >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))) & (c <= now)


def half_open(c: Column, since: Column, until: Column) -> Column:
    return (c >= since) & (c < until)
