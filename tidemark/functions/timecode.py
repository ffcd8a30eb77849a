"""Exact time arithmetic on whole microseconds, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def overlap_us(start_a, end_a, start_b, end_b) -> Column:
    """Shared length of two half-open intervals, never negative."""
    return F.greatest(F.lit(0).cast("long"), F.least(_c(end_a), _c(end_b)) - F.greatest(_c(start_a), _c(start_b)))


def pts_to_us(pts, numerator, denominator, origin_us=0) -> Column:
    """Presentation time stamp in a rational time base to microseconds, ties away from zero, minus the origin."""
    big = _c(pts).cast("decimal(38,0)") * _c(numerator).cast("decimal(10,0)") * F.lit(2_000_000).cast("decimal(8,0)")
    den = _c(denominator).cast("decimal(10,0)")
    size = F.floor((F.abs(big) + den) / (den * 2)).cast("long")
    return F.when(_c(pts) < 0, -size).otherwise(size) - _c(origin_us)


def seconds_to_us(seconds) -> Column:
    """Ties go to the even microsecond."""
    return F.bround(_c(seconds).cast("double") * 1_000_000).cast("long")


def us_to_seconds(us) -> Column:
    return _c(us) / F.lit(1_000_000.0)


def format_timestamp(us, milliseconds: bool = True) -> Column:
    """H:MM:SS.mmm with a sign for negative times; parts of a millisecond are cut off."""
    us = _c(us)
    ms = F.floor(F.abs(us) / 1000).cast("long")
    s = F.floor(ms / 1000).cast("long")
    sign = F.when(us < 0, "-").otherwise("")
    parts = [sign, F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60]
    return F.format_string("%s%d:%02d:%02d.%03d", *parts, ms % 1000) if milliseconds else F.format_string("%s%d:%02d:%02d", *parts)


def format_srt(us) -> Column:
    """HH:MM:SS,mmm; negative times show as zero."""
    ms = F.floor(F.greatest(F.lit(0).cast("long"), _c(us)) / 1000).cast("long")
    s = F.floor(ms / 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60, ms % 1000)


def parse_time(text) -> Column:
    """Seconds, M:S or H:M:S to microseconds; blank is null, more than three parts is null."""
    parts = F.split(F.trim(_c(text)), ":")
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc * 60 + x.cast("double"))
    return F.when((F.trim(_c(text)) != "") & (F.size(parts) <= 3), seconds_to_us(total))


def rate(text) -> Column:
    """'30000/1001' to a double; '0/0', 'N/A' and other non-numbers are null."""
    parts = F.split(_c(text), "/")
    top, low = parts.getItem(0).try_cast("double"), F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(2)).try_cast("double")).otherwise(F.lit(1.0))
    return F.when(low != 0, top / low)
