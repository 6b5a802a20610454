"""Time parsing and ISO formatting.

Spark 4 runs with ANSI mode on, where ``to_timestamp`` raises on bad input;
every parse here is a ``try_`` variant and yields NULL instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_event_time(c: str | Column) -> Column:
    """ISO-8601 text (with or without fraction) -> TIMESTAMP, bad -> NULL."""
    return F.try_to_timestamp(_c(c))


def epoch_seconds(c: str | Column) -> Column:
    """Epoch seconds -> TIMESTAMP, rendered in the session zone (pinned to UTC)."""
    return F.timestamp_seconds(_c(c))


def iso_format(c: str | Column) -> Column:
    """``isoformat()`` layout: seconds always, microseconds only when non-zero."""
    ts = _c(c)
    frac = F.when(F.date_format(ts, "SSSSSS") != F.lit("000000"),
                  F.concat(F.lit("."), F.date_format(ts, "SSSSSS"))).otherwise(F.lit(""))
    return F.when(ts.isNotNull(), F.concat(F.date_format(ts, ISO_SECONDS), frac))


def day(c: str | Column) -> Column:
    return F.date_format(_c(c), "yyyy-MM-dd")


def shown(c: str | Column) -> Column:
    """Display time, to the second."""
    return F.date_format(_c(c), "yyyy-MM-dd HH:mm:ss")


def to_event_time(c: str | Column) -> Column:
    """Any stored time (NTZ, LTZ or text) -> TIMESTAMP usable by a watermark.

    Watermarks reject ``TIMESTAMP_NTZ``; with the session zone at UTC the
    cast keeps the wall-clock value.
    """
    return _c(c).cast("timestamp")


def to_wall_clock(c: str | Column) -> Column:
    """TIMESTAMP -> TIMESTAMP_NTZ (UTC wall clock), for comparison with naive tables."""
    return _c(c).cast("timestamp_ntz")
