"""Latest rows, last row, range filters.

Top-n is a two-level tree: n rows per key within each group of ``FAN_IN``
input partitions, then n of those winners. Each first-level merge sees at
most ``FAN_IN * n`` rows per key, the last one ``(partitions / FAN_IN) * n``;
Spark plans the ``row_number() <= n`` filters as group limits on both sides
of the shuffle. Results come back oldest first.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARRIVAL = ("ts", "seq")
# Input partitions merged per first-level group of the top-n tree.
FAN_IN = 1024
ROWS = "_rows"


def _desc(order: Sequence[str]) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in order]


def _asc(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order]


def _group_limit(df: DataFrame, n: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First tree level: top ``n`` per key within each group of input partitions."""
    group = F.floor(F.spark_partition_id() / FAN_IN)
    w = Window.partitionBy(*keys, "_grp").orderBy(*_desc(order))
    return (df.withColumn("_grp", group)
            .withColumn("_rank", F.row_number().over(w))
            .filter(F.col("_rank") <= n)
            .drop("_grp", "_rank"))


def latest(df: DataFrame, n: int = 100, order: Sequence[str] = ARRIVAL) -> DataFrame:
    """The last ``n`` rows in ``order`` (the newest arrivals), oldest first."""
    if n < 0:
        raise ValueError("n must be >= 0")
    return _group_limit(df, n, (), order).orderBy(*_desc(order)).limit(n).orderBy(*_asc(order))


def latest_per_key(df: DataFrame, n: int, keys: Sequence[str],
                   order: Sequence[str] = ARRIVAL, rank: str | None = None) -> DataFrame:
    """The last ``n`` rows of every key (``rank`` 1 = newest)."""
    w = Window.partitionBy(*keys).orderBy(*_desc(order))
    out = (_group_limit(df, n, keys, order)
           .withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n))
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def latest_of_kind(tables: dict[str, DataFrame], kind: str, n: int = 100,
                   order: Sequence[str] | None = None) -> DataFrame:
    """``latest`` on one of the recent-rows tables; unknown kind raises."""
    if kind not in tables:
        raise ValueError(f"unknown data type: {kind!r} (expected one of {sorted(tables)})")
    df = tables[kind]
    received = [c for c in ("batch", "processed_at", "arrival_part", "arrival_seq") if c in df.columns]
    default = received or ARRIVAL
    return latest(df, n, order or default)


_DAY = re.compile(r"\d{4}-\d{2}-\d{2}$")


def in_range(c: str | Column, start: str | None, end: str | None,
             inclusive_end: bool = False, kind: str = "string") -> Column:
    """``start <= c <= end``; ``kind`` is the type of ``c``.

    ISO text compares as text: with a date-only ``end``,
    ``"2024-01-05T00:00:00" > "2024-01-05"``, so the end day itself is
    excluded; ``inclusive_end=True`` compares only the day part of ``c``
    against ``end``. Dates and timestamps compare as times with the same
    meaning: a date-only ``end`` is midnight, excluded, or with
    ``inclusive_end`` the whole day is in.
    """
    x = F.col(c) if isinstance(c, str) else c
    cond = F.lit(True)
    if kind in ("timestamp", "timestamp_ntz", "date"):
        def bound(text: str) -> Column:
            return F.lit(text).cast("timestamp_ntz" if kind != "timestamp" else kind)
        x = x.cast("timestamp_ntz") if kind == "date" else x
        if start:
            cond = cond & (x >= bound(start))
        if end and _DAY.match(end):
            cond = cond & ((x < bound(end) + F.expr("INTERVAL 1 DAY")) if inclusive_end else (x < bound(end)))
        elif end:
            cond = cond & (x <= bound(end))
        return cond
    x = x.cast("string")
    if start:
        cond = cond & (x >= F.lit(start))
    if end:
        cond = cond & ((F.substring(x, 1, len(end)) <= F.lit(end)) if inclusive_end
                       else (x <= F.lit(end)))
    return cond


def date_range(df: DataFrame, start: str | None, end: str | None, col: str = "date",
               inclusive_end: bool = False) -> DataFrame:
    """Rows of ``df`` in the range, by the type of ``col``; all rows unless both ends are given."""
    if not (start and end):
        return df
    return df.filter(in_range(col, start, end, inclusive_end, dict(df.dtypes)[col]))


def latest_then_range(df: DataFrame, n: int, start: str | None, end: str | None,
                      col: str = "date", order: Sequence[str] = ARRIVAL,
                      inclusive_end: bool = False) -> DataFrame:
    """Limit first, then filter: the filter sees only the last ``n`` rows."""
    return date_range(latest(df, n, order), start, end, col, inclusive_end)


def last_row(df: DataFrame, cols: Sequence[str], order: Sequence[str] = ARRIVAL) -> DataFrame:
    """One row holding ``cols`` of the newest row (NULLs when ``df`` is empty), and the number of rows."""
    newest = F.max_by(F.struct(*cols), F.struct(*order)).alias("_last")
    return df.agg(newest, F.count(F.lit(1)).alias(ROWS)).select(*[F.col(f"_last.{c}").alias(c) for c in cols], ROWS)
