"""Typing of price-history text cells, as native expressions.

CSV exports write numbers as display text: ``"64,036.5"``, ``"65.59K"``,
``"4.96%"``, dates as ``"12/31/2023"``. Each parser below is one Catalyst
expression (no UDF) and reproduces Python ``float()`` acceptance: Spark's
own cast also takes Java suffixes (``1d``, ``5f``), which Python rejects, so
every cast is guarded by a pattern of what Python accepts. Digit
underscores (``1_000``) are rejected (Python would take them).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's float() accepts, without digit underscores.
_PY_FLOAT = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"
# Python's str.strip() whitespace (ASCII part).
_WS = " \t\n\r\x0b\x0c"

# Volume suffixes in the order they are tested, and their factors.
VOLUME_SUFFIXES = [("K", 1e3), ("M", 1e6), ("B", 1e9)]

# Market date layouts accepted for the CSV ``Date`` column.
# One letter takes padded and unpadded numbers alike.
DATE_FORMATS = ["M/d/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy-M-d", "yyyy/M/d", "d MMM yyyy",
                "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss"]
# Day-first layouts, taken only where a whole source is read by one layout.
DAY_FIRST_FORMATS = ["d/M/yyyy", "d.M.yyyy", "d-M-yyyy"]


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    return F.btrim(_c(c), F.lit(_WS))


def py_float(c: str | Column, stripped: bool = False) -> Column:
    """``float(text)`` or NULL where Python would raise.

    The text is referenced once: a failed full match extracts ``""``, which
    casts to NULL. (``when(rlike(s), cast(s))`` would evaluate ``s`` twice:
    Spark does not share subexpressions across conditional branches.)
    """
    s = _c(c) if stripped else strip(c)
    return F.regexp_extract(s, _PY_FLOAT, 0).try_cast("double")


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def parse_number(c: str | Column) -> Column:
    """Thousands separators removed, then a number; unparseable -> NULL."""
    return nan_to_null(py_float(F.replace(_c(c), F.lit(","), F.lit(""))))


def parse_percent(c: str | Column) -> Column:
    """``"4.96%"`` -> 4.96; unparseable -> NULL."""
    return nan_to_null(py_float(F.replace(_c(c), F.lit("%"), F.lit(""))))


def volume_parts(c: str | Column) -> tuple[Column, Column]:
    """Volume text -> (number text, factor): the first suffix found sets both.

    Separate from the parse so a projection can compute it once per cell.
    """
    s = strip(c)
    body, factor = None, None
    for letter, f in VOLUME_SUFFIXES:
        b = F.replace(s, F.lit(letter), F.lit(""))
        body = F.when(s.contains(letter), b) if body is None else body.when(s.contains(letter), b)
        factor = (F.when(s.contains(letter), F.lit(f)) if factor is None
                  else factor.when(s.contains(letter), F.lit(f)))
    return strip(body.otherwise(F.replace(s, F.lit(","), F.lit("")))), factor.otherwise(F.lit(1.0))


def volume_from_parts(body: str | Column, factor: str | Column) -> Column:
    return F.coalesce(py_float(body, stripped=True) * _c(factor), F.lit(0.0))


def parse_volume(c: str | Column) -> Column:
    """Volume text with an optional K/M/B suffix -> double; missing/bad -> 0.0.

    The first suffix letter found (tested K, then M, then B, upper case only)
    is removed everywhere and sets the factor; commas are removed only when
    there is no suffix, so ``"1,234.5K"`` is unparseable (0.0).
    """
    return volume_from_parts(*volume_parts(c))


def parse_market_date(c: str | Column, formats: list[str] | None = None,
                      stripped: bool = False) -> Column:
    """First layout that parses wins; NULL when none does."""
    s = _c(c) if stripped else strip(c)
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in (formats or DATE_FORMATS)])


def parse_date_as(c: str | Column, layout: str | Column, formats: list[str]) -> Column:
    """The text read by the layout named in ``layout`` (one of ``formats``); NULL where it does not fit."""
    out = None
    for f in formats:
        here = F.try_to_timestamp(_c(c), F.lit(f))
        out = F.when(_c(layout) == f, here) if out is None else out.when(_c(layout) == f, here)
    return out
