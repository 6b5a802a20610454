"""Display formats and small arithmetic used by the views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display formats of the dashboard numbers.
MONEY_PREFIX = "$"
MONEY_DECIMALS = 2
PERCENT_DECIMALS = 2
MISSING_MONEY = "$nan"
STATUS_UP, STATUS_DOWN = "Bullish", "Bearish"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    """``$1,234.50``: thousands separators, two decimals."""
    x = _c(c)
    return F.when(x.isNotNull(), F.concat(F.lit(MONEY_PREFIX), F.format_number(x, MONEY_DECIMALS)))


def signed_percent(c: str | Column) -> Column:
    """``+1.23%`` / ``-0.50%``; a tie goes to the even digit (``format_number``; ``%.2f`` would round it up)."""
    x = _c(c).cast("double")
    digits = F.replace(F.format_number(F.abs(x), PERCENT_DECIMALS), F.lit(","), F.lit(""))
    shown = F.when(F.isnan(x), F.lit("nan")).otherwise(digits)
    return F.when(x.isNotNull(), F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("+")), shown, F.lit("%")))


def band(middle: str | Column, spread: str | Column, k: float) -> tuple[Column, Column]:
    """``middle + k*spread`` and ``middle - k*spread``."""
    m, s = _c(middle), _c(spread)
    return m + F.lit(k) * s, m - F.lit(k) * s


def is_bullish(change: str | Column) -> Column:
    """``change >= 0``; NULL and NaN count as not bullish.

    Spark orders NaN above every number, so ``NaN >= 0`` would be true here
    where Python's comparison is false: the NaN guard keeps Python's answer.
    """
    x = _c(change)
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (x >= 0), F.lit(False))


def market_status(change: str | Column) -> Column:
    return F.when(is_bullish(change), F.lit(STATUS_UP)).otherwise(F.lit(STATUS_DOWN))
