"""Read-side queries over the bar / recent-rows tables.

Each function is a batch query on demand; a periodic refresh is a trigger
(or a scheduler) around it, not a polling loop.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticksmith.functions import display, timefmt
from ticksmith.operators import ema, latest as L
from ticksmith.operators import rolling, series

# What the dashboard shows when there is no row.
EMPTY_SNAPSHOT = {"current_price": "$0.00", "price_change": "0.00%",
                  "current_volume": "$0.00", "market_status": "N/A"}
DEFAULT_ROWS = 100
RECENT_TRADES = 5


def snapshot(df: DataFrame, n: int = DEFAULT_ROWS, start: str | None = None,
             end: str | None = None, date_col: str = "date",
             order: Sequence[str] = L.ARRIVAL) -> DataFrame:
    """Current price, change and volume of the newest row, formatted.

    Last ``n`` rows, then the date range, then the newest row. Always one
    row: when nothing is left after the filter it is the neutral snapshot. A
    missing price or volume of an existing row is shown as ``$nan``.
    """
    window = L.latest_then_range(df, n, start, end, date_col, order)
    last = L.last_row(window, ["price", "change_percent", "volume"], order)
    have = F.col(L.ROWS) > 0

    def money(c: str):
        return F.coalesce(display.money(F.nanvl(c, F.lit(None).cast("double"))), F.lit(display.MISSING_MONEY))

    return last.select(
        "price", "change_percent", "volume",
        F.when(have, money("price")).otherwise(F.lit(EMPTY_SNAPSHOT["current_price"])).alias("current_price"),
        F.when(have, F.coalesce(display.signed_percent("change_percent"), F.lit("N/A")))
         .otherwise(F.lit(EMPTY_SNAPSHOT["price_change"])).alias("price_change"),
        F.when(have, money("volume")).otherwise(F.lit(EMPTY_SNAPSHOT["current_volume"])).alias("current_volume"),
        F.when(have, display.market_status("change_percent"))
         .otherwise(F.lit(EMPTY_SNAPSHOT["market_status"])).alias("market_status"),
    )


def market_status(df: DataFrame, change: str = "change_percent") -> DataFrame:
    """Per row: Bullish when the change is >= 0, else Bearish."""
    return df.withColumn("market_status", display.market_status(change)) \
             .withColumn("positive", display.is_bullish(change))


def recent_trades(df: DataFrame, n: int = RECENT_TRADES, ts: str = "timestamp",
                  order: Sequence[str] = L.ARRIVAL) -> DataFrame:
    """Last ``n`` rows as display text, oldest first: day, price, volume."""
    return L.latest(df, n, order).select(
        *order,
        timefmt.day(timefmt.parse_event_time(F.col(ts).cast("string"))).alias("day"),
        display.money("price").alias("price_text"),
        display.money("volume").alias("volume_text"))


def _axis(ts: str):
    """Message time text -> naive timestamp for a chart axis."""
    return timefmt.to_wall_clock(timefmt.parse_event_time(F.col(ts).cast("string"))).alias("x")


def price_series(df: DataFrame, ts: str = "timestamp", keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, _axis(ts), "price")


def ohlc_series(df: DataFrame, ts: str = "timestamp", keep: Sequence[str] = ()) -> DataFrame:
    """Candles: open, high, low and the bar's price as close."""
    return df.select(*keep, _axis(ts), "open", "high", "low", F.col("price").alias("close"))


def band_series(bands: DataFrame, n: int = DEFAULT_ROWS, start: str | None = None, end: str | None = None,
                ts: str = "window_start", order: Sequence[str] = ("window_start",)) -> DataFrame:
    """The mean and band panel: the last ``n`` windows, then the range on their start, oldest first."""
    rows = L.latest_then_range(bands, n, start, end, ts, order)
    return rows.select(timefmt.to_wall_clock(ts).alias("x"), F.col("bb_middle").alias("sma"),
                       F.col("bb_upper").alias("upper"), F.col("bb_lower").alias("lower"))


def _slice(df: DataFrame, n: int, keys: Sequence[str], order: Sequence[str], price: str = "price"):
    """The last ``n`` priced rows per key, and their window: at most ``n`` rows a group, so no blocks are needed."""
    priced = series.finite(df, price).where(F.col(price).isNotNull())
    return L.latest_per_key(priced, n, keys, order), Window.partitionBy(*keys).orderBy(*order)


def macd_series(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                lookback: int | None = DEFAULT_ROWS) -> DataFrame:
    """MACD line, signal and histogram as the chart computes them.

    With ``lookback`` the recursion is seeded on the first of the last
    ``lookback`` rows per key (the visible slice); ``None`` uses the full
    history.
    """
    if not lookback:
        return ema.macd(df, keys=keys, order=order)
    src, w = _slice(df, lookback, keys, order)
    if lookback > ema.block_rows_for([12, 26, 9]):  # more than one block
        return ema.macd(src, keys=keys, order=order)
    rows = src.withColumns({series.HALO: F.lit(False), ema.J: F.row_number().over(w) - 1, ema.CONT: F.lit(False)})
    return ema.macd_of_whole(rows, w, "price").drop(series.HALO, ema.J, ema.CONT)


def price_level_rsi_series(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                           lookback: int | None = DEFAULT_ROWS) -> DataFrame:
    if not lookback:
        return rolling.price_level_rsi(df, 14, keys=keys, order=order, out="RSI")
    src, w = _slice(df, lookback, keys, order)
    return rolling.add_price_level_rsi(src, w, "price", 14, "RSI")


def export_csv(df: DataFrame, path: str, n: int = DEFAULT_ROWS,
               order: Sequence[str] = L.ARRIVAL) -> str:
    """Write the latest ``n`` rows, oldest first, as CSV with a header; returns the folder.

    Spark writes no index column (a pandas export would put one first).
    """
    (L.latest(df, n, order).coalesce(1)  # n rows
       .sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path))
    return path


def read_export(spark, path: str, schema) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(os.path.join(path, "*.csv"))
