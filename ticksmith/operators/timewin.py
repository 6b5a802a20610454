"""Sliding event-time windows: mean and Bollinger bands, batch and streaming.

The time-window SMA and the bands share input and window, so one aggregate
computes ``avg`` and ``stddev_samp`` once and two projections are cut from
it. Spark expands each row into its ``duration/slide`` windows and
aggregates partially before the shuffle, so the shuffle carries one partial
state per (task, window), however many rows one window or one instrument
holds. The same function serves a streaming frame (after ``withWatermark``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticksmith.functions.display import band

# Window, slide and band width of the streaming indicators.
WINDOW = "5 minutes"
SLIDE = "1 minute"
BAND_K = 2.0


def window_stats(df: DataFrame, ts: str = "timestamp", value: str = "price",
                 duration: str = WINDOW, slide: str = SLIDE, k: float = BAND_K,
                 keys: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, window): ``bb_middle, bb_std, bb_upper, bb_lower``.

    ``bb_std`` is the sample standard deviation: NULL for a one-row window,
    and so are the bands. Rows with a NULL event time fall in no window.
    """
    agg = (df.groupBy(*keys, F.window(ts, duration, slide).alias("window"))
           .agg(F.avg(value).alias("bb_middle"), F.stddev_samp(value).alias("bb_std")))
    upper, lower = band("bb_middle", "bb_std", k)
    return agg.select(*keys,
                      F.col("window.start").alias("window_start"),
                      F.col("window.end").alias("window_end"),
                      "bb_middle", "bb_std",
                      upper.alias("bb_upper"), lower.alias("bb_lower"))


def sma_view(stats: DataFrame, keys: Sequence[str] = (), name: str = "sma_20") -> DataFrame:
    """The time-window mean under the result name the SMA topic uses.

    Note the name is historical: it is the mean over a time window, not over
    20 rows (see ``rolling.sma`` for that).
    """
    return stats.select(*keys, "window_start", "window_end", F.col("bb_middle").alias(name))


def bands_view(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return stats.select(*keys, "window_start", "window_end",
                        "bb_middle", "bb_std", "bb_upper", "bb_lower")


def sliding_sma(df: DataFrame, ts: str = "timestamp", value: str = "price",
                duration: str = WINDOW, slide: str = SLIDE,
                keys: Sequence[str] = ()) -> DataFrame:
    return sma_view(window_stats(df, ts, value, duration, slide, keys=keys), keys)


def sliding_bands(df: DataFrame, ts: str = "timestamp", value: str = "price",
                  duration: str = WINDOW, slide: str = SLIDE, k: float = BAND_K,
                  keys: Sequence[str] = ()) -> DataFrame:
    return window_stats(df, ts, value, duration, slide, k, keys)
