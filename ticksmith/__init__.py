"""ticksmith: Spark-native market indicators.

Every function takes and returns DataFrames; nothing holds a session.

    from ticksmith import indicator_frame, window_stats, snapshot
    frame = indicator_frame(ticks)                      # RSI, SMA, bands, EMA, MACD per symbol
    bands = window_stats(ticks, ts="ts", value="price")  # sliding 5-minute windows
"""

from ticksmith.operators.ema import ema, macd
from ticksmith.operators.latest import date_range, latest, latest_per_key, latest_then_range
from ticksmith.operators.rolling import bollinger, diff, price_level_rsi, rolling_std, rsi, sma
from ticksmith.operators.timewin import sliding_bands, sliding_sma, window_stats
from ticksmith.plans.indicators import indicator_frame
from ticksmith.plans.normalize import history_bars, normalize_csv_bars, to_messages
from ticksmith.plans.views import (export_csv, macd_series, market_status, ohlc_series,
                                   price_level_rsi_series, price_series, recent_trades, snapshot)
from ticksmith.session import build_session

__all__ = [
    "bollinger", "build_session", "date_range", "diff", "ema", "export_csv", "history_bars",
    "indicator_frame", "latest", "latest_per_key", "latest_then_range", "macd", "macd_series",
    "market_status", "normalize_csv_bars", "ohlc_series", "price_level_rsi", "price_level_rsi_series",
    "price_series", "recent_trades", "rolling_std", "rsi", "sliding_bands", "sliding_sma", "sma",
    "snapshot", "to_messages", "window_stats",
]
