"""The full indicator frame, computed in one pass.

``RSI, SMA_20, SMA_50, BB_middle, BB_upper, BB_lower, EMA_12, EMA_26, MACD,
MACD_signal, MACD_hist`` added to every row. All of them are window
functions over the same halo blocks (series.py): one range shuffle and one
block shuffle of the rows, whatever the number of indicators or the size of
the largest instrument. The EMA carries add one join with a small row per
block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticksmith.operators import ema, rolling, series

# Indicator parameters of the dashboard's frame.
RSI_N = 14
SMA_FAST, SMA_SLOW = 20, 50
BB_N, BB_K = 20, 2.0
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9

FRAME_COLUMNS = ["RSI", "SMA_20", "SMA_50", "BB_middle", "BB_upper", "BB_lower",
                 "EMA_12", "EMA_26", "MACD", "MACD_signal", "MACD_hist"]


def frame_lookback() -> int:
    return max(RSI_N, SMA_SLOW - 1, BB_N - 1)


def indicator_frame(df: DataFrame, price: str = "price",
                    keys: Sequence[str] = ("symbol",),
                    order: Sequence[str] = ("ts", "seq"),
                    before: dict[str, str] | None = None, skip: str | None = None,
                    num_partitions: int | None = None) -> DataFrame:
    """``df`` plus the eleven indicator columns, per instrument in ``order``.

    Rows with a NULL, NaN or infinite price are left out (the recursion
    cannot span them). The window functions are grouped by dependency into
    few projections, so each window operator is one pass over a block group.

    To go on from earlier rows: ``skip`` flags rows that only fill the frames
    (they come first in their series and are dropped), ``before`` has, per
    recursive column, the column with its value before the first other row.
    """
    spans = [MACD_FAST, MACD_SLOW, MACD_SIGNAL]
    blk = series.blocks(series.finite(df, price).where(F.col(price).isNotNull()), keys, order, frame_lookback(),
                        ema.block_rows_for(spans), num_partitions)
    b, w = blk.frame, blk.window
    p = F.col(price)
    f_rsi, f_bb, f_slow = (series.frame(w, n) for n in (RSI_N, BB_N, SMA_SLOW))

    # 1: previous price, row index, band and slow-mean frames
    b = b.withColumns({
        "_delta": p - F.lag(p, 1).over(w),
        "_bb_n": F.count(p).over(f_bb), "_bb_avg": F.avg(p).over(f_bb),
        "_bb_std": F.stddev_samp(p).over(f_bb),
        "_slow_n": F.count(p).over(f_slow), "_slow_avg": F.avg(p).over(f_slow),
        **ema.index_columns(w, skip),
    })
    # 2: RSI frames over the differences, fast and slow EMA within the block
    st = ema.macd_states(price, MACD_FAST, MACD_SLOW, MACD_SIGNAL, before=before, skip=skip)
    d = F.col("_delta")
    gain = F.when(d > 0, d).otherwise(F.lit(0.0))
    loss = F.when(d < 0, -d).otherwise(F.lit(0.0))
    b = b.withColumns({
        "_rsi_n": F.count(F.lit(1)).over(f_rsi),
        "_rsi_gain": F.avg(gain).over(f_rsi), "_rsi_loss": F.avg(loss).over(f_rsi),
        **ema.local_columns(w, st)})
    # 3: the signal line, and one join for the carries of all three
    b = ema.with_line(ema.add_states(b, blk, st, has_local=True), ("EMA_12", "EMA_26", "MACD", "MACD_signal", "MACD_hist"))

    full_bb = F.col("_bb_n") >= BB_N
    middle = F.when(full_bb, F.col("_bb_avg"))
    spread = F.lit(BB_K) * F.when(full_bb, F.col("_bb_std"))
    out = (b if skip is None else b.where(~F.col(skip))).select(
        "*",
        F.when(F.col("_rsi_n") >= RSI_N,
               rolling.rsi_from_means(F.col("_rsi_gain"), F.col("_rsi_loss"))).alias("RSI"),
        middle.alias("SMA_20"),
        F.when(F.col("_slow_n") >= SMA_SLOW, F.col("_slow_avg")).alias("SMA_50"),
        middle.alias("BB_middle"), (middle + spread).alias("BB_upper"), (middle - spread).alias("BB_lower"),
    )
    return series.finish(out).select(*df.columns, *FRAME_COLUMNS)
