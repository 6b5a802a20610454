"""Row-position indicators: difference, rolling mean/std, bands, RSI.

Definitions follow pandas' ``diff`` / ``rolling(n)`` defaults: a rolling value
exists only once the frame holds ``n`` non-null values, the sample standard
deviation has ddof 1, and RSI's first difference counts as zero gain and zero
loss (so the first RSI appears on the 14th row, not the 15th). NaN and
infinite prices are missing values and come out as NULL.

Every ``add_*`` step takes a frame already cut into halo blocks
(:mod:`ticksmith.operators.series`) and the block window; the public
functions do the cutting themselves. All steps are built-in window
functions: one exchange and one sort for any number of them.

Spark aggregates a sliding frame anew for every row, which is ``n`` steps a
row. Beyond ``WIDE`` rows a frame is therefore put together from two running
aggregates (``add_moments``), a few steps a row whatever its length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ticksmith.operators import series

DEFAULT_KEYS = ("symbol",)
DEFAULT_ORDER = ("ts", "seq")
#: Frames longer than this are merged from running moments.
WIDE = 256


def _full(c: str | Column, f: WindowSpec, n: int, agg) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(c).over(f) >= n, agg(c).over(f))


def add_diff(b: DataFrame, w: WindowSpec, src: str, out: str) -> DataFrame:
    return b.withColumn(out, F.col(src) - F.lag(src, 1).over(w))


def add_rolling_mean(b: DataFrame, w: WindowSpec, src: str, n: int, out: str) -> DataFrame:
    return b.withColumn(out, _full(src, series.frame(w, n), n, F.avg))


def add_rolling_std(b: DataFrame, w: WindowSpec, src: str, n: int, out: str) -> DataFrame:
    return b.withColumn(out, _full(src, series.frame(w, n), n, F.stddev_samp))


def add_bollinger(b: DataFrame, w: WindowSpec, src: str, n: int, k: float,
                  middle: str = "BB_middle", upper: str = "BB_upper",
                  lower: str = "BB_lower") -> DataFrame:
    f = series.frame(w, n)
    x = F.col(src)
    b = (b.withColumn("_bb_n", F.count(x).over(f))
         .withColumn("_bb_avg", F.avg(x).over(f))
         .withColumn("_bb_std", F.stddev_samp(x).over(f)))
    full = F.col("_bb_n") >= n
    return (b.withColumn(middle, F.when(full, F.col("_bb_avg")))
            .withColumn(upper, F.col(middle) + F.lit(k) * F.when(full, F.col("_bb_std")))
            .withColumn(lower, F.col(middle) - F.lit(k) * F.when(full, F.col("_bb_std")))
            .drop("_bb_n", "_bb_avg", "_bb_std"))


def add_moments(b: DataFrame, w: WindowSpec, keys: Sequence[str], src: str, n: int,
                count: str = "_mo_n", mean: str = "_mo_mean", std: str = "_mo_std") -> DataFrame:
    """Count, mean and sample deviation of the last ``n`` rows, in a few steps a row whatever ``n``.

    Positions are cut into runs of ``n``. A frame is the end of one run and the
    beginning of the next, so it is the merge of two running aggregates: of the
    next run from its first row on, and of the run before from its last row back
    (looked up at the frame's first row). Moments (count, mean, sum of squared
    deviations) merge without the cancelling of differences of sums.
    """
    run = F.expr(f"{series.POS} div {n}")
    b = b.withColumn("_mo_run", run)
    within = Window.partitionBy(*keys, series.BLOCK, "_mo_run")
    x = F.col(src)

    def moments(order: Column) -> Column:
        f = within.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return F.struct(F.count(x).over(f).alias("n"), F.coalesce(F.avg(x).over(f), F.lit(0.0)).alias("m"),
                        F.coalesce(F.var_pop(x).over(f) * F.count(x).over(f), F.lit(0.0)).alias("d"))

    b = b.withColumn("_mo_head", moments(F.col(series.POS).asc())).withColumn("_mo_back", moments(F.col(series.POS).desc()))
    # a frame that ends with its run is that run
    b = b.withColumn("_mo_tail", F.when((F.col(series.POS) + 1) % n != 0, F.lag("_mo_back", n - 1).over(w)))
    n1, n2 = F.coalesce(F.col("_mo_tail.n"), F.lit(0)), F.col("_mo_head.n")
    m1, m2 = F.coalesce(F.col("_mo_tail.m"), F.lit(0.0)), F.col("_mo_head.m")
    all_n = (n1 + n2).cast("double")
    apart = m2 - m1
    whole = F.when(all_n > 0, (m1 * n1 + m2 * n2) / all_n)
    spread = F.coalesce(F.col("_mo_tail.d"), F.lit(0.0)) + F.col("_mo_head.d") + F.when(all_n > 0, apart * apart * n1 * n2 / all_n)
    return b.select("*", (n1 + n2).alias(count), whole.alias(mean), F.when(all_n > 1, F.sqrt(spread / (all_n - 1))).alias(std)) \
        .drop("_mo_run", "_mo_head", "_mo_back", "_mo_tail")


def _wide(b: DataFrame, w: WindowSpec, keys: Sequence[str], src: str, n: int, outs: dict[str, Column]) -> DataFrame:
    full = F.col("_mo_n") >= n
    return add_moments(b, w, keys, src, n).withColumns({c: F.when(full, e) for c, e in outs.items()}) \
        .drop("_mo_n", "_mo_mean", "_mo_std")


def rsi_from_means(avg_gain: Column, avg_loss: Column) -> Column:
    """100 - 100/(1 + gain/loss); loss 0 gives 100, gain and loss 0 give NULL.

    Written without a division by zero, which raises under ANSI mode.
    """
    return (F.when(avg_loss > 0, F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + avg_gain / avg_loss))
            .when(avg_gain > 0, F.lit(100.0)))


def add_rsi(b: DataFrame, w: WindowSpec, src: str, n: int, out: str) -> DataFrame:
    d = "_rsi_delta"
    b = add_diff(b, w, src, d)
    # A NULL difference (first row) is neither gain nor loss: 0 for both.
    gain = F.when(F.col(d) > 0, F.col(d)).otherwise(F.lit(0.0))
    loss = F.when(F.col(d) < 0, -F.col(d)).otherwise(F.lit(0.0))
    f = series.frame(w, n)
    b = (b.withColumn("_rsi_n", F.count(F.lit(1)).over(f))
         .withColumn("_rsi_gain", F.avg(gain).over(f))
         .withColumn("_rsi_loss", F.avg(loss).over(f)))
    rsi = rsi_from_means(F.col("_rsi_gain"), F.col("_rsi_loss"))
    return (b.withColumn(out, F.when(F.col("_rsi_n") >= n, rsi))
            .drop(d, "_rsi_n", "_rsi_gain", "_rsi_loss"))


def add_price_level_rsi(b: DataFrame, w: WindowSpec, src: str, n: int, out: str) -> DataFrame:
    """The RSI formula applied to the prices in the frame, not to differences.

    Kept for compatibility with charts that plot this quantity; for any
    strictly positive series it is 100 once the frame is full.
    """
    p = F.col(src)
    f = series.frame(w, n)
    b = (b.withColumn("_pl_n", F.count(p).over(f))
         .withColumn("_pl_pos", F.avg(F.when(p > 0, p).otherwise(F.lit(0.0))).over(f))
         .withColumn("_pl_neg", -F.avg(F.when(p < 0, p).otherwise(F.lit(0.0))).over(f)))
    rsi = rsi_from_means(F.col("_pl_pos"), F.col("_pl_neg"))
    return b.withColumn(out, F.when(F.col("_pl_n") >= n, rsi)).drop("_pl_n", "_pl_pos", "_pl_neg")


# ---------------------------------------------------------------- public API

def _run(df: DataFrame, price: str, keys, order, lookback: int, step) -> DataFrame:
    b, w = series.blocked(series.finite(df, price), keys, order, lookback)
    return series.finish(step(b, w))


def diff(df: DataFrame, price: str = "price", out: str = "diff",
         keys: Sequence[str] = DEFAULT_KEYS, order: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    return _run(df, price, keys, order, 1, lambda b, w: add_diff(b, w, price, out))


def sma(df: DataFrame, n: int, price: str = "price", out: str | None = None,
        keys: Sequence[str] = DEFAULT_KEYS, order: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    out = out or f"sma_{n}"
    if n > WIDE:
        return _run(df, price, keys, order, n - 1, lambda b, w: _wide(b, w, keys, price, n, {out: F.col("_mo_mean")}))
    return _run(df, price, keys, order, n - 1, lambda b, w: add_rolling_mean(b, w, price, n, out))


def rolling_std(df: DataFrame, n: int, price: str = "price", out: str | None = None,
                keys: Sequence[str] = DEFAULT_KEYS, order: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    out = out or f"std_{n}"
    if n > WIDE:
        return _run(df, price, keys, order, n - 1, lambda b, w: _wide(b, w, keys, price, n, {out: F.col("_mo_std")}))
    return _run(df, price, keys, order, n - 1, lambda b, w: add_rolling_std(b, w, price, n, out))


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, price: str = "price",
              keys: Sequence[str] = DEFAULT_KEYS, order: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    if n > WIDE:
        mean, std = F.col("_mo_mean"), F.col("_mo_std")
        outs = {"BB_middle": mean, "BB_upper": mean + F.lit(k) * std, "BB_lower": mean - F.lit(k) * std}
        return _run(df, price, keys, order, n - 1, lambda b, w: _wide(b, w, keys, price, n, outs))
    return _run(df, price, keys, order, n - 1, lambda b, w: add_bollinger(b, w, price, n, k))


def rsi(df: DataFrame, n: int = 14, price: str = "price", out: str = "rsi",
        keys: Sequence[str] = DEFAULT_KEYS, order: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    # The oldest difference in the frame needs the price one row further back.
    return _run(df, price, keys, order, n, lambda b, w: add_rsi(b, w, price, n, out))


def price_level_rsi(df: DataFrame, n: int = 14, price: str = "price", out: str = "rsi_price_level",
                    keys: Sequence[str] = DEFAULT_KEYS, order: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    return _run(df, price, keys, order, n - 1, lambda b, w: add_price_level_rsi(b, w, price, n, out))
