import models
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticksmith.operators import ema, rolling, series
from ticksmith.plans import fixtures
from ticksmith.plans.indicators import indicator_frame

from sf_paths import SF_SMALL


def _ticks(spark):
    return fixtures.ticks(spark, SF_SMALL)


def _model(pdf):
    """The model's columns for every symbol, in the order symbol, ts, seq."""
    parts = [models.frame(g.sort_values(["ts", "seq"])["price"].tolist()) for _, g in pdf.groupby("symbol")]
    return {c: np.array([np.nan if v is None else v for p in parts for v in p[c]]) for c in parts[0]}


def _close(a, b, tol=1e-9):
    a, b = np.asarray(a, float), np.asarray(b, float)
    assert (np.isnan(a) == np.isnan(b)).all()
    m = ~np.isnan(a)
    assert np.allclose(a[m], b[m], rtol=tol, atol=tol)


def test_positions_are_a_permutation(spark):
    t = _ticks(spark)
    ix = series.with_global_position(t, ["symbol"], ["ts", "seq"], num_partitions=7)
    p = ix.toPandas().sort_values(["symbol", "ts", "seq"])
    assert (p["_pos"].to_numpy() == np.arange(len(p))).all()


@pytest.mark.parametrize("block", [7, 64, 1 << 14])
def test_rolling_matches_the_model_for_any_block_size(spark, block):
    t = _ticks(spark)
    b, w = series.blocked(t, ["symbol"], ["ts", "seq"], lookback=50, block_rows=block,
                          num_partitions=3)
    b = rolling.add_diff(b, w, "price", "diff")
    b = rolling.add_rsi(b, w, "price", 14, "RSI")
    b = rolling.add_rolling_mean(b, w, "price", 50, "SMA_50")
    b = rolling.add_bollinger(b, w, "price", 20, 2.0)
    got = series.finish(b).toPandas().sort_values(["symbol", "ts", "seq"])
    exp = _model(t.toPandas())
    assert len(got) == len(exp["diff"])
    for c in ["diff", "RSI", "SMA_50", "BB_middle", "BB_upper", "BB_lower"]:
        _close(got[c], exp[c])


@pytest.mark.parametrize("block", [16, 97, None])
def test_macd_matches_the_model_for_any_block_size(spark, block):
    t = _ticks(spark)
    got = ema.macd(t, block_rows=block).toPandas().sort_values(["symbol", "ts", "seq"])
    exp = _model(t.toPandas())
    for c in ["EMA_12", "EMA_26", "MACD", "MACD_signal", "MACD_hist"]:
        _close(got[c], exp[c], 1e-9)


@pytest.mark.parametrize("span", [1, 1.5, 2, 12, 200, 1000])
def test_ema_is_exact_for_any_span_block_and_buffer(spark, monkeypatch, span):
    rng = np.random.default_rng(int(span))
    rows = [("hot", i, 0, float(x)) for i, x in enumerate(rng.uniform(1, 50, 5000))]
    rows += [(f"s{k}", i, 0, float(i + k)) for k in range(40) for i in range(k % 5 + 1)] + [(None, i, 0, float(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "symbol string, ts long, seq long, price double")
    want = np.concatenate([models.recursion([r[3] for r in rows if r[0] == k], span)
                           for k in sorted({r[0] for r in rows}, key=lambda k: (k is not None, k or ""))])
    seen = []
    for fan, buffer in ((512, "4096"), (2, "300")):  # one level of summaries, and many
        monkeypatch.setattr(ema, "FAN", fan)
        spark.conf.set("spark.sql.windowExec.buffer.in.memory.threshold", buffer)
        try:
            got = ema.ema(df, span, out="e").orderBy("symbol", "ts").toPandas()["e"].to_numpy()
        finally:
            spark.conf.unset("spark.sql.windowExec.buffer.in.memory.threshold")
        _close(got, want)
        seen.append(got)
    _close(seen[0], seen[1], 1e-12)


def test_rows_are_hardly_copied_whatever_the_span(spark):
    df = spark.range(20_000).select(F.lit("x").alias("symbol"), F.col("id").alias("ts"), F.col("id").alias("seq"),
                                    F.col("id").cast("double").alias("price"))
    for span in (2, 30, 200, 1000):
        cut, _ = series.blocked(df, ["symbol"], ["ts", "seq"], 1, ema.block_rows_for([span]))
        assert cut.count() < 1.1 * 20_000
    for n in (50, 4081, 6000):
        cut, _ = series.blocked(df, ["symbol"], ["ts", "seq"], n - 1)
        assert cut.count() <= 2.1 * 20_000


def test_long_macd_has_no_gaps(spark):
    df = spark.range(8000).select(F.lit("x").alias("symbol"), F.col("id").alias("ts"), F.col("id").alias("seq"),
                                  (F.col("id") % 37 + 5).cast("double").alias("price"))
    got = ema.macd(df, fast=5, slow=200, signal=9).toPandas().sort_values("ts")
    xs = got["price"].tolist()
    line = [a - b for a, b in zip(models.recursion(xs, 5), models.recursion(xs, 200))]
    _close(got["MACD_hist"], [a - b for a, b in zip(line, models.recursion(line, 9))], 1e-9)


def test_nan_and_infinity_are_missing(spark):
    xs = [float(i % 11 + 1) for i in range(60)]
    for i, bad in ((25, float("nan")), (40, float("inf"))):
        xs[i] = bad
    df = _series(spark, xs)
    got = rolling.bollinger(rolling.diff(rolling.sma(df, 5)), 5, 2.0).orderBy("seq").toPandas()
    _close(got["sma_5"], [np.nan if v is None else v for v in models.mean(xs, 5)])
    _close(got["diff"], [np.nan if v is None else v for v in models.difference(xs)])
    _close(got["BB_middle"], [np.nan if v is None else v for v in models.mean(xs, 5)])
    rsi = rolling.rsi(df, 5).orderBy("seq").toPandas()["rsi"]
    _close(rsi, [np.nan if v is None else v for v in models.strength(xs, 5)])
    kept = [x for x in xs if models.present(x)]
    e = ema.ema(df, 12).orderBy("seq").toPandas()["ema_12"]
    _close(e, models.recursion(kept, 12))


def test_indicator_frame_matches_the_model(spark):
    t = _ticks(spark)
    got = indicator_frame(t).toPandas().sort_values(["symbol", "ts", "seq"])
    exp = _model(t.toPandas())
    for c in ["RSI", "SMA_20", "SMA_50", "BB_middle", "BB_upper", "BB_lower",
              "EMA_12", "EMA_26", "MACD", "MACD_signal", "MACD_hist"]:
        _close(got[c], exp[c])
    # properties
    m = got["BB_middle"].notna()
    assert (got.loc[m, "BB_lower"] <= got.loc[m, "BB_middle"] + 1e-9).all()
    assert (got.loc[m, "BB_middle"] <= got.loc[m, "BB_upper"] + 1e-9).all()
    r = got["RSI"].dropna()
    assert ((r >= 0) & (r <= 100)).all()
    _close(got["MACD_hist"], got["MACD"] - got["MACD_signal"], 1e-9)


def _series(spark, prices):
    rows = [("x", (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i)).to_pydatetime(), i, float(p))
            for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq long, price double")


def test_rsi_edges(spark):
    # FIXTURES §3: 14 equal prices -> NULL; rising -> 100; falling -> 0; first at row 14.
    for prices, want in [([5.0] * 20, None), (list(range(1, 21)), 100.0), (list(range(20, 0, -1)), 0.0)]:
        got = rolling.rsi(_series(spark, prices), 14).orderBy("seq").toPandas()["rsi"].tolist()
        assert all(pd.isna(v) for v in got[:13])
        for v in got[13:]:
            assert (pd.isna(v) if want is None else v == want)


def test_price_level_rsi_is_100_for_positive_prices(spark):
    got = rolling.price_level_rsi(_series(spark, [3.0, 1.0, 2.0] * 7), 14).orderBy("seq").toPandas()
    vals = got["rsi_price_level"].tolist()
    assert all(pd.isna(v) for v in vals[:13]) and all(v == 100.0 for v in vals[13:])


def test_ema_of_constant_and_span_one(spark):
    s = _series(spark, [7.5] * 40)
    got = ema.ema(s, 12).toPandas()["ema_12"]
    assert np.allclose(got, 7.5)
    ident = ema.ema(_series(spark, [1.0, 5.0, 2.0]), 1).orderBy("seq").toPandas()["ema_1"].tolist()
    assert ident == [1.0, 5.0, 2.0]


def test_hot_key_is_split_across_blocks(spark):
    """One symbol with most rows: block groups stay bounded by block + lookback."""
    hot = spark.range(0, 5000).select(F.lit("HOT").alias("symbol"),
                                      F.expr("timestamp_seconds(id)").cast("timestamp_ntz").alias("ts"),
                                      F.col("id").alias("seq"),
                                      F.expr("cast(id % 97 as double)").alias("price"))
    cold = spark.range(0, 50).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("symbol"),
                                     F.expr("timestamp_seconds(id)").cast("timestamp_ntz").alias("ts"),
                                     F.col("id").alias("seq"), F.lit(1.0).alias("price"))
    df = hot.unionByName(cold)
    b, w = series.blocked(df, ["symbol"], ["ts", "seq"], lookback=19, block_rows=256, num_partitions=6)
    sizes = b.groupBy("symbol", series.BLOCK).count().agg(F.max("count")).first()[0]
    assert sizes <= 256 + 19
    got = series.finish(rolling.add_rolling_mean(b, w, "price", 20, "m")).filter("symbol = 'HOT'")
    xs = df.filter("symbol = 'HOT'").toPandas().sort_values("seq")["price"].tolist()
    _close(got.toPandas().sort_values("seq")["m"], [np.nan if v is None else v for v in models.mean(xs, 20)])


def test_input_partitioning_does_not_change_results(spark):
    t = _ticks(spark)
    a = rolling.sma(t.repartition(1), 20).toPandas().sort_values(["symbol", "ts", "seq"])
    b = rolling.sma(t.repartition(5, "price"), 20).toPandas().sort_values(["symbol", "ts", "seq"])
    _close(a["sma_20"], b["sma_20"], 1e-12)


def test_null_price_blanks_frames(spark):
    prices = [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0]
    df = spark.createDataFrame([("x", i, i, p) for i, p in enumerate(prices)], "symbol string, ts long, seq long, price double")
    got = rolling.diff(rolling.sma(df, 3)).orderBy("seq").toPandas()
    _close(got["sma_3"], [np.nan if v is None else v for v in models.mean(prices, 3)])
    _close(got["diff"], [np.nan if v is None else v for v in models.difference(prices)])


def test_single_unkeyed_series(spark):
    """The reference's case: one instrument, no symbol column."""
    t = _ticks(spark).filter(F.col("symbol") == "click").drop("symbol")
    got = indicator_frame(t, keys=()).toPandas().sort_values(["ts", "seq"])
    p = t.toPandas().sort_values(["ts", "seq"])["price"].tolist()
    exp = {k: [np.nan if v is None else v for v in col] for k, col in models.frame(p).items()}
    _close(got["SMA_50"], exp["SMA_50"])
    _close(got["EMA_26"], exp["EMA_26"])
    s = rolling.sma(t, 20, keys=()).toPandas().sort_values(["ts", "seq"])
    _close(s["sma_20"], exp["SMA_20"])
