import pandas as pd
from pyspark.sql import functions as F

from ticksmith.functions import display
from ticksmith.operators import latest as L
from ticksmith.operators import timewin
from ticksmith.plans import fixtures, views

from sf_paths import SF_SMALL


def test_sma_equals_band_middle_and_band_order(spark):
    t = fixtures.ticks(spark, SF_SMALL)
    stats = timewin.window_stats(t, ts="ts", value="price")
    sma = timewin.sliding_sma(t, ts="ts", value="price")
    j = stats.join(sma, ["window_start", "window_end"])
    assert j.filter(F.abs(F.col("bb_middle") - F.col("sma_20")) > 1e-12).count() == 0
    assert j.filter("bb_lower > bb_middle or bb_middle > bb_upper").count() == 0
    assert stats.count() == sma.count()


def test_one_row_window_has_null_std(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:30", 10.0)], "timestamp string, price double") \
        .withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    rows = timewin.window_stats(df).collect()
    assert len(rows) == 5
    assert all(r.bb_std is None and r.bb_upper is None and r.bb_middle == 10.0 for r in rows)


def _msgs(spark):
    rows = [(i, f"2024-01-0{1 + i // 3}T00:00:00", f"2024-01-0{1 + i // 3}T00:00:00", 100.0 + i, 10.0 * i,
             float(i - 4)) for i in range(9)]
    return spark.createDataFrame(rows, "seq long, timestamp string, date string, price double, "
                                       "volume double, change_percent double")


def test_date_range_excludes_end_day(spark):
    # FIXTURES §3: '2024-01-05'..'2024-01-05' excludes the row 2024-01-05T00:00:00.
    df = spark.createDataFrame([("2024-01-05T00:00:00",)], "date string")
    assert L.date_range(df, "2024-01-05", "2024-01-05").count() == 0
    assert L.date_range(df, "2024-01-05", "2024-01-05", inclusive_end=True).count() == 1


def test_limit_then_filter(spark):
    m = _msgs(spark)
    got = L.latest_then_range(m, 4, "2024-01-01", "2024-01-03", order=("seq",))
    # last 4 rows are seq 5..8 (dates 01-02, 01-03, 01-03, 01-03); filter keeps 01-02 only
    assert sorted(r.seq for r in got.collect()) == [5]


def test_latest_per_key(spark):
    m = _msgs(spark).withColumn("symbol", (F.col("seq") % 2).cast("string"))
    got = L.latest_per_key(m, 2, ["symbol"], ("seq",)).collect()
    assert sorted(r.seq for r in got) == [5, 6, 7, 8]


def test_unknown_kind(spark):
    import pytest
    with pytest.raises(ValueError):
        L.latest_of_kind({"price": _msgs(spark)}, "volume")


def test_snapshot_and_empty_snapshot(spark):
    m = _msgs(spark)
    s = views.snapshot(m, 100, order=("seq",)).first()
    assert (s.current_price, s.price_change, s.current_volume, s.market_status) == \
        ("$108.00", "+4.00%", "$80.00", "Bullish")
    e = views.snapshot(m, 100, "2030-01-01", "2030-01-02", order=("seq",)).first()
    assert (e.current_price, e.price_change, e.current_volume, e.market_status) == \
        ("$0.00", "0.00%", "$0.00", "N/A")


def test_status_nan_and_null_are_bearish(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.0,), (-1.0,)], "c double")
    got = [r[0] for r in df.select(display.market_status("c")).collect()]
    assert got == ["Bearish", "Bearish", "Bullish", "Bearish"]


def test_money_and_percent_formats(spark):
    values = [1.234, -0.5, 1.125, 0.125, 0.375, -1.125, 1234.5, 0.005, 2.675, float("nan")]
    df = spark.createDataFrame([(1234.5 * (1 if p > 0 else -1), p) for p in values], "m double, p double")
    got = df.select("m", "p", display.money("m"), display.signed_percent("p")).collect()
    assert [(r[2], r[3]) for r in got] == [(f"${r[0]:,.2f}", f"{r[1]:+.2f}%") for r in got]


def test_recent_trades_and_export(spark, scratch):
    m = _msgs(spark)
    rt = views.recent_trades(m, 5, order=("seq",)).collect()
    assert [r.seq for r in rt] == [4, 5, 6, 7, 8]  # oldest first
    assert [r.seq for r in L.latest(m, 3, ("seq",)).collect()] == [6, 7, 8]
    assert rt[0].day == "2024-01-02" and rt[0].price_text == "$104.00"
    path = views.export_csv(m, f"{scratch}/exp", 3, ("seq",))
    back = views.read_export(spark, path, m.schema).toPandas()
    assert list(back["seq"]) == [6, 7, 8]
    assert list(back.columns) == m.columns  # no index column


def test_ohlc_axis_is_naive(spark):
    got = views.ohlc_series(_msgs(spark).withColumn("open", F.col("price"))
                            .withColumn("high", F.col("price")).withColumn("low", F.col("price")))
    assert dict(got.dtypes)["x"] == "timestamp_ntz"
    assert got.first().x == pd.Timestamp("2024-01-01").to_pydatetime()


def test_top_n_tree_with_small_fan_in(spark, monkeypatch):
    monkeypatch.setattr(L, "FAN_IN", 2)
    t = fixtures.ticks(spark, SF_SMALL).repartition(10)
    got = sorted(r.seq for r in L.latest(t, 7, ("ts", "seq")).collect())
    pdf = t.toPandas().sort_values(["ts", "seq"])
    assert got == sorted(pdf["seq"].tail(7))
    per = L.latest_per_key(t, 3, ["symbol"], ("ts", "seq"), rank="r").toPandas()
    exp = pdf.groupby("symbol").tail(3)
    assert sorted(per["seq"]) == sorted(exp["seq"]) and set(per["r"]) == {1, 2, 3}


def test_time_columns_use_time_bounds(spark):
    df = spark.sql("select explode(sequence(timestamp'2024-01-09 12:00:00', timestamp'2024-01-12', interval 6 hours)) as t") \
        .select("t", F.col("t").cast("timestamp_ntz").alias("n"), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss").alias("s"),
                F.to_date("t").alias("d"))
    for bounds in (("2024-01-10", "2024-01-11T06:00:00"), ("2024-01-10", "2024-01-11"), ("2024-01-09T18:00:00", "2024-01-12")):
        want = L.date_range(df, *bounds, col="s").count()
        assert L.date_range(df, *bounds, col="t").count() == L.date_range(df, *bounds, col="n").count() == want > 0
        day = L.date_range(df, *bounds, col="s", inclusive_end=True).count()
        assert L.date_range(df, *bounds, col="t", inclusive_end=True).count() == day
    assert L.date_range(df, "2024-01-10", "2024-01-11", col="d", inclusive_end=True).count() == 8


def test_snapshot_of_a_row_without_a_price(spark):
    m = spark.createDataFrame([("2024-01-01T00:00:00", None, 4.0, 3.0, 1)],
                              "date string, price double, change_percent double, volume double, seq long")
    s = views.snapshot(m, 100, order=("seq",)).first()
    assert (s.current_price, s.price_change, s.current_volume, s.market_status) == ("$nan", "+4.00%", "$3.00", "Bullish")


def test_chart_macd_is_one_shuffle_per_limit(spark):
    df = views.macd_series(fixtures.ticks(spark, SF_SMALL), ["symbol"], ["ts", "seq"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2  # the two levels of the limit; the windows reuse the last one


def test_chart_macd_of_a_long_slice(spark):
    import models
    df = spark.range(7000).select(F.lit("x").alias("symbol"), F.col("id").alias("ts"), F.col("id").alias("seq"),
                                  (F.col("id") % 41 + 3).cast("double").alias("price"))
    got = views.macd_series(df, ["symbol"], ["ts", "seq"], lookback=6000).orderBy("ts").collect()
    xs = [r.price for r in got]
    line = [a - b for a, b in zip(models.recursion(xs, 12), models.recursion(xs, 26))]
    assert len(xs) == 6000
    assert all(abs(r.MACD_signal - v) < 1e-9 for r, v in zip(got, models.recursion(line, 9)))


def test_market_dates_without_padding(spark):
    from ticksmith.functions import text
    cells = ["01/05/2024", "1/5/2024", "2024/01/05", "2024-1-5", "5 Jan 2024", "Jan 5, 2024", "January 5, 2024", "2024-01-05T00:00:00", "x"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r[0] for r in df.select(text.parse_market_date("c").cast("date").cast("string")).collect()]
    assert got == ["2024-01-05"] * 8 + [None]
