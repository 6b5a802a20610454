"""EMA that decays across gaps, date layouts per source, the snapshot kept beside a stream."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticksmith.operators import decay_ema, ema
from ticksmith.plans import normalize, views
from ticksmith.streaming import live_snapshot

TICKS = "symbol string, ts long, seq long, price double"


def gappy(seed=5):
    """Series with single gaps, long gaps over many blocks, a late first price, no price at all."""
    rng = random.Random(seed)
    rows = []
    for name, n in (("hot", 700), ("late", 90), ("none", 60), (None, 40), ("one", 1)):
        for i in range(n):
            x = rng.uniform(-50, 150) if rng.random() < 0.8 else rng.choice([None, float("nan"), float("inf")])
            if (name == "hot" and 200 <= i < 390) or (name == "late" and i < 75) or name == "none":
                x = None
            rows.append((name, i // 2, len(rows), x))
    rng.shuffle(rows)
    return rows


def wanted(rows, span):
    out = {}
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    for part in by.values():
        s = pd.Series([math.nan if r[3] is None or math.isinf(r[3]) else r[3] for r in part], dtype="float64")
        out |= {r[2]: y for r, y in zip(part, s.ewm(span=span, adjust=False).mean())}
    return out


@pytest.mark.parametrize("block,fan", [(None, 512), (16, 3)])
def test_decayed_ema_equals_pandas(spark, monkeypatch, block, fan):
    monkeypatch.setattr(decay_ema, "FAN", fan)
    rows = gappy()
    df = spark.createDataFrame(rows, TICKS)
    for span in (12, 1, 300):
        got = {r.seq: r.y for r in decay_ema.decayed_ema(df, span, out="y", block_rows=block).collect()}
        want = wanted(rows, span)
        assert got.keys() == want.keys()
        for k, y in want.items():
            assert (got[k] is None and math.isnan(y)) or math.isclose(got[k], y, rel_tol=1e-9, abs_tol=1e-9), (span, k, got[k], y)


def test_decayed_ema_without_gaps_is_the_plain_one(spark):
    df = spark.createDataFrame([r for r in gappy() if r[3] is not None and math.isfinite(r[3])], TICKS)
    a = {r.seq: r.y for r in decay_ema.decayed_ema(df, 26, out="y", block_rows=32).collect()}
    b = {r.seq: r.y for r in ema.ema(df, 26, out="y").collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)
    assert decay_ema.decayed_ema(df.limit(0), 12).collect() == []


@pytest.mark.parametrize("block,fan", [(None, 512), (16, 3)])
def test_decayed_macd_equals_pandas(spark, monkeypatch, block, fan):
    monkeypatch.setattr(decay_ema, "FAN", fan)
    monkeypatch.setattr(ema, "FAN", fan)
    rows = gappy(6)
    out = decay_ema.decayed_macd(spark.createDataFrame(rows, TICKS), block_rows=block)
    assert out.columns == ["symbol", "ts", "seq", "price", "EMA_12", "EMA_26", "MACD", "MACD_signal", "MACD_hist"]
    got = {r.seq: r for r in out.collect()}
    fast, slow = wanted(rows, 12), wanted(rows, 26)
    line = [(r[0], r[1], r[2], None if math.isnan(fast[r[2]]) else fast[r[2]] - slow[r[2]]) for r in rows]
    signal = wanted(line, 9)
    assert got.keys() == signal.keys()
    for _, _, k, m in line:
        want = (fast[k], slow[k], m, signal[k], None if m is None else m - signal[k])
        for name, y in zip(out.columns[4:], want):
            g = got[k][name]
            assert (g is None and (y is None or math.isnan(y))) or math.isclose(g, y, rel_tol=1e-9, abs_tol=1e-9), (name, k, g, y)


def test_decayed_macd_without_gaps_is_the_plain_one(spark):
    df = spark.createDataFrame([r for r in gappy() if r[3] is not None and math.isfinite(r[3])], TICKS)
    a = {r.seq: r for r in decay_ema.decayed_macd(df, block_rows=32).collect()}
    b = {r.seq: r for r in ema.macd(df).collect()}
    assert a.keys() == b.keys()
    assert all(math.isclose(a[k][c], b[k][c], rel_tol=1e-9, abs_tol=1e-9) for k in a for c in ("EMA_12", "MACD_signal", "MACD_hist"))
    assert decay_ema.decayed_macd(df.limit(0)).collect() == []


def cells(spark, dates):
    return spark.createDataFrame([(s, d) for s, ds in dates.items() for d in ds], "feed string, Date string")


def test_layouts_are_elected_per_source(spark):
    got = normalize.elect_layouts(cells(spark, {
        "us": ["03/04/2024", " 12/31/2023 ", None], "eu": ["03/04/2024", "31/12/2023", ""], "iso": ["2024-03-04"],
        "alike": ["May 5, 2024"], "same": ["5/5/2024"], "blank": ["", None]}), ["feed"])
    assert {r.feed: r.layout for r in got.collect()} == {
        "us": "M/d/yyyy", "eu": "d/M/yyyy", "iso": "yyyy-M-d", "alike": "MMM d, yyyy", "same": "M/d/yyyy"}


@pytest.mark.parametrize("dates,why", [(["03/04/2024"], "several date layouts"), (["12/31/2023", "31/12/2023"], "no date layout"),
                                       (["someday"], "no date layout")])
def test_undecided_sources_are_errors(spark, dates, why):
    with pytest.raises(Exception, match=why):
        normalize.elect_layouts(cells(spark, {"x": dates}), ["feed"]).collect()


def test_day_first_source_keeps_its_rows(spark):
    days = ["01/02/2024", "13/02/2024", "28/02/2024", ""]
    raw = spark.createDataFrame([("eu", d, "1", "1", "1", "1", "2K", "1%") for d in days],
                                "feed string, Date string, Price string, Open string, High string, Low string, "
                                "`Vol.` string, `Change %` string")
    out = normalize.normalize_csv_bars(raw, layout_by=("feed",))
    assert [str(r.date)[:10] for r in out.collect()] == ["2024-02-01", "2024-02-13", "2024-02-28"]
    assert normalize.normalize_csv_bars(raw).count() == 1  # without election only a date that is also month-first


def test_snapshot_beside_a_stream(spark, scratch):
    schema = "seq long, date string, price double, change_percent double, volume double"
    rows = [(i, f"2024-01-{1 + i % 28:02d}T00:00:00", float(i), None if i % 7 == 0 else i - 40.0, 2.0 * i) for i in range(90)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, schema)
    neutral = live_snapshot.snapshot(spark, scratch, df.schema, 10, order=("seq",)).first()
    assert neutral.market_status == "N/A"
    step = live_snapshot.writer(scratch, 10, ("seq",))
    cuts = [0, 5, 5, 60, 61, 90]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        step(spark.createDataFrame(rows[a:b], schema), i)
        if i == 3:
            step(spark.createDataFrame(rows[a:b], schema), i)  # a replay
        seen = spark.createDataFrame(rows[:b], schema)
        for span in ((None, None), ("2024-01-01", "2024-01-12")):
            got = live_snapshot.snapshot(spark, scratch, df.schema, 10, *span, order=("seq",)).collect()
            assert got == views.snapshot(seen, 10, *span, order=("seq",)).collect()
    assert live_snapshot.recent(spark, scratch).count() == 10
    with pytest.raises(RuntimeError, match="state of the previous batch"):
        live_snapshot.writer(f"{scratch}/other", order=("seq",))(df, 4)
