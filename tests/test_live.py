"""Live indicators, rows out of order, repeats, the recent-rows index, wide frames."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ticksmith.functions import timefmt
from ticksmith.operators import ema, rolling
from ticksmith.plans.indicators import FRAME_COLUMNS, indicator_frame
from ticksmith.sinks import writers
from ticksmith.sources import messages as msg_sources
from ticksmith.streaming import batch_frame, manifest, ordered, stream, tail

TICKS = "symbol string, ts long, seq long, price double"


def ticks(seed=3):
    """A hot instrument, a small one, one with five rows and one without a name."""
    rng = random.Random(seed)
    names = ["hot"] * 500 + ["cold"] * 120 + ["few"] * 5 + [None] * 70
    rng.shuffle(names)
    return [(n, i // 2, i, rng.choice([rng.uniform(50, 150)] * 30 + [None, float("nan")])) for i, n in enumerate(names)]


def close(got, want):
    return got == want or (got is not None and want is not None and math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-9))


def same_rows(got, want):
    key = lambda r: (r["seq"],)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r["seq"] for r in got] == [r["seq"] for r in want]
    for g, w in zip(got, want):
        assert all(close(g[c], w[c]) for c in FRAME_COLUMNS), (g, w)


def test_live_frame_equals_the_batch_frame(spark, scratch):
    rows = ticks()
    whole = spark.createDataFrame(rows, TICKS)
    step = batch_frame.writer(scratch, num_partitions=2)
    cuts = [0, 30, 31, 380, len(rows)]  # a batch of one row, and one with more rows than any frame
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        batch = spark.createDataFrame(rows[a:b] + (rows[5:9] if i else []), TICKS)  # and old rows again
        step(batch, i)
        if i == 2:
            step(batch, i)  # a replay
    same_rows(batch_frame.read_output(spark, scratch).collect(), indicator_frame(whole).collect())
    kept = spark.read.parquet(f"{scratch}/state/batch=3/tail").groupBy("symbol").count().collect()
    assert {r.symbol: r["count"] for r in kept} == {"hot": 49, "cold": 49, "few": 5, None: 49}
    with pytest.raises(RuntimeError, match="state of the previous batch"):
        batch_frame.writer(f"{scratch}/other")(whole, 1)


def test_live_frame_of_one_series_and_an_empty_batch(spark, scratch):
    rows = [r for r in ticks(4) if r[0] == "hot"][:150]
    step = batch_frame.writer(scratch, keys=(), num_partitions=2)
    for i, part in enumerate((rows[:60], [], rows[60:])):
        step(spark.createDataFrame(part, TICKS), i)
    want = indicator_frame(spark.createDataFrame(rows, TICKS), keys=()).collect()
    same_rows(batch_frame.read_output(spark, scratch).collect(), want)


def test_macd_plans_one_scan(spark):
    df = spark.createDataFrame(ticks(), TICKS)
    for out, most in ((ema.macd(df), 5), (indicator_frame(df), 5)):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert (plan.count("Window [") <= most) is True


def test_rows_wait_for_their_turn(spark, scratch):
    seen = {}
    schema = "ts timestamp, seq long"

    def at(*minutes):
        return spark.createDataFrame([(m, m) for m in minutes], "m long, seq long").select(
            F.timestamp_seconds(F.col("m") * 60).alias("ts"), "seq")

    def step(df, i):
        seen[i] = sorted(r.seq for r in df.collect())

    run = ordered.in_order(step, scratch, 600)
    run(at(30, 12, 20, 25), 0)
    assert seen[0] == [12, 20]
    run(at(19, 21, 24, 40).unionByName(spark.createDataFrame([(None, 99)], schema)), 1)  # 19 is behind, 99 has no time
    assert seen[1] == [21, 24, 25, 30]
    run(at(19, 21, 24, 40).unionByName(spark.createDataFrame([(None, 99)], schema)), 1)  # a replay
    run(spark.createDataFrame([], schema), 2)
    assert seen[2] == []
    ordered.flush(spark, step, scratch, 3)
    assert seen[3] == [40] and seen[1] == [21, 24, 25, 30]
    assert [r.seq for r in ordered.late_rows(spark, scratch).collect()] == [19]


def test_repeats_are_dropped(spark, scratch):
    rows = spark.createDataFrame([(i, i % 40) for i in range(60)], "m long, seq long") \
        .select(F.timestamp_seconds(F.col("seq") * 10 + 1000).alias("ts"), "seq")
    rows.repartition(3).write.parquet(f"{scratch}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{scratch}/in")
    with stream.shuffle_partitions(spark, 2):
        q: StreamingQuery = ordered.once(source, ["seq"], "ts").writeStream.format("parquet") \
            .option("checkpointLocation", f"{scratch}/c").option("path", f"{scratch}/out").trigger(availableNow=True).start()
    stream.run_available([q])
    assert sorted(r.seq for r in spark.read.parquet(f"{scratch}/out").collect()) == list(range(40))


def test_window_tables_take_a_window_once(spark, scratch):
    def send(minutes, lot):
        rows = spark.createDataFrame([(m, float(m)) for m in minutes], "m long, sma_20 double").select(
            "sma_20", F.timestamp_seconds(F.col("m") * 60).alias("window_start"), F.timestamp_seconds(F.col("m") * 60 + 300).alias("window_end"))
        writers.publish(rows, path=f"{scratch}/sma/lot={lot}")

    for lot, minutes in enumerate(([1, 2, 3, 3], [2, 3, 4, 200], [4, 200, 201])):
        send(minutes, lot)
        for name, within in (("once", "1 hour"), ("all", None)):
            with stream.shuffle_partitions(spark, 2):
                qs = tail.start_tables({"sma": msg_sources.file_stream(spark, f"{scratch}/sma")}, f"{scratch}/{name}",
                                       {"availableNow": True}, once_within=within)
            stream.await_all(spark, qs)
    got = {name: sorted(r.sma_20 for r in tail.latest_rows(spark, f"{scratch}/{name}", "sma").collect()) for name in ("once", "all")}
    assert got == {"once": [1.0, 2.0, 3.0, 4.0, 200.0, 201.0], "all": [1.0, 2.0, 2.0, 3.0, 3.0, 3.0, 4.0, 4.0, 200.0, 200.0, 201.0]}


def test_index_bounds_what_is_read(spark, scratch):
    write = tail._table_writer(scratch, "sma", 3)

    def lot(i):
        return spark.createDataFrame([(float(10 * i + k), "f", k) for k in range(2)],
                                     f"sma_20 double, {msg_sources.ARRIVAL_PART} string, {msg_sources.ARRIVAL_SEQ} long").coalesce(1)

    for i in range(14):
        write(lot(i) if i != 5 else lot(5).limit(0), i)
    write(lot(13), 13)  # a replay
    want = [float(10 * i + k) for i in range(14) if i != 5 for k in range(2)]
    table = tail.read_tables(spark, scratch, ("sma",))["sma"]
    assert sorted(r.sma_20 for r in table.collect()) == want
    state = manifest.load(spark, f"{scratch}/_index/sma")
    assert [f["level"] for f in state["folders"]] == [2, 1, 0] and sum(f["rows"] for f in state["folders"]) == 26
    assert len(manifest.versions(spark, f"{scratch}/_index/sma")) == 2
    last = tail.latest_rows(spark, scratch, "sma", 3)
    assert [r.sma_20 for r in last.collect()] == want[-3:]
    assert {f.split("/")[-2] for f in last.inputFiles()} == {f["folder"] for f in state["folders"][-2:]}
    assert [r.sma_20 for r in tail.latest_rows(spark, scratch, "sma", 1000).collect()] == want
    assert tail.latest_rows(spark, scratch, "sma", 2, order=("sma_20",)).count() == 2
    with pytest.raises(RuntimeError, match="index"):
        tail._table_writer(f"{scratch}/other", "sma", 3)(lot(0), 4)
    with pytest.raises(RuntimeError, match="no such table"):
        tail.latest_rows(spark, f"{scratch}/other", "sma")


def test_display_time(spark):
    df = spark.createDataFrame([("2024-03-01T04:05:06.789",), (None,)], "t string")
    got = [r[0] for r in df.select(timefmt.shown(timefmt.parse_event_time("t"))).collect()]
    assert got == ["2024-03-01 04:05:06", None]


def test_wide_frames_match_pandas(spark, monkeypatch):
    df = spark.createDataFrame(ticks(8), TICKS)
    pdf = df.toPandas().sort_values(["symbol", "ts", "seq"])
    pdf["symbol"] = pdf["symbol"].fillna("-")
    monkeypatch.setattr(rolling, "WIDE", 3)
    for n in (4, 60):
        got = rolling.bollinger(df, n, 2.0).toPandas()
        got["symbol"] = got["symbol"].fillna("-")
        got = got.sort_values(["symbol", "ts", "seq"])
        r = pdf.groupby("symbol")["price"].rolling(n)
        mean, std = r.mean().to_numpy(), r.std().to_numpy()
        for c, want in (("BB_middle", mean), ("BB_upper", mean + 2 * std), ("BB_lower", mean - 2 * std)):
            assert all((math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got[c], want))
