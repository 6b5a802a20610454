import json
import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticksmith.functions import timefmt
from ticksmith.operators import timewin
from ticksmith.sources import messages as msg_sources
from ticksmith.streaming import stream


def _write_batches(folder, batches):
    """One message file per batch, modification times in batch order."""
    os.makedirs(folder, exist_ok=True)
    base = time.time() - 1000
    for i, rows in enumerate(batches):
        p = os.path.join(folder, f"part-{i:03d}.json")
        with open(p, "w") as f:
            for ts, price in rows:
                f.write(json.dumps({"timestamp": ts, "date": ts[:10] + "T00:00:00", "price": price}) + "\n")
        os.utime(p, (base + i, base + i))


def _iso(minute):
    return f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00"


ORDER = [
    [(_iso(m), float(m)) for m in range(30)],   # 00:00 .. 00:29
    [(_iso(60), 60.0)],                        # 01:00
    [(_iso(2), 99.0)],                         # late 00:02
    [(_iso(120), 120.0)],                      # 02:00
    [(_iso(2), 98.0)],                         # late 00:02 again
]


def test_watermark_drops_and_emission(spark, scratch):
    src_dir = f"{scratch}/in"
    _write_batches(src_dir, ORDER)
    src = msg_sources.file_stream(spark, src_dir, max_files_per_trigger=1)
    streams = stream.indicator_streams(src)
    out = stream.Outputs(root=f"{scratch}/out")
    qs = stream.start(streams, out, trigger={"availableNow": True})
    stream.run_available(qs)
    agg_q = qs[1]
    drops = [sum(int(o.get("numRowsDroppedByWatermark", 0)) for o in (p.get("stateOperators") or []))
             for p in agg_q.recentProgress if p["numInputRows"] > 0]
    assert drops == [0, 0, 5, 0, 5]

    sma = stream.read_result(spark, out, "sma")
    # streaming result == batch result restricted to windows closed by the final watermark
    rows = [r for b in ORDER for r in b]
    kept = [r for i, b in enumerate(ORDER) for r in b if i not in (2, 4)]
    bdf = spark.createDataFrame(kept, "timestamp string, price double").select(
        timefmt.parse_event_time("timestamp").alias("timestamp"), "price")
    final_wm = pd.Timestamp(max(r[0] for r in rows)) - pd.Timedelta(minutes=10)
    batch = timewin.sliding_sma(bdf).filter(F.col("window_end") <= F.lit(final_wm.to_pydatetime()))
    a = sorted((r.window_start, round(r.sma_20, 9)) for r in sma.collect())
    b = sorted((r.window_start, round(r.sma_20, 9)) for r in batch.collect())
    assert a == b and len(a) > 0
    bb = stream.read_result(spark, out, "bb")
    assert bb.count() == len(a)
    processed = stream.read_result(spark, out, "price")
    assert processed.count() == len(rows)  # pass-through keeps late rows


def test_restart_does_not_duplicate(spark, scratch):
    src_dir = f"{scratch}/in"
    _write_batches(src_dir, ORDER[:2])
    out = stream.Outputs(root=f"{scratch}/out")
    for _ in range(2):  # second run resumes from the checkpoint: no new input
        src = msg_sources.file_stream(spark, src_dir)
        stream.run_available(stream.start(stream.indicator_streams(src), out,
                                              trigger={"availableNow": True}))
    _write_batches(f"{scratch}/in", ORDER[:2] + [[(_iso(200), 1.0)]])
    src = msg_sources.file_stream(spark, src_dir)
    stream.run_available(stream.start(stream.indicator_streams(src), out,
                                          trigger={"availableNow": True}))
    sma = stream.read_result(spark, out, "sma").toPandas()
    assert not sma.duplicated(["window_start"]).any()
    assert stream.read_result(spark, out, "price").count() == 32


def test_kafka_options():
    o = msg_sources.kafka_options("k:9092", "bitcoin_data", max_offsets_per_trigger=100)
    assert o["subscribe"] == "bitcoin_data" and o["startingOffsets"] == "earliest"
    assert o["failOnDataLoss"] == "false" and o["kafka.group.id"] == "bitcoin-spark-processor"
    assert o["maxOffsetsPerTrigger"] == "100"


def test_await_all_raises_first_failure_and_stops_others(spark, scratch):
    import pytest
    src_dir = f"{scratch}/in"
    _write_batches(src_dir, ORDER[:1])
    ok = (msg_sources.file_stream(spark, src_dir).writeStream.format("memory").queryName("alive")
          .option("checkpointLocation", f"{scratch}/ck1").trigger(processingTime="1 second").start())

    def boom(df, batch_id):
        raise RuntimeError("sink down")

    bad = (msg_sources.file_stream(spark, src_dir).writeStream.foreachBatch(boom)
           .option("checkpointLocation", f"{scratch}/ck2").start())
    with pytest.raises(RuntimeError, match="failed"):
        stream.await_all(spark, [ok, bad], timeout=120)
    assert not ok.isActive and not bad.isActive


def test_result_tables_from_topic_messages(spark, scratch):
    import pytest
    from ticksmith.streaming import tail
    topic = f"{scratch}/topic"
    os.makedirs(topic)
    rows = [{"window_start": f"2024-01-01T00:0{i}:00.000Z", "window_end": f"2024-01-01T00:0{i + 5}:00.000Z",
             "sma_20": float(i)} for i in range(4)]
    with open(f"{topic}/m.json", "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")
        f.write(json.dumps(json.dumps(rows[0] | {"sma_20": 9.0})) + "\n")  # double-encoded
    qs = tail.start_tables({"sma": msg_sources.file_stream(spark, topic)}, f"{scratch}/tables",
                           trigger={"availableNow": True})
    stream.run_available(qs)
    last = tail.latest_rows(spark, f"{scratch}/tables", "sma", 2, order=("window_start", "sma_20"))
    assert [r.sma_20 for r in last.orderBy("window_start").collect()] == [2.0, 3.0]
    table = tail.read_tables(spark, f"{scratch}/tables", ("sma",))["sma"]
    assert table.count() == 5 and {"processed_at", "batch", "arrival_part", "arrival_seq"} <= set(table.columns)
    with pytest.raises(ValueError):
        tail.latest_rows(spark, f"{scratch}/tables", "volume")


def test_result_topic_options():
    import pytest
    o = msg_sources.result_topic_options("k:9092", "sma")
    assert o["subscribe"] == "bitcoin_sma" and o["kafka.group.id"] == "bitcoin_consumers_bitcoin_sma"
    assert o["startingOffsets"] == "earliest"
    with pytest.raises(ValueError):
        msg_sources.result_topic_options("k:9092", "volume")


@pytest.mark.parametrize("block", [None, 50])
def test_batch_ema_continues_across_micro_batches(spark, scratch, block):
    from ticksmith.streaming import batch_ema
    rng = np.random.default_rng(5)
    n = 900
    pdf = pd.DataFrame({"symbol": np.where(rng.uniform(size=n) < 0.8, "HOT", "cold"),
                        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="s"),
                        "seq": np.arange(n), "price": rng.uniform(1, 100, n)})
    src = f"{scratch}/ticks"
    os.makedirs(src)
    base = time.time() - 1000
    for i, part in enumerate(pdf.iloc[k:k + 300] for k in range(0, n, 300)):
        p = f"{src}/p{i}.parquet"
        part.to_parquet(p, index=False, coerce_timestamps="us")
        os.utime(p, (base + i, base + i))
    late = pdf.iloc[[10]].copy()
    late["seq"] = 10_000
    late.to_parquet(f"{src}/p9.parquet", index=False, coerce_timestamps="us")
    os.utime(f"{src}/p9.parquet", (base + 9, base + 9))
    schema = spark.read.parquet(f"{src}/p0.parquet").schema
    ticks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    root = f"{scratch}/ema"
    q = (ticks.writeStream.foreachBatch(batch_ema.writer(root, (12, 26), block_rows=block))
         .option("checkpointLocation", f"{root}/_ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got = batch_ema.read_output(spark, root).toPandas().sort_values(["symbol", "seq"])
    assert len(got) == n  # late row dropped
    for sym, g in pdf.groupby("symbol"):
        g = g.sort_values("seq")
        for span in (12, 26):
            e = g["price"].ewm(span=span, adjust=False).mean().to_numpy()
            assert np.allclose(got[got.symbol == sym][f"ema_{span}"].to_numpy(), e, rtol=1e-11)
    state = spark.read.parquet(f"{root}/state/batch=3").toPandas()
    assert sorted(state["symbol"]) == ["HOT", "cold"] and state["seq"].max() == n - 1


def test_batch_ema_null_key_unkeyed_and_lost_state(spark):
    import models
    from ticksmith.streaming import batch_ema
    schema = "symbol string, ts long, seq long, price double"
    xs = [float(i * 7 % 13 + 1) for i in range(30)]
    lots = [spark.createDataFrame([(None, i, i, x) for i, x in enumerate(xs)][a:b], schema) for a, b in ((0, 12), (12, 30))]
    for keys in (("symbol",), ()):
        state, got = None, []
        for lot in lots:
            out = batch_ema.continue_ema(lot, state, (12,), keys)
            state = batch_ema.next_state(out, state, (12,), keys)
            got += [r.ema_12 for r in out.orderBy("ts").collect()]
        assert np.allclose(got, models.recursion(xs, 12), rtol=1e-12)
        assert state.count() == 1


def test_lost_state_is_an_error_and_old_state_goes(spark, scratch):
    from ticksmith.streaming import batch_ema
    step = batch_ema.writer(f"{scratch}/e", (12,))
    for i in range(4):
        step(spark.createDataFrame([("a", i, i, 1.0)], "symbol string, ts long, seq long, price double"), i)
    assert sorted(p for p in os.listdir(f"{scratch}/e/state") if p.startswith("batch")) == ["batch=2", "batch=3"]
    with pytest.raises(RuntimeError, match="state"):
        step(spark.createDataFrame([("a", 9, 9, 1.0)], "symbol string, ts long, seq long, price double"), 9)


def test_quarantine_branch(spark, scratch):
    src_dir = f"{scratch}/in"
    os.makedirs(src_dir)
    with open(f"{src_dir}/m.json", "w") as f:
        f.write('{"timestamp":"2024-01-01T00:00:00","price":1.0}\nnot json\n{}\n')
    streams = stream.indicator_streams(msg_sources.file_stream(spark, src_dir), quarantine=True)
    out = stream.Outputs(root=f"{scratch}/out")
    stream.run_available(stream.start(streams, out, trigger={"availableNow": True}, indicators=False))
    processed = stream.read_result(spark, out, "price")
    assert [r.price for r in processed.collect()] == [1.0]
    rejected = sorted(r.value for r in spark.read.parquet(out.path("rejected")).collect())
    assert rejected == ["not json", "{}"]


def test_missing_kafka_connector_is_explained(spark):
    import pytest
    with pytest.raises(msg_sources.KafkaConnectorMissing, match="spark-sql-kafka"):
        msg_sources.kafka_stream(spark, "localhost:9092")
    with pytest.raises(msg_sources.KafkaConnectorMissing):
        msg_sources.result_stream(spark, "localhost:9092", "sma")
