"""Registered queries over the driver's tables, each with an independent SQL oracle.

Every query reads the given tables (or data Spark derives from them) in
full. Floating results are rounded to 6 decimals on both sides so that
summation-order differences in the last bits do not change value hashes.
Timestamps are returned as naive wall-clock values (``TIMESTAMP_NTZ``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ticksmith.functions import codec, display, text, timefmt
from ticksmith.operators import decay_ema, ema, latest as L, rolling, timewin
from ticksmith.plans import fixtures, normalize, views
from ticksmith.plans.indicators import FRAME_COLUMNS, indicator_frame
from ticksmith.schema import KEYED_BAR_MESSAGE
from ticksmith.session import scratch_path
from ticksmith.sinks import writers
from ticksmith.sources import bars as bar_sources
from ticksmith.sources import messages as msg_sources
from ticksmith.streaming import batch_ema, batch_frame, live_snapshot, ordered, stream, tail

Query = Callable[[SparkSession, str], DataFrame]

TICK_KEYS = ("symbol",)
TICK_ORDER = ("ts", "seq")
ARRIVAL = ("seq",)

# Parameters of the range queries (inside the tables' time spans).
DATE_RANGE = ("2024-01-05", "2024-01-12")
WINDOW_RANGE = ("2024-01-10", "2024-01-11T06:00:00")
BAR_RANGE = ("2001-07-20", "2001-07-25")
LATE_BEFORE = "2024-01-08"
BAND_RANGE = ("2024-01-30T22:00:00", "2024-01-30T23:55:00")


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def _rounded(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def _ticks(spark, sf_dir):
    _utc(spark)
    return fixtures.ticks(spark, sf_dir)


def _tick_messages(spark, sf_dir) -> DataFrame:
    _utc(spark)
    return fixtures.messages(spark, sf_dir)


def _bar_messages(spark, sf_dir) -> DataFrame:
    _utc(spark)
    b = fixtures.bars(spark, sf_dir)
    return normalize.to_messages(b, sent_at=F.col("date"), keep=["symbol"])


EVENT_MESSAGE = StructType([
    StructField("event_id", LongType()), StructField("ts", StringType()),
    StructField("event_type", StringType()), StructField("value", DoubleType()),
    StructField("props", StructType([StructField("k", LongType())])),
])


# ---------------------------------------------------------------- time windows

def q_sliding_sma(spark, sf_dir):
    t = _ticks(spark, sf_dir)
    out = timewin.sliding_sma(t, ts="ts", value="price")
    return _rounded(out, ["sma_20"])


def q_sliding_bands(spark, sf_dir):
    t = _ticks(spark, sf_dir)
    out = timewin.sliding_bands(t, ts="ts", value="price")
    return _rounded(out, ["bb_middle", "bb_std", "bb_upper", "bb_lower"])


def q_sliding_bands_by_symbol(spark, sf_dir):
    t = _ticks(spark, sf_dir)
    out = timewin.sliding_bands(t, ts="ts", value="price", keys=["symbol"])
    return _rounded(out, ["bb_middle", "bb_std", "bb_upper", "bb_lower"])


# ---------------------------------------------------------------- row windows

def q_diff(spark, sf_dir):
    return _rounded(rolling.diff(_ticks(spark, sf_dir)), ["diff"])


def q_sma_20(spark, sf_dir):
    return _rounded(rolling.sma(_ticks(spark, sf_dir), 20), ["sma_20"])


def q_sma_50(spark, sf_dir):
    return _rounded(rolling.sma(_ticks(spark, sf_dir), 50), ["sma_50"])


def q_bollinger_20(spark, sf_dir):
    return _rounded(rolling.bollinger(_ticks(spark, sf_dir), 20, 2.0),
                    ["BB_middle", "BB_upper", "BB_lower"])


def q_rsi_14(spark, sf_dir):
    return _rounded(rolling.rsi(_ticks(spark, sf_dir), 14), ["rsi"])


def q_rsi_price_level(spark, sf_dir):
    return _rounded(rolling.price_level_rsi(_ticks(spark, sf_dir), 14), ["rsi_price_level"])


def q_ema_12(spark, sf_dir):
    return _rounded(ema.ema(_ticks(spark, sf_dir), 12), ["ema_12"])


def q_ema_26(spark, sf_dir):
    return _rounded(ema.ema(_ticks(spark, sf_dir), 26), ["ema_26"])


def q_macd(spark, sf_dir):
    return _rounded(ema.macd(_ticks(spark, sf_dir)),
                    ["EMA_12", "EMA_26", "MACD", "MACD_signal", "MACD_hist"])


def q_indicator_frame(spark, sf_dir):
    return _rounded(indicator_frame(_ticks(spark, sf_dir)), FRAME_COLUMNS)


# ---------------------------------------------------------------- views

MSG_COLS = ["seq", "symbol", "timestamp", "date", "price", "volume", "change_percent"]


def _numbered(df: DataFrame, cols) -> DataFrame:
    """The rows' order as a column: one partition holds them all (a limit ran before)."""
    return df.coalesce(1).withColumn("row", F.monotonically_increasing_id()).select(*cols, "row")


def q_latest_n(spark, sf_dir):
    return _numbered(L.latest(_tick_messages(spark, sf_dir), 100, ARRIVAL), MSG_COLS)


def q_latest_n_per_symbol(spark, sf_dir):
    out = L.latest_per_key(_tick_messages(spark, sf_dir), 100, ["symbol"], ARRIVAL, rank="rank")
    return out.select(*MSG_COLS, F.col("rank").cast("long").alias("rank"))


def q_latest_then_range(spark, sf_dir):
    out = L.latest_then_range(_bar_messages(spark, sf_dir), 100, *BAR_RANGE, col="date",
                              order=("date", "symbol"))
    return out.select("symbol", "date", "price", "volume", "change_percent")


def q_date_range(spark, sf_dir):
    return L.date_range(_tick_messages(spark, sf_dir), *DATE_RANGE, col="date").select(*MSG_COLS)


def q_window_range(spark, sf_dir):
    t = _ticks(spark, sf_dir)
    bands = timewin.sliding_bands(t, ts="ts", value="price")
    out = L.date_range(bands, *WINDOW_RANGE, col="window_start")
    return _rounded(out, ["bb_middle", "bb_std", "bb_upper", "bb_lower"])


def q_snapshot(spark, sf_dir):
    return views.snapshot(_tick_messages(spark, sf_dir), 100, order=ARRIVAL)


def q_snapshot_empty_range(spark, sf_dir):
    # The last 100 rows all fall after this range: the neutral snapshot.
    return views.snapshot(_tick_messages(spark, sf_dir), 100, "2024-01-01", "2024-01-02",
                          order=ARRIVAL)


def q_market_status(spark, sf_dir):
    return views.market_status(_tick_messages(spark, sf_dir)).select(
        "seq", "change_percent", "market_status", "positive")


def q_recent_trades(spark, sf_dir):
    out = views.recent_trades(_tick_messages(spark, sf_dir), 5, order=ARRIVAL)
    return _numbered(out, out.columns)


def q_ohlc_series(spark, sf_dir):
    return views.ohlc_series(_bar_messages(spark, sf_dir), keep=["symbol"])


def q_price_series(spark, sf_dir):
    return views.price_series(_tick_messages(spark, sf_dir), keep=["seq"])


def q_export_csv(spark, sf_dir):
    msgs = _tick_messages(spark, sf_dir).select(*MSG_COLS)
    path = views.export_csv(msgs, scratch_path(spark, "export"), 100, ARRIVAL)
    return _numbered(views.read_export(spark, path, msgs.schema), MSG_COLS)


# ---------------------------------------------------------------- parsing / normalising

def q_normalize_prices(spark, sf_dir):
    _utc(spark)
    o = fixtures.table(spark, sf_dir, "orders")
    t = o.select("o_orderkey", F.format_number("o_totalprice", 2).alias("price_text"))
    return t.select("o_orderkey", "price_text", text.parse_number("price_text").alias("price"))


def q_parse_volume(spark, sf_dir):
    _utc(spark)
    o = fixtures.table(spark, sf_dir, "orders")
    t = o.select("o_orderkey", fixtures.volume_text("o_totalprice", "o_orderpriority").alias("vol_text"))
    return t.select("o_orderkey", "vol_text", text.parse_volume("vol_text").alias("volume"))


def q_parse_percent(spark, sf_dir):
    _utc(spark)
    b = fixtures.bars(spark, sf_dir)
    t = b.select("symbol", "date",
                 F.concat(F.format_string("%.2f", F.col("change_percent")), F.lit("%")).alias("pct_text"))
    return t.select("symbol", "date", "pct_text", text.parse_percent("pct_text").alias("change_percent"))


def q_normalize_bars(spark, sf_dir):
    _utc(spark)
    csv_text = fixtures.bars_as_csv_text(fixtures.bars(spark, sf_dir))
    path = scratch_path(spark, "bars-csv")
    csv_text.write.option("header", True).csv(path)
    raw = bar_sources.read_csv_text(spark, path)
    out = normalize.normalize_csv_bars(raw, sort=True, tiebreak=["symbol"])
    return out.select("symbol", timefmt.to_wall_clock("date").alias("date"),
                      "price", "open", "high", "low", r6("volume").alias("volume"), "change_percent")


def q_flatten_history(spark, sf_dir):
    _utc(spark)
    payloads = fixtures.bars_as_history_payloads(fixtures.bars(spark, sf_dir))
    path = scratch_path(spark, "history-json")
    payloads.write.text(path)
    entries = bar_sources.read_history(spark, path, multiline=False, keep=("Symbol",))
    out = normalize.history_bars(entries, keep=("Symbol",))
    return out.select(F.col("Symbol").alias("symbol"), timefmt.to_wall_clock("date").alias("date"),
                      "price", "open", "high", "low", "volume", "change_percent")


def q_json_roundtrip(spark, sf_dir):
    _utc(spark)
    ev = fixtures.table(spark, sf_dir, "events")
    msg = ev.select(codec.encode_row(
        "event_id", timefmt.iso_format("ts").alias("ts"), "event_type", "value",
        F.from_json("props", "k BIGINT").alias("props")).alias("value"))
    dec = msg.select(codec.decode("value", EVENT_MESSAGE).alias("d")).select("d.*")
    return dec.select("event_id", timefmt.to_wall_clock(timefmt.parse_event_time("ts")).alias("ts"),
                      "event_type", "value", F.col("props.k").alias("k"))


def q_double_encoded_json(spark, sf_dir):
    _utc(spark)
    ev = fixtures.table(spark, sf_dir, "events")
    plain = codec.encode_row("event_id", timefmt.iso_format("ts").alias("ts"), "event_type",
                             "value", F.from_json("props", "k BIGINT").alias("props"))
    wrapped = F.to_json(F.array(plain))
    twice = F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)  # a JSON string literal
    msg = ev.select(F.when(F.col("event_type").isin("click", "view"), twice)
                    .otherwise(plain).alias("value"))
    dec = msg.select(codec.decode_lenient("value", EVENT_MESSAGE).alias("d")).select("d.*")
    return dec.select("event_id", timefmt.to_wall_clock(timefmt.parse_event_time("ts")).alias("ts"),
                      "event_type", "value", F.col("props.k").alias("k"))


# ---------------------------------------------------------------- streaming

def _message_files(spark, sf_dir) -> str:
    """Tick messages written as JSON text files, as the producer would publish them."""
    path = scratch_path(spark, "messages")
    msgs = fixtures.messages(spark, sf_dir).drop("seq", "symbol")
    writers.publish(msgs, path=path)
    return path


def _run_stream(spark, sf_dir, processed: bool = False, indicators: bool = True) -> stream.Outputs:
    """Publish the tick messages as files, then run the streaming indicators over them."""
    _utc(spark)
    src = msg_sources.file_stream(spark, _message_files(spark, sf_dir))
    streams = stream.indicator_streams(src)
    out = stream.Outputs(root=scratch_path(spark, "stream"))
    stream.run_available(stream.start(
        streams, out, trigger={"availableNow": True}, processed=processed, indicators=indicators,
        state_partitions=stream.default_state_partitions(spark)))
    return out


def q_stream_sliding_sma(spark, sf_dir):
    out = _run_stream(spark, sf_dir)
    res = stream.read_result(spark, out, "sma")
    return res.select(timefmt.to_wall_clock("window_start").alias("window_start"),
                      timefmt.to_wall_clock("window_end").alias("window_end"), r6("sma_20").alias("sma_20"))


def q_stream_sliding_bands(spark, sf_dir):
    out = _run_stream(spark, sf_dir)
    res = stream.read_result(spark, out, "bb")
    return res.select(timefmt.to_wall_clock("window_start").alias("window_start"),
                      timefmt.to_wall_clock("window_end").alias("window_end"),
                      *[r6(c).alias(c) for c in ["bb_middle", "bb_std", "bb_upper", "bb_lower"]])


def q_stream_sliding_bands_by_symbol(spark, sf_dir):
    """Several instruments on one stream: one keyed, fused windowed aggregate."""
    _utc(spark)
    path = scratch_path(spark, "messages-keyed")
    writers.publish(fixtures.messages(spark, sf_dir).drop("seq"), path=path)
    streams = stream.indicator_streams(msg_sources.file_stream(spark, path),
                                         schema=KEYED_BAR_MESSAGE, keys=("symbol",))
    out = stream.Outputs(root=scratch_path(spark, "stream-keyed"))
    stream.run_available(stream.start(
        streams, out, trigger={"availableNow": True}, processed=False,
        state_partitions=stream.default_state_partitions(spark)))
    res = stream.read_result(spark, out, "bb", keys=("symbol",))
    return res.select("symbol", timefmt.to_wall_clock("window_start").alias("window_start"),
                      timefmt.to_wall_clock("window_end").alias("window_end"),
                      *[r6(c).alias(c) for c in ["bb_middle", "bb_std", "bb_upper", "bb_lower"]])


def q_stream_passthrough(spark, sf_dir):
    out = _run_stream(spark, sf_dir, processed=True, indicators=False)
    return stream.read_result(spark, out, "price")


def _thirds(df: DataFrame, ts: str) -> list[DataFrame]:
    """``df`` in three lots by time, one after the other."""
    lo, hi = df.agg(F.min(ts), F.max(ts)).first()
    if lo is None:
        return [df]
    a, b = lo + (hi - lo) / 3, lo + (hi - lo) * 2 / 3
    t = F.col(ts)
    return [df.where(t < a), df.where((t >= a) & (t < b)), df.where(t >= b)]


def q_stream_late_file(spark, sf_dir):
    """Three arrivals in time order, then one of old rows again: all its windows are closed, so nothing changes."""
    _utc(spark)
    msgs = fixtures.messages(spark, sf_dir).withColumn("at", timefmt.to_wall_clock(timefmt.parse_event_time("timestamp")))
    lots = _thirds(msgs, "at")
    src, out = scratch_path(spark, "late"), stream.Outputs(root=scratch_path(spark, "stream-late"))
    for i, lot in enumerate([*lots, lots[0]]):
        writers.publish(lot.drop("seq", "symbol", "at"), path=f"{src}/arrival={i}")
        streams = stream.indicator_streams(msg_sources.file_stream(spark, src))
        stream.await_all(spark, stream.start(streams, out, trigger={"availableNow": True}, processed=False,
                                             state_partitions=stream.default_state_partitions(spark)))
    res = stream.read_result(spark, out, "sma")
    return res.select(*_wall(["window_start", "window_end"], ["sma_20"]))


def _arrivals(spark, lots: list[DataFrame], step, checkpoint: str) -> int:
    """Rows of each lot land as files and are drained before the next lands; the number of batches so far."""
    src, n, batches = scratch_path(spark, "tick-files"), stream.default_state_partitions(spark), 0
    for i, lot in enumerate(lots):
        lot.write.parquet(f"{src}/arrival={i}")
        rows = spark.readStream.schema(lot.schema).option("recursiveFileLookup", True).parquet(src)
        with stream.shuffle_partitions(spark, n):
            q = rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        stream.run_available([q])
        batches = max(batches, q.lastProgress["batchId"] + 1 if q.lastProgress else 0)
    return batches


def _emas(got: DataFrame) -> DataFrame:
    return got.select("symbol", "ts", "seq", "price", r6("ema_12").alias("ema_12"), r6("ema_26").alias("ema_26"))


def _stream_ema(spark, sf_dir, keys) -> DataFrame:
    """EMA 12/26 over three arrivals of ticks, each run going on from the state of the one before."""
    root = scratch_path(spark, "stream-ema")
    step = batch_ema.writer(root, spans=(12, 26), keys=keys, num_partitions=stream.default_state_partitions(spark))
    _arrivals(spark, _thirds(_ticks(spark, sf_dir), "ts"), step, f"{root}/_checkpoint")
    return _emas(batch_ema.read_output(spark, root))


def q_stream_indicator_frame(spark, sf_dir):
    """All row indicators over three arrivals of ticks, each going on from the state of the one before."""
    root = scratch_path(spark, "stream-frame")
    step = batch_frame.writer(root, num_partitions=stream.default_state_partitions(spark))
    _arrivals(spark, _thirds(_ticks(spark, sf_dir), "ts"), step, f"{root}/_checkpoint")
    return _rounded(batch_frame.read_output(spark, root), FRAME_COLUMNS)


def q_stream_ema_reordered(spark, sf_dir):
    """Ticks that arrive up to ten minutes late, in three lots by arrival: held until their turn, then folded."""
    root = scratch_path(spark, "stream-ema")
    ticks = _ticks(spark, sf_dir)
    delayed = ticks.withColumn("at", F.col("ts") + F.make_dt_interval(secs=F.pmod(F.xxhash64("seq"), F.lit(600))))
    step = batch_ema.writer(root, spans=(12, 26), num_partitions=stream.default_state_partitions(spark))
    lots = [lot.select(*ticks.columns) for lot in _thirds(delayed, "at")]
    done = _arrivals(spark, lots, ordered.in_order(step, root, 600), f"{root}/_checkpoint")
    if done:
        ordered.flush(spark, step, root, done)
    return _emas(batch_ema.read_output(spark, root))


def q_stream_late_rows(spark, sf_dir):
    """Three arrivals in time order, then a file of old rows: the rows listed as late are that file's."""
    root = scratch_path(spark, "stream-late-rows")
    ticks = _ticks(spark, sf_dir)
    lots = _thirds(ticks, "ts")
    old = ticks.where((F.col("seq") % 5 == 0) & (F.col("ts") < F.lit(LATE_BEFORE).cast("timestamp")))
    step = lambda rows, i: rows.write.mode("overwrite").parquet(f"{root}/out/batch={i}")
    _arrivals(spark, [*lots, old], ordered.in_order(step, root, 600), f"{root}/_checkpoint")
    return ordered.late_rows(spark, root).select("symbol", "seq", "price")


def q_stream_duplicates(spark, sf_dir):
    """A third of the messages is published twice; by their position each counts once."""
    _utc(spark)
    root, src = scratch_path(spark, "stream-once"), scratch_path(spark, "messages")
    msgs = fixtures.messages(spark, sf_dir).select("symbol", "seq", "timestamp", "price") \
        .withColumn("at", timefmt.to_wall_clock(timefmt.parse_event_time("timestamp")))
    schema = msgs.drop("at").schema
    for i, lot in enumerate(_thirds(msgs, "at")):
        writers.publish(lot.unionByName(lot.where("seq % 3 = 0")).drop("at"), path=f"{src}/arrival={i}")
        rows = codec.decode_frame(msg_sources.file_stream(spark, src), schema).withColumn("at", timefmt.parse_event_time("timestamp"))
        with stream.shuffle_partitions(spark, stream.default_state_partitions(spark)):
            q = ordered.once(rows, ["seq"], "at").writeStream.foreachBatch(
                lambda b, i: b.write.mode("overwrite").parquet(f"{root}/out/batch={i}")) \
                .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start()
        stream.run_available([q])
    return spark.read.parquet(f"{root}/out").select("symbol", "seq", "timestamp", "price")


def q_stream_snapshot(spark, sf_dir):
    """The snapshot after three arrivals of messages, from the rows kept beside the stream."""
    root, msgs = scratch_path(spark, "live-snapshot"), _tick_messages(spark, sf_dir)
    at = msgs.withColumn("at", timefmt.to_wall_clock(timefmt.parse_event_time("timestamp")))
    lots = [lot.select(*msgs.columns) for lot in _thirds(at, "at")]
    _arrivals(spark, lots, live_snapshot.writer(root, 100, ARRIVAL), f"{root}/_checkpoint")
    return live_snapshot.snapshot(spark, root, msgs.schema, 100, order=ARRIVAL)


def q_stream_ema(spark, sf_dir):
    """Ticks arriving in three lots; EMA 12/26 per symbol continued from the state table."""
    return _stream_ema(spark, sf_dir, ("symbol",))


def q_stream_ema_unkeyed(spark, sf_dir):
    """The same with all ticks as one series."""
    return _stream_ema(spark, sf_dir, ())


def _recent(spark, sf_dir, kind: str, order: tuple[str, ...]) -> DataFrame:
    """Messages in, result messages out, tailed into a recent-rows table; its last 100 rows."""
    out = _run_stream(spark, sf_dir, processed=kind == "price", indicators=kind != "price")
    root = scratch_path(spark, "tables")
    with stream.shuffle_partitions(spark, stream.default_state_partitions(spark)):
        qs = tail.start_tables({kind: msg_sources.file_stream(spark, out.path(kind))}, root,
                               trigger={"availableNow": True})
    stream.await_all(spark, qs)
    return tail.latest_rows(spark, root, kind, 100, order=order)


def _wall(cols, rounded) -> list[Column]:
    return [*[timefmt.to_wall_clock(c).alias(c) for c in cols], *[r6(c).alias(c) for c in rounded]]


def q_recent_rows_sma(spark, sf_dir):
    rows = _recent(spark, sf_dir, "sma", ("window_start",))
    return rows.select(*_wall(["window_start", "window_end"], ["sma_20"]))


def q_recent_rows_bb(spark, sf_dir):
    rows = _recent(spark, sf_dir, "bb", ("window_start",))
    return rows.select(*_wall(["window_start", "window_end"], ["bb_middle", "bb_std", "bb_upper", "bb_lower"]))


def q_recent_rows_price(spark, sf_dir):
    rows = _recent(spark, sf_dir, "price", ("timestamp", "price", "volume", "change_percent"))
    return rows.select("timestamp", "date", "price", "volume", "change_percent")


def q_table_window_repeats(spark, sf_dir):
    """A third of the window messages is sent again in a second arrival; the table holds every window once."""
    out, root, src = _run_stream(spark, sf_dir), scratch_path(spark, "tables"), scratch_path(spark, "window-arrivals")
    sent = stream.read_messages(spark, out, "sma")
    for i, lot in enumerate((sent, sent.where(F.pmod(F.xxhash64("value"), F.lit(3)) == 0))):
        lot.write.text(f"{src}/arrival={i}")
        with stream.shuffle_partitions(spark, stream.default_state_partitions(spark)):
            qs = tail.start_tables({"sma": msg_sources.file_stream(spark, src)}, root, {"availableNow": True}, once_within="1 hour")
        stream.await_all(spark, qs)
    return tail.read_tables(spark, root, ("sma",))["sma"].select(*_wall(["window_start", "window_end"], ["sma_20"]))


def q_recent_rows_arrival(spark, sf_dir):
    """Nine lots of messages, each in its order, tailed one after the other with folders rewritten in between; the last 100 to arrive."""
    _utc(spark)
    root, src = scratch_path(spark, "tables"), scratch_path(spark, "arrivals")
    msgs = fixtures.messages(spark, sf_dir).withColumn("at", timefmt.to_wall_clock(timefmt.parse_event_time("timestamp")))
    for i, lot in enumerate(lot for third in _thirds(msgs, "at") for lot in _thirds(third, "at")):
        writers.publish(lot.orderBy("timestamp", "seq").drop("seq", "symbol", "at"), path=f"{src}/arrival={i}")
        stream.await_all(spark, tail.start_tables({"price": msg_sources.file_stream(spark, src)}, root,
                                                  trigger={"availableNow": True}, fan=3))
    return tail.latest_rows(spark, root, "price").select("timestamp", "date", "price", "volume", "change_percent")


def q_job_chain(spark, sf_dir):
    """Bars to messages stamped with their date, through the stream, into the price table."""
    _utc(spark)
    topic, root = scratch_path(spark, "bar-topic"), scratch_path(spark, "chain")
    writers.publish(normalize.to_messages(fixtures.bars(spark, sf_dir), sent_at=F.col("date")), path=topic)
    streams = stream.indicator_streams(msg_sources.file_stream(spark, topic), duration="7 days", slide="7 days")
    out = stream.Outputs(root=root)
    n = stream.default_state_partitions(spark)
    stream.await_all(spark, stream.start(streams, out, trigger={"availableNow": True}, state_partitions=n))
    with stream.shuffle_partitions(spark, n):
        qs = tail.start_tables({k: msg_sources.file_stream(spark, out.path(k)) for k in ("price", "sma")}, f"{root}/tables",
                               trigger={"availableNow": True})
    stream.await_all(spark, qs)
    tables = tail.read_tables(spark, f"{root}/tables", ("price", "sma"))
    price = tables["price"].agg(F.lit("price").alias("table"), F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))
    sma = tables["sma"].agg(F.lit("sma").alias("table"), F.count("*").alias("n"), F.round(F.sum("sma_20"), 2).alias("total"))
    return price.unionByName(sma)


# ---------------------------------------------------------------- dirty input, long spans

def q_ema_200(spark, sf_dir):
    return _rounded(ema.ema(_ticks(spark, sf_dir), 200), ["ema_200"])


def q_macd_5_200_9(spark, sf_dir):
    names = ("ema_fast", "ema_slow", "macd", "signal", "hist")
    return _rounded(ema.macd(_ticks(spark, sf_dir), fast=5, slow=200, signal=9, names=names), list(names))


def q_sma_2000(spark, sf_dir):
    return _rounded(rolling.sma(_ticks(spark, sf_dir), 2000), ["sma_2000"])


def q_bollinger_2000(spark, sf_dir):
    return _rounded(rolling.bollinger(_ticks(spark, sf_dir), 2000, 2.0), ["BB_middle", "BB_upper", "BB_lower"])


def _gappy(spark, sf_dir) -> DataFrame:
    """Ticks whose price is NaN at every 97th event."""
    return _ticks(spark, sf_dir).withColumn(
        "price", F.when(F.col("seq") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("price")))


def q_bands_with_gaps(spark, sf_dir):
    return _rounded(rolling.bollinger(_gappy(spark, sf_dir), 20, 2.0), ["BB_middle", "BB_upper", "BB_lower"])


def q_rsi_with_gaps(spark, sf_dir):
    return _rounded(rolling.rsi(_gappy(spark, sf_dir), 14), ["rsi"])


def q_ema_with_gaps(spark, sf_dir):
    return _rounded(ema.ema(_gappy(spark, sf_dir), 12), ["ema_12"])


def q_ema_decay_gaps(spark, sf_dir):
    """EMA 12 over ticks with gaps, the older value losing weight with every missing row."""
    out = decay_ema.decayed_ema(_gappy(spark, sf_dir), 12)
    return out.select("symbol", "ts", "seq", r6("ema_12").alias("ema_12"))


def q_macd_decay_gaps(spark, sf_dir):
    """MACD over ticks with gaps: both EMAs decay across them, the signal goes on through them."""
    names = ["EMA_12", "EMA_26", "MACD", "MACD_signal", "MACD_hist"]
    return decay_ema.decayed_macd(_gappy(spark, sf_dir)).select("symbol", "ts", "seq", *[r6(c).alias(c) for c in names])


def q_layout_per_feed(spark, sf_dir):
    """CSV bars of five feeds, two of them day-first, each read by its one date layout."""
    _utc(spark)
    path = scratch_path(spark, "feeds-csv")
    fixtures.bars_by_feed(fixtures.bars(spark, sf_dir)).write.partitionBy("feed").option("header", True).csv(path)
    out = normalize.normalize_csv_bars(bar_sources.read_csv_text(spark, path), sort=False, layout_by=("feed",))
    return out.select("feed", timefmt.to_wall_clock("date").alias("date"), "price", "open", "high", "low", "change_percent")


def q_percent_ties(spark, sf_dir):
    """Signed percent of eighths: ties go to the even digit."""
    _utc(spark)
    ev = fixtures.table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 801 - 400) / 8).alias("change"))
    return ev.select("event_id", "change", display.signed_percent("change").alias("shown"))


def q_dirty_bars(spark, sf_dir):
    """CSV bars of which about one in seven has a bad or unusual cell, by day of the year."""
    _utc(spark)
    text_bars = fixtures.dirty_csv_text(fixtures.bars_as_csv_text(fixtures.bars(spark, sf_dir)))
    path = scratch_path(spark, "dirty-csv")
    text_bars.write.option("header", True).option("escape", '"').csv(path)
    out = normalize.normalize_csv_bars(bar_sources.read_csv_text(spark, path), sort=False)
    return out.select("symbol", "note", timefmt.to_wall_clock("date").alias("date"), "price", r6("volume").alias("volume"),
                      "change_percent")


def q_chart_bands(spark, sf_dir):
    """The chart's mean and band panel: the last 100 windows, then a range on their start."""
    bands = timewin.sliding_bands(_ticks(spark, sf_dir), ts="ts", value="price")
    out = views.band_series(bands, 100, *BAND_RANGE)
    return _numbered(out.select("x", *[r6(c).alias(c) for c in ("sma", "upper", "lower")]), ["x", "sma", "upper", "lower"])


def q_chart_macd(spark, sf_dir):
    """MACD trio as the chart draws it: seeded on each symbol's last 100 rows."""
    out = views.macd_series(_ticks(spark, sf_dir), TICK_KEYS, TICK_ORDER, lookback=100)
    return _rounded(out, ["EMA_12", "EMA_26", "MACD", "MACD_signal", "MACD_hist"])


def q_chart_rsi(spark, sf_dir):
    """The chart's price-level RSI over each symbol's last 100 rows."""
    out = views.price_level_rsi_series(_ticks(spark, sf_dir), TICK_KEYS, TICK_ORDER, lookback=100)
    return _rounded(out, ["RSI"])


QUERIES: dict[str, Query] = {
    "sliding_sma": q_sliding_sma,
    "sliding_bands": q_sliding_bands,
    "sliding_bands_by_symbol": q_sliding_bands_by_symbol,
    "diff": q_diff,
    "sma_20": q_sma_20,
    "sma_50": q_sma_50,
    "bollinger_20": q_bollinger_20,
    "rsi_14": q_rsi_14,
    "rsi_price_level": q_rsi_price_level,
    "ema_12": q_ema_12,
    "ema_26": q_ema_26,
    "macd": q_macd,
    "indicator_frame": q_indicator_frame,
    "latest_n": q_latest_n,
    "latest_n_per_symbol": q_latest_n_per_symbol,
    "latest_then_range": q_latest_then_range,
    "date_range": q_date_range,
    "window_range": q_window_range,
    "snapshot": q_snapshot,
    "snapshot_empty_range": q_snapshot_empty_range,
    "market_status": q_market_status,
    "recent_trades": q_recent_trades,
    "ohlc_series": q_ohlc_series,
    "price_series": q_price_series,
    "export_csv": q_export_csv,
    "normalize_prices": q_normalize_prices,
    "parse_volume": q_parse_volume,
    "parse_percent": q_parse_percent,
    "normalize_bars": q_normalize_bars,
    "flatten_history": q_flatten_history,
    "json_roundtrip": q_json_roundtrip,
    "double_encoded_json": q_double_encoded_json,
    "stream_sliding_sma": q_stream_sliding_sma,
    "stream_sliding_bands": q_stream_sliding_bands,
    "stream_sliding_bands_by_symbol": q_stream_sliding_bands_by_symbol,
    "stream_passthrough": q_stream_passthrough,
    "stream_ema": q_stream_ema,
    "recent_rows_sma": q_recent_rows_sma,
    "recent_rows_price": q_recent_rows_price,
    "recent_rows_bb": q_recent_rows_bb,
    "job_chain": q_job_chain,
    "stream_ema_unkeyed": q_stream_ema_unkeyed,
    "stream_indicator_frame": q_stream_indicator_frame,
    "stream_ema_reordered": q_stream_ema_reordered,
    "stream_late_rows": q_stream_late_rows,
    "stream_duplicates": q_stream_duplicates,
    "table_window_repeats": q_table_window_repeats,
    "recent_rows_arrival": q_recent_rows_arrival,
    "stream_snapshot": q_stream_snapshot,
    "ema_decay_gaps": q_ema_decay_gaps,
    "macd_decay_gaps": q_macd_decay_gaps,
    "layout_per_feed": q_layout_per_feed,
    "sma_2000": q_sma_2000,
    "bollinger_2000": q_bollinger_2000,
    "stream_late_file": q_stream_late_file,
    "ema_200": q_ema_200,
    "macd_5_200_9": q_macd_5_200_9,
    "bands_with_gaps": q_bands_with_gaps,
    "rsi_with_gaps": q_rsi_with_gaps,
    "ema_with_gaps": q_ema_with_gaps,
    "percent_ties": q_percent_ties,
    "dirty_bars": q_dirty_bars,
    "chart_bands": q_chart_bands,
    "chart_macd": q_chart_macd,
    "chart_rsi": q_chart_rsi,
}
