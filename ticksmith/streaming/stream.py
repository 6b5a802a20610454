"""Streaming indicators: decode -> pass-through, and watermarked sliding windows.

Same code as batch: ``window_stats`` is applied to a streaming frame after
``withWatermark``. Differences from running three independent queries on
one topic:

* the time-window mean and the bands come from one stateful aggregate (one
  state store, one read and decode of the source); both projections are
  written from the same micro-batch by ``foreachBatch``, to per-batch folders
  so a replayed batch overwrites instead of duplicating;
* the pass-through branch is stateless and not watermarked (its
  ``timestamp`` stays text), exactly as the processed topic carries it;
* file mode writes the result topics as folders of JSON messages (``price``,
  ``sma``, ``bb``), which the recent-rows tables read like topics;
* the queries are awaited together: all are waited for, and the first to fail
  stops the others and its error is raised.

Append mode emits a window once, when the watermark (max event time seen
minus the delay, as of the previous batch) passes the window end; rows for
windows already behind it are dropped and counted by Spark as
``numRowsDroppedByWatermark`` (one late row counts once per window it falls
in). Shuffle partitions of a stateful query are fixed by its checkpoint.
"""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ticksmith.functions import timefmt
from ticksmith.functions.codec import decode_frame, with_quarantine
from ticksmith.operators import timewin
from ticksmith.schema import BAR_MESSAGE, RESULT_SCHEMAS
from ticksmith.sinks import writers
from ticksmith.sources.messages import decode_results

# Event-time delay tolerated before a window is final.
WATERMARK = "10 minutes"


@dataclass
class IndicatorStreams:
    processed: DataFrame          # decoded rows, stateless
    stats: DataFrame              # fused windowed aggregate (watermarked)
    keys: tuple[str, ...] = ()
    rejected: DataFrame | None = None   # undecodable messages, when quarantined

    @property
    def sma(self) -> DataFrame:
        return timewin.sma_view(self.stats, self.keys)

    @property
    def bands(self) -> DataFrame:
        return timewin.bands_view(self.stats, self.keys)


def indicator_streams(messages: DataFrame, schema: StructType = BAR_MESSAGE,
                      event_time: str = "timestamp", value: str = "price",
                      watermark: str = WATERMARK, duration: str = timewin.WINDOW,
                      slide: str = timewin.SLIDE, k: float = timewin.BAND_K,
                      keys: tuple[str, ...] = (), quarantine: bool = False) -> IndicatorStreams:
    """Plans (not started) for a ``value`` message stream.

    ``quarantine=True`` keeps messages that decode to nothing out of the
    pass-through (which would otherwise carry them as ``{}``) and routes their
    original text to a ``rejected`` stream instead.
    """
    parsed = decode_frame(messages, schema)
    timed = (parsed.select(*keys, timefmt.parse_event_time(event_time).alias(event_time), value)
             .withWatermark(event_time, watermark))
    stats = timewin.window_stats(timed, event_time, value, duration, slide, k, keys)
    if quarantine:
        good, bad = with_quarantine(messages, schema)
        return IndicatorStreams(processed=good, stats=stats, keys=keys, rejected=bad)
    return IndicatorStreams(processed=parsed, stats=stats, keys=keys)


@dataclass
class Outputs:
    """Where each stream writes: folders (files) or Kafka topics."""
    root: str
    kafka_servers: str | None = None
    topics: dict[str, str] = field(default_factory=dict)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def checkpoint(self, name: str) -> str:
        return f"{self.root}/_checkpoints/{name}"


def default_state_partitions(spark: SparkSession) -> int:
    """One state store per core of the cluster (the default parallelism)."""
    try:
        return max(1, spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 - no SparkContext (e.g. Spark Connect)
        return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def shuffle_partitions(spark: SparkSession, n: int | None):
    """Queries started inside use ``n`` shuffle (and state) partitions.

    A streaming query snapshots the session's settings when it starts and a
    stateful one keeps the partition count for the life of its checkpoint,
    so the count is chosen here, once, instead of inherited by accident.
    """
    if n is None:
        yield
        return
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def start(streams: IndicatorStreams, out: Outputs, trigger: dict | None = None,
          processed: bool = True, indicators: bool = True,
          state_partitions: int | None = None) -> list[StreamingQuery]:
    """Start the pass-through query and/or the fused indicator query."""
    with shuffle_partitions(streams.stats.sparkSession, state_partitions):
        return _start(streams, out, trigger, processed, indicators)


def _start(streams: IndicatorStreams, out: Outputs, trigger: dict | None,
           processed: bool, indicators: bool) -> list[StreamingQuery]:
    trigger = trigger or {"processingTime": "1 second"}
    queries = []
    if processed:
        if out.kafka_servers:
            w = writers.stream_sink(streams.processed, checkpoint=out.checkpoint("processed"),
                                    kafka_servers=out.kafka_servers, topic=out.topics["price"])
        else:
            w = writers.stream_sink(streams.processed, checkpoint=out.checkpoint("processed"),
                                    path=out.path("price"))
        queries.append(w.trigger(**trigger).start())
        if streams.rejected is not None:
            queries.append(writers.stream_sink(streams.rejected, checkpoint=out.checkpoint("rejected"),
                                               path=out.path("rejected"), encode=False)
                           .trigger(**trigger).start())

    if not indicators:
        return queries
    keys = streams.keys

    def split(batch: DataFrame) -> dict[str, DataFrame]:
        return {"sma": timewin.sma_view(batch, keys), "bb": timewin.bands_view(batch, keys)}

    if out.kafka_servers:
        def sink(batch: DataFrame, batch_id: int) -> None:
            batch.persist()  # one run of the stateful plan for both topics
            try:
                for name, part in split(batch).items():
                    (writers.as_messages(part).write.format("kafka")
                     .option("kafka.bootstrap.servers", out.kafka_servers)
                     .option("topic", out.topics[name]).save())
            finally:
                batch.unpersist()
    else:
        sink = writers.idempotent_batch_writer({"sma": out.path("sma"), "bb": out.path("bb")}, split)
    queries.append(streams.stats.writeStream.outputMode("append")
                   .option("checkpointLocation", out.checkpoint("indicators"))
                   .foreachBatch(sink).trigger(**trigger).start())
    return queries


def await_all(spark: SparkSession, queries: list[StreamingQuery],
              timeout: float | None = None, poll: float = 1.0) -> None:
    """Wait until all of ``queries`` have ended; on the first error stop the others and raise it.

    With ``availableNow`` each query drains its own input, so one that ends
    early must not cut off the others. Waits on these queries only: the
    session-wide ``awaitAnyTermination`` also returns for other (earlier or
    unrelated) queries of the session. ``timeout`` stops what still runs.
    """
    started = time.monotonic()
    try:
        while any(q.isActive for q in queries) and not any(q.exception() for q in queries):
            if timeout is not None and time.monotonic() - started >= timeout:
                break
            next((q for q in queries if q.isActive), queries[0]).awaitTermination(poll)
    finally:
        for q in queries:
            if q.isActive:
                q.stop()
    for q in queries:
        err = q.exception()
        if err is not None:
            raise RuntimeError(f"streaming query {q.name or q.id} failed: {err}")


def run_available(queries: list[StreamingQuery]) -> None:
    """For ``availableNow`` triggers: wait for every query to drain its input."""
    for q in queries:
        q.awaitTermination()
        err = q.exception()
        if err is not None:
            raise RuntimeError(f"streaming query {q.name or q.id} failed: {err}")


def read_messages(spark: SparkSession, out: Outputs, name: str) -> DataFrame:
    """The messages of one result folder (``price``, ``sma``, ``bb``) as ``value`` text."""
    if name == "price":
        return spark.read.text(out.path(name))
    return spark.read.option("basePath", out.path(name)).text(f"{out.path(name)}/batch=*").select("value")


def read_result(spark: SparkSession, out: Outputs, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Typed rows of one result folder; ``keys`` are text fields beside the topic's own."""
    schema = StructType([StructField(k, StringType()) for k in keys] + RESULT_SCHEMAS[name].fields)
    return decode_results(read_messages(spark, out, name), name, schema)
