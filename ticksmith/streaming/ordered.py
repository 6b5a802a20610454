"""Rows out of order and rows sent twice, in front of any batch step.

``in_order`` wraps a ``foreachBatch`` step that needs each instrument's rows in
event order (``batch_ema.writer``, ``batch_frame.writer``). Rows wait in a
holding table until the frontier, the largest event time seen less ``delay``,
has passed them, and go on in the batch that does; rows behind the frontier of
the batch before are late and written aside, each once. Every table is written per
batch id with overwrite, so replays are idempotent. The holding table is bounded by what
arrives within ``delay``.

``once`` drops repeated messages by the position their source gave them, with
state bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticksmith.session import delete_path
from ticksmith.streaming.batch_ema import read_state

Step = Callable[[DataFrame, int], None]


def _step(step: Step, root: str, ts: str, seconds: float | None) -> Step:
    def run(batch: DataFrame, batch_id: int) -> None:
        spark, at = batch.sparkSession, f"{root}/order/batch={batch_id}"
        held, frontier = None, None
        if batch_id > 0:
            held = read_state(spark, f"{root}/order/batch={batch_id - 1}/held")
            frontier = read_state(spark, f"{root}/order/batch={batch_id - 1}/frontier").first()[0]
        passed = F.lit(frontier) if frontier is not None else None
        late = batch.where(F.col(ts) <= passed) if passed is not None else batch.limit(0)
        late.write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}")
        new = batch if passed is None else batch.where(F.col(ts) > passed)
        pool = new.where(F.col(ts).isNotNull())
        pool = pool if held is None else pool.unionByName(held.select(*pool.columns))
        pool.write.mode("overwrite").parquet(f"{at}/pool")  # one run of the source's plan
        pool = spark.read.parquet(f"{at}/pool")
        newest = pool.agg(F.max(ts)).first()[0]
        if seconds is None:
            frontier = newest if newest is not None else frontier
        elif newest is not None:
            reached = spark.range(1).select(F.lit(newest) - F.make_dt_interval(secs=F.lit(seconds))).first()[0]
            frontier = reached if frontier is None else max(frontier, reached)
        ready = pool.where(F.col(ts) <= F.lit(frontier)) if frontier is not None else pool.limit(0)
        ahead = pool.where(F.col(ts) > F.lit(frontier)) if frontier is not None else pool
        ahead.write.mode("overwrite").parquet(f"{at}/held")
        spark.range(1).select(F.lit(frontier).cast(dict(pool.dtypes)[ts]).alias("frontier")) \
            .write.mode("overwrite").parquet(f"{at}/frontier")
        step(ready, batch_id)
        if batch_id > 1:
            delete_path(spark, f"{root}/order/batch={batch_id - 2}")
    return run


def in_order(step: Step, root: str, delay_seconds: float = 600.0, ts: str = "ts") -> Step:
    """``step`` on each batch's rows whose turn has come; late rows go to ``<root>/late``."""
    return _step(step, root, ts, float(delay_seconds))


def flush(spark: SparkSession, step: Step, root: str, batch_id: int, ts: str = "ts") -> None:
    """The rows still held, as batch ``batch_id`` (the one after the last): for a stream that has ended."""
    held = read_state(spark, f"{root}/order/batch={batch_id - 1}/held")
    _step(step, root, ts, None)(held.limit(0), batch_id)


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("basePath", f"{root}/late").parquet(f"{root}/late/batch=*")


def once(rows: DataFrame, position: Sequence[str], event_time: str, watermark: str = "10 minutes") -> DataFrame:
    """``rows`` of a stream without repeats of ``position`` that come within ``watermark`` of the first."""
    return rows.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(list(position))
