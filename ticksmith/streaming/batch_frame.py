"""All row indicators on live data: ``foreachBatch`` + halo blocks.

Each micro-batch runs the skew-safe indicator frame (``plans/indicators``) and
every instrument goes on from a small state, written per batch id:

* ``tail``: its last ``frame_lookback()`` rows (49 prices). They stand, flagged,
  in front of the batch's rows, so the rolling frames (RSI, means, bands) see what they
  would see in one long table; they are the halo of the batch's first block;
* ``last``: time, sequence and the three recursions (fast and slow EMA,
  signal) at its last row: the recursion's value before the batch's first row.

A replayed batch reads the state of the batch before it and overwrites its own
outputs, so replays are idempotent; a missing state is an error. Rows not after
the instrument's last row are late and dropped (``streaming/ordered`` holds
rows back until their turn, and lists the late ones). A hot instrument spreads over
blocks inside the batch; state is 49 rows an instrument, whatever its history.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticksmith.operators import latest as L, series
from ticksmith.plans import indicators
from ticksmith.session import delete_path
from ticksmith.streaming.batch_ema import read_state, renamed, same_keys

#: The recursive columns, carried from batch to batch.
RECURSIVE = ("EMA_12", "EMA_26", "MACD_signal")
_OLD = "_old"


def continue_frame(batch: DataFrame, tail: DataFrame | None, last: DataFrame | None, price: str = "price",
                   keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"),
                   num_partitions: int | None = None) -> DataFrame:
    """The indicator frame of one micro-batch's rows, each key going on from ``tail`` and ``last``."""
    keys, (ts, seq) = list(keys), order
    before = {c: f"_prev_{c}" for c in RECURSIVE}
    rows = series.finite(batch, price).where(F.col(price).isNotNull())
    if last is None:
        rows = rows.select("*", *[F.lit(None).cast("double").alias(p) for p in before.values()])
        return indicators.indicator_frame(rows, price, keys, order, before, None, num_partitions).drop(*before.values())
    known = renamed(last, keys).select(*[f"_k_{k}" for k in keys], F.col(ts).alias("_last_ts"), F.col(seq).alias("_last_seq"),
                                       *[F.col(c).alias(p) for c, p in before.items()])
    known = known if keys else F.broadcast(known)  # one row
    rows = rows.join(known, same_keys(rows, known, keys), "left")
    late = (F.col(ts) < F.col("_last_ts")) | ((F.col(ts) == F.col("_last_ts")) & (F.col(seq) <= F.col("_last_seq")))
    rows = rows.where(~F.coalesce(late, F.lit(False))).drop("_last_ts", "_last_seq", *[f"_k_{k}" for k in keys])
    here = rows.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    old = tail.join(here, same_keys(tail, here, keys), "left_semi") if keys else tail
    both = rows.withColumn(_OLD, F.lit(False)).unionByName(
        old.select(*keys, *order, price).withColumn(_OLD, F.lit(True)), allowMissingColumns=True)
    return indicators.indicator_frame(both, price, keys, order, before, _OLD, num_partitions).drop(_OLD, *before.values())


def next_state(out: DataFrame, tail: DataFrame | None, last: DataFrame | None, price: str = "price",
               keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq")) -> tuple[DataFrame, DataFrame]:
    """``tail`` and ``last`` after the rows ``out``; keys without new rows keep theirs."""
    keys, cols = list(keys), [*order, *RECURSIVE]
    rows = out.select(*keys, *order, price)
    rows = rows if tail is None else rows.unionByName(tail.select(*rows.columns))
    newest = out.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("l")).where("l is not null") \
        .select(*keys, *[F.col(f"l.{c}").alias(c) for c in cols])
    if last is not None:
        new = renamed(newest.select(*keys, F.lit(1).alias("_new")), keys)
        newest = last.select(*keys, *cols).join(new, same_keys(last, new, keys), "left_anti").unionByName(newest)
    return L.latest_per_key(rows, indicators.frame_lookback(), keys, order), newest


def writer(root: str, price: str = "price", keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"),
           num_partitions: int | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: outputs to ``<root>/out``, state to ``<root>/state``."""
    def step(batch: DataFrame, batch_id: int) -> None:
        spark, state = batch.sparkSession, f"{root}/state/batch={batch_id}"
        tail = last = None
        if batch_id > 0:
            tail, last = (read_state(spark, f"{root}/state/batch={batch_id - 1}/{t}") for t in ("tail", "last"))
        path = f"{root}/out/batch={batch_id}"
        continue_frame(batch, tail, last, price, keys, order, num_partitions).write.mode("overwrite").parquet(path)
        for name, part in zip(("tail", "last"), next_state(spark.read.parquet(path), tail, last, price, keys, order)):
            part.write.mode("overwrite").parquet(f"{state}/{name}")
        if batch_id > 1:  # a replay needs the state before its batch, nothing older
            delete_path(spark, f"{root}/state/batch={batch_id - 2}")
    return step


def read_output(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out/batch=*").drop("batch")
