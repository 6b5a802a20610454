"""Streaming EMA that scales inside a micro-batch: ``foreachBatch`` + blocks.

Each micro-batch runs the skew-safe blocked EMA (``operators/ema``), and every
instrument goes on from a small state table:

* state: one row per instrument (last ts, seq and EMA values), written per
  batch id under ``<root>/state/batch=<id>``; a replayed batch reads the state
  of the batch before it and overwrites its own outputs, so replays are
  idempotent. State older than the batch before is removed; a missing state
  is an error, not a fresh start;
* rows not after the instrument's last folded row are late and dropped (join
  with the state; adaptive execution splits a skewed join partition);
* continuation: the first row of an instrument in the batch is seeded with
  the state's value, ``y = a*x + q*y_prev``, which is exact.

Instruments are matched null-safely: a NULL key is an instrument too. With no
keys there is one series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticksmith.operators import ema, series
from ticksmith.session import delete_path


def _names(spans: Sequence[float]) -> list[str]:
    return [f"ema_{int(s)}" for s in spans]


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda c, k: c & left[k].eqNullSafe(right[f"_k_{k}"]), keys, F.lit(True))


def renamed(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    return state.withColumnsRenamed({k: f"_k_{k}" for k in keys})


def continue_ema(batch: DataFrame, state: DataFrame | None, spans: Sequence[float],
                 keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"),
                 price: str = "price", block_rows: int | None = None,
                 num_partitions: int | None = None) -> DataFrame:
    """EMA of one micro-batch's rows, continuing each key from ``state``.

    ``num_partitions``: range partitions of the batch, whose size Spark does
    not know (default: the session's shuffle partitions).
    """
    keys, spans = list(keys), list(spans)
    names = _names(spans)
    ts, seq = order
    rows = series.finite(batch, price).filter(F.col(price).isNotNull())
    prev = [f"_prev_{n}" for n in names]
    if state is not None:
        st = renamed(state, keys).select(
            *[f"_k_{k}" for k in keys], F.col(ts).alias("_last_ts"), F.col(seq).alias("_last_seq"),
            *[F.col(n).alias(p) for n, p in zip(names, prev)])
        if not keys:
            st = F.broadcast(st)  # one row
        rows = rows.join(st, same_keys(rows, st, keys), "left")
        after = (F.col("_last_ts").isNull() | (F.col(ts) > F.col("_last_ts"))
                 | ((F.col(ts) == F.col("_last_ts")) & (F.col(seq) > F.col("_last_seq"))))
        rows = rows.filter(after).drop("_last_ts", "_last_seq", *[f"_k_{k}" for k in keys])
    else:
        rows = rows.select("*", *[F.lit(None).cast("double").alias(p) for p in prev])

    limit = min(ema.block_rows_for(spans), block_rows or series.DEFAULT_BLOCK_ROWS)
    blk = series.blocks(rows, keys, order, 1, limit, num_partitions)
    states = ema.States(price, list(zip(spans, names)), before=dict(zip(names, prev)))
    b = ema.add_states(ema.add_index(blk.frame, blk.window), blk, states)
    return series.finish(b).drop(ema.J, ema.CONT, *prev)


def next_state(out: DataFrame, state: DataFrame | None, spans: Sequence[float],
               keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Last folded row per key: this batch's, else the previous state's."""
    keys = list(keys)
    cols = [*order, *_names(spans)]
    last = (out.groupBy(*keys)
            .agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_l")).where("_l is not null")
            .select(*keys, *[F.col(f"_l.{c}").alias(c) for c in cols]))
    if state is None:
        return last
    old = state.select(*keys, *cols)
    new = renamed(last.select(*keys, F.lit(1).alias("_new")), keys)
    return old.join(new, same_keys(old, new, keys), "left_anti").unionByName(last)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise RuntimeError(f"the state of the previous batch is missing: {path}") from e


def writer(root: str, spans: Sequence[float] = (12, 26), keys: Sequence[str] = ("symbol",),
           order: Sequence[str] = ("ts", "seq"), price: str = "price",
           block_rows: int | None = None, num_partitions: int | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: outputs to ``<root>/out``, state to ``<root>/state``."""
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = read_state(spark, f"{root}/state/batch={batch_id - 1}") if batch_id > 0 else None
        out_path = f"{root}/out/batch={batch_id}"
        continue_ema(batch, state, spans, keys, order, price, block_rows, num_partitions).write.mode("overwrite").parquet(out_path)
        written = spark.read.parquet(out_path)
        (next_state(written, state, spans, keys, order)
         .write.mode("overwrite").parquet(f"{root}/state/batch={batch_id}"))
        if batch_id > 1:  # a replay needs the state before its batch, nothing older
            delete_path(spark, f"{root}/state/batch={batch_id - 2}")
    return step


def read_output(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out/batch=*").drop("batch")
