"""The market snapshot kept as a small state beside a stream, so that a refresh reads 100 rows and no table.

Per micro-batch the newest ``n`` rows of the batch (a limit per task, then one
merge, ``operators/latest``) and of the state before it give the next state: the
last ``n`` rows are mergeable, so arrivals may be cut anywhere and rows may come
in any order. A state is written per batch id with overwrite and read from the
batch before, so a replay gives the same state; a small version file (``manifest``)
names the finished one, so a refresh never sees a half-written state. Older states
are removed. Messages sent twice are ``ordered.once``'s to drop.

Defined results: before the first batch, and while no row has come, the snapshot
is the neutral one; a batch without rows keeps the state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ticksmith.operators import latest as L
from ticksmith.plans import views
from ticksmith.session import delete_path
from ticksmith.streaming import manifest
from ticksmith.streaming.batch_ema import read_state


def writer(root: str, n: int = views.DEFAULT_ROWS, order: Sequence[str] = L.ARRIVAL) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that keeps the newest ``n`` rows by ``order`` under ``<root>/recent``."""
    def step(batch: DataFrame, batch_id: int) -> None:
        spark, at = batch.sparkSession, f"{root}/recent/batch="
        rows = L.latest(batch, n, order)
        if batch_id > 0:
            rows = L.latest(rows.unionByName(read_state(spark, f"{at}{batch_id - 1}")), n, order)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{at}{batch_id}")
        manifest.save(spark, f"{root}/_index", batch_id, {"batch": batch_id})
        if batch_id > 2:  # a replay needs the state before its batch, a refresh in flight the one before that
            delete_path(spark, f"{at}{batch_id - 3}")
    return step


def recent(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest rows as of the last finished batch; None before the first."""
    now = manifest.load(spark, f"{root}/_index")
    return None if now is None else spark.read.parquet(f"{root}/recent/batch={now['batch']}")


def snapshot(spark: SparkSession, root: str, schema, n: int = views.DEFAULT_ROWS, start: str | None = None,
             end: str | None = None, date_col: str = "date", order: Sequence[str] = L.ARRIVAL) -> DataFrame:
    """``views.snapshot`` of the kept rows; ``schema`` is the rows', for the time before the first batch."""
    rows = recent(spark, root)
    rows = spark.createDataFrame([], schema) if rows is None else rows
    return views.snapshot(rows, n, start, end, date_col, order)
