"""Recent-rows tables: result streams appended into queryable tables.

One streaming query per table (price / sma / bb), each decoding its topic's
messages, stamping the receive time and appending to a file table with its
own checkpoint: one folder per micro-batch, overwritten if the batch is
replayed. Rows keep the order of their arrival (batch, file or partition,
place). Readers query the tables in batch (``latest_rows``); nothing
is shared in memory between the writer and the readers.

A trigger a second makes tens of thousands of folders a day, so each table has
an index (``manifest``): its live folders in order of arrival with their row counts.
``latest_rows`` adds the counts up from the end and reads only the folders that
the last ``n`` rows are in. Whenever ``FAN`` folders of one level stand at the
end, they are rewritten as one of the next level, so a table of m batches has
at most ``FAN`` folders for each of log(m) levels. Folders that a version
replaced are removed with the next version: a reader of the one before still finds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ticksmith.operators import latest as L
from ticksmith.session import delete_path
from ticksmith.sinks.writers import with_receive_time
from ticksmith.sources.messages import ARRIVAL_PART, ARRIVAL_SEQ, decode_results
from ticksmith.streaming import manifest, ordered

#: Folders rewritten as one.
FAN = 64
# Order of arrival: micro-batch, then the place the message came from.
BATCH = "batch"
KINDS = ("price", "sma", "bb")
WINDOW_KINDS = ("sma", "bb")
TABLE_ORDER = {kind: (BATCH, ARRIVAL_PART, ARRIVAL_SEQ) for kind in KINDS}
# Files that land together have no order of arrival among them: by the rows' own time within a micro-batch.
TIMED_ORDER = {kind: (BATCH, time, ARRIVAL_PART, ARRIVAL_SEQ) for kind, time in
               (("price", "timestamp"), ("sma", "window_start"), ("bb", "window_start"))}


def _index(root: str, kind: str) -> str:
    return f"{root}/_index/{kind}"


def _read(spark: SparkSession, path: str, state: dict, folders: list[dict]) -> DataFrame:
    schema = StructType.fromJson(state["schema"])
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f['folder']}" for f in folders])


def _table_writer(root: str, kind: str, fan: int):
    path, index = f"{root}/{kind}", _index(root, kind)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = manifest.load(spark, index, before=batch_id)
        if last is None and batch_id > 0:
            raise RuntimeError(f"the index of the table before batch {batch_id} is missing: {index}")
        if ARRIVAL_PART not in batch.columns:
            batch = batch.withColumn(ARRIVAL_PART, F.lit(None).cast("string"))
        if ARRIVAL_SEQ not in batch.columns:
            batch = batch.withColumn(ARRIVAL_SEQ, F.monotonically_increasing_id())
        batch = batch.withColumn(BATCH, F.lit(batch_id).cast("long"))
        folder = f"lot-{batch_id}"
        batch.write.mode("overwrite").parquet(f"{path}/{folder}")
        stored = spark.read.parquet(f"{path}/{folder}")
        now = {"schema": stored.schema.jsonValue(), "folders": list(last["folders"]) if last else [], "replaced": []}
        rows = stored.count()  # from the files' footers
        if rows:
            now["folders"].append({"folder": folder, "rows": rows, "level": 0})
        else:
            now["replaced"].append(folder)
        while len(same := now["folders"][-fan:]) == fan and len({f["level"] for f in same}) == 1:
            one = {"folder": f"{same[0]['folder']}-to-{batch_id}-level-{same[0]['level'] + 1}",
                   "rows": sum(f["rows"] for f in same), "level": same[0]["level"] + 1}
            _read(spark, path, now, same).write.mode("overwrite").parquet(f"{path}/{one['folder']}")
            now["folders"][-fan:] = [one]
            now["replaced"] += [f["folder"] for f in same]
        manifest.save(spark, index, batch_id, now)
        for old in last["replaced"] if last else []:
            delete_path(spark, f"{path}/{old}")
    return write


def start_tables(sources: dict[str, DataFrame], root: str,
                 trigger: dict | None = None, fan: int = FAN, once_within: str | None = None) -> list[StreamingQuery]:
    """``sources``: kind -> streaming frame with a ``value`` message column.

    Other columns (where the message came from) are kept in the table.

    ``once_within`` (e.g. ``"1 hour"``): the writer of a result topic sends the
    windows of a micro-batch again when it replays it, so a window table takes
    each window once. State holds the windows of that time; a window that ends
    further behind the newest one of the batches before counts as sent again.
    Messages without a window count as one. Price rows, which have no name of
    their own, are left as they come.
    """
    if fan < 2:
        raise ValueError("fan must be at least 2")
    trigger = trigger or {"processingTime": "1 second"}
    queries = []
    for kind, messages in sources.items():
        rows = decode_results(messages, kind)
        if once_within and kind in WINDOW_KINDS:
            rows = ordered.once(rows, ["window_start"], "window_end", once_within)
        queries.append(with_receive_time(rows).writeStream.foreachBatch(_table_writer(root, kind, fan)).outputMode("append")
                       .option("checkpointLocation", f"{root}/_checkpoints/{kind}")
                       .trigger(**trigger).start())
    return queries


def _state(spark: SparkSession, root: str, kind: str) -> dict:
    state = manifest.load(spark, _index(root, kind))
    if state is None:
        raise RuntimeError(f"no such table: {root}/{kind}")
    return state


def read_tables(spark: SparkSession, root: str, kinds=KINDS) -> dict[str, DataFrame]:
    """Whole tables."""
    states = {k: _state(spark, root, k) for k in kinds}
    return {k: _read(spark, f"{root}/{k}", s, s["folders"]) for k, s in states.items()}


def latest_rows(spark: SparkSession, root: str, kind: str, n: int = 100,
                order: tuple[str, ...] | None = None) -> DataFrame:
    """The last ``n`` rows of one table, oldest first; an unknown kind raises ``ValueError``.

    In order of arrival (the default), or any that begins with the batch, only the folders that hold them are read.
    """
    if kind not in TABLE_ORDER:
        raise ValueError(f"unknown data type: {kind!r}")
    state = _state(spark, root, kind)
    folders, first = state["folders"], 0
    if order is None or order[0] == BATCH:
        first, rows = len(folders), 0
        while first and rows < n:
            first -= 1
            rows += folders[first]["rows"]
    return L.latest_of_kind({kind: _read(spark, f"{root}/{kind}", state, folders[first:])}, kind, n, order or TABLE_ORDER[kind])
