"""Ordered series without a hot task: global positions and halo blocks.

Row-position indicators (lag, rolling frames, EMA) are defined over each
instrument's rows in time order. The direct plan,
``Window.partitionBy(symbol).orderBy(ts)``, sends every row of a symbol to one
task; one symbol holding a third of the data then holds a third of the job.

The plan used here instead:

1. ``repartitionByRange(P, *keys, *order)``: Spark samples the sort key, so a
   hot symbol is spread over many range partitions. Rows are sorted inside
   each partition and numbered by ``monotonically_increasing_id`` (partition
   index in the upper bits, position in the partition in the lower bits),
   then written once to the shared checkpoint folder.
2. Partition sizes (at most ``P`` rows, one per partition, read from one
   column of that table) become start offsets, broadcast back: every row
   gets its global position ``_pos`` in the total order (keys, order).
3. Rows are cut into blocks of ``B`` consecutive positions. A row is also
   copied, flagged as halo, into every later block whose first position lies
   at most ``lookback`` rows after it, so a block sees the ``lookback`` rows
   before it. Window functions then run over ``partitionBy(*keys, _blk)``:
   every group holds at most ``B + lookback`` rows whatever the skew, and a
   frame reaching back ``lookback`` rows sees exactly the rows the
   one-task-per-symbol plan would. Halo rows are dropped afterwards.

Two shuffles of the frame as given (range, then block), both balanced, one
write of it, and one broadcast with a row per partition, not per data row.
A block is never smaller than its look-back, so rows are copied about once
at most, whatever the look-back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ticksmith.session import scratch_path

POS = "_pos"
BLOCK = "_blk"
HALO = "_halo"
_RID = "_rid"
_PART = "_part"
_START = "_start"
_ROWS = "_rows"
# monotonically_increasing_id keeps the row's position inside its partition
# in the lower 33 bits.
_ROW_MASK = (1 << 33) - 1

DEFAULT_BLOCK_ROWS = 1 << 14
_WINDOW_BUFFER = "spark.sql.windowExec.buffer.in.memory.threshold"
# Estimated bytes of one range partition; a plan whose size Spark does not
# know (a micro-batch, an RDD) reports an astronomic one.
PARTITION_BYTES = 128 << 20
_UNKNOWN_BYTES = 1 << 60


def _names(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def cores(df: DataFrame) -> int:
    try:
        return df.sparkSession.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - no SparkContext (e.g. Spark Connect)
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def plan_bytes(df: DataFrame) -> int | None:
    """Size of ``df`` as the optimizer estimates it; None if it cannot."""
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - no classic session
        return None
    return size if size < _UNKNOWN_BYTES else None


def range_partitions(df: DataFrame) -> int:
    """Number of range partitions: the plan's estimated bytes over ``PARTITION_BYTES``.

    At least one per core, so every core has work. Where Spark does not know
    the size, the session's ``spark.sql.shuffle.partitions`` holds; callers
    that know more pass ``num_partitions``. Adaptive execution cannot
    coalesce a fixed-count repartition, so the count has to fit from the
    start. No job runs and no file list is fetched.
    """
    size = plan_bytes(df)
    if size is None:
        return max(cores(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(cores(df), -(-size // PARTITION_BYTES))


def finite(df: DataFrame, col: str) -> DataFrame:
    """NaN and infinite values of ``col`` become NULL: a missing price, as in pandas."""
    if dict(df.dtypes).get(col) not in ("double", "float"):
        return df
    x = F.col(col)
    return df.withColumn(col, F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x))


def with_global_position(df: DataFrame, keys: str | Sequence[str],
                         order: str | Sequence[str],
                         num_partitions: int | None = None,
                         keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``_pos``: 0-based position of each row in the order (keys, order).

    ``order`` must make rows unique within a key (e.g. ``ts, seq``). Only the
    columns in ``keep`` (default: all) go into the written table.

    The range-sorted, numbered rows are written once under the shared
    checkpoint folder. Partition sizes must describe exactly the partitions
    that were numbered; two reads of a range exchange would sample their
    bounds separately and disagree, and a lost executor could renumber a
    recomputed partition. The written table fixes the numbering, and the
    size pass reads one column of it.
    """
    return _positions(_numbered(df, keys, order, num_partitions, keep))


def _numbered(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str], num_partitions: int | None,
              keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` range-sorted, with the partition and the place in it as ``_rid``, as a written table."""
    spark = df.sparkSession
    sort_cols = [*_names(keys), *_names(order)]
    n = num_partitions or range_partitions(df)
    path = scratch_path(spark, "series-positions")
    (df.repartitionByRange(n, *sort_cols)
       .sortWithinPartitions(*sort_cols)
       .select(*(keep or df.columns), F.monotonically_increasing_id().alias(_RID))
       .write.mode("overwrite").parquet(path))
    return spark.read.parquet(path)


def _positions(numbered: DataFrame) -> DataFrame:
    part = F.shiftright(F.col(_RID), 33).cast("int")
    # One row per non-empty partition: bounded by n, not by the data.
    sizes = numbered.groupBy(part.alias(_PART)).agg(F.count(F.lit(1)).alias(_ROWS))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        _PART, F.coalesce(F.sum(_ROWS).over(before), F.lit(0)).alias(_START))
    return (numbered.withColumn(_PART, part)
            .join(F.broadcast(starts), _PART)
            .withColumn(POS, F.col(_START) + F.col(_RID).bitwiseAND(F.lit(_ROW_MASK)))
            .drop(_RID, _PART, _START))


def with_halo_blocks(indexed: DataFrame, lookback: int,
                     block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Assign ``_blk`` and copy each row into the later blocks it is halo for."""
    if block_rows < 1 or lookback < 0:
        raise ValueError("block_rows must be >= 1 and lookback >= 0")
    first = F.expr(f"{POS} div {block_rows}")
    last = F.expr(f"({POS} + {lookback}) div {block_rows}")
    return (indexed
            .withColumn(BLOCK, F.explode(F.sequence(first, last)))
            .withColumn(HALO, F.col(BLOCK) != first))


def block_window(keys: str | Sequence[str]) -> WindowSpec:
    """Window over one block of one series, in series order."""
    return Window.partitionBy(*_names(keys), BLOCK).orderBy(POS)


def frame(w: WindowSpec, n: int) -> WindowSpec:
    """The last ``n`` rows up to and including the current one."""
    return w.rowsBetween(-(n - 1), Window.currentRow)


def window_group_rows(df: DataFrame) -> int:
    """Rows a window partition group may hold in Spark's in-memory buffer.

    Larger groups move to Spark's spillable buffer, which is slower to
    iterate and holds memory differently, so block + halo is kept under this.
    """
    try:
        return int(df.sparkSession.conf.get(_WINDOW_BUFFER))
    except Exception:  # noqa: BLE001
        return 4096


def blocked(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str],
            lookback: int, block_rows: int | None = None,
            num_partitions: int | None = None) -> tuple[DataFrame, WindowSpec]:
    """``df`` cut into halo blocks, plus the window spec to compute over.

    All columns of ``df`` travel: select the needed ones first.

    The blocks are hash-partitioned by block into the same
    data-sized partition count as the range step. Window work is CPU-bound:
    a byte-sized adaptive coalesce would put a few megabytes of rows on a
    couple of cores, and an explicit count is not coalesced. The window's
    distribution is then already satisfied, so no further exchange is added.
    """
    n = num_partitions or range_partitions(df)
    placed = with_global_position(df, keys, order, n)
    cut = with_halo_blocks(placed, lookback, block_size(df, lookback, block_rows)).repartition(n, BLOCK)
    return cut, block_window(keys)


@dataclass
class Blocks:
    """A frame cut into halo blocks, and what a scan over the blocks needs."""
    frame: DataFrame        # rows with halo copies, dealt by block
    window: WindowSpec      # one block of one series
    placed: DataFrame       # the rows with their global position, before cutting
    keys: list[str]
    rows: int               # rows of a block
    count: int              # number of blocks


def blocks(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str], lookback: int,
           block_rows: int | None = None, num_partitions: int | None = None) -> Blocks:
    """``blocked`` with the number of blocks (the written table's rows are counted) and the uncut frame."""
    n = num_partitions or range_partitions(df)
    numbered = _numbered(df, keys, order, n)
    placed, rows = _positions(numbered), block_size(df, lookback, block_rows)
    cut = with_halo_blocks(placed, lookback, rows).repartition(n, BLOCK)
    return Blocks(cut, block_window(keys), placed, _names(keys), rows, -(-numbered.count() // rows))


def block_size(df: DataFrame, lookback: int, block_rows: int | None = None) -> int:
    """Rows of a block: never fewer than its halo, so a row is copied about once at most.

    Up to ``block_rows`` (default: what keeps a block plus its halo inside
    the in-memory window buffer; a longer look-back takes the spillable one).
    """
    fits = min(DEFAULT_BLOCK_ROWS, window_group_rows(df) - lookback)
    return max(lookback, 1, min(fits, block_rows) if block_rows else fits)


def finish(df: DataFrame, keep_position: bool = False) -> DataFrame:
    """Drop halo copies and helper columns."""
    out = df.filter(~F.col(HALO)).drop(BLOCK, HALO)
    return out if keep_position else out.drop(POS)


def row_index(w: WindowSpec) -> Column:
    """0-based index of the row inside its block group (halo rows included)."""
    return F.row_number().over(w) - 1
