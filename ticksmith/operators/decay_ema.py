"""EMA and MACD that decay across missing prices (pandas ``ewm(span, adjust=False)`` with NaN in the column).

A row without a price repeats the value before it, but its time passes: after a
gap the older value has less weight. With ``q = 1 - a`` and ``g`` the rows since
the last price,

    y = (1 - p) * x + p * y_last,    p = q^g / (q^g + a),

so every priced row is an affine map with a coefficient of its own (``p = q``
without a gap). Within one block of rows (``series``), from its first price
``x_f`` on, ``y_j = Q_j * y_f + R_j`` with ``Q_j`` the product of the ``p`` after
``f`` and ``R_j = Q_j * sum (1 - p_i) x_i / Q_i``: running sums, native. Products
are kept as logarithms, re-based per block and centred, so every power lies in
``e^+-600`` (a row costs at most ``|ln q|``, however the gaps lie in the block).

Only ``y_f`` depends on what came before: on the value carried in and on the
place of the last price, which may lie any number of rows back. A block hands on
the map ``(f, x_f, Q, R, last place)``; two such maps make one again, as the gap
between them is known, so they are composed ``FAN`` at a time, level by level,
and joined back by block. Blocks are written once, so each window runs once, and
the map of a block is read off its last row without an aggregate. Several spans
share the blocks, the window steps and the join.

The signal of a MACD is a plain EMA of the line, which has a value in every row
from the first price on: it moves on through a gap. It takes the linear scan of
``ema`` over the same blocks.

Defined results: NULL, NaN and infinite prices are missing; rows before a series'
first price are NULL; an empty table gives an empty one; a NULL key is a series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticksmith.operators import ema, series
from ticksmith.operators.ema import FAN, alpha, block_rows_for
from ticksmith.session import scratch_path

_CENTRE = 600.0
_CONT, _FIRST, _X, _LAST, _PREV, _LN, _Q, _R = "_cont", "_first", "_x", "_last", "_prev", "_ln", "_q", "_r"
_MAP = "struct<fresh:boolean,f:bigint,x:double,q:double,r:double,l:bigint>"
_FIELDS = ("fresh", "f", "x", "q", "r", "l")
_NONE = "_none"


def _kept(q: float, gap: Column) -> Column:
    """Share of the older value when a price comes ``gap`` rows after the last one."""
    left = F.pow(F.lit(q), gap)
    return left / (left + F.lit(1.0 - q))


def _ln_kept(q: float, gap: Column) -> Column:
    """``ln`` of ``_kept``, also where the power itself is too small for a double."""
    return gap * F.lit(math.log(q)) - F.ln(F.pow(F.lit(q), gap) + F.lit(1.0 - q))


def _local(blk: series.Blocks, price: str, qs: Sequence[float]) -> DataFrame:
    """The blocked rows with ``_q0, _r0, ..`` (value = ``_q`` * value at the block's first price + ``_r``)."""
    w = blk.window
    run, past = (w.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, -1))
    x = F.when(~F.col(series.HALO), F.col(price))
    at = F.when(x.isNotNull(), F.col(series.POS))
    b = blk.frame.withColumns({
        _CONT: F.max(series.HALO).over(run), _FIRST: F.first(at, True).over(run), _X: F.first(x, True).over(run),
        _LAST: F.last(at, True).over(run), _PREV: F.last(at, True).over(past)})
    gap = F.when(x.isNotNull(), F.col(series.POS) - F.col(_PREV))  # NULL: no price, or the block's first
    decays = [(i, q) for i, q in enumerate(qs) if q > 0.0]
    lns = {f"{_LN}{i}": F.sum(F.coalesce(_ln_kept(q, gap), F.lit(0.0))).over(run) for i, q in decays}
    b = b.withColumns(lns)
    parts = {}
    for i, q in decays:
        ln = F.col(f"{_LN}{i}")
        added = (F.lit(1.0) - _kept(q, gap)) * F.col(price) * F.exp(-ln - F.lit(_CENTRE))
        total = F.sum(F.coalesce(added, F.lit(0.0))).over(run)
        parts |= {f"{_Q}{i}": F.exp(ln), f"{_R}{i}": total * F.exp(ln + F.lit(_CENTRE))}
    for i in set(range(len(qs))) - {i for i, _ in decays}:  # span 1: the newest price
        again, newest = F.col(_LAST) > F.col(_FIRST), F.last(x, True).over(run)
        parts |= {f"{_Q}{i}": F.when(again, 0.0).otherwise(1.0), f"{_R}{i}": F.when(again, newest).otherwise(0.0)}
    return b.withColumns(parts).drop(_PREV, *lns)


def _struct(**of: Column) -> Column:
    return F.struct(*[of[c].alias(c) for c in _FIELDS]).cast(_MAP)


def _then(a: Column, b: Column, q: float) -> Column:
    """The map ``a`` followed by ``b``."""
    p = _kept(q, b["f"] - a["l"])
    both = _struct(fresh=a["fresh"], f=a["f"], x=a["x"], q=b["q"] * p * a["q"],
                   r=b["q"] * (p * a["r"] + (F.lit(1.0) - p) * b["x"]) + b["r"], l=b["l"])
    alone = _struct(fresh=a["fresh"], **{c: b[c] for c in _FIELDS[1:]})
    return F.when(b["fresh"], b).when(b["f"].isNull(), a).when(a["f"].isNull(), alone).otherwise(both)


def _carries(maps: DataFrame, q: float, blocks: int) -> DataFrame:
    """``_blk, m``: what all blocks before a block make of an empty start, as one map."""
    groups = maps.groupBy(F.expr(f"{series.BLOCK} div {FAN}").alias("_grp")) \
        .agg(F.sort_array(F.collect_list(F.struct(F.col(series.BLOCK).alias("b"), "m"))).alias("a"))
    kind = f"struct<after:array<struct<b:bigint,m:{_MAP}>>,m:{_MAP}>"
    same = _struct(fresh=F.lit(False), f=F.lit(None), x=F.lit(None), q=F.lit(1.0), r=F.lit(0.0), l=F.lit(None))

    def step(acc: Column, e: Column) -> Column:
        now = _then(acc["m"], e["m"], q)
        return F.struct(F.concat(acc["after"], F.array(F.struct((e["b"] + 1).alias("b"), now.alias("m")))).alias("after"),
                        now.alias("m")).cast(kind)

    folded = groups.select("_grp", F.aggregate("a", F.struct(F.array().alias("after"), same.alias("m")).cast(kind), step).alias("s"))
    rows = folded.select("_grp", F.explode("s.after").alias("e"))
    if blocks <= FAN:
        return rows.select(F.col("e.b").alias(series.BLOCK), F.col("e.m").alias("m"))
    above = _carries(folded.select(F.col("_grp").alias(series.BLOCK), F.col("s.m").alias("m")), q, -(-blocks // FAN)) \
        .select(F.col(series.BLOCK).alias("_grp"), F.col("m").alias("up"))
    whole = F.when(F.col("up").isNull(), F.col("e.m")).otherwise(_then(F.col("up"), F.col("e.m"), q))
    return rows.join(above, "_grp", "left").select(F.col("e.b").alias(series.BLOCK), whole.alias("m"))


def _decayed(blk: series.Blocks, price: str, emas: Sequence[tuple[float, str]]) -> DataFrame:
    """The blocked rows, without halo copies, with the EMA of every ``(span, out)``."""
    spark = blk.frame.sparkSession
    qs = [1.0 - alpha(span) for span, _ in emas]
    path = scratch_path(spark, "decay-blocks")
    _local(blk, price, qs).where(~F.col(series.HALO)).write.mode("overwrite").parquet(path)
    both = spark.read.parquet(path)
    ends = both.where(F.col(series.POS) == (F.col(series.BLOCK) + 1) * blk.rows - 1)
    given: DataFrame | None = None
    for i, q in enumerate(qs):
        maps = ends.select(series.BLOCK, _struct(fresh=~F.col(_CONT), f=F.col(_FIRST), x=F.col(_X), q=F.col(f"{_Q}{i}"),
                                                 r=F.col(f"{_R}{i}"), l=F.col(_LAST)).alias("m"))
        one = _carries(maps, q, blk.count).select(
            series.BLOCK, (F.col("m.q") * F.col("m.x") + F.col("m.r")).alias(f"_carry{i}"), F.col("m.l").alias(f"_place{i}"))
        given = one if given is None else given.join(one, series.BLOCK)
    rows = both.join(given, series.BLOCK, "left")
    values = {}
    for i, (q, (_, out)) in enumerate(zip(qs, emas)):
        carry = F.when(F.col(_CONT), F.col(f"_carry{i}"))
        p = _kept(q, F.col(_FIRST) - F.col(f"_place{i}"))
        first = F.when(carry.isNull(), F.col(_X)).otherwise(p * carry + (F.lit(1.0) - p) * F.col(_X))
        values[out] = F.when(F.col(_FIRST).isNull(), carry).otherwise(F.col(f"{_Q}{i}") * first + F.col(f"{_R}{i}"))
    return rows.withColumns(values).drop(_CONT, _FIRST, _X, _LAST, *[f"{c}{i}" for i in range(len(qs))
                                                                     for c in (_Q, _R, "_carry", "_place")])


def decayed_ema(df: DataFrame, span: float, price: str = "price", out: str | None = None,
                keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"),
                block_rows: int | None = None) -> DataFrame:
    """``df`` with the EMA of ``price``; every row is kept, those without a price repeat the last value."""
    out = out or f"ema_{int(span) if float(span).is_integer() else span}"
    limit = min(block_rows_for([span]), block_rows or series.DEFAULT_BLOCK_ROWS)
    blk = series.blocks(series.finite(df, price), keys, order, 1, limit)
    return series.finish(_decayed(blk, price, [(span, out)]))


def decayed_macd(df: DataFrame, price: str = "price", fast: float = 12, slow: float = 26, signal: float = 9,
                 keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"),
                 names: Sequence[str] = ("EMA_12", "EMA_26", "MACD", "MACD_signal", "MACD_hist"),
                 block_rows: int | None = None) -> DataFrame:
    """``df`` with MACD of ``price``, every row kept: EMAs and line hold still in a gap, the signal moves on to the line."""
    limit = min(block_rows_for([fast, slow, signal]), block_rows or series.DEFAULT_BLOCK_ROWS)
    src = series.finite(df, price)
    n = series.range_partitions(src)
    blk = series.blocks(src, keys, order, 1, limit, n)
    e_fast, e_slow, line, sig, hist = names
    valued = _decayed(blk, price, [(fast, e_fast), (slow, e_slow)]).drop(series.BLOCK, series.HALO) \
        .withColumn(line, F.col(e_fast) - F.col(e_slow)).withColumn(_NONE, F.col(line).isNull())
    path = scratch_path(df.sparkSession, "decay-line")  # read by the blocks and by their maps
    valued.write.mode("overwrite").parquet(path)
    placed = df.sparkSession.read.parquet(path)
    cut = series.with_halo_blocks(placed, 1, blk.rows).repartition(n, series.BLOCK)
    again = series.Blocks(cut, blk.window, placed, blk.keys, blk.rows, blk.count)
    states = ema.States(line, [(signal, sig)], skip=_NONE)
    b = ema.add_states(ema.add_index(again.frame, again.window, _NONE), again, states)
    b = b.withColumn(sig, F.when(~F.col(_NONE), F.col(sig)))
    return series.finish(b.withColumn(hist, F.col(line) - F.col(sig))).drop(ema.J, ema.CONT, _NONE)
