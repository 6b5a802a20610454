"""Exponential moving average (pandas ``ewm(span, adjust=False)``) and MACD.

The recursion ``y0 = x0, y_t = a*x_t + q*y_(t-1)`` (``a = 2/(span+1)``,
``q = 1-a``) has no built-in window function. Within one block of rows it is

    y_j = l_j + q^(j+1) * carry,    l_j = q^j * sum_{i<=j} w_i * q^(-i),

with ``w_i = a*x_i`` (``w_0 = x_0`` where the series begins) and ``carry`` the
value at the end of the block before: a running ``sum`` window times a power,
native, no Python. It scales for any span:

* Carries are exact, not cut off. Fast, slow and signal EMA are one linear
  state: over a block it goes through one affine map (a lower triangular
  matrix, as the signal follows the other two). The maps come from weighted
  sums of the block's rows (no window), are composed in order, ``FAN`` at a
  time (an array of at most ``FAN`` elements per group), level by level until
  one group is left, and the results flow back down: one join for all EMAs.
  Only the last series of a block hands on a carry and only its first takes
  one, so there is one map per block however many series it holds.
* The powers stay finite. They are re-based in every block and centred: rows
  use ``q^-(i-c)`` and ``q^(j-c)`` with ``c = 600/|ln q|``, so every power
  lies in ``e^+-600`` for blocks of up to ``2c`` rows.

Blocks carry one halo row, which only tells whether their first series goes
on from the block before. Rows with a NULL, NaN or infinite input are left
out (pandas would decay across gaps instead).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ticksmith.operators import series

_MAX_EXPONENT = 600.0
J = "_j"
CONT = "_cont"
# Block summaries folded in one array.
FAN = 512


def alpha(span: float) -> float:
    if span < 1:
        raise ValueError("span must be >= 1")
    return 2.0 / (span + 1.0)


def _centre(q: float) -> int:
    """Exponent centre: powers ``q^(j-c)`` stay within ``e^+-600`` for ``j <= 2c``."""
    return int(_MAX_EXPONENT / -math.log(q))


def block_rows_for(spans: Sequence[float], cap: int = series.DEFAULT_BLOCK_ROWS) -> int:
    """Largest block that keeps every power finite."""
    qs = [1.0 - alpha(s) for s in spans if 1.0 - alpha(s) > 0.0]
    return min([cap, *(2 * _centre(q) for q in qs)])


def index_columns(w: WindowSpec, skip: str | None = None) -> dict[str, Column]:
    """``_j``: 0-based index among the block's own rows of a series; ``_cont``: it goes on from the block before.

    Rows flagged ``skip`` come first in their series and are no part of the recursion.
    """
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = F.col(series.HALO) if skip is None else F.col(series.HALO) | F.col(skip)
    before = F.col(series.HALO) if skip is None else F.col(series.HALO) & ~F.col(skip)
    return {J: F.sum(F.when(out, 0).otherwise(1)).over(running) - 1, CONT: F.max(before).over(running)}


def add_index(b: DataFrame, w: WindowSpec, skip: str | None = None) -> DataFrame:
    return b.withColumns(index_columns(w, skip))


def _first(x: Column, a: float, before: Column | None) -> Column:
    """What the first row of a series adds to its share ``a * x``, given the value ``before`` it (NULL: none)."""
    fresh = F.lit(1.0 - a) * x
    return fresh if before is None else F.coalesce(F.lit(1.0 - a) * before, fresh)


def _local(x: Column, span: float, w: WindowSpec, first: Column, skip: str | None = None) -> Column:
    """EMA within the block, without the carry; ``first``: what a series' first row adds."""
    a = alpha(span)
    q = 1.0 - a
    out = F.col(series.HALO) if skip is None else F.col(series.HALO) | F.col(skip)
    added = F.when((F.col(J) == 0) & ~F.col(CONT), first).otherwise(F.lit(0.0))
    weight = F.when(out, 0.0).otherwise(F.lit(a) * x + added)
    if q <= 0.0:
        return weight
    shifted = F.col(J) - F.lit(_centre(q))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(F.when(F.col(J) < 0, 0.0).otherwise(weight * F.pow(F.lit(q), -shifted))).over(running) \
        * F.pow(F.lit(q), shifted)


def _mixed(q1: float, q2: float, n: Column) -> Column:
    """sum of ``q1^i * q2^(n-1-i)`` over ``0 <= i < n``, without cancelling."""
    hi, lo = max(q1, q2), min(q1, q2)
    if lo == hi:
        return n * F.pow(F.lit(hi), n - 1)
    r = lo / hi
    return F.pow(F.lit(hi), n - 1) * (1.0 - F.pow(F.lit(r), n)) / (1.0 - r)


@dataclass
class States:
    """EMAs of ``src`` (``(span, out)`` each) and, if given, the EMA ``signal`` of the first minus the second."""
    src: str
    emas: list[tuple[float, str]]
    signal: tuple[float, str] | None = None
    before: dict[str, str] | None = None    # per output, a column with the value before the series' first row
    skip: str | None = None                 # flag of rows that are no part of the recursion

    @property
    def outs(self) -> list[str]:
        return [out for _, out in self.emas] + ([self.signal[1]] if self.signal else [])

    @property
    def qs(self) -> list[float]:
        return [1.0 - alpha(span) for span, _ in [*self.emas, *([self.signal] if self.signal else [])]]

    @property
    def links(self) -> list[tuple[int, int]]:
        """Places of the map's matrix that can differ from zero."""
        n = len(self.emas)
        return [(i, i) for i in range(len(self.qs))] + ([(n, 0), (n, 1)] if self.signal else [])

    def prior(self, out: str, of: Callable[[str], Column] = F.col) -> Column | None:
        return of(self.before[out]) if self.before and out in self.before else None

    def moved(self, carry: Callable[[int], Column], i: int, n: Column) -> Column:
        """What ``n`` rows leave of the carry in state ``i``."""
        qs = self.qs
        own = F.pow(F.lit(qs[i]), n) * carry(i)
        if (i, 0) not in self.links or i == 0:
            return own
        a, (f, s, g) = 1.0 - qs[i], qs
        return own + F.lit(a) * (F.lit(f) * _mixed(f, g, n) * carry(0) - F.lit(s) * _mixed(s, g, n) * carry(1))


def _maps(blk: series.Blocks, st: States) -> DataFrame:
    """``_blk, s0.., p00..`` of each block's last series (last state = s + p * carry), by weighted sums of its rows."""
    qs, k = st.qs, len(st.emas)
    rows = series.with_halo_blocks(blk.placed, 1, blk.rows)
    mine = ~F.col(series.HALO) if st.skip is None else ~F.col(series.HALO) & ~F.col(st.skip)
    end = (F.col(series.BLOCK) + 1) * blk.rows - 1
    x, left = F.col(st.src), end - F.col(series.POS)
    total = lambda weight: F.sum(F.when(mine, weight * x))
    sums = [F.coalesce(total(F.pow(F.lit(q), left)), F.lit(0.0)).alias(f"t{i}") for i, q in enumerate(qs[:k])]
    if st.signal:
        sums += [F.coalesce(total(_mixed(qs[i], qs[k], left + 1)), F.lit(0.0)).alias(f"m{i}") for i in (0, 1)]
    priors = [F.col(c) for c in (st.before or {}).values()]
    place = F.when(mine, F.col(series.POS))
    agg = rows.groupBy(*blk.keys, series.BLOCK).agg(
        F.max(F.col(series.HALO) & (F.lit(True) if st.skip is None else ~F.col(st.skip))).alias("cont"),
        F.max(F.when(~F.col(series.HALO), F.col(series.POS))).alias("last"), F.min(place).alias("first"),
        F.min_by(F.struct(x.alias("x"), *priors), place).alias("f"), *sums)
    agg = agg.where(F.col("last") == end)
    n = end - F.col("first") + 1
    fresh = ~F.col("cont") & F.col("first").isNotNull()
    add = [F.when(fresh, _first(F.col("f.x"), 1.0 - q, st.prior(out, lambda c: F.col(f"f.{c}")))).otherwise(0.0)
           for q, (_, out) in zip(qs, st.emas)]
    state = [F.lit(1.0 - q) * F.col(f"t{i}") + F.when(fresh, F.pow(F.lit(q), n - 1) * add[i]).otherwise(0.0)
             for i, q in enumerate(qs[:k])]
    if st.signal:
        g = qs[k]
        part = [F.lit(1.0 - qs[i]) * F.col(f"m{i}") + F.when(fresh, _mixed(qs[i], g, n) * add[i]).otherwise(0.0) for i in (0, 1)]
        prior = st.prior(st.signal[1], lambda c: F.col(f"f.{c}"))
        extra = F.lit(0.0) if prior is None else F.when(fresh, F.pow(F.lit(g), n) * F.coalesce(prior, F.lit(0.0))).otherwise(0.0)
        state.append(F.lit(1.0 - g) * (part[0] - part[1]) + extra)
    unit = lambda j: lambda i: F.lit(1.0 if i == j else 0.0)
    return agg.select(series.BLOCK, *[s.alias(f"s{i}") for i, s in enumerate(state)], *[
        F.when(F.col("cont"), st.moved(unit(j), i, n)).otherwise(0.0).alias(f"p{i}{j}") for i, j in st.links])


def _carries(maps: DataFrame, st: States, blocks: int) -> DataFrame:
    """``_blk, _c0..``: the state handed to each block but the first, composing the maps in order.

    Each map's result is booked on the block after it, so the last block, which need not be full, needs no map.
    """
    ids, links = range(len(st.qs)), st.links
    names = [f"s{i}" for i in ids] + [f"p{i}{j}" for i, j in links]
    groups = maps.groupBy((F.expr(f"{series.BLOCK} div {FAN}")).alias("_grp")) \
        .agg(F.sort_array(F.collect_list(F.struct(F.col(series.BLOCK).alias("b"), *names))).alias("a"))
    kind = "array<struct<b:bigint," + ",".join(f"{c}:double" for c in names) + ">>"

    def state(after: Column, at: dict[str, Column]) -> Column:
        return F.struct(after.alias("after"), *[at[c].alias(c) for c in names])

    def then(acc: Column, e: Column) -> dict[str, Column]:
        at = {f"s{i}": sum((e[f"p{i}{j}"] * acc[f"s{j}"] for a, j in links if a == i), e[f"s{i}"]) for i in ids}
        at |= {f"p{i}{j}": sum((e[f"p{i}{m}"] * acc[f"p{m}{j}"] for a, m in links if a == i and (m, j) in links), F.lit(0.0))
               for i, j in links}
        return at

    def step(acc: Column, e: Column) -> Column:
        now = then(acc, e)
        here = F.struct((e["b"] + 1).alias("b"), *[now[c].alias(c) for c in names])
        return state(F.concat(acc["after"], F.array(here)), now)

    start = state(F.array().cast(kind), {c: F.lit(1.0 if c[0] == "p" and c[1] == c[2] else 0.0) for c in names})
    folded = groups.select("_grp", F.aggregate("a", start, step).alias("f"))
    rows = folded.select("_grp", F.explode("f.after").alias("e"))
    if blocks <= FAN:
        return rows.select(F.col("e.b").alias(series.BLOCK), *[F.col(f"e.s{i}").alias(f"_c{i}") for i in ids])
    up = folded.select(F.col("_grp").alias(series.BLOCK), *[F.col(f"f.{c}").alias(c) for c in names])
    above = _carries(up, st, -(-blocks // FAN)).withColumnRenamed(series.BLOCK, "_grp")
    given = lambda j: F.coalesce(F.col(f"_c{j}"), F.lit(0.0))
    return rows.join(above, "_grp", "left").select(F.col("e.b").alias(series.BLOCK), *[
        sum((F.col(f"e.p{i}{j}") * given(j) for a, j in links if a == i), F.col(f"e.s{i}")).alias(f"_c{i}") for i in ids])


def local_columns(w: WindowSpec, st: States) -> dict[str, Column]:
    """The EMAs but the signal within each block; one window step, with any others on the same frame."""
    x = F.col(st.src)
    return {out: _local(x, span, w, _first(x, alpha(span), st.prior(out)), st.skip) for span, out in st.emas}


def _add_signal(b: DataFrame, w: WindowSpec, st: States) -> DataFrame:
    if not st.signal:
        return b
    span, out = st.signal
    line, q = F.col(st.emas[0][1]) - F.col(st.emas[1][1]), 1.0 - alpha(span)
    prior = st.prior(out)
    # the first line value is the first signal: zero, unless the series goes on
    first = F.lit(0.0) if prior is None else F.coalesce(F.lit(q) * prior, F.lit(0.0))
    return b.withColumn(out, _local(line, span, w, first, st.skip))


def add_states(b: DataFrame, blk: series.Blocks, st: States, has_local: bool = False) -> DataFrame:
    """The EMAs of ``st`` on a blocked frame with ``add_index``: one join for all of them.

    ``b`` may have more columns than ``blk.frame``, from other window steps,
    ``local_columns`` (``has_local``) among them.
    """
    b = _add_signal(b if has_local else b.withColumns(local_columns(blk.window, st)), blk.window, st)
    ids = range(len(st.qs))
    both = b.join(_carries(_maps(blk, st), st, blk.count), series.BLOCK, "left")
    n = F.col(J) + 1
    given = lambda i: F.coalesce(F.col(f"_c{i}"), F.lit(0.0))
    return both.withColumns({out: F.when(F.col(CONT), F.col(out) + st.moved(given, i, n)).otherwise(F.col(out))
                             for i, out in enumerate(st.outs)}).drop(*[f"_c{i}" for i in ids])


def macd_states(src: str, fast: float = 12, slow: float = 26, signal: float = 9,
                names: Sequence[str] = ("EMA_12", "EMA_26", "MACD", "MACD_signal", "MACD_hist"), **how) -> States:
    return States(src, [(fast, names[0]), (slow, names[1])], (signal, names[3]), **how)


def with_line(b: DataFrame, names: Sequence[str]) -> DataFrame:
    e_fast, e_slow, line, sig, hist = names
    kept = [c for c in b.columns if c not in names]
    line_of, sig_of = F.col(e_fast) - F.col(e_slow), F.col(sig)
    return b.select(*kept, e_fast, e_slow, line_of.alias(line), sig_of.alias(sig), (line_of - sig_of).alias(hist))


def add_macd(b: DataFrame, blk: series.Blocks, src: str, fast: float = 12, slow: float = 26, signal: float = 9,
             names: Sequence[str] = ("EMA_12", "EMA_26", "MACD", "MACD_signal", "MACD_hist"), **how) -> DataFrame:
    return with_line(add_states(b, blk, macd_states(src, fast, slow, signal, names, **how)), names)


def macd_of_whole(df: DataFrame, w: WindowSpec, src: str, fast: float = 12, slow: float = 26, signal: float = 9,
                  names: Sequence[str] = ("EMA_12", "EMA_26", "MACD", "MACD_signal", "MACD_hist")) -> DataFrame:
    """MACD of series short enough to be one block each (``block_rows_for``); needs ``_j``, ``_cont``, ``_halo``."""
    st = macd_states(src, fast, slow, signal, names)
    return with_line(_add_signal(df.withColumns(local_columns(w, st)), w, st), names)


# ---------------------------------------------------------------- public API

def _prepared(df: DataFrame, price: str) -> DataFrame:
    return series.finite(df, price).where(F.col(price).isNotNull())


def _run(df: DataFrame, spans: Sequence[float], price: str, keys, order, step, block_rows: int | None = None) -> DataFrame:
    limit = min(block_rows_for(spans), block_rows or series.DEFAULT_BLOCK_ROWS)
    blk = series.blocks(_prepared(df, price), keys, order, 1, limit)
    return series.finish(step(add_index(blk.frame, blk.window), blk).drop(J, CONT))


def ema(df: DataFrame, span: float, price: str = "price", out: str | None = None,
        keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"),
        block_rows: int | None = None) -> DataFrame:
    out = out or f"ema_{int(span) if float(span).is_integer() else span}"
    return _run(df, [span], price, keys, order, lambda b, blk: add_states(b, blk, States(price, [(span, out)])), block_rows)


def macd(df: DataFrame, price: str = "price", fast: float = 12, slow: float = 26,
         signal: float = 9, keys: Sequence[str] = ("symbol",),
         order: Sequence[str] = ("ts", "seq"),
         names: Sequence[str] = ("EMA_12", "EMA_26", "MACD", "MACD_signal", "MACD_hist"),
         block_rows: int | None = None) -> DataFrame:
    return _run(df, [fast, slow, signal], price, keys, order,
                lambda b, blk: add_macd(b, blk, price, fast, slow, signal, names), block_rows)
