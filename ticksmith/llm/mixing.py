"""Mixing sources to target weights by Poisson replication (native Spark only).

The repetition rate of a source is its target share of all characters over
its present share. Each document gets a Poisson count with that mean, drawn
by inverting the distribution at a uniform number hashed from the seed and
the document id, so the draw needs no shared state and any rerun repeats it.
Documents are exploded by their count and shuffled globally by a second hash.

A mean above ``PIECE`` is the sum of equal smaller Poisson means, each with
its own hash, so the tabulated distribution stays short for any rate.

Defined results: rows without a source are a source of their own; a source
without any character gets rate zero; targets for absent sources are spread
over the others in proportion; sources missing from given targets get rate
zero. Repeated rows draw alike (same id, same hash); rows without an id
share one draw. Null texts count as empty. Extra columns are carried;
clashing names get underscores added.

The rates are one row per source: written to the shared folder first, so
that Spark knows their size and broadcasts them only below its threshold;
beyond it the join shuffles and large sources are split by Spark's skew
handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticksmith.llm.common import free_name, stored

SEED = 20240
#: Target share ~ (present share) ** TEMPERATURE when no targets are given.
TEMPERATURE = 0.5
#: Largest mean inverted at once, and the places of its table (the tail beyond is below 2**-53).
PIECE = 16
PLACES = 96


def _source_key(col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(col).cast("string")), F.lit("n"))


def _hashed(*parts) -> Column:
    """52 uniform bits as a long."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def rates(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE,
          source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``source_key, rate``: how often a document of the source is to appear on average."""
    sizes = docs.groupBy(_source_key(source_col).alias("source_key")).agg(
        F.sum(F.coalesce(F.length(text_col), F.lit(0))).alias("chars")).where("chars > 0")
    if targets is None:
        weight = F.pow("chars", F.lit(temperature))
    else:
        pairs = [x for k, v in targets.items() for x in (F.lit(f"s{k}"), F.lit(float(v)))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("source_key")], F.lit(0.0)) if pairs else F.lit(0.0)
    sizes = stored(sizes.withColumn("weight", weight), "source-sizes")
    total, weights = sizes.agg(F.sum("chars"), F.sum("weight")).first()  # two numbers
    share = F.try_divide(F.col("weight"), F.lit(float(weights or 0)))
    rate = F.try_divide(share * F.lit(float(total or 0)), F.col("chars"))
    return sizes.select("source_key", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def _with_table(rate: DataFrame) -> DataFrame:
    """``pieces`` and the cumulative distribution ``cdf`` of each piece."""
    pieces = F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int")
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(PLACES - 1)),
        F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf")),
        lambda acc, i: F.struct(
            (acc["p"] * F.col("mean") / i).alias("p"),
            F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * F.col("mean") / i)).alias("cdf")),
        lambda acc: acc["cdf"])
    return rate.withColumn("pieces", pieces).withColumn("mean", F.col("rate") / F.col("pieces")) \
        .withColumn("cdf", step).select("source_key", "pieces", "cdf")


def _name(id_col: str, text_col: str) -> Column:
    """What a row draws by: its id, or its text if it has none."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))


def copies(doc: Column, seed: int) -> Column:
    """Poisson count of the row named ``doc``, joined with its source's ``pieces`` and ``cdf``."""

    def one(j: Column) -> Column:
        u = (_hashed(seed, doc, j.cast("string")).cast("double") + 0.5) / F.lit(float(2**52))
        return F.get(F.transform(F.array(u), lambda x: F.size(F.filter("cdf", lambda c: c < x))), F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), F.col("pieces")), F.lit(0), lambda acc, j: acc + one(j))


def mix(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE,
        seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``copy`` (from 1) and ``shuffle_key``, in shuffled order."""
    copy, order = free_name(docs, "copy"), free_name(docs, "shuffle_key")
    spread = stored(_with_table(rates(docs, targets, temperature, source_col, text_col)), "source-rates")
    key = "source_key"
    plain = [F.col(c).alias(f"in_{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*plain, _source_key(source_col).alias(key)).join(spread, key)
    doc = _name(f"in_{docs.columns.index(id_col)}", f"in_{docs.columns.index(text_col)}")
    back = [F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)]
    out = rows.withColumn("n", copies(doc, seed)).where("n > 0") \
        .select(*back, F.explode(F.sequence(F.lit(1), F.col("n"))).alias(copy))
    shuffled = out.withColumn(order, _hashed(seed, "order", _name(id_col, text_col), F.col(copy).cast("string")))
    return shuffled.repartition(F.col(order)).sortWithinPartitions(order)
