"""Connected components of a distributed edge list (large star, small star).

No vertex's neighbours are ever gathered in one place: each round takes the
smallest neighbour with a partially aggregated minimum and joins it back, a
join whose large keys Spark may split. Rounds are written to the shared
folder and end when the edge list no longer changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticksmith.llm.common import stored


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``u, v`` (long) links to ``u, root``: each linked vertex but the roots, with the smallest vertex it reaches.

    Self-links, repeated links and nulls are ignored; no links, no rows.
    """
    e = edges.where("u is not null and v is not null and u <> v") \
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(e, "links")
    last = _digest(e)
    for _ in range(max_rounds):
        if not last[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored before the joins: between two plain tables Spark can split a large key
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        large = stored(large, "large-star")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v") \
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = stored(small, "links")
        now = _digest(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return e.select("u", F.col("v").alias("root"))
