"""Exact top-k inner-product search by multi-resolution segment statistics.

Vectors become integer codes. A vector cut into segments of length l has a
mean m and a deviation s per segment; for two vectors

    distance^2 >= sum l * ((m - m')^2 + (s - s')^2),

and, as score = (|x|^2 + |y|^2 - distance^2) / 2, the score is at most
sum l * (m * m' + s * s'). A task holds one block of queries and one block
of candidates. From coarse (1 segment) to fine (16) it drops candidates whose
bound is below the k-th best exact score already known, and computes exact
scores for the survivors only. The blocks' best are merged by a window with
a group limit.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do rows without an id. Shorter vectors count as filled up
with zeros (an empty one scores 0). Repeated rows are separate rows: each is
a query of its own and a candidate of the others. Ties go to the smaller
candidate id, then to any. Scores beyond a long are clamped to its ends.
Extra columns are ignored.

Every query meets every candidate block, so work grows with queries times
candidates; both sides move in blocks of fixed size, dealt by a hash, and no
side is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ticksmith.llm.common import stored

SCALE = 64
LEVELS = (1, 4, 16)
CANDIDATE_ROWS = 4096
QUERY_ROWS = 4096
#: Queries whose bounds are held at once.
SLICE = 256
_LONG = 2**63


def usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _codes(vectors: pa.Array, scale: int, width: int) -> np.ndarray:
    """Codes, one row per vector, as exact floats or (if too large) Python integers."""
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    n = np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        coded = np.floor(scale * flat)
    out[row, col] = coded
    if np.isinf(coded).any() or (len(coded) and np.abs(coded).max() ** 2 * max(width, 1) >= 2**53):
        exact = np.zeros((len(n), width), object)
        exact[row, col] = [int(x.__floor__()) for x in (int(scale) * _fraction(v) for v in flat)]
        return exact
    return out


def _fraction(x: float):
    from fractions import Fraction
    return Fraction(x)


def features(codes: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(l) * mean and sqrt(l) * deviation per segment; their inner product bounds the score."""
    n, d = codes.shape
    edges = [d * i // segments for i in range(segments + 1)]
    cols = []
    for a, b in zip(edges, edges[1:]):
        if b > a:
            part = codes[:, a:b]
            cols += [part.mean(1) * (b - a) ** 0.5, part.std(1) * (b - a) ** 0.5]
    return np.stack(cols, 1) if cols else np.zeros((n, 1))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to smaller ids; -inf is none."""
    at = np.flatnonzero(scores != -np.inf)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search_block(q: np.ndarray, q_uid: np.ndarray, c: np.ndarray, c_uid: np.ndarray, c_id: np.ndarray,
                 k: int) -> tuple[list, list, list]:
    """Query place, candidate place and score of each query's best ``k`` in the block."""
    qs: list[int] = []
    cs: list[int] = []
    ss: list[int] = []
    if q.dtype == object or c.dtype == object:
        # codes too large for exact floats: plain integer arithmetic, no bounds
        q, c = q.astype(object), c.astype(object)
        for i in range(len(q)):
            scores = [sum(a * b for a, b in zip(q[i], row)) for row in c]
            order = sorted((j for j in range(len(c)) if c_uid[j] != q_uid[i]), key=lambda j: (-scores[j], c_id[j]))[:k]
            qs += [i] * len(order)
            cs += order
            ss += [max(-_LONG, min(_LONG - 1, scores[j])) for j in order]
        return qs, cs, ss
    bounds_c = [features(c, s) for s in LEVELS]
    norm_c = np.sqrt((c * c).sum(1))
    for lo in range(0, len(q), SLICE):
        part = q[lo:lo + SLICE]
        rows = np.arange(len(part))
        own = q_uid[lo:lo + SLICE, None] == c_uid[None, :]
        slack = 1e-9 * np.sqrt((part * part).sum(1))[:, None] * norm_c[None, :] + 1e-6
        cols = np.arange(len(c))
        alive = ~own
        floor = np.full(len(part), -np.inf)
        for level, fc in zip(LEVELS, bounds_c):
            bound = features(part, level) @ fc[cols].T + slack[:, cols]
            bound[~alive] = -np.inf
            if level == LEVELS[0] and len(cols) > k:
                # exact scores of the most promising give the first k-th best
                top = np.argpartition(bound, len(cols) - k, axis=1)[:, -k:]
                got = np.einsum("qd,qkd->qk", part, c[cols[top]])
                got[~alive[rows[:, None], top]] = -np.inf
                floor = got.min(1)
            alive &= bound >= floor[:, None]
            some = alive.any(0)
            cols, alive = cols[some], alive[:, some]
        scores = part @ c[cols].T
        scores[~alive] = -np.inf
        for i in rows:
            at = _best(scores[i], c_id[cols], k)
            qs += [lo + int(i)] * len(at)
            cs += cols[at].tolist()
            ss += scores[i, at].astype(np.int64).tolist()
    return qs, cs, ss


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = SCALE, candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best candidates of each query row."""
    rows = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"),
        F.coalesce(is_query, F.lit(False)).alias("asks")).withColumn("uid", F.monotonically_increasing_id())
    rows = stored(rows, "vectors")
    n, asked, width = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("vec"))).first()
    c_blocks, q_blocks = max(1, -(-n // candidate_rows)), max(1, -(-asked // query_rows))
    width = width or 0

    def block(blocks: int, salt: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "uid"), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    asks = rows.where("asks").select("vec_id", "uid", "vec", block(q_blocks, 1).alias("qb"), every(c_blocks).alias("cb"))
    cands = rows.select("vec_id", "uid", "vec", block(c_blocks, 2).alias("cb"), every(q_blocks).alias("qb"))
    schema = StructType([StructField(c, LongType()) for c in ("quid", "query_id", "vec_id", "score")])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.combine_chunks(), b.combine_chunks()

        def side(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            vec = t.column("vec").combine_chunks()
            if isinstance(vec, pa.ChunkedArray):
                vec = pa.concat_arrays(vec.chunks) if vec.num_chunks else pa.array([], pa.list_(pa.float64()))
            return _codes(vec, scale, width), t.column("uid").to_numpy(), t.column("vec_id").to_numpy()

        (q, q_uid, q_id), (c, c_uid, c_id) = side(a), side(b)
        qs, cs, ss = search_block(q, q_uid, c, c_uid, c_id, k) if len(q) and len(c) else ([], [], [])
        return pa.table({"quid": q_uid[qs], "query_id": q_id[qs], "vec_id": c_id[cs], "score": np.array(ss, np.int64)}
                        if qs else {n: np.zeros(0, np.int64) for n in schema.names})

    met = asks.groupBy("qb", "cb").cogroup(cands.groupBy("qb", "cb")).applyInArrow(meet, schema)
    order = Window.partitionBy("quid").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast(IntegerType()).alias("rank"), "vec_id", "score")
