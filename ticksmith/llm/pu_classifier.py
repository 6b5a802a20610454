"""Quality classifier by positive-unlabelled learning.

Every text gets a fixed vector of surface statistics. A small network is
trained to minimise the non-negative unbiased risk

    pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)])

from trusted positives (label 1), unlabelled text (all rows but the held-out
ones, whatever their label) and the class prior ``pi``. Label 0 takes no part: it
only keeps a document that has both labels from counting as a trusted positive.

* Positives: at most ``max_positive`` rows, those with the smallest id hashes.
* Unlabelled text: every row. ``2^CELL_BITS`` cells, cut by random hyperplanes
  through the positives' centre, hold the count and the exact mean vector of
  their rows (one partial aggregate over integers); the risk over the
  unlabelled text is the weighted risk over the cells. What reaches the driver
  has a fixed size at any input, and no row is left out.
* Prior: a first network separates positives from the unlabelled text; over the
  cut-offs of its output, ``pi`` is the share of unlabelled rows above the cut
  divided by that of positives kept aside, at the cut where this plus its
  sampling error is least (a negative among the unlabelled rows above the cut
  can only raise the ratio).
* Score: ``pi * f_p(g) / f_u(g)``, the share of positives at the network's
  output ``g``, from histograms of all unlabelled rows and of the positives, made
  monotone by pooling neighbours; a thousandth of the score is the output itself, so
  that rows of one step keep their order.

Labels of held-out rows are never read; neither are those rows used as
unlabelled text. Labels, language, source and id are no inputs of a score.

Defined results: null and blank texts have the all-zero vector and get the
score the network gives it. Repeated rows score alike. Rows without an id
are not held out and never training rows. Null labels count as none. Without any positive training row every score is 0.
Extra columns are ignored. Vectors are one row per text; the label join is
on the id, so no key can be hot.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StructField

from ticksmith.llm.common import map_columns, stored

MAX_POSITIVE = 5_000
CELL_BITS = 12
BINS = 2_000
#: Sums of vector components are exact in these units.
UNIT = 2 ** 20
HIDDEN = 24
STEPS = 400
THRESHOLD = 0.7

MARKS = b"!?.,;:|#*$%&<>=\"'()-/@_+[]{}\\"


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def vector(text: str | None) -> np.ndarray:
    """Surface statistics of one text, each about 0 to 1."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return np.zeros(N_FEATURES, np.float32)
    n, w = len(raw), len(words)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    distinct = set(words)
    sizes = np.fromiter(map(len, words), np.int64, w)
    again = sum(map(bytes.__eq__, words, words[1:])) / w
    shout = sum(map(bytes.isupper, words)) / w
    title = sum(map(bytes.istitle, words)) / w
    plain = sum(map(bytes.isalpha, words)) / w
    lines = text.split("\n")
    used = [x for x in lines if x.strip()]
    pairs = len(set(zip(words, words[1:]))) / max(1, w - 1)
    rest = [
        by[48:58].sum(), by[65:91].sum(), by[97:123].sum(), by[128:].sum(), by[9:14].sum() + by[32],
        again, shout, title, plain, len(distinct) / w, pairs,
        min(1.0, np.log1p(w) / 10), min(1.0, float(sizes.mean()) / 20), min(1.0, float(sizes.std()) / 20),
        min(1.0, float(sizes.max()) / 100), min(1.0, 10 * len(used) / w),
        1 - len(set(used)) / max(1, len(used)), float((sizes <= 2).mean()), float((sizes >= 14).mean()),
        float(_ends(words)), min(1.0, 50 / w)]
    # shares of a mark matter at small sizes: square roots spread them
    return np.concatenate([np.sqrt(by[list(MARKS)]), rest]).astype(np.float32)


def _ends(words: list[bytes]) -> float:
    """Share of words that end in a mark other than a full stop or comma."""
    last = np.frombuffer(b"".join([x[-1:] for x in words]), np.uint8)
    return _ODD_END[last].mean()


_ODD_END = np.zeros(256, bool)
_ODD_END[list(b"!?;:|#*$%&<>=\"'()-/@_+[]{}\\")] = True
N_FEATURES = len(MARKS) + 21


def features(docs: DataFrame, text_col: str = "text", name: str = "vector") -> DataFrame:
    def fn(b: pa.RecordBatch) -> list[pa.Array]:
        texts = b.column(b.schema.get_field_index(text_col))
        flat = np.concatenate([vector(t.as_py()) for t in texts])
        return [pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, N_FEATURES), pa.int32()), pa.array(flat))]

    return map_columns(docs, [StructField(name, ArrayType(FloatType()))], fn)


@dataclass
class Model:
    """Standardisation, one hidden layer, and the share of positives by output."""

    mean: np.ndarray
    scale: np.ndarray
    theta: list[np.ndarray]
    steps: np.ndarray | None = None     # score at the middle of each bin

    def raw(self, x: np.ndarray) -> np.ndarray:
        return forward(self.theta, _standard(x, self.mean, self.scale))[1]

    def place(self, x: np.ndarray) -> np.ndarray:
        """The output on a scale from 0 to 1 (its bounds follow from the weights)."""
        most = np.abs(self.theta[2]).sum() + 1e-12
        return np.clip((self.raw(x) - self.theta[3][0]) / most, -1, 1) / 2 + 0.5

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.minimum((self.place(x) * BINS).astype(np.int64), BINS - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.place(x)
        middles = (np.arange(BINS) + 0.5) / BINS
        return 0.999 * np.interp(at, middles, self.steps) + 0.001 * at


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -6, 6)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -60, 60)))


def forward(theta: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ theta[0] + theta[1])
    return h, h @ theta[2] + theta[3][0]


def backward(theta: list[np.ndarray], x: np.ndarray, h: np.ndarray, dg: np.ndarray) -> list[np.ndarray]:
    dh = np.outer(dg, theta[2]) * (1 - h * h)
    return [x.T @ dh, dh.sum(0), h.T @ dg, np.array([dg.sum()])]


Slopes = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[float, np.ndarray, np.ndarray]]


def nn_risk(prior: float) -> Slopes:
    """The non-negative risk (sigmoid loss) and its slopes in the outputs of positives and unlabelled rows."""
    def of(gp: np.ndarray, gu: np.ndarray, wu: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        sp, su = _sigmoid(gp), _sigmoid(gu)  # the loss of y*g is 1 - sigmoid(y*g)
        positive, negative = prior * (1 - sp.mean()), wu @ su - prior * sp.mean()
        dp, du = prior * sp * (1 - sp) / len(gp), wu * su * (1 - su)
        if negative >= 0:
            return positive + negative, -2 * dp, du
        return positive, dp, -du  # the negative part went below zero: step back on it
    return of


def separation(gp: np.ndarray, gu: np.ndarray, wu: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss of telling positives from unlabelled rows."""
    sp, su = _sigmoid(gp), _sigmoid(gu)
    return float(-np.log(sp + 1e-300).mean() - wu @ np.log(1 - su + 1e-300)), -(1 - sp) / len(gp), wu * su


def train(pos: np.ndarray, unl: np.ndarray, weight: np.ndarray, slopes: Slopes, steps: int = STEPS,
          hidden: int = HIDDEN, seed: int = 7) -> Model:
    """Full-batch Adam; ``weight``: rows that each row of ``unl`` stands for."""
    rng = np.random.default_rng(seed)
    wu = weight / weight.sum()
    share = np.concatenate([np.full(len(pos), 0.5 / len(pos)), wu / 2])
    every = np.concatenate([pos, unl])
    mean = share @ every
    scale = np.sqrt(share @ (every - mean) ** 2) + 1e-3
    p, u = _standard(pos, mean, scale), _standard(unl, mean, scale)
    d = p.shape[1]
    theta = [rng.normal(0, d ** -0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        (hp, gp), (hu, gu) = forward(theta, p), forward(theta, u)
        _, dp, du = slopes(gp, gu, wu)
        grads = [a + b for a, b in zip(backward(theta, p, hp, dp), backward(theta, u, hu, du))]
        rate = 0.02 if step < steps * 0.7 else 0.004
        for k, g in enumerate(grads):
            g = g + 1e-4 * theta[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            theta[k] = theta[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, scale, theta)


def estimate_prior(aside: np.ndarray, unlabelled: np.ndarray) -> float:
    """Class prior from two histograms of outputs: positives not trained on, and all unlabelled rows."""
    n_p, n_u = aside.sum(), unlabelled.sum()
    above_p = np.cumsum(aside[::-1]) / n_p
    above_u = np.cumsum(unlabelled[::-1]) / n_u
    some = above_p > 0
    ratio = above_u[some] / above_p[some]
    error = (np.sqrt(np.log(40) / (2 * n_u)) + np.sqrt(np.log(40) / (2 * n_p))) / above_p[some]
    return float(np.clip(ratio[np.argmin(ratio + error)], 0.01, 0.99))


def share_of_positives(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """``prior * f_p / f_u`` per bin, not falling with the output, 0 to 1."""
    p, u = positive / positive.sum(), unlabelled / unlabelled.sum()
    blocks: list[list[float]] = []   # mass of positives, mass of unlabelled rows, bins
    for a, b in zip(p, u):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and (blocks[-2][1] == 0 and blocks[-2][0] == 0 or blocks[-1][0] + blocks[-1][1] == 0
                                   or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
    of = [min(1.0, prior * a / b) if b > 0 else 1.0 for a, b, _ in blocks]
    return np.repeat(of, [int(n) for *_, n in blocks])


def _vectors(rows: DataFrame) -> np.ndarray:
    got = rows.select("vector").toArrow().column("vector").combine_chunks()
    return got.flatten().to_numpy().astype(np.float64).reshape(-1, N_FEATURES)


def _batch(b: pa.RecordBatch) -> np.ndarray:
    return b.column(b.schema.get_field_index("vector")).flatten().to_numpy().reshape(-1, N_FEATURES)


def _cells(pool: DataFrame, pos: np.ndarray, bits: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector and number of rows of each cell; every row of ``pool`` is in one."""
    mean, scale = pos.mean(0), pos.std(0) + 1e-3
    planes = np.random.default_rng(seed).normal(0, 1, (N_FEATURES, bits))

    def fn(b: pa.RecordBatch) -> list[pa.Array]:
        side = _standard(_batch(b), mean, scale) @ planes > 0
        return [pa.array(side @ (1 << np.arange(bits)))]

    units = [F.sum(F.round(F.col("vector")[i].cast("double") * UNIT).cast("long")).alias(f"s{i}") for i in range(N_FEATURES)]
    got = map_columns(pool, [StructField("cell", LongType())], fn).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *units) \
        .orderBy("cell").toArrow()
    n = got.column("n").to_numpy().astype(np.float64)
    sums = np.stack([got.column(f"s{i}").to_numpy() for i in range(N_FEATURES)], 1) if len(n) else np.zeros((0, N_FEATURES))
    return sums / UNIT / np.maximum(n, 1)[:, None], n


def _histogram(pool: DataFrame, model: Model) -> np.ndarray:
    got = map_columns(pool, [StructField("bin", LongType())], lambda b: [pa.array(model.bin(_batch(b)))]) \
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most BINS rows
    out = np.zeros(BINS)
    out[got.column("bin").to_numpy()] = got.column("n").to_numpy()
    return out


def fit(pool: DataFrame, pos: np.ndarray, cell_bits: int = CELL_BITS) -> tuple[Model, float]:
    """The model and the class prior, from positive vectors and all unlabelled rows of ``pool``."""
    means, n = _cells(pool, pos, cell_bits)
    seen, aside = (pos[::2], pos[1::2]) if len(pos) > 1 else (pos, pos)
    first = train(seen, means, n, separation)
    prior = estimate_prior(np.bincount(first.bin(aside), minlength=BINS), _histogram(pool, first))
    model = train(pos, means, n, nn_risk(prior))
    model.steps = share_of_positives(np.bincount(model.bin(pos), minlength=BINS), _histogram(pool, model), prior)
    return model, prior


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", label_id_col: str = "doc_id", threshold: float = THRESHOLD,
             max_positive: int = MAX_POSITIVE, cell_bits: int = CELL_BITS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    rows = features(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text").drop("text")
    rows = stored(rows.withColumn("held_out", held_out("doc_id")), "vectors")
    # a document with several labels is trusted only if all of them are 1
    trusted = labels.select(F.col(label_id_col).alias("doc_id"), F.col(label_col).alias("label")) \
        .where(~held_out("doc_id")).groupBy("doc_id").agg(F.min("label").alias("label")).where("label = 1")
    pool = rows.where("not held_out and doc_id is not null").select("doc_id", "vector")
    pos = _vectors(pool.join(trusted, "doc_id", "left_semi")
                   .orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id", "vector").limit(max_positive))
    model = fit(pool, pos, cell_bits)[0] if len(pos) else None

    def fn(b: pa.RecordBatch) -> list[pa.Array]:
        x = _batch(b)
        return [pa.array(np.round(model.score(x), 9) if model else np.zeros(len(x)))]

    scored = map_columns(rows, [StructField("score", DoubleType())], fn)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
