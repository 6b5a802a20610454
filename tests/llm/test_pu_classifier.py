import random
import zlib

import numpy as np
from fixtures_llm import docs, empty, prose

from ticksmith.llm import pu_classifier as P


def tables(spark, n=600):
    rng = random.Random(6)
    data, marks = [], []
    for i in range(n):
        good = rng.random() < 0.8
        text = prose(rng, rng.randint(30, 90)) if good else " ".join(w + "###" for w in prose(rng, 60).upper().split())
        data.append((i, text))
        if rng.random() < 0.6:
            marks.append((i, int(good)))
    return (spark.createDataFrame(data + [(9001, None), (9002, "")], "doc_id long, text string"),
            spark.createDataFrame(marks, "doc_id long, quality int"))


def test_held_out_accuracy_and_fold(spark):
    df, labels = tables(spark)
    got = {r.doc_id: r for r in P.classify(df, labels).collect()}
    assert len(got) == 602
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_held_out_labels_are_not_read(spark):
    from pyspark.sql import functions as F
    df, labels = tables(spark, 200)
    flipped = labels.withColumn("quality", F.when(P.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = sorted(map(tuple, P.classify(df, labels).collect()))
    assert a == sorted(map(tuple, P.classify(df, flipped).collect()))


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    only = spark.createDataFrame([(0, 1), (1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    df = docs(spark, extra=["score", "vector", "label"])
    assert {r.score for r in P.classify(df, none).collect()} == {0.0}
    assert P.classify(df, only).count() == df.count()
    assert P.classify(empty(spark), only).count() == 0


def test_risk_slopes_match_numeric_ones():
    rng = np.random.default_rng(3)
    p, u, wu = rng.normal(0.4, 1, (15, 6)), rng.normal(0, 1, (25, 6)), rng.random(25)
    wu /= wu.sum()
    theta = [rng.normal(0, 0.5, (6, 4)), rng.normal(0, 0.1, 4), rng.normal(0, 0.5, 4), np.array([0.1])]
    for slopes in (P.nn_risk(0.3), P.separation):
        (hp, gp), (hu, gu) = P.forward(theta, p), P.forward(theta, u)
        _, dp, du = slopes(gp, gu, wu)
        grads = [a + b for a, b in zip(P.backward(theta, p, hp, dp), P.backward(theta, u, hu, du))]
        for t, g in zip(theta, grads):
            for at in np.ndindex(t.shape):
                old, e, v = t[at], 1e-6, []
                for x in (old + e, old - e):
                    t[at] = x
                    v.append(slopes(P.forward(theta, p)[1], P.forward(theta, u)[1], wu)[0])
                t[at] = old
                assert abs((v[0] - v[1]) / (2 * e) - g[at]) < 1e-6
    # beyond zero only the negative part is stepped back
    value, dp, du = P.nn_risk(0.9)(np.full(3, 5.0), np.full(4, -5.0), np.full(4, 0.25))
    assert value < 0.01 and (dp > 0).all() and (du < 0).all()


def test_prior_and_share_of_positives():
    rng = np.random.default_rng(4)
    good, bad = rng.beta(8, 2, 40_000), rng.beta(2, 8, 15_000)
    hist = lambda x: np.histogram(x, P.BINS, (0, 1))[0].astype(float)
    p, u = hist(good[:10_000]), hist(np.concatenate([good[10_000:], bad]))
    prior = P.estimate_prior(p, u)
    assert abs(prior - 30 / 45) < 0.04
    got = P.share_of_positives(p, u, prior)
    assert len(got) == P.BINS and (np.diff(got) >= 0).all() and got.min() >= 0 and got.max() <= 1
    assert got[200] < 0.05 and got[1800] > 0.9
    assert P.share_of_positives(np.eye(P.BINS)[5], np.eye(P.BINS)[7], 0.5).shape == (P.BINS,)


def test_negatives_take_no_part_and_every_row_is_in_a_cell(spark):
    df, labels = tables(spark, 300)
    a = sorted(map(tuple, P.classify(df, labels).collect()))
    assert a == sorted(map(tuple, P.classify(df, labels.where("quality = 1")).collect()))
    rows = P.features(df, "text").select("vector")
    vectors = P._vectors(rows)
    means, n = P._cells(rows, vectors[:50], 4)
    assert n.sum() == 302 and 1 < len(n) <= 16
    assert np.allclose(n @ means, vectors.sum(0), atol=1e-3)
