"""Property test: halo blocks give per-symbol results for any block size."""

import models
import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from ticksmith.operators import ema, rolling, series


@settings(max_examples=8, deadline=None, derandomize=True)
@given(lengths=st.lists(st.integers(1, 240), min_size=1, max_size=3),
       block=st.integers(3, 90), span=st.integers(2, 30), n=st.integers(2, 25),
       seed=st.integers(0, 10_000))
def test_blocked_indicators_match_the_models(spark, lengths, block, span, n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k, length in enumerate(lengths):
        t0 = pd.Timestamp("2024-01-01")
        for i in range(length):
            rows.append((f"s{k}", (t0 + pd.Timedelta(seconds=int(i))).to_pydatetime(),
                         k * 100_000 + i, float(np.round(rng.uniform(1, 50), 2))))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq long, price double")
    b, w = series.blocked(df, ["symbol"], ["ts", "seq"], n, block_rows=block, num_partitions=3)
    b = rolling.add_rolling_mean(b, w, "price", n, "m")
    b = rolling.add_rolling_std(b, w, "price", n, "sd")
    b = rolling.add_rsi(b, w, "price", n, "r")
    got = series.finish(b).toPandas().sort_values(["symbol", "seq"])
    smooth = ema.ema(df, span, out="e", block_rows=block).toPandas().sort_values(["symbol", "seq"])
    for k in range(len(lengths)):
        xs = [r[3] for r in rows if r[0] == f"s{k}"]
        mine = got[got.symbol == f"s{k}"]
        assert len(mine) == len(xs)
        exp = {"m": models.mean(xs, n), "sd": models.deviation(xs, n), "r": models.strength(xs, n)}
        cols = {c: mine[c].to_numpy(float) for c in exp} | {"e": smooth[smooth.symbol == f"s{k}"]["e"].to_numpy(float)}
        exp["e"] = models.recursion(xs, span)
        for c, e in exp.items():
            want = np.array([np.nan if v is None else v for v in e])
            assert (np.isnan(cols[c]) == np.isnan(want)).all(), c
            there = ~np.isnan(want)
            assert np.allclose(cols[c][there], want[there], rtol=1e-9, atol=1e-8), (c, block, span, n)
