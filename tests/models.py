"""Independent models of the row indicators: plain loops over one series, from the definitions.

Missing values are ``None`` in and out.
"""

import math


def present(x):
    return x is not None and not math.isnan(x) and not math.isinf(x)


def difference(xs):
    return [xs[i] - xs[i - 1] if i and present(xs[i]) and present(xs[i - 1]) else None for i in range(len(xs))]


def _frames(xs, n):
    """The last n values up to each place, or None while there are fewer or one is missing."""
    for i in range(len(xs)):
        last = xs[max(0, i - n + 1):i + 1]
        yield last if len(last) == n and all(map(present, last)) else None


def mean(xs, n):
    return [None if f is None else math.fsum(f) / n for f in _frames(xs, n)]


def deviation(xs, n):
    out = []
    for f in _frames(xs, n):
        if f is None or n < 2:
            out.append(None)
            continue
        m = math.fsum(f) / n
        out.append(math.sqrt(math.fsum((x - m) ** 2 for x in f) / (n - 1)))
    return out


def recursion(xs, span):
    a, y, out = 2 / (span + 1), None, []
    for x in xs:
        y = x if y is None else y + a * (x - y)
        out.append(y)
    return out


def strength(xs, n):
    """RSI: rises against falls among the last n steps; the first row's step counts as none."""
    steps = [0.0 if d is None else d for d in difference(xs)]
    out = []
    for i in range(len(xs)):
        last = steps[i - n + 1:i + 1] if i >= n - 1 else None
        up = math.fsum(s for s in last if s > 0) if last else 0.0
        down = -math.fsum(s for s in last if s < 0) if last else 0.0
        out.append(None if last is None or up + down == 0 else 100.0 * up / (up + down))
    return out


def frame(xs):
    """All columns of the indicator frame for one series without missing values."""
    middle, wide = mean(xs, 20), deviation(xs, 20)
    fast, slow = recursion(xs, 12), recursion(xs, 26)
    line = [f - s for f, s in zip(fast, slow)]
    signal = recursion(line, 9)
    return {"diff": difference(xs), "RSI": strength(xs, 14), "SMA_20": middle, "SMA_50": mean(xs, 50), "BB_middle": middle,
            "BB_upper": [None if m is None else m + 2 * w for m, w in zip(middle, wide)],
            "BB_lower": [None if m is None else m - 2 * w for m, w in zip(middle, wide)],
            "EMA_12": fast, "EMA_26": slow, "MACD": line, "MACD_signal": signal,
            "MACD_hist": [x - y for x, y in zip(line, signal)]}
