import hashlib
import random

import numpy as np
import pytest
from fixtures_llm import docs, empty

from ticksmith.llm import substring_dedup as S
from ticksmith.llm.suffix_bytes import RepeatedSuffixes


def brute(rows, least):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - least + 1):
            w = b[i:i + least]
            if w in seen:
                cover[i:i + least] = b"\1" * least
            seen.add(w)
        kept = bytes(x for x, c in zip(b, cover) if not c)
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out.append((d, len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_maximal_repeats_cover_all_repeated_windows():
    rng = random.Random(3)
    for _ in range(150):
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        base = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3)]
        strings = ["".join(rng.choice(base + ["x", "ab" * rng.randint(0, 9)]) for _ in range(rng.randint(0, 4))).encode()
                   for _ in range(rng.randint(1, 7))]
        least = rng.choice([7, 8, 10])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
        data = np.frombuffer(b"".join(strings), np.uint8)
        if not len(data):
            continue
        sa = RepeatedSuffixes(data, starts, least)
        ends = starts[1:]
        suffix = [data[p:ends[k]].tobytes() for p, k in zip(sa.order, sa.string)]
        for x, y, n in zip(suffix, suffix[1:], sa.lcp[1:]):
            same = next((i for i, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
            assert n == same or (n < least and same < least) or x[:least] != y[:least]
            assert n < least or x <= y
        got = [set() for _ in strings]
        for e, n, f in sa.maximal_repeats(sa.order):
            p, q = sa.order[e], sa.order[f]
            assert q < p and data[p:p + n].tobytes() == data[q:q + n].tobytes()
            k = sa.string[e]
            got[k] |= set(range(p - starts[k], p - starts[k] + n))
        seen, want = set(), [set() for _ in strings]
        for k, s in enumerate(strings):
            for i in range(len(s) - least + 1):
                if s[i:i + least] in seen:
                    want[k] |= set(range(i, i + least))
                seen.add(s[i:i + least])
        assert got == want


def fixture():
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcde ") for _ in range(rng.randint(30, 200))) for _ in range(6)]

    def text():
        return "".join(rng.choice(passages + ["x" * rng.randint(0, 300), "ab" * rng.randint(0, 90)]) if rng.random() < .7
                       else "".join(rng.choice("abcdefgh é") for _ in range(60)) for _ in range(rng.randint(0, 6)))

    rows = [(i, text()) for i in range(150)]
    rows += [(200 + i, rows[5][1]) for i in range(10)]
    return rows + [(300, None), (301, ""), (302, "z" * 9000), (303, "y" * 50 + "z" * 5000), (-4, rows[7][1])]


@pytest.mark.parametrize("limits", [{}, {"hot_classes": 3}, {"hot_bytes": 300}, {"local_hot": 2}, {"small": True}])
def test_dedup_matches_brute_force(spark, limits, monkeypatch):
    if limits == {"small": True}:  # every buffer overflows again and again
        for name, n in (("CHUNK", 700), ("RUN", 20), ("ARRAY_BYTES", 500), ("DEAL_RUNS", 40), ("HOLD_RUNS", 30)):
            monkeypatch.setattr(S, name, n)
        limits = {"hot_classes": 40}
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in S.dedup(df, **limits).collect()) == brute(rows, 100)


def test_repeat_groups_list_every_occurrence(spark):
    rng = random.Random(1)

    def noise(n):
        return "".join(rng.choice("abcdefghij") for _ in range(n))

    shared = noise(150)
    rows = [(i, noise(180) + shared + noise(180)) for i in range(6)]
    df = spark.createDataFrame(rows, "doc long, text string")
    found = S.repeats(df)
    groups = {}
    for r in found.collect():
        groups.setdefault((r["repeat"], r.length), []).append((r.doc, r.first))
    assert any({d for d, _ in g} == set(range(6)) and [d for d, f in g if f] == [0] for g in groups.values())


def test_edges(spark):
    df = docs(spark, extra=["doc", "data"])
    got = S.dedup(df, with_bytes=True)
    rows = got.collect()
    assert len(rows) == df.count()
    assert all(r.n_bytes - r.n_removed == len(r.kept) for r in rows)
    same = sorted(r.n_removed for r in rows if r.doc_id == 5)  # repeated rows: one is the earlier
    assert same[0] < same[1] == same[2] == next(r.n_bytes for r in rows if r.doc_id == 5)
    assert S.dedup(empty(spark)).count() == 0
