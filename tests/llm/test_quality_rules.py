from collections import Counter

from fixtures_llm import docs, empty

from ticksmith.llm import quality_rules as Q


def brute(text, least):
    w = (text or "").encode().split()
    n = len(w)
    seen = Counter(tuple(w[i:i + 3]) for i in range(n - 2))
    three = {i + d for i in range(n - 2) if seen[tuple(w[i:i + 3])] > 1 for d in range(3)}
    order = sorted(range(n), key=lambda i: w[i:])
    depth = [0] * n
    for a, b in zip(order, order[1:]):
        k = 0
        while max(a, b) + k < n and w[a + k] == w[b + k]:
            k += 1
        if k >= least:
            depth[a], depth[b] = max(depth[a], k), max(depth[b], k)
    cover = {p for i, d in enumerate(depth) for p in range(i, i + d)}
    return n, len(three), len(cover), max(depth, default=0)


def test_counts_match_brute_force():
    import random
    rng = random.Random(4)
    texts = [None, "", " \n", "a", "a a a a a a"] + [
        " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(60)] + [
        " ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(rng.randint(0, 200))) for _ in range(40)]
    for least in (2, 4, 10):
        got = list(zip(*(x.tolist() for x in Q.repeat_counts(texts, least))))
        assert got == [brute(t, least) for t in texts]


def test_judge_base_columns_and_edges(spark):
    got = Q.judge(docs(spark, extra=["kept"])).collect()
    assert len(got) == docs(spark).count()
    for r in got:
        t = r.text or ""
        assert r.n_words == len(t.encode().split())
        assert r.word_chars == len(t) - sum(t.count(c) for c in " \t\n\x0b\x0c\r")
        assert r.n_symbols == sum(t.count(c) for c in "#*$%&|<>")
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r["kept"] == 7 and (not r["kept_"] or not r.base_failed)  # the clashing column stays


def test_dup_lines():
    assert Q._dup_lines("a\nb\na\n\n\na") == 2
    assert Q._dup_lines(" \n \n\t\n") == 0


def test_long_repeat_is_rejected(spark):
    import random
    rng = random.Random(9)
    half = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(100))
    df = spark.createDataFrame([(1, half + " " + half), (2, half)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in Q.judge(df).collect()} == {1: False, 2: True}


def test_empty_table(spark):
    assert Q.keep(empty(spark)).count() == 0
