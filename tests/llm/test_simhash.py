import numpy as np
import xxhash
from fixtures_llm import docs, empty, rows

from ticksmith.llm import simhash as S


def fingerprint(text, words=4):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def labels(codes, bits):
    parent = list(range(len(codes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= bits:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(codes))]


def near(rng, n):
    out = []
    for _ in range(n):
        base = int(rng.integers(0, 2**63))
        for _ in range(int(rng.integers(1, 12))):
            x = base
            for b in rng.integers(0, 64, int(rng.integers(0, 6))):
                x ^= 1 << int(b)
            out.append(x)
    return sorted(set(out))


def test_fingerprints_match_definition():
    texts = [t for _, t, *_ in rows()][:48] + ["É É É é", "A B C D E", "a b\x0bc d e"]
    got = S.fingerprints(texts).view(np.uint64).tolist()
    assert got == [fingerprint(t) for t in texts]


def test_trie_matches_all_pairs():
    rng = np.random.default_rng(2)
    for _ in range(5):
        codes = near(rng, 40)
        for bits in (0, 2, 4):
            for frontier in (1 << 19, 64):
                got = S.trie_forest(np.array(codes, np.uint64), 0, bits, frontier).tolist()
                assert got == labels(codes, bits)


def test_distributed_join_with_split_groups(spark):
    codes = near(np.random.default_rng(3), 60)
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    want = {}
    for c, k in zip(signed, labels(codes, 4)):
        want.setdefault(k, []).append(c)
    want = {c: min(v) for v in want.values() for c in v}
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    for most in (1 << 17, 15):
        assert {r.fp: r.root for r in S.classes_with_component(df, 4, most).collect()} == want


def test_components_of_documents(spark):
    data = rows()
    fps = [fingerprint(t) for _, t, *_ in data]
    uniq = sorted(set(fps))
    group = dict(zip(uniq, labels(uniq, 4)))
    least = {}
    for (i, *_), f in zip(data, fps):
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in S.near_duplicates(docs(spark, extra=["fp", "uid"])).collect()), key=repr)
    want = sorted(((i, int(np.uint64(f).view(np.int64)), least.get(group[f])) for (i, *_), f in zip(data, fps)), key=repr)
    assert got == want
    kept = S.keep_one(docs(spark, extra=["fp", "row_uid"]))
    assert kept.columns[-2:] == ["fp", "row_uid"]
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == sorted(
        {least.get(group[f], -1) for f in fps})


def test_empty_table(spark):
    assert S.near_duplicates(empty(spark)).count() == 0
    assert S.keep_one(empty(spark)).count() == 0
