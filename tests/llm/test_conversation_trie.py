import hashlib
import math
import random
import zlib

from pyspark.sql import functions as F

from ticksmith.llm import conversation_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(t)] for c, t in own.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + t[h:]
    return {c: tuple(t) for c, t in out.items()}


def brute(seqs):
    members = {}
    for c, t in seqs.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    out = []
    for node, m in members.items():
        below = [v for v in members if v[:len(node)] == node]
        inner = {v[:-1] for v in members if v}
        ends = ",".join(str(c) for c in sorted(c for c in m if seqs[c] == node))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m),
                    sum(len(v) == len(node) + 1 for v in below), sum(v not in inner for v in below),
                    sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below if v),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rows(seed, n, texts, longest):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        c = rng.choice([c, c, c + 1000, -c])
        for t in range(rng.randint(1, longest)):
            out.append((c, t, ["user", "assistant"][t % 2], rng.choice(texts)))
    rng.shuffle(out)
    return out


def check(spark, data, **how):
    convs, turns = T.rebuilt(spark.createDataFrame(data, SCHEMA))
    want = brute(sequences(data))
    assert got(T.trie(convs, turns, **how)) == want
    return want


def test_brute_force(spark):
    check(spark, rows(1, 60, ["a", "b", "éé", ""], 9))


def test_bands_and_shards_recombine(spark):
    data = rows(2, 50, ["a", "b"], 12) + [(5, t, "user", "a") for t in range(100, 170)] + [(6, t, "user", "a") for t in range(100, 140)]
    want = check(spark, data, width=3, shard_rows=4)
    assert max(w[1] for w in want) > 60
    check(spark, data)


def test_copies_and_a_conversation_with_most_rows(spark):
    data = [(c, t, "user", f"t{t}") for c in range(0, 900, 1) for t in range(3)]
    data += [(2000, t, "user", "same") for t in range(3000)]
    convs, turns = T.rebuilt(spark.createDataFrame(data, SCHEMA))
    nodes = T.trie(convs, turns, shard_rows=64).orderBy("depth").collect()
    deep = nodes[-1]
    assert deep.depth >= 2990 and deep.n_convs == 1 and nodes[0].n_convs == 901
    assert nodes[0].saved_tokens == sum((r.n_convs - 1) * 2 for r in nodes if 0 < r.depth and r.n_convs > 1)


def test_odd_rows(spark):
    data = [(None, 0, "user", "orphan"), (1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "assistant", "w"),
            (2, 5, None, ""), (2, None, "", None), (3, 0, "user", "long " * 20000), (4, 0, "user", "long " * 20000),
            (10, 0, "user", "only"), (11, 0, "user", "gone")]
    check(spark, data)


def test_empty_and_extra_columns(spark):
    convs, turns = T.rebuilt(spark.createDataFrame([], SCHEMA))
    assert T.trie(convs, turns).count() == 0
    data = rows(3, 12, ["a", "b"], 5)
    df = spark.createDataFrame(data, SCHEMA)
    for c in ("pos", "conv", "size", "k1", "band"):
        df = df.withColumn(c, F.lit(9))
    assert got(T.trie(*T.rebuilt(df))) == brute(sequences(data))


def test_only_the_root(spark):
    # conversation 1 takes more turns than it has from one that is absent
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    check(spark, [(c, 0, "user", "x")])
