from collections import Counter

from fixtures_llm import docs, empty, prose

from ticksmith.llm import mixing


def test_counts_follow_the_rates(spark):
    import random
    rng = random.Random(3)
    data = [(i, prose(rng, 20), "a" if i % 4 else "b") for i in range(4000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(df, {"a": 0.25, "b": 0.75, "absent": 5.0}).collect()
    chars = Counter()
    for r in got:
        chars[r.source] += len(r.text)
    share = chars["b"] / sum(chars.values())
    assert abs(share - 0.75) < 0.03
    assert abs(sum(chars.values()) / sum(len(t) for _, t, _ in data) - 1) < 0.05
    copies = Counter(r.doc_id for r in got)
    for source, mean in (("a", 1 / 3), ("b", 3.0)):
        n = [copies.get(i, 0) for i, _, s in data if s == source]
        assert abs(sum(n) / len(n) - mean) < 0.15
        var = sum((x - mean) ** 2 for x in n) / len(n)
        assert abs(var - mean) < 0.35  # Poisson: variance equals mean
    # shuffled: neighbours in the output are not neighbours in the input
    assert sum(abs(a.doc_id - b.doc_id) < 5 for a, b in zip(got, got[1:])) < 0.02 * len(got)
    again = mixing.mix(df, {"a": 0.25, "b": 0.75, "absent": 5.0}).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_large_rate_is_split(spark):
    df = spark.createDataFrame([(1, "aaaa", "rare")] + [(i, "b" * 40, "common") for i in range(2, 402)], "doc_id long, text string, source string")
    got = Counter(r.source for r in mixing.mix(df, {"rare": 0.5, "common": 0.5}).collect())
    assert 1700 < got["rare"] < 2300  # mean 2000.5


def test_edges(spark):
    df = docs(spark, extra=["copy", "shuffle_key", "source_key"])
    out = mixing.mix(df)
    assert out.columns == df.columns + ["copy_", "shuffle_key_"]
    rows = out.collect()
    assert {r.source for r in rows} <= {"src0", "src1", "src2", None}
    per = Counter((r.doc_id, r.text) for r in rows)
    twice = [n for (i, _), n in per.items() if i == 5]
    assert not twice or twice[0] % 3 == 0  # three equal rows draw alike
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(df, {}).count() == 0


def test_rows_without_an_id_draw_by_their_text(spark):
    import random
    rng = random.Random(8)
    df = spark.createDataFrame([(None, prose(rng, 20), "a") for _ in range(500)] + [(1, prose(rng, 20), "b")], "doc_id long, text string, source string")
    out = mixing.mix(df, {"a": 0.5, "b": 0.5}).where("source = 'a'").collect()
    per = Counter(r.text for r in out)
    assert len(set(per.values())) > 1 and 0 < len(per) < 500
    assert len({r.shuffle_key for r in out}) == len(out)
