"""The pipeline's stages against brute force, and on odd tables."""

import hashlib
import math
from collections import Counter

from fixtures_llm import SCHEMA, docs, empty, rows
from pyspark.sql import functions as F
from test_pii import brute as base_spans
from test_pii_graph import learned
from test_quality_rules import brute as repetition
from test_simhash import fingerprint, labels

import corpus_pipeline as C
from ticksmith.llm import mixing, packing, pii, quality_rules
from ticksmith.llm.common import stored


def quality(data):
    def good(t):
        n, again, covered, longest = repetition(t, quality_rules.MIN_REPEAT)
        return n >= 50 and 2 * again <= n and covered <= quality_rules.MAX_COVERED * n and longest <= quality_rules.MAX_LONGEST * n
    return [r for r in data if good(r[1])]


def near_duplicates(data):
    codes = [fingerprint(r[1]) for r in data]
    best = {}
    for i, root in enumerate(labels(codes, 4)):
        best.setdefault(root, []).append(((data[i][0] is None, data[i][0] or 0), i))
    return [data[min(m)[1]] for m in best.values()]


def personal_data(data):
    texts = [r[1] or "" for r in data]
    _, found = learned(texts)
    out = []
    for i, r in enumerate(data):
        spans = []
        for a, b, k in sorted([(a, b, k) for k, a, b in base_spans(texts[i])] + [(a, b, pii.FOUND) for a, b in found[i]]):
            if spans and a < spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b, k])
        t = texts[i]
        for a, b, k in reversed(spans):
            t = t[:a] + f"[{k.upper()}]" + t[b:]
        out.append((r[0], t, r[2], r[3], len(t)))
    return out


def mixed(data):
    chars = Counter()
    for r in data:
        chars[r[3]] += len(r[1])
    weights = {s: n ** mixing.TEMPERATURE for s, n in chars.items() if n}
    out = Counter()
    for r in data:
        rate = weights[r[3]] / sum(weights.values()) * sum(chars.values()) / chars[r[3]]
        parts = max(1, math.ceil(rate / mixing.PIECE))
        name = str(r[0]) if r[0] is not None else "null" + hashlib.md5(r[1].encode()).hexdigest()
        n = 0
        for j in range(1, parts + 1):
            u = (int(hashlib.md5(f"{mixing.SEED}:{name}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = c = math.exp(-rate / parts)
            k = 0
            while c < u:
                k += 1
                p *= rate / parts / k
                c += p
            n += k
        out[r] += n
    return +out


def corpus():
    data = [r for r in rows(7) if r[0] not in (60, 61, 62)]
    for i in range(6):
        key = hashlib.sha1(str(i).encode()).hexdigest()
        data.append((300 + i, f'{data[i][1]} token = "{key}" call +1 (269) 555-329{i} or me{i}@mail.org {data[i + 6][1]} token = "ab{i}1234"', "en", "src2", 1))
    return data


def test_stages_match_brute_force(spark):
    data = corpus()
    now = spark.createDataFrame(data, SCHEMA)
    steps = {"quality_rules": quality, "simhash_near_dedup": near_duplicates, "pii": personal_data, "mixing": mixed}
    for name, stage in C.STAGES[:-1]:
        now = stored(stage(spark, now, ""), "test-stage")
        data = steps[name](data)
        got = Counter(tuple(r) for r in now.collect())
        assert got == Counter(data)
        if name == "pii":
            assert sum("[ID]" in r[1] for r in data) >= 5 and not any('"ab' in r[1] for r in data)
        data = list(got.elements())
    packed = C.STAGES[-1][1](spark, now, "").collect()
    lengths = Counter(r.doc_id for r in packed if r.piece == 0)
    assert lengths == Counter(r[0] for r in data)
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= packing.CAPACITY and len(fill) == math.ceil(sum(fill.values()) / packing.CAPACITY)


def test_stages_on_odd_tables(spark):
    odd = docs(spark).withColumns({"copy": F.lit(7), "fp": F.lit(7), "kept": F.lit(7), "pii_spans": F.lit(7), "uid": F.lit(7)})
    for name, stage in C.STAGES:
        none = stage(spark, empty(spark), "")
        assert none.count() == 0
        out = stage(spark, odd, "")
        if name == "packing":
            assert out.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
        else:
            assert none.columns == empty(spark).columns and out.columns == odd.columns
            assert out.where("copy <> 7 or fp <> 7 or kept <> 7 or pii_spans <> 7 or uid <> 7").isEmpty()
        if name == "pii":
            assert out.where("text is null").count() == odd.where("text is null").count() == 1
