"""The learned spans against plain loops, and time in proportion to the spans."""

import random
import re
import time
from collections import Counter, defaultdict

from test_pii import brute

from ticksmith.llm import pii

TOKEN = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z._%+@-]*[0-9][A-Za-z0-9._%+@-]*")
WORD = re.compile(r"[^\W_]+|[^\w\s]|_")


def instances(text):
    base = []
    for _, a, b in sorted(brute(text), key=lambda s: s[1:]):
        if base and a < base[-1][1]:
            base[-1][1] = max(base[-1][1], b)
        else:
            base.append([a, b])
    out = [(a, b, True) for a, b in base]
    for m in TOKEN.finditer(text):
        a, b = m.span()
        if b - a >= pii.MIN_CHARS and sum(c.isdigit() for c in m.group()) >= pii.MIN_DIGITS \
                and not any(x < b and a < y for x, y in base):
            out.append((a, b, False))
    return sorted(out)


def edges(texts):
    for i, text in enumerate(texts):
        own = instances(text)
        for j, (a, b, base) in enumerate(own):
            left = WORD.findall(text[own[j - 1][1] if j else 0:a].lower())
            right = WORD.findall(text[b:own[j + 1][0] if j + 1 < len(own) else len(text)].lower())
            value = text[a:b]
            seed = base or (len(value) >= pii.KEY_CHARS and re.search("[A-Za-z]", value) is not None)
            patterns = ([f"< {left[-2]} {left[-1]}"] if len(left) > 1 else []) + ([f"< {left[-1]}"] if left else []) + ([f"> {right[0]}"] if right else [])
            yield i, a, b, base, seed, value.lower(), patterns


def learned(texts, min_seeds=pii.MIN_SEEDS, min_confidence=pii.MIN_CONFIDENCE, rounds=pii.ROUNDS):
    grams = Counter()
    for t in texts:
        w = WORD.findall(t.lower())
        grams.update(w)
        grams.update(f"{a} {b}" for a, b in zip(w, w[1:]))
    found = list(edges(texts))
    n, seed = Counter(), defaultdict(float)
    for _, _, _, _, s, value, patterns in found:
        for p in patterns:
            n[p, value] += 1
            seed[value] = max(seed[value], float(s))
    of = defaultdict(list)
    for p, v in n:
        of[p].append(v)
    wide = {p: v for p, v in of.items() if len(v) >= min_seeds}
    score, conf = dict(seed), {}
    for _ in range(rounds):
        conf = {}
        for p, values in wide.items():
            followed = sum(n[p, v] for v in values)
            c = sum(n[p, v] * score[v] for v in values) / max(followed, grams[p[2:]])
            if sum(score[v] >= min_confidence for v in values) >= min_seeds and c >= min_confidence:
                conf[p] = c
        for v in score:
            rest = 1.0
            for p in conf:
                if (p, v) in n:
                    rest *= 1 - min(conf[p], 0.999)
            score[v] = max(seed[v], 1 - rest)
    spans = defaultdict(list)
    for i, a, b, base, _, _, patterns in found:
        if not base and any(p in conf for p in patterns):
            spans[i].append((a, b))
    return conf, spans


def texts(seed, n=200):
    rng = random.Random(seed)
    value = {"mail": lambda: f"u{rng.randrange(10**4)}@mail.org", "short": lambda: f"ref{rng.randrange(10**5, 10**6)}x",
             "key": lambda: "%032x" % rng.getrandbits(128) + "a1", "number": lambda: str(rng.randrange(10**6, 10**9))}
    lead = [("contact us at", "mail", "short"), ('token = "', "key", "short"), ("order no.", "short", "number"), ("of the", "mail", "number"), ("id:", "short", "mail")]
    out = []
    for _ in range(n):
        words = [rng.choice(["of", "the", "river", "stone", "é", "at", "=", "no"]) for _ in range(rng.randint(0, 25))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            context, usual, other = rng.choice(lead)
            glue = "" if context.endswith('"') else " "
            words.insert(rng.randint(0, len(words)), context + glue + value[usual if rng.random() < 0.7 else other]() + rng.choice(["", ".", '"', " now"]))
        out.append(" ".join(words))
    return out


def test_graph_matches_plain_loops(spark):
    some = 0
    for seed, how in ((1, {}), (2, {"min_seeds": 2, "min_confidence": 0.3, "rounds": 4})):
        data = texts(seed)
        df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
        conf, spans = learned(data, **how)
        rows = pii.spans(df, "text")
        got = {r.pattern: r.confidence for r in pii.learn(rows.select("found"), df.select("text"), **how).collect()}
        assert got.keys() == conf.keys() and all(abs(got[p] - conf[p]) < 1e-9 for p in conf)
        for r in pii.annotate(df, **how).collect():
            assert [(s.start, s.end) for s in r.pii_spans if s.kind == pii.FOUND] == spans[r.doc_id]
        some += sum(map(len, spans.values()))
    assert some > 30


def test_small_bitmap_only_costs_rows(spark):
    df = spark.createDataFrame([(t,) for t in texts(4)], "text string")
    grams = spark.createDataFrame([("of",), ("of the",), ('= "',), ("absent",)], "gram string")
    words = Counter()
    for t in texts(4):
        w = WORD.findall(t.lower())
        words.update(w)
        words.update(f"{a} {b}" for a, b in zip(w, w[1:]))
    for bits in (64, pii.BITS):
        got = {r.gram: r.total for r in pii._occurrences(df, grams, bits).collect()}
        assert got == {g: words[g] for g in ("of", "of the", '= "')}


def test_time_follows_the_spans(spark):
    def seconds(n):
        text = " ".join(f"user{i}@mail.org AB{i:06d}x" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        out = pii.redact(df).first().text
        assert out.count("[EMAIL]") == n
        return time.time() - began

    seconds(100)
    small, large = seconds(4000), seconds(16000)
    assert large < 5 * small + 2, (small, large)
