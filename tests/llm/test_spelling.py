import random
import re
import zlib
from collections import Counter

from fixtures_llm import docs, empty

from ticksmith.llm import spelling as S

LOWER = {c: c + 32 for c in range(65, 91)}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def count(rows):
    total = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 31 == 0:
                at = h % len(r)
                r = r[:at] + r[at + 1:]
            total[r] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def group(n):
    out = {}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def got(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def typed(rng, w, letters):
    at, kind = rng.randrange(len(w) + 1), rng.choice("idr")
    if kind == "i":
        return w[:at] + rng.choice(letters) + w[at:]
    at = min(at, len(w) - 1)
    return w[:at] + ("" if kind == "d" else rng.choice(letters)) + w[at + 1:]


def words(rng, letters, n):
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 12))) for _ in range(n)]
    out = {}
    for w in base:
        out[w] = rng.choice([2, 30, 400, 5000])
        for _ in range(rng.randint(0, 5)):
            v = typed(rng, w, letters)
            out.setdefault(v, rng.choice([2, 3, 30, 300]))
            if v:
                out.setdefault(typed(rng, v, letters), 2)
    return {w: c for w, c in out.items() if len(w) >= 2}


def test_brute_force(spark):
    for seed, letters, n in ((1, "abcdefghäß", 120), (2, "ab", 60)):
        n_of = words(random.Random(seed), letters, n)
        df = spark.createDataFrame(list(n_of.items()), "word string, n long")
        for pairs in (32, 0):  # 0: every group is split to the last letter
            assert got(S.variants(df, pairs=pairs)) == group(n_of)


def test_common_beginning_is_split(spark):
    n_of = words(random.Random(3), "abcdefgh", 100)
    n_of = {"vorhersehbar" + w: n for w, n in n_of.items()} | {w + "lichkeiten": n for w, n in n_of.items()}
    df = spark.createDataFrame(list(n_of.items()), "word string, n long")
    assert got(S.variants(df, pairs=4)) == group(n_of)


def test_chains_of_forms(spark):
    n_of = {"aaaaaaa": 10, "aaaaaab": 100, "aaaaabb": 1000, "aaaabbb": 10000, "aaabbbb": 100000, "aabbbbb": 10**6}
    df = spark.createDataFrame(list(n_of.items()), "word string, n long")
    assert got(S.variants(df)) == group(n_of)
    assert {r[4] for r in got(S.variants(df)).values()} == {"aabbbbb"}


def test_counts(spark):
    rng = random.Random(4)
    vocab = ["Straßenbahn", "Äpfelkuchen", "UNDERSTANDING", "understanding", "short", "understánding", "a×b÷cdefg"]
    rows = [(i % 40, " ".join(rng.choice(vocab) for _ in range(30)) + rng.choice([".", "1", "-x"])) for i in range(80)]
    rows += [(1, None), (2, ""), (None, "nothing nothing nothing"), rows[3], (7, "x" * 50000), (8, "x" * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: r.n for r in S.word_counts(df).collect()} == count(rows)
    assert got(S.variants(S.word_counts(df))) == group(count(rows))


def test_empty_and_extra_columns(spark):
    assert S.variants(S.word_counts(empty(spark))).count() == 0
    d = docs(spark, extra=("word", "n"))
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    assert got(S.variants(S.word_counts(d))) == group(count(rows))
