import hashlib
import random
import re

from fixtures_llm import docs, empty
from pyspark.sql import functions as F

from ticksmith.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(texts, items, window=10):
    wins = {}
    for item, t in items:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for t in texts:
        w = words(t)
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                own = wins.get(tuple(w[i:i + n]))
                if own is not None:
                    hit |= set(range(i, i + n))
                    found |= {x for x in own if x is not None}
        ids = ",".join(sorted(str(x) for x in found))
        out.append((len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def got(spark, texts, items, **how):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = sorted(D.contaminated(d, b, **how).collect())
    return [tuple(r)[1:] for r in rows]


def case(seed, vocab, n_docs=30):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, some(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 25]))) for i in range(14)]
    items += [(3, items[4][1]), (100, items[12][1] + " " + items[7][1]), (None, some(12)), (200, None)]
    texts = [None, "", " \n"]
    for _ in range(n_docs):
        t = some(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            w = words(rng.choice(items)[1])
            cut = rng.randint(0, max(0, len(w) - 8))
            t += rng.choice([" ", ", ", "\n"]) + rng.choice([" ", "-"]).join(w[cut:]) + " " + some(rng.randint(0, 5))
        texts.append(t.title() if rng.random() < 0.3 else t)
    return texts, items


def test_brute_force_plain_words(spark):
    texts, items = case(1, [f"w{i}" for i in range(60)])
    assert got(spark, texts, items) == brute(texts, items)


def test_brute_force_few_words_and_other_windows(spark):
    texts, items = case(2, ["ä", "b", "ßc", "7"], 12)  # every shingle is everywhere
    assert got(spark, texts, items) == brute(texts, items)
    assert got(spark, texts, items, window=4, shingle=2) == brute(texts, items, 4)
    assert got(spark, texts, items, window=1, shingle=1) == brute(texts, items, 1)


def test_passage_at_the_edges(spark):
    item = " ".join(f"word{i}" for i in range(12))
    texts = [item, item + " tail", "head " + item, " ".join(item.split()[1:]), " ".join(item.split()[:9]), item.replace("word5", "other")]
    assert got(spark, texts, [(1, item)]) == brute(texts, [(1, item)])
    assert [r[1] for r in got(spark, texts, [(1, item)])] == [12, 12, 12, 11, 0, 0]


def test_texts_do_not_run_together(spark):
    assert [r[1] for r in got(spark, ["one two", "three four"], [(1, "two three")])] == [0, 0]
    assert [r[1] for r in got(spark, ["one two three"], [(1, "one"), (2, "two three")])] == [3]


def test_a_passage_in_most_documents(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [passage + f" own{i} " + passage if i % 3 else f"own{rng.random()}" for i in range(300)]
    items = [(i, passage) for i in range(20)]
    assert got(spark, texts, items) == brute(texts, items)


def test_small_bitmap_only_costs_rows(spark, monkeypatch):
    monkeypatch.setattr(D, "MIN_BITS", 64)
    monkeypatch.setattr(D, "MAX_BITS", 64)
    texts, items = case(3, [f"w{i}" for i in range(200)], 15)
    assert got(spark, texts, items) == brute(texts, items)


def test_odd_rows_empty_tables_and_clashing_names(spark):
    d = docs(spark, extra=("n_words", "uid"))
    items = spark.createDataFrame([(7, "alphaa"), (8, "x" * 60000)], "item_id long, text string")
    out = D.contaminated(d, items)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_words", "uid", "n_words_", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert out.count() == d.count() and out.where("n_words = 7 and uid = 7").count() == d.count()
    assert [r.n_hit for r in out.where("doc_id in (40, 41, 42, 61)").orderBy("doc_id").collect()] == [0, 0, 0, 1]
    assert D.contaminated(empty(spark), items).count() == 0
    none = D.contaminated(docs(spark), items.limit(0))
    assert none.where(F.col("contaminated") | (F.col("n_items") > 0)).isEmpty() and none.count() == d.count()
