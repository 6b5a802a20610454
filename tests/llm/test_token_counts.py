import numpy as np
import public_tokenizers
from fixtures_llm import docs, empty, rows
from tokenizers import Tokenizer

from ticksmith.llm import token_counts as T

TEXTS = ["a b\n\n\nc  \n d\n", "\n", "", "é\n\U0001F600\U0001F600 x\n\té", "line one\r\nline two\r\n\r\n\r\nthree", " \n \n ", "tab\t\n\n\n\n\n\n"]


def brute(text):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
    ends = starts[1:] + [len(text)]
    count, cross = [0] * len(starts), [0] * len(starts)
    for a, b in tok.encode(text, add_special_tokens=False).offsets:
        over = [max(0, min(b, e) - max(a, s)) for s, e in zip(starts, ends)]
        k = over.index(max(over))
        count[k] += 1
        cross[k] += sum(o > 0 for o in over) > 1
    return list(zip(range(len(starts)), starts, ends, count, cross))


def test_sections_match_brute_force(spark):
    data = list(enumerate(TEXTS)) + [(100 + n, r[1]) for n, r in enumerate(rows()) if r[1] and len(r[1]) < 3000]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {}
    for r in T.count_by_section(df).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.start, r.end, r.n_tokens, r.n_crossing))
    for i, t in data:
        assert sorted(got[i]) == brute(t)


def test_majority_rule():
    sections = np.array([0, 3, 5])
    a, b = np.array([0, 2, 1, 2, 0]), np.array([2, 4, 5, 8, 8])
    # inside; tie goes to the earlier; 2 and 2; 1, 2 and 3; 3, 2 and 3
    assert T.attribute(a, b, sections, 8).tolist() == [0, 0, 0, 2, 0]


def test_edges(spark):
    got = T.count_by_section(docs(spark, extra=["section", "start", "n_tokens"]))
    assert got.columns == ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]
    by = {}
    for r in got.collect():
        by[r.doc_id] = by.get(r.doc_id, 0) + r.n_tokens
    assert by[40] == 0 and by[41] == 0 and by[43] == 2 and by[60] > 20000
    assert T.count_by_section(empty(spark)).count() == 0
