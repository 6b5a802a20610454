import re

from fixtures_llm import docs, empty

from ticksmith.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else True,
            "card": 13 <= len(digits) <= 19 and luhn(digits or "1"), "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


HARD = ["a@b.c_d@e.fg x@y.z", "1.2.3.4.5.6.7.8 999.1.1.1 00255.1.1.1", "4111 1111 1111 1111 41111111111111111111 4111-1111-1111-1111",
        "+1 (269) 555-3296 45241 +12 34 +1234567890123456 ++1 234 567 890", "é\U0001F600 a@b.co \x01 1.2.3.4 \x02", None, "", "a" * 30000,
        "1" * 3000, "x@y" + ".z" * 20000, "@" * 50, "1.2.3.4," * 1500, "%%a@b.c.d.e@f.g @h.i", "12345678901234 -5", "1-2 - 3 4 5"]


def test_base_spans_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    for r in pii.annotate(df).collect():
        assert [(s.kind, s.start, s.end) for s in r.pii_spans if s.kind != pii.FOUND] == brute(r.text)


def test_learned_context_finds_unseen_identifiers(spark):
    data = [(i, f"zed word{'abc'[i % 3]} Contact us: user{i}.x@mail.org then the and of") for i in range(30)]
    data += [(100 + i, f"blah contact us: AB-{i}7{i}81234 foo") for i in range(5)]
    data += [(200, "the and of nothing 1234567 here"), (201, None), (202, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert all(got[100 + i] == "blah contact us: [ID] foo" for i in range(5))
    assert got[3] == "zed worda Contact us: [EMAIL] then the and of"
    assert got[200] == data[35][1] and got[201] is None and got[202] == ""


def test_common_pattern_is_not_trusted(spark):
    data = [(i, f"of the user{i}@mail.org") for i in range(10)] + [(100 + i, "of the river and of the stone") for i in range(200)]
    df = spark.createDataFrame(data + [(999, "of the code 12345678 of the 87654321x")], "doc_id long, text string")
    assert all(s.kind != pii.FOUND for r in pii.annotate(df).collect() for s in r.pii_spans)


def test_overlapping_spans_are_one(spark):
    df = spark.createDataFrame([(1, "call +4111111111111111 now")], "doc_id long, text string")
    assert pii.redact(df).first().text.count("[") == 1


def test_edges(spark):
    df = docs(spark, extra=["pii_spans", "uid", "base"])
    assert pii.redact(df).columns == df.columns
    assert pii.annotate(df).count() == df.count()
    assert pii.redact(empty(spark)).count() == 0
