"""Personal data: base patterns and bootstrapped contextual extraction (native Spark only).

Base kinds (e-mail, IP, card, phone) are regular expressions; matches and
their code-point offsets come from marking each match and splitting at the
marks, all within the row.

The method then learns where identifiers stand. Seed instances are the base
matches and tokens whose form gives key material away (``KEY_CHARS`` characters
or more, letters and digits mixed). Other identifier-shaped tokens are
candidates. An instance's lexical patterns back off from the two words left
of it to one word left and one word right; words are runs of letters and digits,
or one other character, and do not reach into the next instance. Spark scores the bipartite
pattern-instance graph for some rounds: a pattern's confidence is
the score of the instances it stands with over all its occurrences in the
corpus, whatever it stands beside; an instance's score is the noisy-or of its
trusted patterns (seeds stay at 1). Promoted instances support further
patterns in the next round. Tokens in a pattern of high confidence, seen
with enough different promoted instances, are further spans of kind ``id``;
form alone, without such a pattern, makes none.

Occurrences are counted over every word and word pair of the corpus by one plan
at every size: pairs are tested inside the row against a bitmap of fixed size
(``BITS``) of the patterns' hashes; the few that pass are summed before the
shuffle and joined to the patterns by their text, so counts are exact.

Defined results: null text is empty and has no spans. Repeated rows are
annotated alike; a value repeated in a pattern counts once for support.
Extra columns are carried, clashing names get underscores added. Everything
per text stays in its row, in time linear in the text and its spans; the graph
is aggregated by partial sums, so a pattern or value of any frequency is no hot
group. Pattern tables are written first, so Spark broadcasts them only when it
has measured them small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticksmith.llm.common import free_name, stored

KINDS = ["email", "ip", "card", "phone"]
FOUND = "id"

# The base patterns, written so that each text is scanned in linear time:
# a match can only begin where its run of characters begins (or where the
# last match ended), and runs never give characters back.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Identifier-shaped: a maximal run of these characters that holds a digit.
TOKEN = r"(?<![A-Za-z0-9._%+@-])[A-Za-z._%+@-]*+[0-9][A-Za-z0-9._%+@-]*+"
# Words of a context.
WORD = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"

#: Shape of a candidate: characters and digits at least.
MIN_CHARS, MIN_DIGITS = 6, 4
#: A token of so many characters, letters and digits mixed, is a seed.
KEY_CHARS = 20
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.5
ROUNDS = 3
#: Bits of the pattern bitmap (a power of two), 32 to a word of its literal.
BITS = 1 << 17

_BLOCK = 64
_CHUNK = 1024


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of ``value``, which is evaluated once however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _scan(values: Column, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running ``op`` over an array, each element included; block by block, so in linear time."""
    def inside(block: Column) -> Column:
        return F.transform(block, lambda _, i: F.aggregate(
            F.slice(block, F.lit(1), i + 1), start, lambda acc, x: op(acc, x)))

    def blocks(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int")),
                           lambda c: let(F.slice(a, c * _BLOCK + 1, _BLOCK), inside))

    def carried(parts: Column) -> Column:
        none = F.slice(F.array(start), F.lit(1), F.lit(0))
        before = F.aggregate(parts, F.struct(start.alias("at"), none.alias("all")), lambda acc, b: F.struct(
            op(acc["at"], F.element_at(b, -1)).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
            lambda acc: acc["all"])
        return F.flatten(F.zip_with(parts, before, lambda b, at: F.transform(b, lambda x: op(at, x))))

    return let(values, lambda a: F.when(F.size(a) > 0, let(blocks(a), carried)).otherwise(a))


def _add(a: Column, b: Column) -> Column:
    return a + b


def marked(text: Column, pattern: str, maybe: Column) -> Column:
    """array<struct<start, end, value>> of all matches; empty unless ``maybe``."""
    clean = F.translate(text, "\x01\x02", "\x03\x03")
    parts = F.split(F.regexp_replace(clean, pattern, "\x01$0\x02"), "[\x01\x02]", -1)

    def spans(p: Column, ends: Column) -> Column:
        # parts alternate: between, match, between, ..., between
        return F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), lambda i: F.struct(
            F.get(ends, i - 1).alias("start"), F.get(ends, i).alias("end"), F.get(p, i).alias("value")))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(maybe, let(parts, lambda p: F.when(F.size(p) > 1, let(
        _scan(F.transform(p, F.length), F.lit(0), _add), lambda ends: spans(p, ends))).otherwise(none))).otherwise(none)


def _digits(c: Column) -> Column:
    return F.translate(c, " -().+", "")


def luhn(digits: Column) -> Column:
    """Is the digit string's Luhn sum a multiple of ten?"""
    def step(r: Column, i: Column) -> Column:
        d = F.substring(r, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    total = let(F.reverse(digits), lambda r: F.aggregate(
        F.sequence(F.lit(1), F.length(r)), F.lit(0), lambda s, i: s + step(r, i)))
    return total % 10 == 0


def _small_parts(ip: Column) -> Column:
    """All parts at most 255, whatever their leading zeros."""
    def ok(part: Column) -> Column:
        return let(F.regexp_replace(part, "^0++(?=[0-9])", ""),
                   lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    return F.forall(F.split(ip, r"\."), ok)


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind, the valid matches in order."""
    def between(c: Column, lo: int, hi: int) -> Column:
        return (F.length(c) >= lo) & (F.length(c) <= hi)

    return {
        "email": marked(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(marked(text, IP, F.rlike(text, F.lit(IP))), lambda s: _small_parts(s["value"])),
        "card": F.filter(marked(text, CARD, F.rlike(text, F.lit(CARD))), lambda s: luhn(_digits(s["value"]))),
        "phone": F.filter(marked(text, PHONE, F.contains(text, F.lit("+"))),
                          lambda s: between(_digits(s["value"]), 9, 15)),
    }


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _CHUNK), 0)


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text in chunks, without a walk from its beginning."""
    first = F.floor(start / _CHUNK).cast("int")
    some = F.floor(end / _CHUNK).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(chunks, first + 1, some), ""), start - first * _CHUNK + 1, end - start)


def _merged(spans: Column) -> Column:
    """Overlapping spans of an array sorted by start become one, with the first's other fields."""
    def heads(s: Column, reach: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                        lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(reach, i - 1)))

    def joined(s: Column, reach: Column, h: Column) -> Column:
        def one(i: Column, j: Column) -> Column:
            last = F.coalesce(F.get(h, j + 1), F.size(s)) - 1
            return F.get(s, i).withField("end", F.get(reach, last))
        return F.transform(h, one)

    return let(spans, lambda s: F.when(F.size(s) > 0, let(
        _scan(F.transform(s, lambda x: x["end"]), F.lit(0), F.greatest),
        lambda reach: let(heads(s, reach), lambda h: joined(s, reach, h)))).otherwise(s))


def _apart(spans: Column) -> Column:
    """Of base spans and tokens sorted by start, all base spans and the tokens that overlap none."""
    far = F.lit(2**31 - 1)

    def kept(s: Column, reach: Column, ahead: Column) -> Column:
        n = F.size(s)
        free = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(s, i)["base"] | (
            (F.get(reach, i) <= F.get(s, i)["start"]) & (F.get(ahead, n - 1 - i) >= F.get(s, i)["end"])))
        return F.transform(free, lambda i: F.get(s, i))

    reach = lambda s: _scan(F.transform(s, lambda x: F.when(x["base"], x["end"]).otherwise(F.lit(0))), F.lit(0), F.greatest)
    ahead = lambda s: _scan(F.transform(F.reverse(s), lambda x: F.when(x["base"], x["start"]).otherwise(far)), far, F.least)
    return let(spans, lambda s: F.when(F.size(s) > 0, let(reach(s), lambda r: let(ahead(s), lambda a: kept(s, r, a)))).otherwise(s))


def _with_patterns(text: Column, spans: Column) -> Column:
    """``start, end, base, seed, value, patterns`` of disjoint spans in order."""
    def around(chunks: Column, s: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(s, i - 1)["end"])
            after = F.coalesce(F.get(s, i + 1)["start"], F.length(text))
            left = F.regexp_extract_all(F.lower(_cut(chunks, before, x["start"])), F.lit(WORD), 0)
            right = F.regexp_extract(F.lower(_cut(chunks, x["end"], after)), WORD, 0)
            key = (F.length(x["value"]) >= KEY_CHARS) & F.rlike(x["value"], F.lit("[A-Za-z]"))
            patterns = let(left, lambda w: F.array(
                F.when(F.size(w) >= 2, F.concat(F.lit("< "), F.try_element_at(w, F.lit(-2)), F.lit(" "), F.try_element_at(w, F.lit(-1)))),
                F.when(F.size(w) >= 1, F.concat(F.lit("< "), F.try_element_at(w, F.lit(-1)))),
                F.when(right != "", F.concat(F.lit("> "), right))))
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"),
                            (x["base"] | key).alias("seed"), F.lower(x["value"]).alias("value"),
                            F.array_compact(patterns).alias("patterns"))
        return F.transform(s, one)

    none = F.array().cast("array<struct<start:int,end:int,base:boolean,seed:boolean,value:string,patterns:array<string>>>")
    return let(spans, lambda s: F.when(F.size(s) > 0, let(_chunks(text), lambda c: around(c, s))).otherwise(none))


def spans(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds ``base`` (base spans with kind, by kind) and ``found`` (all instances with their patterns, in order)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    kinds = base_spans(t)
    tokens = F.filter(marked(t, TOKEN, F.rlike(t, F.lit("[0-9]"))), lambda s: (F.length(s["value"]) >= MIN_CHARS) & (
        F.length(F.regexp_replace(s["value"], "[^0-9]", "")) >= MIN_DIGITS))

    def named(found: Column, kind: str) -> Column:
        return F.transform(found, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(kind != FOUND).alias("base"),
            s["value"].alias("value"), F.lit(kind).alias("kind")))

    rows = docs.withColumns({"base": F.concat(*[named(kinds[k], k) for k in KINDS]), "tokens": named(tokens, FOUND)})
    both = let(_merged(F.array_sort("base")), lambda b: _apart(F.array_sort(F.concat(b, F.col("tokens")))))
    none = F.array().cast("array<struct<start:int,end:int,base:boolean,value:string,kind:string>>")
    some = F.when(F.size("base") + F.size("tokens") > 0, both).otherwise(none)
    return rows.withColumns({"base": F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))),
                              "found": _with_patterns(t, some)}).drop("tokens")


def _occurrences(texts: DataFrame, grams: DataFrame, bits: int = BITS) -> DataFrame:
    """``gram, total``: how often each word or pair of words in ``grams`` stands in the texts, whatever stands beside it."""
    place = lambda g: F.xxhash64(g).bitwiseAND(F.lit(bits - 1))
    one = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(31)).cast("int"))
    filled = dict(grams.groupBy(F.shiftright(place(F.col("gram")), 5).alias("at")).agg(
        F.bit_or(one(place(F.col("gram")))).alias("b")).collect())  # at most bits / 32 rows
    bitmap = F.expr(f"array({', '.join(f'{filled.get(i, 0)}L' for i in range(bits // 32))})")

    def known(g: Column) -> Column:
        return let(place(g), lambda p: F.get(bitmap, F.shiftright(p, 5).cast("int")).bitwiseAND(one(p)) != 0)

    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0)
    pairs = lambda w: F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    passed = let(words, lambda w: F.concat(F.filter(w, known), F.filter(pairs(w), lambda g: g.isNotNull() & known(g))))
    stood = texts.where("text is not null").select(F.explode(passed).alias("gram"))
    return stood.groupBy("gram").agg(F.count("*").alias("total")).join(grams, "gram")


def learn(found: DataFrame, texts: DataFrame, min_seeds: int = MIN_SEEDS,
          min_confidence: float = MIN_CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """``pattern, confidence`` of the patterns to trust, from rows of ``found`` and the corpus ``text``."""
    each = found.select(F.explode("found").alias("s")).select(F.explode("s.patterns").alias("pattern"), "s.value", "s.seed")
    edges = stored(each.groupBy("pattern", "value").agg(F.count("*").alias("n"), F.max(F.col("seed").cast("double")).alias("seed")), "pattern-instances")
    # a pattern needs that many different instances, promoted or not
    wide = stored(edges.groupBy("pattern").agg(F.count("*").alias("values")).where(F.col("values") >= min_seeds)
                  .select("pattern", F.substring("pattern", 3, 2**31 - 1).alias("gram")), "wide-patterns")
    total = stored(_occurrences(texts, stored(wide.select("gram").distinct(), "grams")), "pattern-totals")
    totals = stored(wide.join(total, "gram", "left").select("pattern", F.coalesce("total", F.lit(0)).alias("total")), "totals")
    graph = stored(edges.join(wide.select("pattern"), "pattern"), "graph")
    score = stored(graph.groupBy("value").agg(F.max("seed").alias("score")), "instance-scores")
    conf = None
    for _ in range(rounds):
        # an instance glued to the word beside it is not in the totals
        hits = graph.join(score, "value").groupBy("pattern").agg(
            F.sum(F.col("n") * F.col("score")).alias("hit"), F.sum("n").alias("followed"),
            F.count_if(F.col("score") >= min_confidence).alias("support"))
        conf = stored(hits.where(F.col("support") >= min_seeds).join(totals, "pattern").select("pattern", (
            F.col("hit") / F.greatest("followed", "total")).alias("confidence")).where(F.col("confidence") >= min_confidence), "trusted-patterns")
        raised = graph.join(conf, "pattern", "left").groupBy("value").agg(F.greatest(F.max("seed"), 1 - F.product(
            1 - F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.999)))).alias("score"))
        score = stored(raised, "instance-scores")
    return conf


def annotate(docs: DataFrame, text_col: str = "text", min_seeds: int = MIN_SEEDS,
             min_confidence: float = MIN_CONFIDENCE, rounds: int = ROUNDS, keep_text: bool = True) -> DataFrame:
    """Columns of ``docs`` (without the text unless ``keep_text``) plus ``pii_spans``.

    ``pii_spans``: array<struct<kind,start,end>>, base kinds in order, then
    ``id``; each by start; code points, end exclusive.
    """
    carried = [c for c in docs.columns if keep_text or c != text_col]
    plain = docs.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(docs.columns)])
    text = f"in_{docs.columns.index(text_col)}"
    rows = spans(plain, text).withColumn("uid", F.monotonically_increasing_id())
    if not keep_text:
        slim = stored(rows.drop(text), "pii-rows")
        texts = docs.select(F.col(text_col).alias("text"))
    else:
        slim = stored(rows, "pii-rows")
        texts = slim.select(F.col(text).alias("text"))
    patterns = stored(learn(slim.select("found"), texts, min_seeds, min_confidence, rounds).select("pattern"), "patterns")
    tokens = slim.select("uid", F.explode(F.filter("found", lambda s: ~s["base"])).alias("s")) \
        .select("uid", "s.start", "s.end", F.explode("s.patterns").alias("pattern"))
    ids = tokens.join(patterns, "pattern").select("uid", "start", "end").distinct() \
        .groupBy("uid").agg(F.sort_array(F.collect_list(F.struct(F.lit(FOUND).alias("kind"), "start", "end"))).alias("ids"))
    ids = stored(ids, "found-spans")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return slim.join(ids, "uid", "left").select(
        *[F.col(f"in_{docs.columns.index(c)}").alias(c) for c in carried],
        F.concat("base", F.coalesce("ids", none)).alias(free_name(docs, "pii_spans")))


def redact(docs: DataFrame, text_col: str = "text", **learning) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    at = free_name(docs, "pii_spans")
    t = F.col(text_col)
    ordered = F.array_sort(F.transform(at, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def rebuild(m: Column, chunks: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            begin = F.when(i == 0, F.lit(0)).otherwise(F.get(m, i - 1)["end"])
            return F.concat(_cut(chunks, begin, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.concat(F.array_join(F.transform(m, piece), ""), _cut(chunks, F.element_at(m, -1)["end"], F.length(t)))

    clean = F.when(F.size(at) > 0, let(_merged(ordered), lambda m: let(_chunks(t), lambda c: rebuild(m, c)))).otherwise(t)
    found = annotate(docs, text_col, **learning)
    return found.select(*[clean.alias(c) if c == text_col else F.col(c) for c in docs.columns])
