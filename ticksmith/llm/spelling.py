"""Spelling variants: words one edit apart, grouped under their frequent form.

Counts. Words are maximal letter runs, lower-cased (A-Z only); a fixed share of
the runs, chosen by a hash of document id and run, loses one letter. Counts are
summed per batch, then by word. Words with fewer than ``MIN_CHARS`` code points
or ``MIN_COUNT`` occurrences are no words here.

Asymmetric q-chunks. Of two words one edit apart let x be the shorter (of equal
length, either). x is cut into two disjoint chunks, its halves; the edit
leaves one of them whole, and in y it stands at the same place or one further,
by the difference of the lengths. So x contributes its two chunks and y the
positional grams of the same lengths within shift one; equal chunk, equal place and equal
length of x join, and the pair is verified.

Frequent chunks (a third of all words may share a beginning) are split, not
paired: what is left of x and of y beside an equal chunk must again be one edit
apart, so the same step is taken on the rests, with the chunk in the key,
until a group's pairs are at most ``PAIRS`` for each of its members. No pair is lost and
no group is ever gathered: groups are counted by partial sums and joined
between written tables.

A word's form is its near word of the largest count (ties: the smallest), if
that is ``RATIO`` times its own; counts grow tenfold with every step, so forms
followed to the last (by pointer doubling) end after a few rounds.

Defined results: null and empty texts have no runs, a null id counts as empty
text; repeated rows count twice; extra columns are not read; an empty table
gives no rows. A batch holds the distinct words of its texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticksmith.llm.common import lean, small_batches, stored, text_chunks

MIN_CHARS, MIN_COUNT = 7, 2
#: One in so many (document, run) pairs loses a letter.
TYPO_EVERY = 31
RATIO = 10
#: Pairs to verify for each member of a chunk group; groups beyond are split.
PAIRS = 32

_UPPER = {c: c + 32 for c in range(65, 91)}


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_count: int = MIN_COUNT, typo_every: int = TYPO_EVERY) -> DataFrame:
    """``word, n`` of the words of whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long_run = re.compile("[A-Za-zÀ-ÿ]{%d,}" % min_chars)  # losing a letter never lengthens a run
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in text_chunks(texts):
                total: dict[str, int] = {}
                for i in range(lo, hi):
                    own: dict[str, int] = {}
                    for r in long_run.findall(texts[i] or ""):
                        r = r.lower() if r.isascii() else r.translate(_UPPER)
                        own[r] = own.get(r, 0) + 1
                    prefix = zlib.crc32(f"{'' if ids[i] is None else ids[i]}:".encode())
                    for r, n in own.items():
                        h = zlib.crc32(r.encode(), prefix)
                        if h % typo_every == 0:
                            at = h % len(r)
                            r = r[:at] + r[at + 1:]
                            if len(r) < min_chars:
                                continue
                        total[r] = total.get(r, 0) + n
                yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    small_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(lean(run), "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _halved(side: str, key: list[Column], whole: Column, length: Column, extra: Column) -> Column:
    """Both chunks of a rest: of x its halves, of y the grams in their places (``extra``: how much longer y is)."""
    half = F.floor((length - extra) / 2).cast("int")
    tail = length - extra - half

    def entry(kind: int, chunk: Column, rest: Column) -> Column:
        return F.struct(F.xxhash64(*key, F.lit(kind), chunk).alias("key"), F.lit(side).alias("side"), rest.alias("rest"))

    return F.array(entry(0, F.substring(whole, F.lit(1), half), F.substring(whole, half + 1, length)),
                   entry(1, F.substring(whole, length - tail + 1, tail), F.substring(whole, F.lit(1), length - tail)))


def near_pairs(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """``x, y``: all pairs of different ``word`` values exactly one edit apart, each once (x the shorter, or the smaller).

    Words have two code points or more; shorter ones take no part.
    """
    size = F.length("word")
    # y looks for an x of its own length and for one a letter shorter
    roles = words.where(size >= 2).select("word", F.explode(F.array(*[
        F.struct(F.lit(s).alias("s"), F.lit(d).alias("d"), F.lit(longer).alias("longer"))
        for s, d, longer in (("x", 0, False), ("x", 0, True), ("y", 0, False), ("y", 1, True))])).alias("r"))
    key = [F.col("r.longer"), size - F.col("r.d")]
    entries = roles.select("word", F.col("r.d").alias("d"), F.explode(F.when(F.col("r.s") == "x", _halved("x", key, F.col("word"), size, F.lit(0))).otherwise(
        _halved("y", key, F.col("word"), size, F.col("r.d")))).alias("e")).select("word", "d", "e.*")
    found = []
    for _ in range(40):  # a rest is half as long each time
        entries = stored(entries, "chunk-entries")
        groups = entries.groupBy("key").agg(
            F.count_if(F.col("side") == "x").alias("xs"), F.count_if(F.col("side") == "y").alias("ys"),
            F.max(F.when(F.col("side") == "x", F.length("rest"))).alias("left"))
        large = stored(groups.where((F.col("xs") * F.col("ys") > F.lit(pairs) * (F.col("xs") + F.col("ys"))) & (F.col("left") >= 2))
                       .select("key"), "large-groups")
        more = not large.isEmpty()
        small = entries.join(large, "key", "left_anti") if more else entries
        x = small.where("side = 'x'").select("key", F.col("word").alias("x"))
        y = small.where("side = 'y'").select("key", F.col("word").alias("y"))
        one = (F.levenshtein("x", "y", 1) == 1) & ((F.length("x") < F.length("y")) | (F.col("x") < F.col("y")))
        found.append(stored(x.join(y, "key").where(one).select("x", "y").distinct(), "near"))
        if not more:
            break
        rest = F.length("rest")
        entries = entries.join(large, "key", "left_semi").select("word", "d", F.explode(F.when(
            F.col("side") == "x", _halved("x", [F.col("key")], F.col("rest"), rest, F.lit(0))).otherwise(
            _halved("y", [F.col("key")], F.col("rest"), rest, F.col("d")))).alias("e")).select("word", "d", "e.*")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def variants(counts: DataFrame, ratio: int = RATIO, pairs: int = PAIRS) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of ``word, n`` (each word once)."""
    words = stored(counts.select("word", "n"), "words")
    linked = stored(near_pairs(words.select("word"), pairs), "near-pairs")
    both = linked.unionByName(linked.select(F.col("y").alias("x"), F.col("x").alias("y")))
    seen = both.join(words.select(F.col("word").alias("y"), F.col("n").alias("m")), "y") \
        .groupBy("x").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("y").alias("form"))).alias("best"))
    best = words.join(seen.withColumnRenamed("x", "word"), "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    formed = stored(best.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                F.when(enough, F.col("best.form")).alias("form"),
                                F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    links = stored(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if links.join(onward, "root", "left_semi").isEmpty():
            break
        links = stored(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return formed.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
