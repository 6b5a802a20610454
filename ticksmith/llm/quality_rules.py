"""Quality rules with suffix-array repetition.

Each text's word suffix array gives its longest-common-prefix (LCP)
intervals. The deepest interval around a suffix names the longest maximal
repeat that starts there; the spans of all occurrences of all repeats of at
least ``min_repeat`` words are united. A text is rejected if the united
spans cover too large a share of its words, or if one repeat is too long,
both besides the plain base rules.

Defined results: a null or blank text has no words, all counts are zero and
the base rules reject it. Repeated rows are judged alike, each by itself.
Extra columns are carried; a clashing name gets underscores added. Work and
memory are per text; texts never meet in a shuffle, so no key can be hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from ticksmith.llm.common import free_name, map_columns, text_chunks
from ticksmith.llm.suffix_words import WordSuffixes, word_ids

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
MAX_REPEAT_WORDS_PCT = 50
MIN_REPEAT = 10
#: Just above every labelled good document that passes the base rules (0.182 and 0.091 of its words).
MAX_COVERED = 0.20
MAX_LONGEST = 0.10

LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
         "n_covered_words", "longest_repeat"]


def _dup_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(BLANKS):
            seen.add(line)
    return n


def repeat_counts(texts: list, min_repeat: int) -> tuple[np.ndarray, ...]:
    """Per text: words, words in repeated 3-word windows, words covered by repeats, longest repeat."""
    ids, starts = word_ids(texts)
    n_words = np.diff(starts)
    sa = WordSuffixes(ids, starts)
    at = np.concatenate([[0], np.cumsum(sa.repeated_windows3())])
    windows = at[starts[1:]] - at[starts[:-1]]
    sa.finish()
    a, b, n = sa.lcp(min_repeat)
    # Depth of the deepest LCP interval around each suffix: the larger of its two neighbours' LCPs.
    depth = np.zeros(len(ids) + 1, np.int64)
    np.maximum.at(depth, a, n)
    np.maximum.at(depth, b, n)
    # Union of the spans [i, i + depth[i]): a word is covered if some span that begins before it reaches it.
    reach = np.maximum.accumulate(np.arange(len(ids)) + depth[:-1]) if len(ids) else depth[:-1]
    covered = np.concatenate([[0], np.cumsum(reach > np.arange(len(ids)))])
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, sa.text_of, depth[:-1])
    return n_words, windows, covered[starts[1:]] - covered[starts[:-1]], longest


def measure(docs: DataFrame, text_col: str = "text", min_repeat: int = MIN_REPEAT,
            into: str = "measures") -> DataFrame:
    """All columns of ``docs`` plus the struct-free measures, prefixed where they would clash."""
    names = [free_name(docs, c) for c in LONGS]

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        cols = np.zeros((len(LONGS), len(texts)), np.int64)
        for lo, hi in text_chunks(texts):
            cols[0, lo:hi], cols[4, lo:hi], cols[5, lo:hi], cols[6, lo:hi] = repeat_counts(texts[lo:hi], min_repeat)
        for i, t in enumerate(texts):
            if t:
                cols[1, i] = len(t) - sum(map(t.count, BLANKS))
                cols[2, i] = sum(map(t.count, SYMBOLS))
                cols[3, i] = _dup_lines(t)
        return [pa.array(c) for c in cols]

    return map_columns(docs, [StructField(c, LongType()) for c in names], fn)


def judge(docs: DataFrame, text_col: str = "text", min_repeat: int = MIN_REPEAT,
          max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST,
          min_words: int = MIN_WORDS, max_repeat_words_pct: int = MAX_REPEAT_WORDS_PCT) -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept``.

    ``max_covered``: largest share of words inside repeats of at least
    ``min_repeat`` words. ``max_longest``: largest share of words that one
    repeat may have.
    """
    c = {name: F.col(free_name(docs, name)) for name in LONGS}
    base_failed = (c["n_words"] < min_words) | \
        (100 * c["n_repeat_words"] > max_repeat_words_pct * c["n_words"])
    repetitive = (c["n_covered_words"] > max_covered * c["n_words"]) | \
        (c["longest_repeat"] > max_longest * c["n_words"])
    return measure(docs, text_col, min_repeat) \
        .withColumn(free_name(docs, "base_failed"), base_failed) \
        .withColumn(free_name(docs, "kept"), ~base_failed & ~repetitive)


def keep(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    return judge(docs, text_col, **limits).where(F.col(free_name(docs, "kept"))).select(*docs.columns)
