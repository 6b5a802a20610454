"""Token counts per section by offset-mapped attribution.

A document is encoded once, as a whole. Tokens of a byte-level vocabulary
follow each other without gaps, so their lengths give their character spans.
The spans are interval-joined to the document's sections by binary search
over the section starts. A token that crosses a section boundary counts
where most of its characters lie, and in the earlier section on a tie; a
token inside a character that several tokens share has that character's
span.

Sections default to lines (a line feed ends its line). Defined results: null
and empty texts have one empty section without tokens. Repeated rows are
counted alike. Extra columns are ignored. Documents never meet, so nothing
is shuffled and no key can be hot.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ticksmith.llm.common import lean, small_batches

VOCABULARY = "byte_bpe_50k.tiktoken"


def load_encoder(path: str):
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def line_starts(text: str) -> np.ndarray:
    """Where each line begins; the first at 0. (A line feed at the very end begins an empty last line.)"""
    starts, at = [0], text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(starts, np.int64)


def spans(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens of ``sizes`` bytes that make up ``data``."""
    raw = np.frombuffer(data, np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character each byte belongs to
    end = np.cumsum(sizes)
    return char[end - sizes], char[end - 1] + 1


def attribute(start: np.ndarray, end: np.ndarray, sections: np.ndarray, length: int) -> np.ndarray:
    """The section of each token span, by the majority rule; ``sections`` are sorted starts."""
    first = np.searchsorted(sections, start, "right") - 1
    last = np.searchsorted(sections, end - 1, "right") - 1
    edge = np.append(sections, length)
    for i in np.flatnonzero(first != last):
        s = np.arange(first[i], last[i] + 1)
        inside = np.minimum(edge[s + 1], end[i]) - np.maximum(edge[s], start[i])
        first[i] = s[int(inside.argmax())]  # the first of equals
    return first


def count_by_section(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     sections: Callable[[str], np.ndarray] = line_starts, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, section, start, end, n_tokens, n_crossing`` for every section of every document.

    ``start`` and ``end`` are character offsets; ``n_crossing`` counts the
    section's tokens that also reach into another one.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["section", "start", "end", "n_tokens", "n_crossing"]
    schema = StructType([src.schema["doc_id"], StructField("section", IntegerType()),
                         *[StructField(n, LongType()) for n in names[1:]]])
    if vocabulary is None:
        import public_tokenizers
        vocabulary = public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ranks = load_encoder(vocabulary)
        size_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            size_of[i] = len(token)
        for b in batches:
            rows: list[np.ndarray] = []
            cols: list[list[np.ndarray]] = [[] for _ in names]
            held = 0

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.concatenate(rows)))] + [
                        pa.array(np.concatenate(c), pa.int32() if n == "section" else pa.int64()) for n, c in zip(names, cols)],
                    names=["doc_id", *names])

            for i, text in enumerate(b.column(1).to_pylist()):
                text = text or ""
                starts = sections(text)
                counts = np.zeros((2, len(starts)), np.int64)
                if text:
                    sizes = size_of[np.array(encoder.encode_ordinary(text), np.int64)]
                    a, e = spans(text.encode("utf-8", "replace"), sizes)
                    own = attribute(a, e, starts, len(text))
                    ends = np.append(starts[1:], len(text))
                    counts[0] = np.bincount(own, minlength=len(starts))
                    counts[1] = np.bincount(own[(a < starts[own]) | (e > ends[own])], minlength=len(starts))
                rows.append(np.full(len(starts), i))
                for c, v in zip(cols, (np.arange(len(starts)), starts, np.append(starts[1:], len(text)), *counts)):
                    c.append(v)
                held += len(starts)
                if held > 100_000:
                    yield flush()
                    rows, held = [], 0
                    cols = [[] for _ in names]
            if rows:
                yield flush()

    small_batches(docs.sparkSession)
    return src.mapInArrow(lean(run), schema)
