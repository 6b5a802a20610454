"""Exact substring dedup with an enhanced suffix array's common-prefix interval tree.

Every byte covered by a ``MIN_BYTES`` string that also starts earlier in the
corpus is removed. All such strings sit in maximal repeats, and a task finds
these by a stack scan over the longest-common-prefix intervals of a suffix
array, keeping the left-maximal ones with all their occurrences. To bring the
occurrences together without moving the corpus to every task:

1. Each window of ``MIN_BYTES`` bytes has an anchor, the smallest hash of its
   ``GRAM``-byte strings, so equal windows have equal anchors. Consecutive
   windows with one anchor form a run. Runs travel as a few numbers: anchor,
   hash of the run's bytes, document, place.
2. Runs with equal bytes are one class. Its first run stays, the others are
   covered whole. This already settles copies and the inside of shared
   passages; map tasks do it for their own texts first.
3. Only anchors with several classes (edges of passages, edits) need bytes:
   the first run of each class is fetched from its text, dealt by anchor,
   and the task's suffix array finds the maximal repeats among them.

An anchor with more than ``HOT_CLASSES`` classes, or more than ``HOT_BYTES``
bytes in them, would be too much for one suffix array. Its windows are hashed instead and grouped by Spark with partial
aggregation; the result is the same. Map tasks that see ``LOCAL_HOT``
classes of one anchor send them that way at once.

Order: smaller id, then earlier start. Defined results: null text is empty.
If ids are not unique and non-null, rows are put in the order of (id, text),
nulls first, and of repeated rows one counts as the earlier. Texts under
``MIN_BYTES`` bytes lose nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BinaryType, BooleanType, ByteType, IntegerType, LongType, StringType, StructField,
                               StructType)

from ticksmith.llm.byte_hashes import MIX, gram_hashes, stir
from ticksmith.llm.common import lean, small_batches, stored
from ticksmith.llm.suffix_bytes import RepeatedSuffixes

MIN_BYTES = 100
GRAM = 24
#: Windows of one run at most.
RUN = 4096
HOT_CLASSES = 20_000
HOT_BYTES = 4_000_000
LOCAL_HOT = 2048
#: Runs that a map task gathers before it deals them, and that a reduce task holds of one bucket.
DEAL_RUNS = 500_000
HOLD_RUNS = 2_000_000
#: Text bytes a map task works on at once (longer texts overlap by a window), and run bytes of one suffix array.
CHUNK = 1_000_000
ARRAY_BYTES = 1_000_000

RUN_TYPE = np.dtype([("m", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("n", "<u4")])
COVER, RUNS, HOT = 0, 1, 2
#: Flag in ``n``: the run may hold a window twice.
SELF = 1 << 31


# --- runs of windows ------------------------------------------------------

def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    out, size = h.copy(), 1
    while size * 2 <= width:
        out[:-size] = np.minimum(out[:-size], out[size:])
        size *= 2
    if size < width:
        shift = width - size
        out[:-shift] = np.minimum(out[:-shift], out[shift:])
    return out


def find_runs(data: np.ndarray, starts: np.ndarray, docs: np.ndarray, base: np.ndarray, least: int, gram: int) -> np.ndarray:
    """All runs of the pieces of text: anchor, hash of bytes, document, place in its text, number of bytes.

    ``base``: where each piece begins in its document.
    """
    n = len(data)
    size = np.diff(starts)
    if n < least or not (size >= least).any():
        return np.zeros(0, RUN_TYPE)
    h = gram_hashes(data, gram)
    # places of the first and the last smallest gram of each window: the hash's top bits with the place below
    place = np.uint64((1 << n.bit_length()) - 1)
    at = np.arange(n, dtype=np.uint64)
    top = h & ~place
    left = _sliding_min(top | at, least - gram + 1) & place
    twice = left != place - (_sliding_min(top | (place - at), least - gram + 1) & place)
    low = h[left.astype(np.int64)]
    twice[1:] |= (left[1:] != left[:-1]) & (low[1:] == low[:-1])
    del top, at
    text = np.repeat(np.arange(len(size)), size)
    valid = np.arange(n) + least <= starts[1:][text]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    end = np.flatnonzero(stop) + 1  # one past the last window's start
    pieces = -(-(end - begin) // RUN)
    if (pieces > 1).any():  # long runs (periodic text) are cut
        begin_, k = np.repeat(begin, pieces), np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        end = np.minimum(begin_ + (k + 1) * RUN, np.repeat(end, pieces))
        begin = begin_ + k * RUN
    length = end - begin + least - 1
    # an anchor that stands twice in a run: the run may repeat windows in itself
    seen = np.concatenate([[0], np.cumsum(twice)])
    own = (seen[end] - seen[begin]) > 0
    # bytes of a run: its grams at multiples of GRAM and the last one, folded in order
    c = length.astype(np.uint64)
    to, live = begin.copy(), np.arange(len(begin))
    last = begin + length - gram
    while len(live):
        here = np.minimum(to[live], last[live])
        x = (c[live] ^ h[here]) * np.uint64(MIX[14])
        c[live] = stir(x, 15)
        live = live[to[live] < last[live]]
        to[live] += gram
    out = np.empty(len(begin), RUN_TYPE)
    out["m"], out["c"], out["doc"] = low[begin], c, docs[text[begin]]
    out["at"], out["n"] = begin - starts[text[begin]] + base[text[begin]], length | (own * SELF)
    return out


def split_classes(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first run of each class, all others), both by anchor and class."""
    order = np.lexsort((runs["at"], runs["doc"], runs["c"], runs["m"]))
    r = runs[order]
    new = np.ones(len(r), bool)
    new[1:] = (r["m"][1:] != r["m"][:-1]) | (r["c"][1:] != r["c"][:-1])
    return r[new], r[~new]


def _counts(firsts: np.ndarray) -> np.ndarray:
    """Classes of each run's anchor (``firsts`` by anchor)."""
    if not len(firsts):
        return np.zeros(0, np.int64)
    cut = np.concatenate([[0], np.flatnonzero(firsts["m"][1:] != firsts["m"][:-1]) + 1, [len(firsts)]])
    return np.repeat(np.diff(cut), np.diff(cut))


def _sizes(firsts: np.ndarray) -> np.ndarray:
    """Bytes in all classes of each run's anchor (``firsts`` by anchor)."""
    if not len(firsts):
        return np.zeros(0, np.int64)
    cut = np.concatenate([[0], np.flatnonzero(firsts["m"][1:] != firsts["m"][:-1]) + 1])
    total = np.add.reduceat((firsts["n"] & ~np.uint32(SELF)).astype(np.int64), cut)
    return np.repeat(total, np.diff(np.append(cut, len(firsts))))


def _ends(runs: np.ndarray) -> np.ndarray:
    return runs["at"].astype(np.int64) + (runs["n"] & ~np.uint32(SELF))


def merge_spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as maximal runs (touching spans are one)."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    b, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(b), bool)
    new[1:] = b[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return b[at], reach[np.append(at[1:], len(b)) - 1]


def _rows(kind: int, bucket: np.ndarray, keys: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(bucket, np.int64)), pa.array(np.full(len(blobs), kind, np.int8)),
         pa.array(np.asarray(keys, np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "kind", "doc", "data"])


def _cover_rows(docs: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch | None:
    """One row per document with its united spans."""
    if not len(docs):
        return None
    order = np.argsort(docs, kind="stable")
    docs, begin, end = docs[order], begin[order].astype(np.int64), end[order].astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(docs[1:] != docs[:-1]) + 1, [len(docs)]])
    blobs = [np.stack(merge_spans(begin[a:b], end[a:b]), 1).astype("<i8").tobytes() for a, b in zip(cut[:-1], cut[1:])]
    return _rows(COVER, docs[cut[:-1]], docs[cut[:-1]], blobs)


def _request_rows(kind: int, runs: np.ndarray) -> pa.RecordBatch | None:
    """One row per document with the runs whose bytes are wanted."""
    if not len(runs):
        return None
    r = runs[np.lexsort((runs["at"], runs["doc"]))]
    cut = np.concatenate([[0], np.flatnonzero(r["doc"][1:] != r["doc"][:-1]) + 1, [len(r)]])
    docs = r["doc"][cut[:-1]]
    return _rows(kind, docs, docs, [r[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])])


_ROW_SCHEMA = StructType([StructField("bucket", LongType()), StructField("kind", ByteType()),
                          StructField("doc", LongType()), StructField("data", BinaryType())])


def _map_runs(texts: DataFrame, least: int, gram: int, buckets: int, local_hot: int) -> DataFrame:
    """Rows of ``kind``: covers found locally, packed runs per bucket, requests of hot anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for b in batches:
            ids, col = b.column(0).to_numpy(), b.column(1).cast(pa.binary())
            pieces: list[tuple[int, int, bytes]] = []
            size = 0
            for doc, x in zip(ids.tolist(), col):
                raw = x.as_py()
                for at in range(0, max(1, len(raw)), CHUNK):
                    part = raw[at:at + CHUNK + least - 1]
                    if pieces and size + len(part) > CHUNK:
                        held.append(found(pieces))
                        n += len(held[-1])
                        pieces, size = [], 0
                        if n >= DEAL_RUNS:
                            yield from deal(np.concatenate(held))
                            held, n = [], 0
                    pieces.append((doc, at, part))
                    size += len(part)
            if pieces:
                held.append(found(pieces))
                n += len(held[-1])
        if n:
            yield from deal(np.concatenate(held))

    def found(pieces: list[tuple[int, int, bytes]]) -> np.ndarray:
        docs, base = (np.array([x[k] for x in pieces], np.int64) for k in (0, 1))
        starts = np.concatenate([[0], np.cumsum([len(x[2]) for x in pieces])]).astype(np.int64)
        return find_runs(np.frombuffer(b"".join([x[2] for x in pieces]), np.uint8), starts, docs, base, least, gram)

    def deal(runs: np.ndarray) -> Iterator[pa.RecordBatch]:
        firsts, others = split_classes(runs)
        rows = _cover_rows(others["doc"], others["at"], _ends(others))
        if rows is not None:
            yield rows
        n = _counts(firsts)
        hot = firsts[n > local_hot]
        if len(hot):
            yield _request_rows(HOT, hot)
            marks = np.unique(hot["m"])  # tell the bucket that these anchors are hot
            told = np.zeros(len(marks), RUN_TYPE)
            told["m"] = marks
            firsts = np.concatenate([firsts[n <= local_hot], told])
        bucket = (firsts["m"] >> np.uint64(11)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        firsts, bucket = firsts[order], bucket[order]
        cut = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
        if len(bucket):
            yield _rows(RUNS, bucket[cut[:-1]].astype(np.int64), np.zeros(len(cut) - 1),
                        [_pack(firsts[a:e]) for a, e in zip(cut[:-1], cut[1:])])

    return texts.mapInArrow(lean(run), _ROW_SCHEMA)


def _pack(runs: np.ndarray) -> bytes:
    """Column by column: it compresses better than row by row."""
    return b"".join(np.ascontiguousarray(runs[f]).tobytes() for f in RUN_TYPE.names)


def _unpack(data: bytes) -> np.ndarray:
    n = len(data) // RUN_TYPE.itemsize
    out, at = np.empty(n, RUN_TYPE), 0
    for f in RUN_TYPE.names:
        kind = RUN_TYPE[f]
        out[f] = np.frombuffer(data, kind, n, at)
        at += n * kind.itemsize
    return out


class _Out:
    """Covers and requests gathered over many runs, so that a document gets few rows from a task."""

    def __init__(self) -> None:
        self.covers: list[np.ndarray] = []
        self.asked: dict[int, list[np.ndarray]] = {RUNS: [], HOT: []}
        self.n = 0

    def cover(self, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        if len(doc):
            self.covers.append(np.stack([doc.astype(np.int64), begin.astype(np.int64), end.astype(np.int64)]))
            self.n += len(doc)

    def ask(self, kind: int, runs: np.ndarray) -> None:
        if len(runs):
            self.asked[kind].append(runs)
            self.n += len(runs)

    def rows(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        """All that was gathered, if it is ``least`` entries or more."""
        if self.n < least:
            return
        if self.covers:
            yield _cover_rows(*np.concatenate(self.covers, axis=1))
        for kind, runs in self.asked.items():
            if runs:
                yield _request_rows(kind, np.concatenate(runs))
        self.__init__()


class _Bucket:
    """Runs of one bucket as they arrive; large anchors go the other way as soon as they are known."""

    def __init__(self, limit: int, most: int, out: _Out) -> None:
        self.limit, self.most, self.out = limit, most, out
        self.held: list[np.ndarray] = []
        self.n, self.hot = 0, np.zeros(0, np.uint64)

    def add(self, runs: np.ndarray) -> None:
        self.held.append(runs)
        self.n += len(runs)
        if self.n >= HOLD_RUNS:
            firsts = self._settle()
            self.held, self.n = [firsts], len(firsts)

    def _settle(self) -> np.ndarray:
        """Covers and hot requests go out; the first runs of the other anchors remain."""
        runs = np.concatenate(self.held)
        told = runs["n"] == 0
        self.hot = np.union1d(self.hot, runs["m"][told])
        firsts, others = split_classes(runs[~told])
        self.hot = np.union1d(self.hot, firsts["m"][(_counts(firsts) > self.limit) | (_sizes(firsts) > self.most)])
        is_hot = np.isin(firsts["m"], self.hot)
        self.out.cover(others["doc"], others["at"], _ends(others))
        self.out.ask(HOT, firsts[is_hot])
        return firsts[~is_hot]

    def close(self) -> None:
        if self.n:
            firsts = self._settle()
            self.out.ask(RUNS, firsts[(_counts(firsts) > 1) | (firsts["n"] >= SELF)])


def _reduce_runs(rows: DataFrame, hot: int, most: int) -> DataFrame:
    """Covers and requests, from the runs of whole buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out()
        at, bucket = None, _Bucket(hot, most, out)
        for b in batches:
            kinds = b.column(1).to_numpy()
            passed = np.flatnonzero(kinds != RUNS)
            if len(passed):
                yield b.take(pa.array(passed))
            for i in np.flatnonzero(kinds == RUNS).tolist():
                here = b.column(0)[i].as_py()
                if here != at:
                    bucket.close()
                    at, bucket = here, _Bucket(hot, most, out)
                bucket.add(_unpack(b.column(3)[i].as_py()))
                yield from out.rows(DEAL_RUNS)
        bucket.close()
        yield from out.rows()

    return rows.repartition("bucket").sortWithinPartitions("kind", "bucket").mapInArrow(lean(run), _ROW_SCHEMA)


# --- bytes of the undecided runs ------------------------------------------

_RUN_BYTES = StructType([StructField("anchor", LongType()), StructField("kind", ByteType()), StructField("doc", LongType()),
                         StructField("at", IntegerType()), StructField("bytes", BinaryType())])


def _fetch(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """The bytes of the runs asked for."""
    wanted = asked.groupBy("doc", "kind").agg(F.collect_list("data").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            size = 0
            for doc, kind, blobs, text in zip(b.column(0), b.column(1), b.column(2), b.column(3)):
                raw = text.as_py().encode("utf-8", "replace")
                doc, kind = doc.as_py(), kind.as_py()
                for blob in blobs.as_py():
                    r = np.frombuffer(blob, RUN_TYPE)
                    for m, at, n in zip(r["m"].view(np.int64).tolist(), r["at"].tolist(), (r["n"] & ~np.uint32(SELF)).tolist()):
                        for c, v in zip(cols, (m, kind, doc, at, raw[at:at + n])):
                            c.append(v)
                        size += n
                if size > 4_000_000:
                    yield _run_batch(cols)
                    cols, size = [[] for _ in range(5)], 0
            if cols[0]:
                yield _run_batch(cols)

    joined = wanted.join(texts, "doc").select("doc", "kind", "data", "text")
    return joined.mapInArrow(lean(run), _RUN_BYTES)


def _run_batch(cols: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int8(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_RUN_BYTES.names)


REPEATS = StructType([StructField("repeat", LongType()), StructField("length", LongType()), StructField("doc", LongType()),
                      StructField("start", LongType()), StructField("first", BooleanType())])


def array_repeats(doc: np.ndarray, at: np.ndarray, strings: list[bytes], least: int,
                  out: _Out | None = None) -> pa.RecordBatch | None:
    """The maximal repeats among the runs of some whole anchors.

    One row per occurrence; with ``out``, the spans of all but first
    occurrences go there instead.
    """
    starts = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
    sa = RepeatedSuffixes(np.frombuffer(b"".join(strings), np.uint8), starts, least)
    # places in corpus order: by document, then place in the text
    where, place = doc[sa.string], at[sa.string] + sa.order - starts[sa.string]
    rank = np.empty(len(place), np.int64)
    rank[np.lexsort((place, where))] = np.arange(len(place))
    found = sa.maximal_repeats(rank)
    if not found:
        return None
    e, n, f = (np.array(x, np.int64) for x in zip(*found))
    if out is not None:
        out.cover(where[e], place[e], place[e] + n)
        return None
    heads = list(set(zip(f.tolist(), n.tolist())))
    raw = b"".join(strings)
    name = {h: xxhash.xxh64_intdigest(raw[sa.order[h[0]]:sa.order[h[0]] + h[1]]) for h in heads}
    p = np.append(e, [h[0] for h in heads])
    size = np.append(n, [h[1] for h in heads])
    g = np.array([name[x] for x in zip(f.tolist(), n.tolist())] + [name[h] for h in heads], np.uint64).view(np.int64)
    first = np.arange(len(p)) >= len(e)
    return pa.RecordBatch.from_arrays([pa.array(g), pa.array(size), pa.array(where[p]), pa.array(place[p]), pa.array(first)],
                                      names=REPEATS.names)


def _by_arrays(runs: DataFrame, least: int, as_covers: bool) -> DataFrame:
    """``array_repeats`` of the runs, dealt by anchor; one array holds whole anchors of about ``ARRAY_BYTES``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        out = _Out() if as_covers else None

        def solve() -> Iterator[pa.RecordBatch]:
            rows = array_repeats(np.array([x[1] for x in held], np.int64), np.array([x[2] for x in held], np.int64),
                                 [x[3] for x in held], least, out)
            if rows is not None:
                yield rows
            elif out is not None:
                yield from out.rows(DEAL_RUNS)

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(4))):
                if size >= ARRAY_BYTES and row[0] != held[-1][0]:
                    yield from solve()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield from solve()
        if out is not None:
            yield from out.rows()

    return runs.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "doc", "at", "bytes") \
        .mapInArrow(lean(run), _ROW_SCHEMA if as_covers else REPEATS)


def _by_windows(runs: DataFrame, least: int) -> DataFrame:
    """The same for anchors with too many classes: every window hashed and grouped."""
    schema = StructType([StructField("repeat", LongType()), StructField("check", LongType()), StructField("doc", LongType()),
                         StructField("start", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, at, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                n = len(raw) - least + 1
                both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[i:i + least]) for i in range(n)]), ">i8").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[::2]), pa.array(both[1::2]), pa.array(np.full(n, doc)),
                                                  pa.array(at + np.arange(n, dtype=np.int64))], names=schema.names)

    windows = stored(runs.select("doc", "at", "bytes").mapInArrow(run, schema), "hot-windows")
    first = stored(windows.groupBy("repeat", "check").agg(F.min(F.struct("doc", "start")).alias("m"), F.count("*").alias("n"))
                   .where("n > 1").select("repeat", "check", "m"), "hot-firsts")
    return windows.join(first, ["repeat", "check"]).select(
        "repeat", F.lit(least).cast("long").alias("length"), "doc", "start",
        ((F.col("m.doc") == F.col("doc")) & (F.col("m.start") == F.col("start"))).alias("first"))


# --- the operator ---------------------------------------------------------

def ordered_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, text, doc_id``; ``doc`` is a unique long in corpus order, the id itself if it will do."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, ids = src.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == ids and dict(src.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint"):
        return src.select(F.col("doc_id").cast("long").alias("doc"), "text", "doc_id")
    return stored(src.orderBy("doc_id", "text").select(F.monotonically_increasing_id().alias("doc"), "text", "doc_id"),
                  "ordered-texts")


def _runs(texts: DataFrame, least: int, gram: int, hot_classes: int, local_hot: int, hot_bytes: int) -> DataFrame:
    """``kind, doc, data``: covers of whole runs, and the runs whose bytes are needed."""
    buckets = 8 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(_reduce_runs(_map_runs(texts, least, gram, buckets, local_hot), hot_classes, hot_bytes).drop("bucket"), "runs")


def repeats(texts: DataFrame, least: int = MIN_BYTES, gram: int = GRAM, hot_classes: int = HOT_CLASSES,
            local_hot: int = LOCAL_HOT, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``repeat, length, doc, start, first``: the maximal repeats of ``doc, text`` with all their occurrences.

    Runs with equal bytes are listed as one repeat too; a repeat longer than
    a run appears as the overlapping parts that its runs hold. Occurrences
    inside a longer listed repeat are left to that one.
    """
    settled = _runs(texts, least, gram, hot_classes, local_hot, hot_bytes)
    found = _by_arrays(_fetch(texts, settled.where(F.col("kind") == RUNS)), least, False)
    hot = settled.where(F.col("kind") == HOT)
    return found if hot.isEmpty() else found.unionByName(_by_windows(_fetch(texts, hot), least))


def _covers(texts: DataFrame, least: int, gram: int, hot_classes: int, local_hot: int, hot_bytes: int) -> DataFrame:
    """``doc, data, s, e``: packed spans, and begins and ends, of all that goes."""
    settled = _runs(texts, least, gram, hot_classes, local_hot, hot_bytes)
    whole = settled.where(F.col("kind") == COVER).select("doc", "data")
    # one fetch for both ways, whether or not some anchor is hot
    runs = stored(_fetch(texts, settled.where(F.col("kind") != COVER)), "run-bytes")
    edges = stored(_by_arrays(runs.where(F.col("kind") == RUNS), least, True).select("doc", "data"), "edges")
    packed = whole.unionByName(edges).groupBy("doc").agg(F.collect_list("data").alias("data"))
    hot = settled.where(F.col("kind") == HOT)
    if hot.isEmpty():
        none = F.lit(None).cast("array<bigint>")
        return packed.select("doc", "data", none.alias("s"), none.alias("e"))
    again = _by_windows(runs.where(F.col("kind") == HOT), least).where(~F.col("first")).groupBy("doc").agg(
        F.collect_list("start").alias("s"), F.collect_list(F.col("start") + F.col("length")).alias("e"))
    return packed.join(stored(again, "hot-spans"), "doc", "full")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_BYTES, gram: int = GRAM,
          hot_classes: int = HOT_CLASSES, local_hot: int = LOCAL_HOT, hot_bytes: int = HOT_BYTES,
          with_bytes: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row, and the ``kept`` bytes if asked for."""
    small_batches(docs.sparkSession)
    texts = ordered_texts(docs, id_col, text_col)
    cover = _covers(texts.select("doc", "text"), least, gram, hot_classes, local_hot, hot_bytes)
    schema = StructType([texts.schema["doc_id"], StructField("n_bytes", LongType()), StructField("n_removed", LongType()),
                         StructField("n_spans", LongType()), StructField("kept_sha256", StringType()),
                         *([StructField("kept", BinaryType())] if with_bytes else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(4)]
            kept_bytes = []
            for text, blobs, s, e in zip(*(b.column(k) for k in range(1, 5))):
                raw = text.as_py().encode("utf-8", "replace")
                spans = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in blobs.as_py() or []]
                if s.is_valid and len(s):
                    spans.append(np.stack([np.array(s.as_py(), np.int64), np.array(e.as_py(), np.int64)], 1))
                kept = raw
                begin = end = np.zeros(0, np.int64)
                if spans:
                    every = np.concatenate(spans)
                    begin, end = merge_spans(every[:, 0], every[:, 1])
                    cuts = [0, *np.stack([begin, end], 1).ravel().tolist(), len(raw)]
                    kept = b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2]))
                for c, v in zip(out, (len(raw), int((end - begin).sum()), len(begin), hashlib.sha256(kept).hexdigest())):
                    c.append(v)
                if with_bytes:
                    kept_bytes.append(kept)
            arrays = [b.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(kept_bytes, pa.binary())] if with_bytes else []),
                                             names=schema.names)

    return texts.join(cover, "doc", "left").select("doc_id", "text", "data", "s", "e").mapInArrow(lean(run), schema)
