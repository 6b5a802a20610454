"""SimHash near-duplicates by a binary-trie self-join.

One 64-bit fingerprint per text from the XXH64 hashes of its word shingles.
Equal fingerprints form one class; only distinct fingerprints are joined.
Two fingerprints within ``max_bits`` bits agree in one of ``max_bits + 1``
blocks of bits at least, so each is dealt to one task per block with that
block turned to the top. A task builds the binary trie of its fingerprints
(as ranges of a sorted array) and walks node pairs together, bit by bit,
adding differing bits and dropping a pair once the budget is exceeded. Block
values with more than ``max_group`` fingerprints are dealt again by blocks of
their remaining bits. A task returns a spanning forest of its links, never
all pairs, and connected components join the forests.

Defined results: a null or blank text has fingerprint zero and is linked
like any other. Repeated rows share a class. A null ``doc_id`` never names a
component unless no other id is in it. Extra columns are ignored, or
carried by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ticksmith.llm.common import free_name, lean, map_columns, stored, text_chunks
from ticksmith.llm.components import components

SEED = 42
SHINGLE = 4
MAX_BITS = 4
#: Fingerprints that share one block value before the value is split further.
MAX_GROUP = 1 << 17
#: Node pairs held at once by a task.
FRONTIER = 1 << 19
#: Shingle hashes spread into bits at once.
BLOCK = 1 << 18


# --- fingerprints ---------------------------------------------------------

def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> list[int]:
    """XXH64 of every word shingle, repeats included; the whole sequence if there are fewer words."""
    w = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, six ASCII blanks part
    if not w:
        return []
    joined = b" ".join(w)
    if len(w) <= words:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = (np.cumsum([len(x) + 1 for x in w]) - 1).tolist()
    starts = [0] + [e + 1 for e in ends[:-words]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], seed) for s, e in zip(starts, ends[words - 1:])]


def fingerprints(texts: list, words: int = SHINGLE) -> np.ndarray:
    """int64 per text: a bit is 1 if more than half the shingle hashes have it."""
    out = np.zeros(len(texts), np.uint64)
    for lo, hi in text_chunks(texts, 1_000_000):
        hashes = [shingle_hashes(t, words) for t in texts[lo:hi]]
        n = np.array([len(h) for h in hashes])
        some = np.flatnonzero(n)
        if not len(some):
            continue
        flat = np.array([x for h in hashes for x in h], ">u8")
        text = np.repeat(np.arange(len(some)), n[some])
        ones = np.zeros((len(some), 64), np.int64)
        for a in range(0, len(flat), BLOCK):  # 64 bytes a hash: a block at a time, however long a text
            bits = np.unpackbits(flat[a:a + BLOCK].view(np.uint8).reshape(-1, 8), axis=1)
            here = text[a:a + BLOCK]
            cut = np.concatenate([[0], np.flatnonzero(here[1:] != here[:-1]) + 1])
            ones[here[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
        packed = np.packbits(2 * ones > n[some][:, None], axis=1)
        out[lo + some] = packed.view(">u8").ravel().astype(np.uint64)
    return out.view(np.int64)


def with_fingerprint(docs: DataFrame, text_col: str = "text", words: int = SHINGLE, name: str = "fingerprint") -> DataFrame:
    def fn(b: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(fingerprints(b.column(b.schema.get_field_index(text_col)).to_pylist(), words))]

    return map_columns(docs, [StructField(name, LongType())], fn)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- trie self-join -------------------------------------------------------

class _Forest:
    """Smallest-member labels under a growing set of links."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


def trie_forest(codes: np.ndarray, prefix: int, max_bits: int, frontier: int = FRONTIER) -> np.ndarray:
    """Label of each of the sorted distinct uint64 ``codes``: the first code it is linked to.

    Only codes equal in their top ``prefix`` bits are compared. Node pairs
    are ranges ``[alo, ahi) x [blo, bhi)`` at one depth with the bits by
    which they differ so far; a range with itself stands for all its pairs.
    """
    n = len(codes)
    forest = _Forest(n)
    ones: dict[int, np.ndarray] = {}

    def split(depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if depth not in ones:
            bit = (codes >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        c = ones[depth]
        return hi - (c[hi] - c[lo])

    top = codes >> np.uint64(64 - prefix) if prefix else np.zeros(n, np.uint64)
    cut = np.concatenate([[0], np.flatnonzero(top[1:] != top[:-1]) + 1, [n]]) if n else np.zeros(1, np.int64)
    lo, hi = cut[:-1], cut[1:]
    big = hi - lo > 1
    lo, hi = lo[big], hi[big]
    stack = [(prefix, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        depth, alo, ahi, blo, bhi, d = stack.pop()
        if not len(d):
            continue
        if len(d) > frontier:
            half = len(d) // 2
            stack += [(depth, *(x[half:] for x in (alo, ahi, blo, bhi, d))),
                      (depth, *(x[:half] for x in (alo, ahi, blo, bhi, d)))]
            continue
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            # two leaves: all that is left of their paths at once
            x, y = alo[single], blo[single]
            near = np.bitwise_count(codes[x] ^ codes[y]) <= max_bits
            forest.link(x[near], y[near])
            alo, ahi, blo, bhi, d = (v[~single] for v in (alo, ahi, blo, bhi, d))
        if depth == 64 or not len(d):
            continue
        am, bm = split(depth, alo, ahi), split(depth, blo, bhi)
        same = alo == blo
        new = []
        # both children 0, both 1, then 0 with 1 and (unless a node meets itself) 1 with 0
        for a0, a1, b0, b1, e, ok in ((alo, am, blo, bm, d, None), (am, ahi, bm, bhi, d, None),
                                      (alo, am, bm, bhi, d + 1, None), (am, ahi, blo, bm, d + 1, ~same)):
            live = (a1 > a0) & (b1 > b0) & (e <= max_bits) & ~((a0 == b0) & (a1 - a0 == 1))
            if ok is not None:
                live &= ok
            new.append((a0[live], a1[live], b0[live], b1[live], e[live]))
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*new))))
    return forest.label


def _blocks(prefix: int, parts: int) -> list[tuple[int, int]]:
    """(offset, width) of ``parts`` blocks of the bits below the top ``prefix``."""
    rest = 64 - prefix
    cuts = [rest * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _mask(bits: int) -> int:
    m = (1 << bits) - 1
    return m - (1 << 64) if m >= 1 << 63 else m


def _turned(code: Column, prefix: int, offset: int) -> Column:
    """``code`` with the bits below ``prefix`` turned left by ``offset``."""
    rest = 64 - prefix
    if not offset:
        return code
    low = code.bitwiseAND(F.lit(_mask(rest)))
    turned = F.shiftleft(low, offset).bitwiseOR(F.shiftrightunsigned(low, rest - offset)).bitwiseAND(F.lit(_mask(rest)))
    return code.bitwiseAND(F.lit(~_mask(rest) if rest < 64 else 0)).bitwiseOR(turned)


def _deal(rows: DataFrame, prefix: int, max_bits: int) -> list[tuple[int, DataFrame]]:
    """``path, code, fp`` dealt by each block of the remaining bits: (new prefix, rows)."""
    by_width: dict[int, list[Column]] = {}
    for i, (offset, width) in enumerate(_blocks(prefix, max_bits + 1)):
        by_width.setdefault(prefix + width, []).append(F.struct(
            F.concat_ws(".", F.col("path"), F.lit(str(i))).alias("path"),
            _turned(F.col("code"), prefix, offset).alias("code")))
    return [(p, rows.select(F.explode(F.array(*cols)).alias("s"), "fp").select("s.path", "s.code", "fp"))
            for p, cols in by_width.items()]


def _forests(rows: DataFrame, prefix: int, max_bits: int) -> DataFrame:
    """Links ``u, v`` inside the groups of equal path and top bits."""
    top = F.shiftrightunsigned("code", 64 - prefix)
    dealt = rows.withColumn("top", top).repartition("path", "top").sortWithinPartitions("path", "top")
    schema = StructType([StructField("u", LongType()), StructField("v", LongType())])

    def solve(path: np.ndarray, code: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        us, vs = [], []
        cuts = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1, [len(path)]])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            order = np.argsort(code[lo:hi])
            c, f = code[lo:hi][order], fp[lo:hi][order]
            label = trie_forest(c, prefix, max_bits)
            linked = np.flatnonzero(label != np.arange(len(c)))
            us.append(f[linked])
            vs.append(f[label[linked]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            part = (np.asarray(b.column(0).to_pylist(), object), b.column(1).to_numpy().view(np.uint64),
                    b.column(2).to_numpy(), b.column(3).to_numpy())
            held.append(part)
            n += b.num_rows
            if n >= 100_000:
                path, code, fp, tops = (np.concatenate(x) for x in zip(*held))
                # the last group may go on in the next batch
                whole = np.flatnonzero((path != path[-1]) | (tops != tops[-1]))
                end = int(whole[-1]) + 1 if len(whole) else 0
                if end:
                    yield solve(path[:end], code[:end], fp[:end])
                held = [(path[end:], code[end:], fp[end:], tops[end:])]
                n = len(path) - end
        if n:
            path, code, fp, _ = (np.concatenate(x) for x in zip(*held))
            yield solve(path, code, fp)

    return dealt.select("path", "code", "fp", "top").mapInArrow(lean(run), schema)


def trie_links(classes: DataFrame, max_bits: int = MAX_BITS, max_group: int = MAX_GROUP) -> DataFrame:
    """Links ``u, v`` that connect distinct fingerprints (``fp``) as all pairs within ``max_bits`` would."""
    todo = [(0, classes.select(F.lit("").alias("path"), F.col("fp").alias("code"), "fp"))]
    links = None
    while todo:
        prefix, rows = todo.pop()
        for p, dealt in _deal(rows, prefix, max_bits):
            cold = dealt
            # Groups can be too large only if all fingerprints together are; bits run out at some depth.
            if p + max_bits + 1 <= 48:
                key = F.shiftrightunsigned("code", 64 - p)
                large = stored(dealt.groupBy("path", key.alias("top")).count().where(F.col("count") > max_group)
                               .select("path", "top"), "large-groups")
                if not large.isEmpty():
                    dealt = dealt.withColumn("top", key)
                    cold = dealt.join(large, ["path", "top"], "left_anti").drop("top")
                    hot = dealt.join(large, ["path", "top"], "left_semi").drop("top")
                    todo.append((p, hot.select("path", "code", "fp")))
            part = _forests(cold, p, max_bits)
            links = part if links is None else links.unionByName(part)
    return links


def classes_with_component(rows: DataFrame, max_bits: int = MAX_BITS, max_group: int = MAX_GROUP) -> DataFrame:
    """``fp, root`` for every distinct ``fp`` of ``rows``; equal roots are one component."""
    classes = stored(rows.select("fp").distinct(), "fingerprint-classes")
    roots = components(trie_links(classes, max_bits, max_group))
    return classes.join(roots.withColumnRenamed("u", "fp"), "fp", "left") \
        .select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE,
                    max_bits: int = MAX_BITS, max_group: int = MAX_GROUP) -> DataFrame:
    """``doc_id, fp (long), component_id`` for every row; ``component_id`` is the smallest id reachable."""
    rows = with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
                            "text", words, "fp").drop("text")
    rows = stored(rows, "fingerprints")
    comp = stored(classes_with_component(rows, max_bits, max_group), "components")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(comp, "fp")
    # stored before the join: between two plain tables Spark can split a large component
    named = stored(least.groupBy("root").agg(F.min("least").alias("component_id")), "component-names")
    by_fp = stored(comp.join(named, "root").select("fp", "component_id"), "component-ids")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE,
             max_bits: int = MAX_BITS, max_group: int = MAX_GROUP) -> DataFrame:
    """One row per component, that of the smallest id, with the columns of ``docs``."""
    fp, uid = free_name(docs, "fp"), free_name(docs, "row_uid")
    rows = stored(with_fingerprint(docs, text_col, words, fp).withColumn(uid, F.monotonically_increasing_id()),
                  "fingerprinted")
    slim = rows.select(F.col(fp).alias("fp"), F.col(uid).alias("uid"), F.col(id_col).alias("id"))
    comp = stored(classes_with_component(slim, max_bits, max_group), "components")
    first = F.min(F.struct(F.col("id").isNull(), "id", "uid"))
    best = slim.groupBy("fp").agg(first.alias("best")).join(comp, "fp") \
        .groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.uid").alias(uid))
    # The kept ids grow with the documents, so they are not for broadcasting, at any size.
    return rows.join(stored(best, "kept-rows").hint("shuffle_merge"), uid, "left_semi").select(*docs.columns)
