"""Best-fit packing with swap-based local search.

Documents become token pieces of at most ``CAPACITY`` ids. Pieces are dealt
to shards of about ``SHARD_ROWS`` by a hash; a task packs its shard by
best-fit decreasing, then improves underfull sequences from the fullest to
the emptiest: it moves a piece in, exchanges one for one, two for one or one
for two, each exchange raising the sum of squared fills, until the emptiest
sequences run empty or no exchange helps. What is left underfull in every
shard is dealt anew and packed together, so that sequences of all shards come
to meet, until one shard is left or a deal saves less than ``LEAST_GAIN`` of
the open sequences; one that saves none leaves the packing before it.

Defined results: null and blank texts are just the end token. Repeated rows
are separate pieces with equal ids. A null id is carried. Extra columns are
ignored. Pieces are dealt evenly whatever their ids, so no key can be hot; a
task holds one shard's lengths, not its tokens.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from ticksmith.llm.common import lean, small_batches, stored
from ticksmith.llm.word_tokens import for_worker, tokenizer_path

CAPACITY = 4096
END_ID = 1
SHARD_ROWS = 8192
#: Text bytes encoded at once by a task.
BATCH_BYTES = 16_000_000
#: Sequences at least this full are final after any deal.
FULL = 0.98
#: Share of the open sequences that a new deal must save to be followed by another.
LEAST_GAIN = 0.001


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids``: each document's ids with ``end_id``, cut only beyond ``capacity``.

    ``ids`` are little-endian unsigned 32-bit numbers in a row; without them
    their checksum, ``ids_crc32``, is returned instead.
    """
    path = tokenizer or tokenizer_path()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = StructType([src.schema["doc_id"], StructField("piece", IntegerType()), StructField("start", LongType()),
                         StructField("length", LongType()),
                         StructField("ids", BinaryType()) if with_ids else StructField("ids_crc32", LongType())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = for_worker(path)
        for b in batches:
            size = b.column(1).nbytes
            step = max(1, int(b.num_rows * BATCH_BYTES / max(1, size)))
            for lo in range(0, b.num_rows, step):
                data, at = words.encode_array(b.column(1)[lo:lo + step])
                cols: list[list] = [[] for _ in range(5)]
                for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    raw = bytes(data[s:e]) + end
                    n = len(raw) // 4
                    for k, first in enumerate(range(0, n, capacity)):
                        part = raw[4 * first:4 * (first + capacity)]
                        for c, v in zip(cols, (lo + i, k, first, len(part) // 4, part if with_ids else zlib.crc32(part))):
                            c.append(v)
                rows = b.column(0).take(pa.array(cols[0], pa.int64()))
                last = pa.array(cols[4], pa.binary() if with_ids else pa.int64())
                yield pa.RecordBatch.from_arrays([rows, pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                                                  pa.array(cols[3], pa.int64()), last], names=schema.names)

    small_batches(docs.sparkSession)
    return src.mapInArrow(lean(run), schema)


# --- one shard ------------------------------------------------------------

def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: item numbers by bin."""
    bins: list[list[int]] = []
    gaps: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        at = bisect.bisect_left(gaps, (n, -1))
        if at < len(gaps):
            room, b = gaps.pop(at)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > n:
            bisect.insort(gaps, (room - n, b))
    return bins


class _Pool:
    """Pieces of the emptier bins, by length."""

    def __init__(self, items: list[tuple[int, int]]) -> None:
        self.items = sorted(items)
        self._sizes: np.ndarray | None = None

    def remove(self, n: int, i: int) -> None:
        del self.items[bisect.bisect_left(self.items, (n, i))]
        self._sizes = None

    def add(self, n: int, i: int) -> None:
        bisect.insort(self.items, (n, i))
        self._sizes = None

    def at_most(self, n: int) -> tuple[int, int] | None:
        at = bisect.bisect_right(self.items, (n, 1 << 62))
        return self.items[at - 1] if at else None

    def pair(self, most: int) -> tuple[tuple[int, int], tuple[int, int]] | None:
        """Two pieces with the largest sum of at most ``most``."""
        if self._sizes is None:
            self._sizes = np.array([n for n, _ in self.items], np.int64)
        s = self._sizes[:np.searchsorted(self._sizes, most, "right")]
        if len(s) < 2:
            return None
        # partner: the last piece that fits beside each, other than itself
        other = np.searchsorted(s, most - s, "right") - 1
        here = np.arange(len(s))
        other = np.where(other >= here, np.maximum(np.minimum(other, len(s) - 1), 0), -1)
        other = np.where(other == here, -1, other)
        total = np.where(other >= 0, s + s[other], -1)
        best = int(total.argmax())
        if total[best] < 0:
            return None
        return self.items[best], self.items[int(other[best])]


def improve(lengths: list[int], bins: list[list[int]], capacity: int, passes: int = 3) -> list[list[int]]:
    """Local search between underfull bins; stops at the lower bound or when a pass frees no bin."""
    least = -(-sum(lengths) // capacity)
    for _ in range(passes):
        if len(bins) <= least:
            break
        fill = [sum(lengths[i] for i in b) for b in bins]
        order = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: -fill[b])
        home = {i: b for b in order for i in bins[b]}
        pool = _Pool([(lengths[i], i) for i in home])

        def shift(i: int, to: int) -> None:
            frm = home[i]
            bins[frm].remove(i)
            bins[to].append(i)
            fill[frm] -= lengths[i]
            fill[to] += lengths[i]
            home[i] = to

        for b in order:
            for i in bins[b]:
                pool.remove(lengths[i], i)
            while bins[b] and fill[b] < capacity and pool.items:
                room = capacity - fill[b]
                if (got := pool.at_most(room)) is not None:  # move
                    pool.remove(*got)
                    shift(got[1], b)
                    continue
                best: tuple | None = None
                for x in bins[b]:  # one for one
                    got = pool.at_most(lengths[x] + room)
                    if got and got[0] > lengths[x] and (best is None or got[0] - lengths[x] > best[0]):
                        best = (got[0] - lengths[x], [x], [got])
                if best is None or best[0] < room:
                    for x in bins[b]:  # two for one
                        pair = pool.pair(lengths[x] + room)
                        gain = pair[0][0] + pair[1][0] - lengths[x] if pair else 0
                        # both must come from one bin, or fit what they leave behind anyway
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, [x], list(pair))
                    for k, x in enumerate(bins[b]):  # one for two
                        for y in bins[b][k + 1:]:
                            got = pool.at_most(lengths[x] + lengths[y] + room)
                            gain = got[0] - lengths[x] - lengths[y] if got else 0
                            if gain > 0 and (best is None or gain > best[0]):
                                best = (gain, [x, y], [got])
                if best is None:
                    break
                _, out, into = best
                donor = home[into[0][1]]
                if len(into) == 2 and home[into[1][1]] != donor:
                    # x goes where more room is left; it must fit there
                    donors = sorted({home[p[1]] for p in into},
                                    key=lambda d: fill[d] - sum(p[0] for p in into if home[p[1]] == d))
                    donor = donors[0]
                    left = fill[donor] - sum(p[0] for p in into if home[p[1]] == donor)
                    if left + lengths[out[0]] > capacity:
                        break
                for p in into:
                    pool.remove(*p)
                    shift(p[1], b)
                for x in out:
                    shift(x, donor)
                    pool.add(lengths[x], x)
        kept = [b for b in bins if b]
        if len(kept) == len(bins):
            break
        bins = kept
    return [b for b in bins if b]


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    return improve(lengths, best_fit(lengths, capacity), capacity)


# --- all shards -----------------------------------------------------------

def pack(items: DataFrame, capacity: int = CAPACITY, length_col: str = "length", shard_rows: int = SHARD_ROWS,
         least_gain: float = LEAST_GAIN) -> DataFrame:
    """``items`` (a stored frame; lengths of 1 to ``capacity``) plus ``sequence_id`` and ``offset`` (long).

    ``least_gain``: share of the open sequences that a deal must save to be followed by another.
    """
    cols = items.columns
    names = [StructField(c, LongType()) for c in ("sequence_id", "offset", "sequence_fill")]
    uid = F.monotonically_increasing_id()
    whole = items.where(F.col(length_col) >= capacity).select(
        "*", (-1 - uid).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = items.where(F.col(length_col) < capacity).withColumn("uid", uid)
    schema = StructType(list(todo.schema.fields) + names)

    def run(t: pa.Table) -> pa.Table:
        t = t.drop_columns(["shard"])
        n, ids = t.column(length_col).to_pylist(), t.column("uid").to_pylist()
        seq, off, fill = np.zeros((3, len(n)), np.int64)
        for b in pack_lengths(n, capacity):
            at = 0
            for i in b:
                seq[i], off[i] = ids[b[0]], at  # a piece opens one sequence at most, so its number names it
                at += n[i]
            fill[b] = at
        for name, a in (("sequence_id", seq), ("offset", off), ("sequence_fill", fill)):
            t = t.append_column(name, pa.array(a))
        return t

    full = F.col("sequence_fill") >= int(FULL * capacity)
    opens = F.col("offset") == 0
    result, left, deal = whole, todo.count(), 0
    kept: DataFrame | None = None  # the pieces of ``todo`` as packed before, in ``was`` sequences
    was = 0
    while left:
        shards = -(-left // shard_rows)
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64(F.lit(deal), "uid"), F.lit(shards)))
        packed = stored(dealt.groupBy("shard").applyInArrow(run, schema), "packed")
        used, rest, rest_used = packed.agg(F.count_if(opens), F.count_if(~full), F.count_if(~full & opens)).first()
        if kept is not None and used >= was:
            result = result.unionByName(kept.select(*cols, "sequence_id", "offset"))
            break
        last = shards == 1 or (kept is not None and was - used < least_gain * was)
        result = result.unionByName((packed if last else packed.where(full)).select(*cols, "sequence_id", "offset"))
        if last:
            break
        kept, was, left, deal = packed.where(~full), rest_used, rest, deal + 1
        todo = kept.select(*cols, "uid")
    return result


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   tokenizer: str | None = None, shard_rows: int = SHARD_ROWS, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece, and ``ids`` if asked for."""
    cut = pieces(docs, id_col, text_col, capacity, tokenizer=tokenizer, with_ids=with_ids)
    if with_ids:
        cut = cut.withColumn("ids_crc32", F.crc32("ids"))
    return pack(stored(cut, "pieces"), capacity, shard_rows=shard_rows)
