"""Benchmark decontamination by a prefix-filtered set join.

Texts are words; an item of the benchmark is cut into windows of ``WINDOW``
words (a shorter item is one window), a window into shingles of ``SHINGLE``
words. A document holds a window only if it holds all the window's shingles,
so of the shingles ordered by rarity the necessary prefix is one, the rarest:

1. Occurrences of the items' shingles are counted over all documents. A window
   of which one shingle occurs nowhere is out.
2. Documents yield the places of prefix shingles, with the words around them
   that a window could cover; these are joined to the windows by the shingle.
3. A window laid over the place must begin and end within the document
   (positional and length bounds), and its words must equal the document's.

Documents never travel: a pass tests shingle hashes against a bitmap of at
most ``MAX_BITS`` bits, which only spares rows (hits are joined by the whole
hash and verified word by word). Equal windows are one window, whatever number
of items hold them; item lists are made once per distinct set of windows'
groups. Joins stand between written tables, so Spark can split a passage that
a third of the documents hold, or broadcast the smaller side by its size.

Defined results: null or empty text has no words and no hits; an item without
words has no windows; items without an id mark words but are neither counted
nor listed; an id on several rows is one item. Repeated document rows get a
result each. Other columns of the documents are carried, and clashing names
get underscores. Empty tables give no rows or no hits. Working memory is bounded by
the shingle arrays of about 2 MB of text, or of one longer text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ticksmith.llm.byte_hashes import MIX, stir
from ticksmith.llm.common import free_name, lean, map_columns, small_batches, stored, text_chunks

WINDOW = 10
SHINGLE = 3
#: Bits of a shingle bitmap: 16 for each shingle, within these bounds.
MIN_BITS, MAX_BITS = 1 << 16, 1 << 26

_LETTERS = np.random.default_rng(20240613).integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


class Words:
    """Words of some texts: lower-cased bytes, bounds, hashes and the text each belongs to."""

    def __init__(self, texts: list):
        raw = [(t or "").encode() for t in texts]
        # a separator byte ends each text, so no word crosses texts
        self.data = _LOWER[np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)]
        inside = _IN_WORD[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        first = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
        self.first = np.searchsorted(self.start, first)  # of text i: words first[i] .. first[i + 1]
        self.text = np.repeat(np.arange(len(raw)), np.diff(self.first))
        self.hash = self._hashes(inside)

    def _hashes(self, inside: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        place = np.arange(int(size.sum())) - np.repeat(at, size)
        power = np.full(int(size.max()), MIX[0], np.uint64)
        power = np.cumprod(power)
        letters = _LETTERS[self.data[inside]] * power[place]
        return stir(np.add.reduceat(letters, at) + size.astype(np.uint64), 1)

    def shingles(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (word numbers) and hashes of all runs of ``words`` words within one text."""
        n = len(self.hash) - words + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = self.hash[:n].copy()
        for k in range(1, words):
            h *= np.uint64(MIX[2])
            h += self.hash[k:k + n]
            h = stir(h, 3)
        h = stir(h + np.uint64(words), 4)
        whole = np.flatnonzero(self.text[:n] == self.text[words - 1:])
        return whole, h[whole]

    def join(self, begin: int, end: int) -> str:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[begin:end], self.end[begin:end])).decode()


def _bitmap(hashes: DataFrame, col: str) -> np.ndarray:
    """Bits of all values of ``col``; a power of two of them, at most ``MAX_BITS``."""
    n = hashes.count()
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (16 * n - 1).bit_length() if n else 0))
    place = F.col(col).bitwiseAND(F.lit(bits - 1))
    found = hashes.groupBy(F.shiftright(place, 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("b")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
    return out.view(np.uint64)


def _known(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW,
            shingle: int = SHINGLE) -> DataFrame:
    """``item, words, n, shingles``: each item's windows, words space-joined, with their shingle hashes in order."""
    schema = StructType([StructField("item", items.schema[id_col].dataType), StructField("words", StringType()),
                         StructField("n", IntegerType()), StructField("shingles", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in text_chunks(texts, budget=200_000):
                w = Words(texts[lo:hi])
                whole, hashes = w.shingles(shingle)
                hashes, at = hashes.view(np.int64), dict(zip(whole.tolist(), range(len(whole))))
                own, words, size, parts = [], [], [], []
                for i in range(hi - lo):
                    begin, end = int(w.first[i]), int(w.first[i + 1])
                    n = min(window, end - begin)
                    for s in range(begin, end - n + 1) if n else ():
                        own.append(lo + i)
                        words.append(w.join(s, s + n))
                        size.append(n)
                        if n >= shingle:
                            parts.append(hashes[at[s]:at[s] + n - shingle + 1].tolist())
                        else:
                            k = Words([words[-1]])
                            parts.append(k.shingles(n)[1].view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(own, pa.int64())), pa.array(words, pa.string()), pa.array(size, pa.int32()),
                    pa.array(parts, pa.list_(pa.int64()))], names=schema.names)

    small_batches(items.sparkSession)
    return items.select(id_col, text_col).mapInArrow(lean(run), schema)


def _counts(texts: DataFrame, bitmap: np.ndarray, lengths: list[int]) -> DataFrame:
    """``shingle, n``: occurrences in ``texts`` of all shingles that the bitmap may know."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in text_chunks(texts):
                w = Words(texts[lo:hi])
                for k in lengths:
                    h = w.shingles(k)[1]
                    value, n = np.unique(h[_known(bitmap, h)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    small_batches(texts.sparkSession)
    return texts.mapInArrow(lean(run), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


_PLACE = StructType([StructField("at", IntegerType()), StructField("shingle", LongType()),
                     StructField("lead", IntegerType()), StructField("around", StringType())])


def _places(bitmap: np.ndarray, lengths: list[int], window: int, shingle: int) -> Callable[[list], tuple[list, list]]:
    """Per text, its number of words and the places of known shingles with the words around them."""
    def found(texts: list) -> tuple[list, list]:
        counts, places = [], []
        for lo, hi in text_chunks(texts):
            w = Words(texts[lo:hi])
            here: list[list] = [[] for _ in range(lo, hi)]
            for k in lengths:
                # a shorter shingle is a whole window
                reach = window - shingle if k == shingle else 0
                at, h = w.shingles(k)
                known = _known(bitmap, h)
                for p, v in zip(at[known].tolist(), h[known].view(np.int64).tolist()):
                    i = int(w.text[p])
                    begin, end = int(w.first[i]), int(w.first[i + 1])
                    left = max(begin, p - reach)
                    here[i].append({"at": p - begin, "shingle": v, "lead": p - left,
                                    "around": w.join(left, min(end, p + k + reach))})
            counts += np.diff(w.first).tolist()
            places += here
        return counts, places

    return found


def contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                 item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Columns of ``docs`` without the text plus ``n_words, n_hit, n_items, item_ids_sha256, contaminated``.

    ``n_hit``: words inside occurrences of windows; ``n_items``: items with
    occurring windows, whose ids (as text, sorted, comma-joined) the digest is of.
    """
    if not 1 <= shingle <= window:
        raise ValueError("a window has at least one shingle")
    by_item = stored(windows(items, item_id, item_text, window, shingle), "benchmark-windows")
    distinct = stored(by_item.groupBy("words", "n").agg(F.min("shingles").alias("shingles")), "distinct-windows")
    lengths = sorted(min(r.n, shingle) for r in distinct.select(F.least("n", F.lit(shingle)).alias("n")).distinct().collect())

    # 1. rarity, and the one shingle that a window's occurrence cannot do without
    texts = docs.select(F.col(text_col).alias("text"))
    parts = distinct.select("words", "n", F.posexplode("shingles").alias("off", "shingle"))
    known = _bitmap(parts.select("shingle").distinct(), "shingle")
    counts = stored(_counts(texts, known, lengths), "shingle-counts")
    ranked = parts.join(counts.withColumnRenamed("n", "seen"), "shingle", "left").groupBy("words", "n").agg(
        F.count_if(F.col("seen").isNull()).alias("absent"), F.min(F.struct("seen", "shingle", "off")).alias("p"))
    prefix = stored(ranked.where("absent = 0").select(
        "words", "n", F.col("p.shingle").alias("shingle"), F.col("p.off").alias("off"),
        F.xxhash64("words").alias("wid")), "prefixes")

    # 2. places of prefix shingles, kept with their document
    carried = [c for c in docs.columns if c != text_col]
    plain = docs.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(carried)], F.col(text_col).alias("text"))
    find = _places(_bitmap(prefix.select("shingle").distinct(), "shingle"), lengths, window, shingle)

    def fill(batch: pa.RecordBatch) -> list[pa.Array]:
        counts, places = find(batch.column(batch.schema.get_field_index("text")).to_pylist())
        kind = pa.list_(pa.struct([("at", pa.int32()), ("shingle", pa.int64()), ("lead", pa.int32()), ("around", pa.string())]))
        return [pa.array(counts, pa.int64()), pa.array(places, kind)]

    rows = map_columns(plain, [StructField("n_words", LongType()), StructField("places", ArrayType(_PLACE))], fill) \
        .drop("text").withColumn("uid", F.monotonically_increasing_id())
    rows = stored(rows, "document-places")

    # 3. windows laid over the places
    at = rows.select("uid", "n_words", F.explode("places").alias("c")).select("uid", "n_words", "c.*")
    begin = F.col("at") - F.col("off")
    covered = F.array_join(F.slice(F.split("around", " "), F.col("lead") - F.col("off") + 1, F.col("n")), " ")
    laid = at.join(prefix, "shingle").where((begin >= 0) & (begin + F.col("n") <= F.col("n_words")) & (F.col("off") <= F.col("lead")))
    occurs = stored(laid.where(covered == F.col("words")).select("uid", begin.alias("begin"), "n", "words"), "occurrences")

    # words inside any occurrence: lengths beyond the furthest end so far
    spans = occurs.groupBy("uid", "begin").agg(F.max(F.col("begin") + F.col("n")).alias("end"))
    before = F.max("end").over(Window.partitionBy("uid").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    hit = spans.withColumn("from", F.greatest("begin", F.coalesce(before, F.lit(0)))) \
        .groupBy("uid").agg(F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).cast("long").alias("n_hit"))

    # items: windows of equal item sets are one group, documents of equal group sets share a list
    owners = by_item.where(F.col("item").isNotNull()).select("words", F.col("item").cast("string").alias("item")).distinct()
    used = owners.join(occurs.select("words").distinct(), "words", "left_semi")
    group = stored(used.groupBy("words").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("grp")), "window-groups")
    members = stored(used.join(group, "words").select("grp", "item").distinct(), "group-items")
    per_doc = stored(occurs.select("uid", "words").distinct().join(group, "words").select("uid", "grp").distinct()
                     .groupBy("uid").agg(F.sort_array(F.collect_list("grp")).alias("grps"))
                     .select("uid", "grps", F.sha2(F.array_join("grps", ","), 256).alias("set")), "document-groups")
    lists = per_doc.groupBy("set").agg(F.first("grps").alias("grps")).select("set", F.explode("grps").alias("grp")) \
        .join(members, "grp").select("set", "item").distinct().groupBy("set").agg(
            F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("digest"))
    listed = per_doc.select("uid", "set").join(stored(lists, "item-lists"), "set").drop("set")

    facts = stored(hit.join(listed, "uid", "left"), "hits")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    out = rows.drop("places").join(facts, "uid", "left")
    return out.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(carried)], *[
        e.alias(free_name(docs, name)) for name, e in (
            ("n_words", F.col("n_words")), ("n_hit", n_hit), ("n_items", F.coalesce("n_items", F.lit(0).cast("long"))),
            ("items_sha256", F.coalesce("digest", F.sha2(F.lit(""), 256))), ("contaminated", n_hit > 0))])
