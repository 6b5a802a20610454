"""Prefix trie of conversations from padded turn-id matrices.

A conversation is its sequence of turns (role, text); every distinct sequence of
the first d turns is a node of depth d. A turn at a place is a 128-bit id (a
hash of place, role and text); a node is known by its depth and the exclusive-or
of the ids on its path, which any order of summation gives.

1. Equal conversations become one sequence with a weight, by partial sums, so
   a third of all conversations may be copies.
2. Sequences are cut into bands of ``WIDTH`` turns with the key of the path
   above them; a row is never longer, however many turns a conversation has.
3. Band rows are range-sharded by their ids, about ``SHARD_ROWS`` rows each. A
   shard pads its rows to a matrix and sorts it with lexsort; comparing
   neighbours column by column and OR-accumulating the change masks marks where
   nodes start; reduceat sums every depth. Nodes on a shard's border are
   partial and recombine by their key.
4. Sums over subtrees: a node's own value is booked on the sequence of its
   smallest member; a subtree's sum is then, over the sequences through the
   node, what is booked on them from its depth down. The second pass over the shards sums that.

Turns are placed by the skew-safe global position (``operators.series``), so a
conversation may hold a third of all rows.

Defined results: rows without conv_id belong to no conversation; null role or
text is empty; turns of equal number stand in the order of role and text (null
numbers first); repeated rows are turns of their own; extra columns are not read; an
empty table has no nodes. The digest of a node's members is a SHA-256 over a
sorted stream of ids: sequential by definition, with bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticksmith.llm.common import lean, stored
from ticksmith.operators import series

WIDTH = 32
SHARD_ROWS = 1 << 16
#: Turns taken over from another conversation are the first 0 to SHARED - 1, from the first of every GROUP ids.
SHARED, GROUP = 9, 5
_KEY = ["depth", "k1", "k2"]


def turns(conversations: DataFrame) -> DataFrame:
    """``conv, pos, t1, t2, size``: each conversation's turns in order from 0, with hashes and the bytes of the text."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"t1": F.xxhash64("role", "text"), "t2": F.xxhash64(F.lit(1), "text", "role"),
                             "size": F.octet_length("text").cast("long")})
    placed = stored(series.with_global_position(rows, ["conv"], ["turn", "role", "text"], keep=["conv", "t1", "t2", "size"]), "turns")
    first = stored(placed.groupBy("conv").agg(F.min(series.POS).alias("first")), "first-turns")
    return placed.join(first, "conv").select("conv", (F.col(series.POS) - F.col("first")).alias("pos"), "t1", "t2", "size")


def rebuilt(conversations: DataFrame, shared: int = SHARED, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Conversations whose beginnings are those of others: (``conv`` of all, their ``turns``).

    Conversation c begins with the first ``crc32(c) % shared`` turns of
    conversation ``c - c % group`` (fewer if it has fewer, none if absent) and goes
    on with its own turns after as many.
    """
    own = stored(turns(conversations), "own-turns")
    sizes = stored(own.groupBy("conv").agg(F.count("*").alias("n")), "conversation-sizes")
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % shared
    of = sizes.select("conv", (F.col("conv") - F.col("conv") % group).alias("source"), taken.alias("taken")).join(
        sizes.select(F.col("conv").alias("source"), F.col("n").alias("there")), "source", "left")
    of = stored(of.select("conv", "source", "taken", F.least("taken", F.coalesce("there", F.lit(0))).alias("given")), "beginnings")
    later = own.join(of.select("conv", "taken", "given"), "conv").where("pos >= taken").select(
        "conv", (F.col("pos") - F.col("taken") + F.col("given")).alias("pos"), "t1", "t2", "size")
    early = own.where((F.col("pos") < shared) & (F.col("conv") % group == 0)).withColumnRenamed("conv", "source") \
        .join(of.select("conv", "source", "given"), "source").where("pos < given").select("conv", "pos", "t1", "t2", "size")
    return of.select("conv"), later.unionByName(early)


def _shards(rows: DataFrame, shard_rows: int) -> DataFrame:
    return rows.repartitionByRange(max(1, -(-rows.count() // shard_rows)), "band", "s1", "s2", "m1", "m2")


def _matrix(lists: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows padded with zeros to ``width`` columns, and which cells are theirs."""
    size = np.diff(lists.offsets.to_numpy())
    valid = np.arange(width) < size[:, None]
    out = np.zeros(valid.shape, np.int64)
    out[valid] = lists.flatten().to_numpy()
    return out, valid


def _sorted(batches: Iterator[pa.RecordBatch], names: list[str], width: int):
    """One shard in lexicographic order: its columns, matrices, valid cells, node starts and node keys."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return None
    table = pa.Table.from_batches(batches)
    col = {n: table.column(n).combine_chunks() for n in names}
    flat = {n: c.to_numpy(zero_copy_only=False) for n, c in col.items() if not pa.types.is_list(c.type)}
    both = {n: _matrix(c, width) for n, c in col.items() if pa.types.is_list(c.type)}
    valid = both["m1"][1]
    m1, m2 = both["m1"][0], both["m2"][0]
    keys = [flat["band"], flat["s1"], flat["s2"]]
    for d in range(width):
        keys += [valid[:, d], m1[:, d], m2[:, d]]
    order = np.lexsort(keys[::-1])
    flat = {n: v[order] for n, v in flat.items()}
    cells = {n: v[0][order] for n, v in both.items()}
    valid, m1, m2 = valid[order], cells["m1"], cells["m2"]
    change = np.ones(valid.shape, bool)
    change[1:] = (m1[1:] != m1[:-1]) | (m2[1:] != m2[:-1]) | (valid[1:] != valid[:-1])
    for n in ("band", "s1", "s2"):
        change[1:, 0] |= flat[n][1:] != flat[n][:-1]
    starts = np.logical_or.accumulate(change, axis=1)
    paths = [np.bitwise_xor.accumulate(np.concatenate([flat[s][:, None], m], axis=1), axis=1) for s, m in (("s1", m1), ("s2", m2))]
    return flat, cells, valid, starts, paths


def _nodes(rows: DataFrame, width: int) -> DataFrame:
    """Partial nodes of the shards: key, parent's key, members, smallest member, bytes of the last text."""
    names = ["band", "s1", "s2", "conv", "weight", "m1", "m2", "size"]
    schema = "depth long, k1 long, k2 long, p1 long, p2 long, n long, conv long, size long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _sorted(batches, names, width)
        if shard is None:
            return
        flat, cells, valid, starts, (k1, k2) = shard
        for d in range(width):
            at = np.flatnonzero(valid[:, d])
            if not len(at):
                break
            new = np.flatnonzero(starts[at, d])
            head = at[new]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                flat["band"][head] * width + d + 1, k1[head, d + 1], k2[head, d + 1], k1[head, d], k2[head, d],
                np.add.reduceat(flat["weight"][at], new), np.minimum.reduceat(flat["conv"][at], new), cells["size"][head, d])],
                names=["depth", "k1", "k2", "p1", "p2", "n", "conv", "size"])

    return rows.select(*names).mapInArrow(lean(run), schema)


def _subtrees(rows: DataFrame, width: int) -> DataFrame:
    """Partial sums over subtrees: what is booked on the sequences through a node from its depth down, and their leaves."""
    names = ["band", "s1", "s2", "leaf", "below", "m1", "m2", "booked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _sorted(batches, names, width)
        if shard is None:
            return
        flat, cells, valid, starts, (k1, k2) = shard
        rest = np.cumsum(cells["booked"][:, ::-1], axis=1)[:, ::-1] + flat["below"][:, None]
        for d in range(width):
            at = np.flatnonzero(valid[:, d])
            if not len(at):
                break
            new = np.flatnonzero(starts[at, d])
            head = at[new]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                flat["band"][head] * width + d + 1, k1[head, d + 1], k2[head, d + 1],
                np.add.reduceat(rest[at, d], new), np.add.reduceat(flat["leaf"][at], new))],
                names=[*_KEY, "saved", "leaves"])

    return rows.select(*names).mapInArrow(lean(run), "depth long, k1 long, k2 long, saved long, leaves long")


def _digests(sequences: DataFrame) -> DataFrame:
    """Per node where conversations end, the SHA-256 of their ids in order; ids meet in pieces of 4,096 and stream by."""
    pieces = sequences.groupBy(*_KEY, F.shiftright("conv", 12).alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        last, digest = None, None

        def ended():
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
                (*last, digest.hexdigest()), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*_KEY, "ends"])

        for b in batches:
            done = []
            for *key, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if key != last:
                    if last is not None:
                        done.append(ended())
                    last, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if last is not None:
            yield ended()

    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "piece") \
        .mapInArrow(lean(run), "depth long, k1 long, k2 long, ends string")


def trie(convs: DataFrame, turns: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the prefix trie of ``turns`` (``conv, pos, t1, t2, size``); ``convs`` names all conversations once.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``; a node is named by its smallest member.
    """
    cells = stored(turns.select("conv", "pos", F.xxhash64("pos", "t1", "t2").alias("m1"),
                                F.xxhash64(F.lit(2), "t2", "t1", "pos").alias("m2"), "size"), "turn-ids")
    zero = F.lit(0).cast("long")
    ends = cells.groupBy("conv").agg(F.count("*").alias("depth"), F.bit_xor("m1").alias("k1"), F.bit_xor("m2").alias("k2"))
    sequences = stored(convs.join(ends, "conv", "left").select("conv", *[F.coalesce(c, zero).alias(c) for c in _KEY]), "sequences")
    single = stored(sequences.groupBy(*_KEY).agg(F.min("conv").alias("conv"), F.count("*").alias("weight")), "distinct-sequences")

    # bands of the distinct sequences, with the key of the path above
    band = F.floor(F.col("pos") / width).cast("long")
    in_band = cells.join(single.select("conv", "weight"), "conv").groupBy("conv", "weight", band.alias("band")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "m1", "m2", "size"))).alias("t"), F.bit_xor("m1").alias("x1"), F.bit_xor("m2").alias("x2"))
    above = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    rows = stored(in_band.select("conv", "weight", "band", *[F.col(f"t.{c}").alias(c) for c in ("m1", "m2", "size")],
                                 *[F.coalesce(F.bit_xor(f"x{i}").over(above), zero).alias(f"s{i}") for i in (1, 2)]), "bands")

    # first pass: members of every node; border nodes of the shards recombine
    nodes = _nodes(_shards(rows, shard_rows), width).groupBy(*_KEY).agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max("size").alias("size"))
    root = sequences.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).where("n > 0").select(
        *[zero.alias(c) for c in (*_KEY, "p1", "p2")], "n", "conv", zero.alias("size"))
    nodes = stored(nodes.unionByName(root), "nodes")

    # second pass: what is booked on each sequence, from its own turns down
    leaves = single.join(nodes.select(*_KEY, "n"), _KEY).select("conv", "depth", F.when(F.col("n") == F.col("weight"), 1).otherwise(0).cast("long").alias("leaf"))
    leaves = stored(leaves, "leaves")
    own = nodes.where("depth > 0").select("conv", F.floor((F.col("depth") - 1) / width).cast("long").alias("band"),
                                          ((F.col("depth") - 1) % width).cast("int").alias("at"), ((F.col("n") - 1) * F.col("size")).alias("v"))
    own = own.groupBy("conv", "band").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("own"), F.sum("v").alias("total"))
    deeper = Window.partitionBy("conv").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    booked = rows.drop("size", "weight").join(own, ["conv", "band"], "left").join(leaves.select("conv", "leaf"), "conv").select(
        "band", "s1", "s2", "m1", "m2", "leaf",
        F.transform("m1", lambda _, i: F.coalesce(F.try_element_at("own", i), zero)).alias("booked"),
        F.coalesce(F.sum("total").over(deeper), zero).alias("below"))
    sums = _subtrees(_shards(stored(booked, "booked"), shard_rows), width)
    # everything known of a node meets in one sum
    def fact(df: DataFrame, *key, **has) -> DataFrame:
        kinds = {"p1": "long", "p2": "long", "n": "long", "conv": "long", "children": "long", "saved": "long", "leaves": "long", "ends": "string"}
        return df.select(*[k.alias(c) for k, c in zip(key or map(F.col, _KEY), _KEY)],
                         *[has.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    def cols(*names: str) -> dict:
        return {n: F.col(n) for n in names}

    top = [zero] * 3  # the root's subtree is everything
    facts = reduce(DataFrame.unionByName, [
        fact(nodes, **cols("p1", "p2", "n", "conv")), fact(sums, **cols("saved", "leaves")),
        fact(nodes.agg(F.sum((F.col("n") - 1) * F.col("size")).alias("saved")).where("saved is not null"), *top, **cols("saved")),
        fact(leaves.agg(F.sum("leaf").alias("leaves")).where("leaves is not null"), *top, **cols("leaves")),
        fact(nodes.where("depth > 0"), F.col("depth") - 1, F.col("p1"), F.col("p2"), children=F.lit(1)),
        fact(_digests(sequences), **cols("ends"))])
    known = facts.groupBy(*_KEY).agg(*[F.max(c).alias(c) for c in ("p1", "p2", "n", "conv", "ends")],
                                     *[F.coalesce(F.sum(c), zero).alias(c) for c in ("children", "saved", "leaves")])
    known = stored(known, "node-facts")
    parents = known.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    return known.join(parents, ["depth", "p1", "p2"], "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
