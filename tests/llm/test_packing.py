import random
import zlib

import numpy as np
from fixtures_llm import docs, empty, rows
from tokenizers import Tokenizer

from ticksmith.llm import packing as P
from ticksmith.llm.common import stored
from ticksmith.llm.word_tokens import WordTokens, tokenizer_path

ODD = ["á ́b é", "x<|endoftext|>y <|startoftext|> z", " a b　c", "it's don't 12345 !!??", "가 ᅡ İI ẞ", "a\x1cb\x1fc\x85d  e",
       "ΑΣ ΟΔΟΣ ΣΑΣ.", "ﬁne ǅ ŉ ª º ① ² ٣", "a­b zero​width", "", "  ", None, "İstanbul. I’m o’clock...!? ---, ,,", "𝔘𝔫𝔦 𐐀 Ꭰ ꭰ"]


def test_words_encode_like_the_whole_text():
    whole = Tokenizer.from_file(tokenizer_path())
    enc = WordTokens(tokenizer_path())
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()][::31]
    rng = random.Random(1)
    words = ["".join(rng.choice(letters[:400]) for _ in range(rng.randint(1, 9))) + rng.choice(["", ".", ",", "...!"]) for _ in range(3000)]
    for part in (ODD, letters, words, [" ".join(words)]):
        for t, raw in zip(part, enc.encode(part)):
            assert np.frombuffer(raw, "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids


def test_local_search_only_improves():
    rng = random.Random(2)
    for make in (lambda: rng.randint(1, 100), lambda: rng.randint(30, 60), lambda: rng.choice([34, 35, 50, 66, 17])):
        for n in (0, 1, 7, 300):
            lengths = [make() for _ in range(n)]
            first = P.best_fit(lengths, 100)
            size = len(first)
            bins = P.improve(lengths, first, 100)
            assert sorted(i for b in bins for i in b) == list(range(n))
            assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
            assert -(-sum(lengths) // 100) <= len(bins) <= size


def test_local_search_frees_a_bin():
    # 15 fits nowhere until 60 and 55 are exchanged
    lengths = [60, 30, 55, 40, 15]
    assert len(P.improve(lengths, [[0, 1], [2, 3], [4]], 100)) == 2
    # two for one: 50 goes for 30 and 25, then 45 finds room
    lengths = [40, 50, 30, 25, 45]
    bins = P.improve(lengths, [[0, 1], [2, 3], [4]], 100)
    assert len(bins) == 2


def _check(df, rows_in, capacity):
    whole = Tokenizer.from_file(tokenizer_path())
    got = df.collect()
    want = []
    for i, t, *_ in rows_in:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[s:s + capacity], "<u4")
            want.append((i, k, s, len(part), zlib.crc32(part.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs), -(-sum(r.length for r in got) // capacity)


def test_documents(spark):
    n, bound = _check(P.pack_documents(docs(spark, extra=["piece", "length", "uid"])), rows(), 4096)
    assert n <= bound + 1
    n, bound = _check(P.pack_documents(docs(spark), capacity=300, shard_rows=16), rows(), 300)
    assert n <= bound * 1.2 + 2
    assert P.pack_documents(empty(spark)).count() == 0


def _packed(spark, lengths, **how):
    """Number of sequences; every piece placed once, without gaps and within the capacity."""
    items = stored(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "item long, length long"), "items")
    got = P.pack(items, 100, **how).collect()
    assert sorted((r.item, r.length) for r in got) == list(enumerate(lengths))
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        ends = np.cumsum([n for _, n in sorted(parts)]).tolist()
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 100
    return len(seqs)


def test_shards_are_dealt_until_no_deal_helps(spark):
    rng = random.Random(4)
    # large pieces each with one partner among small ones: shards of 8 rarely hold both
    lengths = [n for _ in range(60) for n in (lambda x: (x, 100 - x))(rng.randint(51, 75))]
    rng.shuffle(lengths)
    few = _packed(spark, lengths, shard_rows=8)
    assert few <= _packed(spark, lengths, shard_rows=8, least_gain=2.0)  # two deals only
    assert _packed(spark, lengths, shard_rows=1000) <= few
    # nothing fits beside anything: the second deal saves none, the first one stays
    assert _packed(spark, [60] * 50, shard_rows=8) == 50
    assert _packed(spark, [100] * 5 + [1], shard_rows=2) == 6
    assert _packed(spark, [], shard_rows=2) == 0
