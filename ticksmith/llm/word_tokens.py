"""Token ids of whole texts by a public word-level BPE file, encoded word by word.

The tokenizer drops white space and never joins characters across it, so a
text's ids are those of its blank-separated words in a row. A batch's words
are split, numbered and put together again by Arrow; only its distinct words
reach Python, and only those not met before reach the tokenizer. A bounded
number of words is kept.

Words of Latin letters, with or without marks after them, are the bulk. They
need none of the tokenizer's normalisation but lower case, and its pattern
takes letters and marks as wholes, so the letters go to its merges directly,
with their bytes spelt in its byte alphabet.
"""

from __future__ import annotations

import gc
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words kept by a Python worker.
CACHE_WORDS = 600_000
# Words of Latin letters with an upper bound of 255: composed, and lowered letter by letter.
_PLAIN = "^(?P<stem>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<mark>[.,;:!?]*)$"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def for_worker(path: str) -> "WordTokens":
    """The encoder of this Python worker: it serves many tasks, and keeps the words it has met."""
    held = sys.modules.setdefault("_ticksmith_word_tokens", types.ModuleType("_ticksmith_word_tokens"))
    if getattr(held, "path", None) != path:
        held.words, held.path = WordTokens(path), path
    return held.words


class WordTokens:
    """``encode``: little-endian uint32 ids of a text, as bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self._tok = Tokenizer.from_file(path)
        self._bare = Tokenizer.from_file(path)
        self._bare.normalizer = normalizers.Sequence([])
        self._bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self._spelt = byte_alphabet()
        self._of: dict[str, bytes] = {}
        size = self._tok.get_vocab_size(with_added_tokens=True)
        self._last = np.zeros(size, bool)
        for text, i in self._tok.get_vocab(with_added_tokens=True).items():
            self._last[i] = text.endswith("</w>")

    def _ids(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self._tok.encode_batch(words, add_special_tokens=False)]

    def _letters(self, stems: list[str]) -> dict[str, bytes]:
        """Ids of lower-case words of letters: each ends at its one end-of-word token, so many are encoded at once."""
        spelt = [s if s.isascii() else s.encode().decode("latin-1").translate(self._spelt) for s in stems]
        raw: list[bytes] = []
        for lo in range(0, len(spelt), 4000):
            got = self._bare.encode_batch_fast([" ".join(spelt[lo:lo + 4000])], add_special_tokens=False)[0]
            ids = np.array(got.ids, "<u4")
            data, at = ids.tobytes(), 0
            for e in (4 * np.flatnonzero(self._last[ids]) + 4).tolist():
                raw.append(data[at:e])
                at = e
        return dict(zip(stems, raw, strict=True))

    def _known(self, words: list[str], encode) -> pa.Array:
        """Ids of distinct ``words``; ``encode`` makes those not met before."""
        tracing = gc.isenabled()
        gc.disable()  # only strings and bytes are made here, no cycles
        try:
            new = [w for w in words if w not in self._of]
            if len(self._of) + len(new) > CACHE_WORDS:
                self._of = {}
                new = words
            self._of.update(encode(new))
            of = self._of
            return pa.array([of[w] for w in words], pa.large_binary())
        finally:
            if tracing:
                gc.enable()

    def _whole(self, words: list[str]) -> dict[str, bytes]:
        return dict(zip(words, self._ids(words)))

    def _of_words(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words."""
        part = pc.extract_regex(words, _PLAIN)
        plain = part.is_valid()
        part = part.filter(plain)
        stems = pc.utf8_lower(pc.struct_field(part, "stem")).dictionary_encode()
        marks = pc.struct_field(part, "mark").dictionary_encode()
        ids = pc.binary_join_element_wise(
            self._known(stems.dictionary.to_pylist(), self._letters).take(stems.indices),
            pa.array(self._ids(marks.dictionary.to_pylist()), pa.large_binary()).take(marks.indices),
            pa.scalar(b"", pa.large_binary()))
        odd = self._known(words.filter(pc.invert(plain)).to_pylist(), self._whole)
        # back to the order of the words: the plain ones come first in the joint array
        is_plain = plain.to_numpy(zero_copy_only=False)
        place = np.where(is_plain, np.cumsum(is_plain) - 1, len(ids) + np.cumsum(~is_plain) - 1)
        return pa.concat_arrays([ids, odd]).take(pa.array(place))

    def encode_array(self, texts: pa.Array) -> tuple[memoryview, np.ndarray]:
        """Ids of all texts in a row as bytes, and the byte at which each text begins (one more at the end)."""
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = words.flatten().dictionary_encode()
        ids = self._of_words(coded.dictionary).take(coded.indices)
        data = ids.buffers()[2]
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset:ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        first = words.offsets.to_numpy()
        return memoryview(data) if data is not None else memoryview(b""), ends[first - first[0]]

    def encode(self, texts: list) -> list[bytes]:
        data, at = self.encode_array(pa.array(texts, pa.string()))
        return [bytes(data[a:e]) for a, e in zip(at[:-1].tolist(), at[1:].tolist())]
