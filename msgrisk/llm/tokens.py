"""Subword ids of whole texts, with a bounded cache of encoded words.

``word_bpe_49k`` drops white space and never merges across it, nor across a
run of punctuation marks, so the ids of a text are those of its words and marks in
order. Each is encoded once per worker and the ids are joined as bytes. Texts
with characters outside ASCII and the Latin letters of U+00C0-U+00FF, or with
neighbouring marks and an apostrophe, are cut at white space only; texts that may hold a special token
are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_WORDS = 250_000  # in each of two generations
JOINED_WORDS = 4096


def _probe_table() -> bytes:
    """Marks become '!', what needs care 0x01, letters, digits and white space stay."""
    out = bytearray(range(256))
    for c in range(256):
        if c >= 0x80:
            out[c] = 0x61 if c <= 0xBF or c == 0xC3 else 1
        elif c < 0x20 and chr(c) not in "\t\n\v\f\r":
            out[c] = 1
        elif 0x20 < c and not chr(c).isalnum():
            out[c] = 0x21
    return bytes(out)


PROBE = _probe_table()
MARKS = re.compile(rb"[!-/:-@\[-`{-~]+")
SIGNS = (b"\xc3\x97", b"\xc3\xb7")  # of U+00C0-U+00FF, those that are no letters


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def codec(path: str) -> "WordCodec":
    return WordCodec(path)


class WordCodec:
    """Encodes texts to little-endian unsigned 32-bit ids (as bytes)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        # the same merges without normalising or matching patterns: enough for words of a-z
        lean = json.loads(self.tokenizer.to_str())
        lean |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
        lean = Tokenizer.from_str(json.dumps(lean))
        self.lean_batch = getattr(lean, "encode_batch_fast", lean.encode_batch)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _learn(self, new: list[str]) -> None:
        """Put the ids of ``new`` words in the cache."""
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        ascii_, plain, rest = [], [], []
        for w in new:
            kept = older.get(w)
            if kept is not None:
                cache[w] = kept
            else:
                (rest if not w.isalpha() else ascii_ if w.isascii() else plain).append(w)
        # words of letters only are one word to the tokenizer: encode many at once, cut at word ends
        for batch, group in ((self.lean_batch, ascii_), (self.batch, plain)):
            for at in range(0, len(group), JOINED_WORDS):
                some = group[at : at + JOINED_WORDS]
                ids = np.array(batch([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
                cuts = np.flatnonzero(self.closes[ids]) + 1
                if len(cuts) != len(some):
                    rest += some
                    continue
                raw, ends = ids.tobytes(), (cuts * 4).tolist()
                cache.update(zip(some, [raw[i:j] for i, j in zip([0, *ends], ends)]))
        for w, e in zip(rest, self.batch(rest, add_special_tokens=False)):
            cache[w] = array("I", e.ids).tobytes()

    def forget(self) -> None:
        """Empty the cache."""
        self.cache, self.older = {}, {}

    def encode_letters(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct words of lower-case letters only, one word to the tokenizer each: a pool of ids, and
        where each word's begin there and how many they are. Nothing is cached."""
        begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        pool, top = [np.zeros(0, "<u4")], 0
        ascii_ = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
        for batch, group in ((self.lean_batch, np.flatnonzero(ascii_)), (self.batch, np.flatnonzero(~ascii_))):
            for at in range(0, len(group), JOINED_WORDS):
                own = group[at : at + JOINED_WORDS]
                some = self._listed(words.take(pa.array(own)))
                ids = np.array(batch([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) != len(some):
                    each = [e.ids for e in self.batch(some, add_special_tokens=False)]
                    ids, ends = np.array([i for e in each for i in e], "<u4"), np.cumsum([len(e) for e in each])
                size[own] = np.diff(ends, prepend=0)
                begin[own] = top + ends - size[own]
                pool.append(ids)
                top += len(ids)
        return np.concatenate(pool), begin, size

    @staticmethod
    def prepared(text: str | None) -> bytes | None:
        """The text with lone marks set apart by spaces; None if it must be encoded whole."""
        if not text:
            return b""
        if "<|" in text:
            return None
        # only A-Z are lowered here: the tokenizer's own lower-casing does the rest
        raw = text.encode("utf-8", "replace").lower()
        probe = raw.translate(PROBE)
        if b"\x01" in probe or any(s in raw for s in SIGNS):
            return raw
        if b"!!" in probe:
            # a run of marks is one word to the tokenizer, but for its rule on letters after an apostrophe
            return raw if b"'" in raw else MARKS.sub(rb" \g<0> ", raw)
        return raw.replace(b".", b" . ").replace(b",", b" , ")

    @staticmethod
    def _listed(words: pa.StringArray) -> list[str]:
        """The words as a list, by way of one joined string: no word holds a space."""
        if not len(words):
            return []
        whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        return pc.binary_join(whole, " ")[0].as_py().split(" ")

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids begin (and the last end)."""
        ready = [self.prepared(t) for t in texts]
        lists = pc.ascii_split_whitespace(pa.array([r or b"" for r in ready], pa.binary()).cast(pa.string()))
        coded = lists.flatten().dictionary_encode()
        vocab, word = self._listed(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)
        missing = [w for w in vocab if w not in self.cache]
        held = self.cache
        self._learn(missing)
        if held is self.cache:
            codes = [held[w] for w in vocab]
        else:
            codes = [self.cache.get(w) or held.get(w, b"") for w in vocab]
        size = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        pool = np.frombuffer(b"".join(codes), "<u4")
        begin = np.cumsum(size) - size
        n = size[word]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        ids = pool[np.repeat(begin[word] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[lists.offsets.to_numpy()]
        if None in ready:
            parts = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
            for i, r in enumerate(ready):
                if r is None:
                    parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4")
            ids = np.concatenate(parts)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not texts:
            return []
        ids, bounds = self.encode_flat(texts)
        raw, at = ids.tobytes(), (bounds * 4).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]
