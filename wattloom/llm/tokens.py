"""Token ids of whole texts by a `tokenizers` file with word-level BPE.

The tokenizer's own normaliser and model give every id. Words are found and
hashed in bulk and each distinct word is encoded once per worker (as far as a
bounded cache holds it), which gives the same ids as encoding whole texts.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from wattloom.llm import text as tx

#: Below this code point, NFC changes nothing and lower-casing is per character.
PLAIN = 0x300


class WordTokenizer:
    """ids(texts) -> flat int32 ids and each text's offset."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.model.no_truncation()
        self.bpe = self.model.model
        steps = json.loads(self.model.to_str())["pre_tokenizer"]
        self.byte_level = _byte_names() if '"ByteLevel"' in json.dumps(steps) else None
        self.index = tx.HashIndex(21)
        self._clear()

    def _clear(self) -> None:
        self.index.clear()
        self.pool = np.zeros(1 << 20, np.int32)
        self.pool_used = 0
        self.at = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out, counts = [np.zeros(0, np.int32)], []
        for lo, hi in tx.chunks(texts):
            ids, n = self._chunk(texts[lo:hi])
            out.append(ids)
            counts.append(n)
        offsets = np.zeros(len(texts) + 1, np.int64)
        if counts:
            np.cumsum(np.concatenate(counts), out=offsets[1:])
        return np.concatenate(out), offsets

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        low = [t.lower() for t in texts]
        joined, codes, starts = tx.flatten(low)
        if codes.max() >= PLAIN:
            odd = np.maximum.reduceat(codes, starts[:-1]) >= PLAIN
            for i in np.flatnonzero(odd):
                low[i] = self.model.normalizer.normalize_str(texts[i])
            joined, codes, starts = tx.flatten(low)
        start, end = self._words(codes)
        h = tx.span_hash(codes, start, end)
        entry = self.index.find(h)
        if (missing := np.flatnonzero(entry < 0)).size:
            new, first = np.unique(h[missing], return_index=True)
            if not self.index.room(len(new)):
                self._clear()
                missing = np.arange(len(h))
                new, first = np.unique(h, return_index=True)
            if not self.index.room(len(new)):  # a single text with more words than the cache holds
                self.index.bits = max(self.index.bits + 1, int(len(new)).bit_length() + 2)
                self.index.mask = (1 << self.index.bits) - 1
                self.index.clear()
            at = missing[first]
            self._learn(new, [joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())])
            entry[missing] = self.index.find(h[missing])
        size = self.size[entry]
        total = np.zeros(len(entry) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.pool[np.repeat(self.at[entry] - total[:-1], size) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(start, starts)])

    @staticmethod
    def _words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans of the pre-tokenizer's pattern: 's 't 're 've 'm 'll 'd at the
        start of a run of symbols, else runs of letters, single numbers, runs of
        symbols."""
        cls = tx.classes()[codes]
        begin = np.empty(len(codes), bool)
        begin[0] = True
        np.not_equal(cls[1:], cls[:-1], out=begin[1:])
        begin |= cls == tx.NUMBER
        begin &= cls != tx.SPACE
        quote = np.flatnonzero((codes == ord("'")) & begin)
        quote = quote[cls[quote + 1] == tx.LETTER] if len(quote) else quote
        if len(quote):
            a, b = codes[quote + 1], codes[np.minimum(quote + 2, len(codes) - 1)]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = np.zeros(len(a), bool)
            for x, y in ("re", "ve", "ll"):
                two |= (a == ord(x)) & (b == ord(y))
            for which, k in ((one, 1), (two, 2)):
                q = quote[which]
                begin[q + 1] = False
                nxt = q + 1 + k
                begin[nxt] |= cls[nxt] == tx.LETTER
        start = np.flatnonzero(begin)
        stop = np.flatnonzero((cls[:-1] != tx.SPACE) & (begin[1:] | (cls[1:] == tx.SPACE))) + 1
        return start, stop

    def _learn(self, hashes: np.ndarray, new: list[str]) -> None:
        first = self.index.used
        self.index.add(hashes, np.arange(first, first + len(new), dtype=np.int32))
        need = first + len(new)
        if need > len(self.at):
            self.at = np.resize(self.at, need * 2)
            self.size = np.resize(self.size, need * 2)
        for lo in range(0, len(new), 2000):
            each = [self._encode(w) for w in new[lo : lo + 2000]]
            size = np.fromiter(map(len, each), np.int64, len(each))
            ids = np.fromiter((i for x in each for i in x), np.int32, int(size.sum()))
            while self.pool_used + len(ids) > len(self.pool):
                self.pool = np.resize(self.pool, 2 * len(self.pool))
            self.pool[self.pool_used : self.pool_used + len(ids)] = ids
            self.at[first + lo : first + lo + len(each)] = np.cumsum(size) - size + self.pool_used
            self.size[first + lo : first + lo + len(each)] = size
            self.pool_used += len(ids)

    def _encode(self, word: str) -> list[int]:
        """One word's ids; by the BPE model alone where the file is byte-level."""
        if self.byte_level:
            return [t.id for t in self.bpe.tokenize(word.encode().decode("latin-1").translate(self.byte_level))]
        return self.model.encode(word, add_special_tokens=False).ids


def _byte_names() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other
    bytes for the characters from 256 on, in order."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in keep else chr(next(rest)) for b in range(256)}


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    """One per worker process and file."""
    return WordTokenizer(path)
