"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once.

White space separates words in the tokenizers used here, so a text's ids are its
words' ids in a row. Each chunk of text is reduced to its distinct words; the
library is asked only about words not seen lately, thousands in one call. Where
each of them turns out to be one piece, the ends of pieces tell them apart;
otherwise a separator word goes between them. Words are found by a hash and
compared byte by byte; a text with a word that shares the hash of another one goes
to the library as a whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from riskloom.llm.words import chunks, padded, same_words, word_hashes, word_spans

#: words remembered in each of two generations, some 40 bytes a word
LIMIT = 300_000
CALL_WORDS = 256
CHUNK_BYTES = 1 << 19
SEPARATOR = "~"
_READY: dict = {}


class Known:
    """Words and their ids in the order of their 64-bit hashes, as flat arrays."""

    def __init__(self):
        self.hashes = np.zeros(0, np.uint64)
        self.start, self.count, self.begin, self.end = (np.zeros(0, np.int64) for _ in range(4))
        self.flat, self.text = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are known, and their places."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes, at

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at some places in a row, and their counts."""
        return gather(self.flat, self.start[at], self.count[at]), self.count[at]

    def words(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the words at some places in a row, and their lengths."""
        size = self.end[at] - self.begin[at]
        return gather(self.text, self.begin[at], size), size

    def add(self, hashes: np.ndarray, flat: np.ndarray, count: np.ndarray, text: np.ndarray, size: np.ndarray) -> None:
        order = np.argsort(np.concatenate([self.hashes, hashes]), kind="stable")
        start, end = np.cumsum(count) - count + len(self.flat), np.cumsum(size) + len(self.text)
        for name, new in (("hashes", hashes), ("start", start), ("count", count), ("begin", end - size), ("end", end)):
            setattr(self, name, np.concatenate([getattr(self, name), new])[order])
        self.flat, self.text = np.concatenate([self.flat, flat]), np.concatenate([self.text, text])


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` in a row."""
    end = np.cumsum(count)
    total = int(end[-1]) if len(end) else 0
    return flat[np.repeat(start - (end - count), count) + np.arange(total)]


class WordEncoder:
    """Encodes with a tokenizer file whose pre-tokenizer removes white space."""

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        mark = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        if len(mark) != 1:
            raise ValueError("the tokenizer has no single id for the separator")
        self.mark = mark[0]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.piece_end = np.zeros(max(vocab.values()) + 1, bool)
        self.piece_end[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.young, self.old = Known(), Known()

    @classmethod
    def get(cls, path: str, plain_specials: bool = False) -> WordEncoder:
        """One encoder per Python worker; its memory lasts from task to task."""
        key = (path, plain_specials)
        if key not in _READY:
            _READY[key] = cls(path, plain_specials)
        return _READY[key]

    def _call(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _together(self, part: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and counts of the lines of ``part``, if all of them are one piece each."""
        ids = self._call(part)
        ends = np.flatnonzero(self.piece_end[ids])
        # no word has less than one piece, so equal numbers mean one each
        if len(ends) != part.count("\n") + 1 or ends[-1] != len(ids) - 1:
            return None
        return ids, np.diff(ends, prepend=-1)

    def _apart(self, part: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The same with separators between them; none of the lines may hold one."""
        if SEPARATOR in part:
            return None
        ids = self._call(part.replace("\n", f" {SEPARATOR} "))
        cuts = np.concatenate([[-1], np.flatnonzero(ids == self.mark), [len(ids)]])
        return (ids[ids != self.mark], np.diff(cuts) - 1) if len(cuts) == part.count("\n") + 2 else None

    def _singly(self, part: str) -> tuple[np.ndarray, np.ndarray]:
        each = [e.ids for e in self.tokenizer.encode_batch_fast(part.split("\n"), add_special_tokens=False)]
        return np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each], np.int64)

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        text = [w.decode() for w in words]
        size = np.fromiter(map(len, words), np.int64, len(words))
        kinds = np.fromiter((0 if t.isalpha() else 2 if SEPARATOR in t else 1 for t in text), np.int8, len(text))
        found, order = [], []
        for kind in range(3):
            at = np.flatnonzero(kinds == kind)
            for low in range(0, len(at), CALL_WORDS):
                some = at[low : low + CALL_WORDS]
                part = "\n".join([text[i] for i in some.tolist()])
                found.append((self._together(part) if kind == 0 else None) or (self._apart(part) if kind < 2 else None) or self._singly(part))
                order.append(some)
        at = np.concatenate(order)
        raw = np.frombuffer(b"".join([words[i] for i in at.tolist()]), np.uint8)
        self.young.add(hashes[at], *(np.concatenate(f) for f in zip(*found, strict=True)), raw, size[at])

    def encode_chunk(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        starts, ends, begin = word_spans(data, offsets)
        if not len(starts):
            yield from [b""] * (len(offsets) - 1)
            return
        distinct, first, which = np.unique(word_hashes(data, starts, ends, fold=False), return_index=True, return_inverse=True)
        if len(self.young.hashes) > LIMIT:
            self.old, self.young = self.young, Known()
        new = np.flatnonzero(~self.young.find(distinct)[0])
        kept, at = self.old.find(distinct[new])
        if kept.any():
            self.young.add(distinct[new[kept]], *self.old.ids(at[kept]), *self.old.words(at[kept]))
        new = new[~kept]
        if len(new):
            raw, i, j = data.tobytes(), starts[first[new]].tolist(), ends[first[new]].tolist()
            self._learn(distinct[new], [raw[a:b] for a, b in zip(i, j, strict=True)])
        known = self.young
        at = known.find(distinct)[1][which]
        other = ~same_words(padded(data), starts, ends, padded(known.text), known.begin[at], known.end[at])
        strange = set(np.searchsorted(begin, np.flatnonzero(other), "right").tolist())
        count = known.count[at]
        ids = gather(known.flat, known.start[at], count).astype("<u4", copy=False)
        bounds = np.concatenate([[0], np.cumsum(count)])[begin].tolist()
        for d, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), 1):
            if d in strange:
                yield self._call(data[offsets[d - 1] : offsets[d]].tobytes().decode()).astype("<u4").tobytes()
            else:
                yield ids[i:j].tobytes()


def encoded(texts: pa.Array, encoder: WordEncoder) -> Iterator[bytes]:
    """Ids of each text of a column, worked on in chunks of about ``CHUNK_BYTES``; null counts as empty."""
    for _, data, offsets in chunks(texts, CHUNK_BYTES):
        yield from encoder.encode_chunk(data, offsets)
