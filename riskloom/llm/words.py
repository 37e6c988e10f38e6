"""Vectorised word and shingle hashes over Arrow string columns.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. Its hash mixes its
length and its bytes, eight at a time, so words of up to eight bytes and equal
length never share one; words of more than ``LONG_WORD`` bytes are hashed by
XXH3. Runs of k words are polynomials over mixed word hashes, from running sums.
Texts are worked on in chunks of a quarter of a megabyte, so memory does not follow
the length of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 18
LONG_WORD = 64
_U = np.uint64
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _odd(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1, 2**63, dtype=np.uint64)) | 1


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(size - 1, self.base, _U)]))
            self.down = np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(size - 1, self.inverse, _U)]))
        return self.up[:n], self.down[:n]


_WORD_POWERS, _CHECK_POWERS = _Powers(_odd(13)), _Powers(_odd(19))
_LANE = _U(_odd(11))
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
#: keeps the first n bytes of a little-endian lane
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, bytes, offsets)`` for groups of rows of about ``limit`` bytes.

    Null counts as an empty text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each text the index of its first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACES[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = space[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = True
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = space[1:]
    inner = cuts[cuts > 0]
    last[inner - 1] = True
    starts = np.flatnonzero(first & ~space)
    ends = np.flatnonzero(last & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def padded(data: np.ndarray) -> np.ndarray:
    """``data`` with eight zero bytes after it, so that eight bytes can be read from each place on."""
    return np.concatenate([data, np.zeros(8, np.uint8)])


def _lanes(pad: np.ndarray) -> np.ndarray:
    return np.ndarray((len(pad) - 7,), "<u8", pad, strides=(1,))


def hash_words(pad: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of ``padded`` bytes."""
    lanes, size = _lanes(pad), ends - starts
    out = mix((size.astype(_U) + _U(1)) * _LANE)
    out = mix(out ^ (lanes[starts] & _MASKS[np.minimum(size, 8)]))
    for done in range(8, LONG_WORD, 8):
        more = np.flatnonzero(size > done)
        if not len(more):
            return out
        lane = lanes[starts[more] + done] & _MASKS[np.minimum(size[more] - done, 8)]
        out[more] = mix(out[more] * _LANE ^ lane)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(pad[starts[i] : ends[i]].tobytes())
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each word; with ``fold``, A-Z counts as a-z."""
    return hash_words(padded(_FOLDED[data] if fold else data), starts, ends) if len(starts) else np.zeros(0, _U)


def same_words(pad: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, starts2: np.ndarray, ends2: np.ndarray) -> np.ndarray:
    """Whether word i of some ``padded`` bytes and word i of others are the same."""
    size = ends - starts
    same = size == ends2 - starts2
    left, right = _lanes(pad), _lanes(other)
    for done in range(0, LONG_WORD, 8):
        more = np.flatnonzero(same & (size > done))
        if not len(more):
            return same
        mask = _MASKS[np.minimum(size[more] - done, 8)]
        same[more] = (left[starts[more] + done] & mask) == (right[starts2[more] + done] & mask)
    for i in np.flatnonzero(same & (size > LONG_WORD)).tolist():
        same[i] = np.array_equal(pad[starts[i] : ends[i]], other[starts2[i] : ends2[i]])
    return same


def run_hashes(hashes: np.ndarray, k: int, powers: _Powers = _WORD_POWERS) -> np.ndarray:
    """Hash of every run of ``k`` words; entry i is the run that starts at word i."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, _U)
    up, down = powers.get(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1] + _U(k))


def run_checks(hashes: np.ndarray, k: int) -> np.ndarray:
    """32 more bits for every run of ``k`` words, of another polynomial over the mixed hashes."""
    return (run_hashes(mix(hashes ^ _LANE), k, _CHECK_POWERS) >> _U(32)).astype(np.uint32).view(np.int32)


def shingle_sets(texts: pa.Array, k: int = 5, fold: bool = True) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes.

    A text of fewer than ``k`` words gives its whole sequence as one shingle, a
    text without words the empty set.
    """
    for _, data, offsets in chunks(texts):
        starts, ends, begin = word_spans(data, offsets)
        hashes = word_hashes(data, starts, ends, fold)
        runs = run_hashes(hashes, k)
        for i, j in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            if j - i >= k:
                yield np.unique(runs[i : j - k + 1])
            elif j > i:
                yield run_hashes(hashes[i:j], j - i)
            else:
                yield np.zeros(0, _U)
