"""Benchmark decontamination: SimHash windows, Hamming block lookup, exact shingle check.

1. Windows of an item's size in words slide over every document. A window whose
   shingles hardly occur in any item can't reach the threshold and is passed
   over; that loses nothing, and is decided without asking which item it is.
2. Each window left gets a 64-bit SimHash of its words. The fingerprints of the
   items of that size are split into ``BLOCKS`` blocks with a limit each. The
   limits add up to ``RADIUS - BLOCKS + 1``, so fingerprints that exceed all of them
   differ in more than ``RADIUS`` bits: looking up the blocks finds all items within
   the radius, and about a fifth of all others, of which one in 500 is within it.
3. Candidates are verified by the exact weighted similarity of 5-word shingles:
   each shingle of the item that occurs in the window weighs as many words of
   the item as it is the first to cover, and similarity is the covered share of
   the item's words. One changed word in a short item leaves most of it covered.

Where a fifth of the words differ, fingerprints are 13 bits apart on average,
with a deviation of 3.2; the radius lies more than two deviations above, and nearer
leaks lie well inside it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import materialize
from riskloom.llm.words import chunks, mix, run_hashes, word_hashes, word_spans

SHINGLE = 5
THRESHOLD = 0.8
BLOCKS = 4
RADIUS = 20
GROUP_BYTES = 8 << 20
_BITS = np.arange(64, dtype=np.uint64)
_SLICE = 1 << 20


def bit_sums(words: np.ndarray) -> np.ndarray:
    """Running counts of each bit of word hashes; row i counts the words before i.

    A word that follows itself counts as another one, or a repeated word would outweigh all others.
    """
    n = np.arange(len(words))
    head = np.maximum.accumulate(np.where(np.concatenate([[True], words[1:] != words[:-1]]), n, 0)) if len(words) else n
    words = words + (n - head).astype(np.uint64)
    sums = np.zeros((len(words) + 1, 64), np.int32)
    np.cumsum((mix(words)[:, None] >> _BITS) & np.uint64(1), axis=0, out=sums[1:])
    return sums


def fingerprints(sums: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """SimHash of windows: a bit is set where more than half of the words have it."""
    ones = sums[start + size] - sums[start]
    return np.bitwise_or.reduce((2 * ones > np.reshape(size, (-1, 1))).astype(np.uint64) << _BITS, axis=1)


def block_limits(radius: int, blocks: int = BLOCKS) -> list[int]:
    """Bits in which each block may differ: who exceeds all limits is beyond the radius."""
    least, more = divmod(radius - blocks + 1, blocks)
    return [least + (b < more) for b in range(blocks)]


def near(prints: np.ndarray, items: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (window, item, distance) within ``radius``, found through the blocks."""
    width, limits = 64 // BLOCKS, block_limits(radius)
    rows, cols = [], []
    step = max(1, _SLICE // max(1, len(items)))
    for low in range(0, len(prints), step):
        part = prints[low : low + step]
        met = np.zeros((len(part), len(items)), bool)
        for b in range(BLOCKS):
            shift, mask = np.uint64(b * width), np.uint64((1 << width) - 1)
            # a block has few distinct values: they are compared, not the windows
            ours, inverse = np.unique((part >> shift) & mask, return_inverse=True)
            met |= (np.bitwise_count(ours[:, None] ^ ((items >> shift) & mask)[None, :]) <= limits[b])[inverse]
        r, c = np.nonzero(met)
        rows.append(r + low)
        cols.append(c)
    row, col = (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    distance = np.bitwise_count(prints[row] ^ items[col]).astype(np.int64)
    keep = distance <= radius
    return row[keep], col[keep], distance[keep]


class SizeClass:
    """Items of one size in words."""

    def __init__(self, size: int, ids: list, words: list[np.ndarray], threshold: float):
        self.size, self.ids = size, ids
        # an item of fewer words than a shingle is one shingle
        self.k = min(SHINGLE, size)
        self.runs = [run_hashes(w, self.k) for w in words]
        self.prints = np.concatenate([fingerprints(bit_sums(w), np.zeros(1, np.int64), size) for w in words])
        self.sets = [set(r.tolist()) for r in self.runs]
        # different shingles that a window must share: one covers k words at each of its places in the item
        places = [int(np.unique(r, return_counts=True)[1].max()) for r in self.runs]
        self.needs = [math.ceil(threshold * size / (self.k * n) - 1e-9) for n in places]
        self.shingles = np.unique(np.concatenate(self.runs))

    def similarity(self, item: int, window_runs: np.ndarray) -> float:
        at = np.flatnonzero(np.isin(self.runs[item], window_runs))
        edge = np.zeros(self.size + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.k, -1)
        return float((np.cumsum(edge)[:-1] > 0).sum() / self.size)


class ItemIndex:
    """Items of one group by size, and the shingles that any of them has."""

    def __init__(self, items: list[tuple[int | None, str]], threshold: float = THRESHOLD, radius: int = RADIUS):
        self.threshold, self.radius = threshold, radius
        by_size: dict[int, tuple[list, list]] = {}
        texts = pa.array([t for _, t in items], pa.string())
        for first, data, offsets in chunks(texts):
            starts, ends, begin = word_spans(data, offsets)
            words = word_hashes(data, starts, ends, fold=True)
            for n, (i, j) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
                if j > i:
                    ids, found = by_size.setdefault(j - i, ([], []))
                    ids.append(items[first + n][0])
                    found.append(words[i:j])
        self.classes = [SizeClass(n, *by_size[n], threshold) for n in sorted(by_size)]
        self.shingles = {k: np.unique(np.concatenate([c.shingles for c in self.classes if c.k == k])) for k in sorted({c.k for c in self.classes})}
        self.sieves = {}
        for k, s in self.shingles.items():
            self.sieves[k] = np.zeros(1 << 20, bool)
            self.sieves[k][(s >> np.uint64(44)).astype(np.int64)] = True

    def _known(self, k: int, runs: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Which runs of ``k`` words are a shingle of any item."""
        known = np.zeros(len(runs), bool)
        at = np.flatnonzero(self.sieves[k][(runs >> np.uint64(44)).astype(np.int64)] & inside)
        known[at] = np.isin(runs[at], self.shingles[k])
        return known

    def search(self, words: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, object, float, int, int, int]]:
        """``document, item id, similarity, distance, start, words`` of the windows of some documents that reach the threshold."""
        n = len(words)
        doc_end = np.repeat(begin[1:], np.diff(begin))
        doc_start = np.repeat(begin[:-1], np.diff(begin))
        runs, counts, shared = {}, {}, {}
        for k in self.shingles:
            runs[k] = run_hashes(words, k)
            known = self._known(k, runs[k], np.arange(len(runs[k])) + k <= doc_end[: len(runs[k])])
            counts[k] = np.concatenate([[0], np.cumsum(known)]) if known.any() else None
            shared[k] = runs[k][known].tolist()
        todo = []
        for c in self.classes:
            if counts[c.k] is None:
                continue
            need = min(c.needs)
            # all whole windows, and for documents that are shorter than the item the document
            start = np.flatnonzero((np.arange(n) + c.size <= doc_end) | (np.arange(n) == doc_start))
            size = np.minimum(c.size, doc_end[start] - start)
            enough = size >= max(c.k, need)
            start, size = start[enough], size[enough]
            have = counts[c.k][start + size - c.k + 1] - counts[c.k][start]
            start, size = start[have >= need], size[have >= need]
            if len(start):
                todo.append((c, start, size))
        if not todo:
            return
        # bits are counted for the words of these windows only; a window's words stay side by side
        edge = np.zeros(n + 1, np.int64)
        for _, start, size in todo:
            np.add.at(edge, start, 1)
            np.add.at(edge, start + size, -1)
        used = np.cumsum(edge)[:-1] > 0
        squeezed = np.cumsum(used) - 1
        sums = bit_sums(words[used])
        for c, start, size in todo:
            for low in range(0, len(start), 1 << 14):
                s, z = start[low : low + (1 << 14)], size[low : low + (1 << 14)]
                row, item, distance = near(fingerprints(sums, squeezed[s], z), c.prints, self.radius)
                # the window's shingles that some item has
                first, last = counts[c.k][s].tolist(), counts[c.k][s + z - c.k + 1].tolist()
                for r, i, d in zip(row.tolist(), item.tolist(), distance.tolist(), strict=True):
                    if len(c.sets[i].intersection(shared[c.k][first[r] : last[r]])) < c.needs[i]:
                        continue
                    a, m = int(s[r]), int(z[r])
                    score = c.similarity(i, runs[c.k][a : a + m - c.k + 1])
                    if score >= self.threshold:
                        doc = int(np.searchsorted(begin, a, "right")) - 1
                        yield doc, c.ids[i], score, d, a - int(begin[doc]), m


def _found(index: ItemIndex, texts: pa.Array) -> Iterator[tuple]:
    for first, data, offsets in chunks(texts):
        starts, ends, begin = word_spans(data, offsets)
        for doc, *rest in index.search(word_hashes(data, starts, ends, fold=True), begin):
            yield first + doc, *rest


def _search(items: list[tuple[int, str]], threshold: float, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(items, threshold, radius)
        for batch in batches:
            best: dict[tuple, tuple] = {}
            for row, item, score, distance, start, size in _found(index, batch.column("text")):
                if (row, item) not in best or (-score, distance, start) < best[row, item][:3]:
                    best[row, item] = (-score, distance, start, size)
            keys, values = list(best), list(best.values())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array([d for d, _ in keys], pa.int64())), pa.array([i for _, i in keys], pa.int64()),
                    pa.array([-v[0] for v in values], pa.float64()), pa.array([v[1] for v in values], pa.int32()),
                    pa.array([v[2] for v in values], pa.int64()), pa.array([v[3] for v in values], pa.int64()),
                ],
                names=["doc_id", "item_id", "similarity", "distance", "start_word", "n_words"],
            )

    return run


def _clean(items: list[tuple[int, str]], threshold: float, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(items, threshold, radius)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[row for row, *_ in _found(index, batch.column("text").cast(pa.string()))]] = False
            yield batch.filter(pa.array(keep))

    return run


_DDL = "doc_id long, item_id long, similarity double, distance int, start_word long, n_words long"


def _groups(benchmark: DataFrame, group_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items in groups of a checked size, one after another."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    groups = max(1, -(-int(total) // (group_bytes // 2)))
    for g in range(groups):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g) if groups > 1 else items
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Leaks of ``benchmark`` (``item_id, text``) in ``docs`` (``doc_id, text``).

    One row for each pair of a document and an item it leaks, with the best
    window: ``doc_id, item_id, similarity, distance, start_word, n_words``;
    documents without a leak have no row. Ties go to the smaller distance, then
    the first window. A-Z is lower-cased. An item of fewer than five words is
    one shingle, so it is leaked where all its words stand in a row. Null and
    empty texts on either side match nothing; rows that repeat an id are judged
    each, their best window counts; null ids are ids like others.

    Items travel to the tasks in groups of about ``group_bytes`` of text. A
    larger benchmark takes one pass over the documents per group, each written
    down before the next one's items are read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    groups = _groups(benchmark, group_bytes)
    rows, after = next(groups), next(groups, None)
    while rows is not None:
        hits = texts.mapInArrow(_search(rows, threshold, radius), _DDL)
        if after is not None or found is not None:
            hits = materialize(hits, "leaks")
        found = hits if found is None else found.union(hits)
        rows, after = after, next(groups, None) if after is not None else None
    best = F.row_number().over(Window.partitionBy("doc_id", "item_id").orderBy(F.desc("similarity"), "distance", "start_word"))
    return found.withColumn("_r", best).filter("_r = 1").drop("_r")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The rows of ``docs`` that leak no item, judged row by row in the pass that reads them; nothing is shuffled."""
    clean = docs
    for n, rows in enumerate(_groups(benchmark, group_bytes)):
        clean = (materialize(clean, "clean") if n else clean).mapInArrow(_clean(rows, threshold, radius), docs.schema)
    return clean
