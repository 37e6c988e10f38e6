"""Substring dedup by a relative Lempel-Ziv parse of blocks against the index of all blocks.

Documents are dealt into blocks of a few megabytes. Each block is parsed against
the index of all blocks:

1. Anchors. Of the 6-word runs of a 20-word window the one with the smallest
   hash is its anchor, so equal windows have equal anchors. A block sends its
   distinct anchors; those that another block sends too come back.
2. Places. Windows whose anchor came back are sent with their first place in
   the block; the index answers with the first place of all where one is
   earlier. Together with the places in the block itself, every window of
   a document that also starts earlier has a source: document and word.
3. Factors. The parse goes through a document greedily: from the first window
   with a source on, a factor extends word by word as long as its source goes
   on with the same words. The next factor starts at its boundary, or at the
   next window with a source. Windows that cross a boundary have been looked up
   like all others, so a factor takes over exactly where the one before ends.
   Words between factors are literals and stay; words of factors go.

The index is a shuffle by hash: rows of an anchor or window are sorted by place,
and a window function over them keeps no more than a row, so a passage that all
blocks share costs one row per block and no memory. The shuffled texts are one
exchange that all three steps read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.words import chunks, run_checks, run_hashes, word_hashes, word_spans

WINDOW = 20
ANCHOR = 6
BLOCK_BYTES = 4 << 20
_NULL_ID = np.iinfo(np.int64).max
#: Rows of one id are ordered by so many low bits of a hash first; equal bits share a block.
_TIE = 0xFFFF
_EMPTY = np.zeros(0, np.uint64)


class _Block:
    """Documents of a block in their order, with window and anchor hashes."""

    def __init__(self, table: pa.Table, window: int):
        keys = table.column("doc_id").combine_chunks().fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
        ties = table.column("tie").to_numpy()
        order = np.lexsort((ties, ties & _TIE, keys))
        self.table, self.ids, self.ties = table.take(pa.array(order)), keys[order], ties[order]
        hashes, begin = [], [np.zeros(1, np.int64)]
        base = 0
        for _, data, offsets in chunks(self.table.column("text").combine_chunks()):
            starts, ends, first = word_spans(data, offsets)
            hashes.append(word_hashes(data, starts, ends, fold=False))
            begin.append(first[1:] + base)
            base += len(starts)
        self.words = np.concatenate(hashes) if hashes else _EMPTY
        self.begin = np.concatenate(begin)
        self.windows, self.checks = run_hashes(self.words, window), run_checks(self.words, window)
        sizes = np.diff(self.begin)
        self.doc_of_word = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(len(self.words)) - np.repeat(self.begin[:-1], sizes)
        # starts of the windows that stay inside their document
        n = len(self.windows)
        self.at = np.flatnonzero(np.arange(n) + window <= self.begin[1:][self.doc_of_word[:n]]) if n else np.zeros(0, np.int64)

    def anchors(self, window: int, k: int) -> np.ndarray:
        """The anchor of each window of ``at``: a sliding minimum by doubling."""
        low = run_hashes(self.words, k)
        width, span = 1, window - k + 1
        while 2 * width <= span:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        rest = span - width
        if rest:
            low = np.minimum(low[: max(0, len(low) - rest)], low[rest:])
        return low[self.at]


def _number(table: pa.Table) -> int:
    return table.column("block")[0].as_py()


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def _send_anchors(window: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        found = np.unique(_Block(table, window).anchors(window, k))
        return pa.Table.from_arrays([pa.array(np.full(len(found), _number(table))), _signed(found)], names=["block", "hash"])

    return run


def _send_windows(window: int, k: int):
    def run(texts: pa.Table, shared: pa.Table) -> pa.Table:
        names, types = ["block", "hash", "check", "at", "doc", "tie", "word"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 3]
        if not texts.num_rows or not shared.num_rows:
            return pa.schema(list(zip(names, types, strict=True))).empty_table()
        block = _Block(texts, window)
        at = block.at[np.isin(block.anchors(window, k), shared.column("hash").to_numpy().view(np.uint64))]
        _, first = np.unique(block.windows[at], return_index=True)
        # in the order of the text, where ids and places compress well
        at = np.sort(at[first])
        doc = block.doc_of_word[at]
        values = [np.full(len(at), _number(texts)), block.windows[at].view(np.int64), block.checks[at], at, block.ids[doc], block.ties[doc] & _TIE, block.place[at]]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)

    return run


def _sources(block: _Block, found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts that also start earlier, and the document and word of their source."""
    at, hashes = block.at, block.windows[block.at]
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    local = at[first][inverse]
    doc, word = block.ids[block.doc_of_word[local]], block.place[local]
    earlier = local < at
    if found.num_rows and len(at):
        # an answer names the window by its place in the block, so no hash travels back
        known = block.windows[found.column("at").to_numpy()]
        order = np.argsort(known)
        spot = np.minimum(np.searchsorted(known[order], hashes), len(known) - 1)
        hit = known[order][spot] == hashes
        row = order[spot[hit]]
        doc[hit], word[hit] = found.column("src_doc").to_numpy()[row], found.column("src_word").to_numpy()[row]
        earlier |= hit
    return at[earlier], doc[earlier], word[earlier]


def parse(at: np.ndarray, doc_of: np.ndarray, source: np.ndarray, word: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Greedy factors ``start, end, source, source word`` of windows with sources, in order.

    ``doc_of`` is the document of each window. A factor runs on while the next
    window continues its source, and starts no earlier than where the one
    before it ends.
    """
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    goes_on = (np.diff(at) == 1) & (np.diff(doc_of) == 0) & (np.diff(source) == 0) & (np.diff(word) == 1)
    head = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    tail = np.concatenate([head[1:], [len(at)]]) - 1
    start, end = at[head], at[tail] + window
    clipped = np.maximum(start, np.concatenate([[0], end[:-1]]))
    return clipped, end, source[head], word[head] + clipped - start


def _parse(window: int, with_text: bool):
    factor = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source_doc", pa.int64()), ("source_start", pa.int64())])
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("factors", pa.list_(factor))]
        + ([("kept_text", pa.string())] if with_text else [])
    )

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return schema.empty_table()
        block = _Block(texts, window)
        at, source, word = _sources(block, found)
        start, end, source, word = parse(at, block.doc_of_word[at] if len(at) else at, source, word, window)
        # factors don't overlap
        edge = np.zeros(len(block.words) + 1, np.int32)
        np.add.at(edge, start, 1)
        np.add.at(edge, end, -1)
        covered = np.cumsum(edge)[:-1] > 0
        bounds = np.searchsorted(start, block.begin)
        rows = []
        for d, raw in enumerate(block.table.column("text")):
            i, j = int(block.begin[d]), int(block.begin[d + 1])
            words = (raw.as_py() or "").encode().split()
            mine = range(int(bounds[d]), int(bounds[d + 1]))
            factors = [
                {"start": int(start[f]) - i, "length": int(end[f] - start[f]), "source_doc": None if source[f] == _NULL_ID else int(source[f]), "source_start": int(word[f])}
                for f in mine
            ]
            if factors:
                words = [words[x] for x in np.flatnonzero(~covered[i:j]).tolist()]
            kept = b" ".join(words)
            rows.append((j - i, sum(f["length"] for f in factors), hashlib.sha256(kept).hexdigest(), factors, *([kept.decode()] if with_text else [])))
        values = zip(*rows, strict=True)
        return pa.Table.from_arrays([block.table.column("doc_id"), *(pa.array(list(v), t) for v, t in zip(values, schema.types[1:], strict=True))], schema=schema)

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block_bytes: int = BLOCK_BYTES, with_text: bool = False) -> DataFrame:
    """Remove words covered by a ``window``-word sequence that also starts earlier.

    Earlier means in a document with a smaller ``doc_id`` or before in the same
    document. Returns one row per input row: ``doc_id, n_words, n_removed,
    kept_sha256``, ``factors`` (``start, length`` in words of the document,
    ``source_doc, source_start`` of the earlier place) and, if asked for,
    ``kept_text``. Null text has no words. Null ids come after all others; rows
    that repeat an id, and rows without one, come in the order of a hash of
    their text. Other columns of ``docs`` don't matter. Words are compared
    by hashes of 64 bits, windows of different blocks by 96. An empty table gives no rows.
    """
    if not 0 < anchor <= window:
        raise ValueError("an anchor is part of its window")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    dealt = texts.withColumn("tie", F.xxhash64("text")).withColumn("block", F.pmod(F.xxhash64("doc_id", F.col("tie").bitwiseAND(_TIE), F.lit(21)), F.lit(blocks)).cast("long"))
    per_block = dealt.groupBy("block")

    anchors = per_block.applyInArrow(_send_anchors(window, anchor), "block long, hash long")
    beside = Window.partitionBy("hash").orderBy("block")
    shared = (
        anchors.withColumn("met", F.lag("block").over(beside).isNotNull() | F.lead("block").over(beside).isNotNull()).filter("met").select("block", "hash")
    )
    windows = per_block.cogroup(shared.groupBy("block")).applyInArrow(_send_windows(window, anchor), "block long, hash long, check int, at int, doc long, tie long, word long")
    first = Window.partitionBy("hash", "check").orderBy("doc", "tie", "word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        windows.withColumns({"n": F.row_number().over(first), "src_doc": F.first("doc").over(first), "src_word": F.first("word").over(first)})
        .filter("n > 1").select("block", "at", "src_doc", "src_word")
    )
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start:long,length:long,source_doc:long,source_start:long>>"
    return per_block.cogroup(found.groupBy("block")).applyInArrow(_parse(window, with_text), ddl + (", kept_text string" if with_text else ""))
