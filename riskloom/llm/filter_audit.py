"""Filter interaction audit: what five quality filters remove in every order.

1. A byte transducer reads each text once. Its state is whether the byte before
   belongs to a word; a table gives, for state and byte, what is counted (words,
   capitals, code points) and whether a word ends there. As the next state
   follows from the byte alone, the states of a whole piece of text are one
   look-up, and running sums of the packed counts give every text's share. Word
   spans go into a hash table whose hits are compared byte by byte.
2. Texts meet by digest. Equal texts fail the same filters, so a group is counted
   by part and label before it travels, however many rows it has.
3. Counts by part and set of failed filters become sums over all sets that avoid a
   given one; any order and step is a difference of two such sums.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import materialize
from riskloom.llm.words import hash_words, mix, padded, same_words

# fixed values: the filters and their limits
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITAL_PERCENT = 2
SYMBOLS = b"#$%&*|"
COPY = 1 << FILTERS.index("E")

PIECE_BYTES = 1 << 18
_FIELD = 21
_END = np.uint64(1 << 63)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
#: state after each byte, as the place of its half of the table: 0 outside a word, 256 inside
_STATE = np.where(_SPACE, 0, 256).astype(np.uint16)


def _table() -> np.ndarray:
    """For state and byte: words begun, capitals and code points in fields of 21 bits, and the end of a word as the top bit."""
    byte = np.arange(256)
    counted = (((byte >= 65) & (byte <= 90)).astype(np.uint64) << np.uint64(_FIELD)) | (((byte & 0xC0) != 0x80).astype(np.uint64) << np.uint64(2 * _FIELD))
    outside = counted | (~_SPACE).astype(np.uint64)
    inside = counted | np.where(_SPACE, _END, np.uint64(0))
    return np.concatenate([outside, inside])


_TABLE = _table()


class WordTable:
    """Distinct words of documents: open addressing over spans, hits compared byte by byte.

    A key is a document and the bytes of a word in ``pad``; only spans are stored.
    """

    def __init__(self, pad: np.ndarray):
        self.pad = pad
        self.slots = np.full(1024, -1, np.int32)
        self.doc, self.start, self.end = (np.zeros(0, np.int64) for _ in range(3))
        self.hash = np.zeros(0, np.uint64)

    def _place(self, doc, start, end, hashes) -> np.ndarray:
        """Put words into slots; which of them are new. Numbers in the table go on after the ones that are there."""
        old, mask = len(self.doc), len(self.slots) - 1
        every = [np.concatenate(pair) for pair in ((self.doc, doc), (self.start, start), (self.end, end), (self.hash, hashes))]
        at = (hashes & np.uint64(mask)).astype(np.int64)
        new, open_ = np.zeros(len(doc), bool), np.arange(len(doc))
        while len(open_):
            spot, own = at[open_], open_ + old
            free = self.slots[spot] < 0
            self.slots[spot[free]] = own[free]
            holder = self.slots[spot].astype(np.int64)
            won = holder == own
            new[open_[won]] = True
            same = ~won & (every[0][holder] == every[0][own]) & (every[3][holder] == every[3][own])
            check = np.flatnonzero(same)
            a, b = own[check], holder[check]
            same[check] = same_words(self.pad, every[1][a], every[2][a], self.pad, every[1][b], every[2][b])
            open_ = open_[~(won | same)]
            at[open_] = (at[open_] + 1) & mask
        number = old + np.cumsum(new) - 1
        self.slots[at[new]] = number[new]
        keep = np.concatenate([np.ones(old, bool), new])
        self.doc, self.start, self.end, self.hash = (e[keep] for e in every)
        return new

    def insert(self, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Documents of the words that were not there yet, one entry per word."""
        if not len(doc):
            return doc
        need = 2 * (len(self.doc) + len(doc))
        if need > len(self.slots):
            held = (self.doc, self.start, self.end, self.hash)
            self.slots = np.full(1 << int(need - 1).bit_length(), -1, np.int32)
            self.doc, self.start, self.end = (np.zeros(0, np.int64) for _ in range(3))
            self.hash = np.zeros(0, np.uint64)
            self._place(*held)
        hashes = mix(hash_words(self.pad, start, end) ^ mix(doc.astype(np.uint64)))
        return doc[self._place(doc, start, end, hashes)]


def _pieces(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int, int, int]]:
    """``first row, rows, first byte, last byte`` of groups of texts of up to ``limit`` bytes; a longer text comes in several pieces."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1))
        for low in range(int(offsets[row]), max(int(offsets[end]), int(offsets[row]) + 1), limit):
            yield row, end - row, low, min(low + limit, int(offsets[end]))
        row = end


def profile_texts(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE_BYTES) -> np.ndarray:
    """``words, distinct words, capitals, code points, symbols`` of each text, one row of the result each."""
    out = np.zeros((5, len(offsets) - 1), np.int64)
    pad, table, begun = padded(data), None, -1
    low_bits = np.uint64((1 << _FIELD) - 1)
    for row, rows, low, high in _pieces(offsets, limit):
        cuts = np.clip(offsets[row : row + rows + 1], low, high)
        if low == offsets[row]:
            table, begun = WordTable(pad), -1
        raw = data[low:high]
        if not len(raw):
            continue
        before = np.empty(len(raw), np.uint8)
        before[1:] = raw[:-1]
        before[cuts[:-1][cuts[:-1] < high] - low] = 32
        if low > offsets[row]:
            before[0] = data[low - 1]
        told = _TABLE[_STATE[before] + raw]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(told & ~_END)])
        share = sums[cuts[1:] - low] - sums[cuts[:-1] - low]
        at = slice(row, row + rows)
        out[0, at] += (share & low_bits).astype(np.int64)
        out[2, at] += ((share >> np.uint64(_FIELD)) & low_bits).astype(np.int64)
        out[3, at] += (share >> np.uint64(2 * _FIELD)).astype(np.int64)
        marks = np.flatnonzero(_SYMBOL[raw]) + low
        out[4, at] += np.diff(np.searchsorted(marks, cuts))
        # words that end in this piece: at white space, or with their text
        last = cuts[1:][(cuts[1:] > cuts[:-1]) & (cuts[1:] == offsets[row + 1 : row + rows + 1])]
        last = last[~_SPACE[data[last - 1]]]
        ends = np.sort(np.concatenate([np.flatnonzero(told & _END) + low, last]))
        starts = np.flatnonzero(told & np.uint64(1)) + low
        if begun >= 0:
            starts = np.concatenate([[begun], starts])
        begun = int(starts[-1]) if len(starts) > len(ends) else -1
        starts = starts[: len(ends)]
        doc = np.searchsorted(offsets[row + 1 : row + rows + 1], starts, "right") + row
        np.add.at(out[1], table.insert(doc, starts, ends), 1)
    return out


def failures(words, distinct, capitals, points, symbols) -> np.ndarray:
    """Bits of the filters A to D that a text fails."""
    failed = [words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT_PERCENT * words, 100 * capitals > MOST_CAPITAL_PERCENT * points, symbols > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(failed))


_COUNTS = ("words", "distinct_words", "capitals", "code_points", "symbols")


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").fill_null("").cast(pa.large_string())
        n = len(texts)
        if not n:
            continue
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        counts = profile_texts(data, offsets)
        digests = [hashlib.sha256(data[i:j]).digest() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), *(pa.array(c) for c in counts), pa.array(failures(*counts))],
            names=["doc_id", "part", "digest", *_COUNTS, "failed"],
        )


def text_profiles(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, words, distinct_words, capitals, code_points, symbols, failed`` of each row of ``docs``.

    ``part`` is the source, empty where it is null; ``digest`` the SHA-256 of the
    text; ``failed`` has a bit for each of the filters A to D. Null text counts
    as empty; an empty text fails A alone. Other columns don't matter.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_profile, "doc_id long, part string, digest binary, " + ", ".join(f"{c} long" for c in _COUNTS) + ", failed int")


def failure_counts(profiles: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, failed, n, good, toxic``: documents by the set of filters A to E they fail.

    E: another row with a smaller id has the same text. Rows that repeat the
    smallest id of a text all pass; null ids are larger than others, and a text
    that only they have passes. Of an id with several labels any counts.
    """
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic")
    )
    marked = profiles.join(known, profiles["doc_id"] == known["_id"], "left").select(
        "doc_id", "part", "digest", "failed", F.coalesce("_good", F.lit(0)).alias("good"), F.coalesce("_toxic", F.lit(0)).alias("toxic")
    )
    kind = ["digest", "failed", "part", "good", "toxic"]
    rows = marked.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "n")
    # a text is one row per part and label from here on, however many copies it has
    texts = rows.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(own).alias("least"))
    first = F.min("least").over(Window.partitionBy("digest"))
    leads = (F.col("least.no_id") == F.col("first.no_id")) & F.col("least.doc_id").eqNullSafe(F.col("first.doc_id"))
    stays = F.when(leads, F.col("least.n")).otherwise(0)
    split = texts.withColumn("first", first).withColumn(
        "_s", F.explode(F.array(F.struct(F.col("failed").alias("f"), stays.alias("n")), F.struct(F.col("failed").bitwiseOR(COPY).alias("f"), (F.col("n") - stays).alias("n"))))
    )
    return split.filter("_s.n > 0").groupBy("part", F.col("_s.f").alias("failed")).agg(
        F.sum("_s.n").alias("n"), F.sum(F.col("_s.n") * F.col("good")).alias("good"), F.sum(F.col("_s.n") * F.col("toxic")).alias("toxic")
    )


def orders(filters: str = FILTERS) -> list[dict]:
    """Every order and step: the bit of the filter and those applied before it."""
    out = []
    for order in permutations(filters):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << filters.index(name)
            out.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    return out


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order and step of ``part, failed, n, good, toxic``: what the step keeps, removes and loses."""
    sets = range(1 << len(filters))
    total = 1
    for i in range(2, len(filters) + 1):
        total *= i
    avoid = lambda c: F.array(*[F.sum(F.when(F.col("failed").bitwiseAND(s) == 0, F.col(c)).otherwise(0)) for s in sets])
    # of all orders, a document falls to each of its k failing filters in one of k
    share = F.col("n") * (total / F.bit_count("failed")).cast("long")
    sums = counts.groupBy("part").agg(
        avoid("n").alias("n"), avoid("good").alias("good"), avoid("toxic").alias("toxic"),
        F.array(*[F.sum(F.when(F.col("failed") == s, F.col("n")).otherwise(0)) for s in sets]).alias("only"),
        F.array(*[F.sum(F.when(F.col("failed").bitwiseAND(1 << i) != 0, share).otherwise(0)) for i in range(len(filters))]).alias("shapley"),
    )
    steps = F.from_json(F.lit(json.dumps(orders(filters))), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    at = lambda c, s: F.get(c, s)
    before, after, bit = F.col("before"), F.col("before").bitwiseOR(F.col("bit")), F.col("bit")
    lost = lambda c: at(c, before) - at(c, after)
    number = F.bit_count(bit - 1)
    return sums.select("*", F.inline(steps)).select(
        "part", "filter_order", "step", at("n", after).alias("kept"), lost("n").alias("removed"), (at("n", F.lit(0)) - at("n", bit) - lost("n")).alias("redundant"),
        at("only", bit).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), at("shapley", number).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Five filters in all 120 orders over whole texts, by source.

    A: under 200 words; B: fewer distinct words than half; C: more than 2 capitals
    in 100 code points; D: one of ``#$%&*|``; E: a copy of an earlier id. Returns
    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``. Null text is empty, a null source the part ``''``; for
    repeated and null ids see ``failure_counts``. An empty table gives no rows.
    """
    return interactions(failure_counts(materialize(text_profiles(docs), "filter-profiles"), labels))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), f AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS failed
  FROM w
), l AS (
  SELECT doc_id, CAST(max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS INT) AS good, CAST(max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS INT) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, failed
), b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)
), o AS (
  SELECT p.name || q.name || r.name || s.name || t.name AS filter_order FROM b p, b q, b r, b s, b t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31
    AND p.bit | q.bit | r.bit | s.bit | t.bit = 31
), s AS (
  SELECT filter_order, CAST(k AS INT) AS step, b.name, b.bit, coalesce((SELECT sum(e.bit) FROM b e WHERE position(e.name IN filter_order) < k), 0)::INT AS before
  FROM o, range(1, 6) AS r(k), b WHERE b.name = substr(filter_order, CAST(k AS INT), 1)
), a AS (
  SELECT part, filter_order, step, name,
    sum(CASE WHEN failed & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN failed & before = 0 AND failed & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN failed & before > 0 AND failed & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN failed = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN failed & before = 0 AND failed & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN failed & before = 0 AND failed & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, name
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, name) AS BIGINT) AS shapley FROM a
"""
