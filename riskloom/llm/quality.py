"""Quality classifier by importance resampling.

Two generative models of bytes are counted: the probability of a byte after the
two bytes before it, from hashed 3-gram and 2-gram counts. The target model is
counted on labelled good documents, the raw model on all documents. A document's
log importance weight is the sum of the log-ratios of its bytes under the two
models; because each byte is judged in its context, a different share of
languages or topics in the labelled documents counts little. Sums are taken to
the power that makes all texts as long as one of ``SCALE`` bytes, as sums over
long texts would blow up small estimation errors. Documents are sampled without
replacement in proportion to these weights by Gumbel top-k: the ``k`` largest
values of log weight plus Gumbel noise, which comes from a hash. ``k`` is a share
of the corpus, by default an upper bound of the labelled share of good documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from riskloom.llm.common import materialize, neutral
from riskloom.llm.words import chunks

BUCKETS = 1 << 16
TARGET_DOCS = 20_000
PRIOR = 1_000.0
SEED = 61
SLICES, MERGES = 16, 64
#: A weight counts as that of a text of SCALE bytes; texts much shorter than HALF weigh less.
SCALE, HALF = 1_000.0, 200.0
#: Deviations of the labelled share of good documents that the default sample adds, as a lost good one costs more.
MARGIN = 2.0
_SPACE = np.arange(256, dtype=np.uint32)
_SPACE[9:14] = 32


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the 3-grams and of their contexts, and the places of their last bytes; they don't cross documents."""
    n = len(data)
    if n < 3:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    data = _SPACE[data]
    pair = (data[:-2] << np.uint32(8)) | data[1:-1]
    triple = ((pair << np.uint32(8)) | data[2:]) * np.uint32(0x9E3779B1)
    triple ^= triple >> np.uint32(15)
    first = np.repeat(offsets[:-1], np.diff(offsets))
    places = np.arange(2, n)
    keep = places - 2 >= first[2:]
    return (triple & np.uint32(BUCKETS - 1))[keep], pair[keep], places[keep]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(2 * BUCKETS, np.int64)
    for batch in batches:
        for _, data, offsets in chunks(batch.column("text")):
            triples, pairs, _ = _buckets(data, offsets)
            total[:BUCKETS] += np.bincount(triples, minlength=BUCKETS)
            total[BUCKETS:] += np.bincount(pairs, minlength=BUCKETS)
    part = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(SLICES), pa.int32()), pa.array([part % MERGES] * SLICES, pa.int32()), pa.array([x.tobytes() for x in np.split(total, SLICES)], pa.binary())],
        names=["slice", "merge", "counts"],
    )


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_buffer(), np.int64) for c in table.column("counts"))
    first = table.slice(0, 1)
    return pa.Table.from_arrays([first.column("slice"), first.column("merge"), pa.array([total.tobytes()], pa.binary())], names=["slice", "merge", "counts"])


def counts(texts: DataFrame) -> np.ndarray:
    """Counts of 3-grams, then of contexts.

    Each task sends its counts as ``SLICES`` packed arrays; they are added up in
    two rounds, and 131,072 numbers reach the driver.
    """
    ddl = "slice int, merge int, counts binary"
    parts = texts.select("text").mapInArrow(_count, ddl)
    once = parts.groupBy("slice", "merge").applyInArrow(_add, ddl)
    rows = once.groupBy("slice").applyInArrow(_add, ddl).orderBy("slice").collect()
    return np.concatenate([np.frombuffer(bytes(r["counts"]), np.int64) for r in rows]) if rows else np.zeros(2 * BUCKETS, np.int64)


class LogRatios:
    """Log of the target's over the raw probability of a byte in its context.

    The target model is smoothed towards the raw one by ``PRIOR`` pseudo-counts a
    context, so that contexts too rare in the target to judge have a ratio near
    zero. Everything is zero where there is nothing to compare.
    """

    def __init__(self, target: np.ndarray, raw: np.ndarray):
        self.target, self.raw = target, raw
        self.empty = not target.sum() or not raw.sum()

    def of(self, triples: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        if self.empty:
            return np.zeros(len(triples))
        raw = (self.raw[:BUCKETS][triples] + 0.5) / (self.raw[BUCKETS:][pairs] + 1.0)
        target = (self.target[:BUCKETS][triples] + PRIOR * raw) / (self.target[BUCKETS:][pairs] + PRIOR)
        return np.log(target / raw)


def _weigh(ratios: LogRatios, keep: list[str]):
    """Adds ``_log_weight`` to the columns ``keep``. A weight follows from its text alone, whatever stands beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights, sizes = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for first, data, offsets in chunks(batch.column("text").cast(pa.string())):
                triples, pairs, places = _buckets(data, offsets)
                n = len(offsets) - 1
                doc = np.repeat(np.arange(n), np.diff(offsets))[places]
                weights[first : first + n] = np.bincount(doc, ratios.of(triples, pairs), minlength=n)
                sizes[first : first + n] = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(np.round(SCALE * weights / (sizes + HALF), 6))], names=[*keep, "_log_weight"]
            )

    return run


def fit_ratios(docs: DataFrame, target: DataFrame, max_target: int = TARGET_DOCS) -> LogRatios:
    """Models of the texts of ``docs`` and of those whose ``doc_id`` is in ``target``.

    At most ``max_target`` target ids are used, drawn by a hash.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    chosen = target.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(max_target)
    # the ids are bounded, so they travel and the texts stay
    return LogRatios(counts(texts.join(F.broadcast(chosen), "doc_id", "left_semi")), counts(texts))


def row_hash(seed: int):
    """A hash of the id and the text, as a column."""
    return F.xxhash64("doc_id", F.xxhash64(F.col("text").cast("string")), F.lit(seed))


def gumbel(seed: int = SEED):
    """Standard Gumbel noise from the hash of a row, as a column."""
    u = (F.pmod(row_hash(seed), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def largest(values: DataFrame, column: str, k: int, bits: int = 64) -> tuple[int, int]:
    """The k-th largest value of a long column, and how many of its rows are among the k.

    A histogram is refined 16 bits at a time (at most 65,536 counts reach the
    driver), so nothing is sorted as a whole.
    """
    prefix = None
    for shift in range(bits - 16, -1, -16):
        level = values if prefix is None else values.filter(F.shiftright(column, shift + 16) == prefix)
        rows = level.groupBy(F.shiftright(column, shift).alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("b")).collect()
        for r in rows:
            prefix = r["b"]
            if r["n"] >= k:
                break
            k -= r["n"]
    return prefix, k


def good_share(labels: DataFrame) -> tuple[DataFrame, float]:
    """Ids of labelled good documents, and the upper bound of their share; all documents where labels are of one kind.

    Of ids with several labels the worst counts.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    r = known.agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good")).first()
    n, good = r["n"], r["good"] or 0
    share = 1.0 if not 0 < good < n else good / n + MARGIN * (good * (n - good) / n**3) ** 0.5
    return known.filter("quality = 1").select("doc_id"), min(1.0, share)


def _keyed(docs: DataFrame, ratios: LogRatios) -> DataFrame:
    """``docs`` with ``_log_weight``, ``_key``, its millionths ``_bits`` and a ``_tie``; no shuffle."""
    named = docs.mapInArrow(_weigh(ratios, docs.columns), StructType([*docs.schema.fields, StructField("_log_weight", DoubleType())]))
    return named.withColumn("_key", F.col("_log_weight") + gumbel()).withColumns({"_bits": F.floor(F.col("_key") * 1e6), "_tie": row_hash(SEED + 1)})


def _sample(docs: DataFrame, labels: DataFrame, share: float | None) -> tuple[LogRatios, DataFrame, object]:
    target, good = good_share(labels)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ratios = fit_ratios(slim, target)
    weighed = materialize(_keyed(slim, ratios).drop("text"), "quality-weights")
    n = weighed.count()
    k = round(n * (good if share is None else share))
    if not 0 < k < n:
        return ratios, weighed, F.lit(k > 0)
    last, rest = largest(weighed, "_bits", k)
    tie, _ = largest(weighed.filter(F.col("_bits") == last), "_tie", rest)
    return ratios, weighed, (F.col("_bits") > last) | ((F.col("_bits") == last) & (F.col("_tie") >= tie))


def classify(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """``doc_id, log_weight, key, kept`` for each row of ``docs``.

    ``labels`` has ``doc_id, quality``; its rows with quality 1 are the target.
    ``share`` is the part of the documents to sample; by default that of good
    documents among the labelled ones plus ``MARGIN`` deviations (with labels of
    one kind all documents are kept). Labels decide nothing else.

    Null and empty texts have weight 0. Rows that repeat an id are judged each;
    only rows that repeat id and text share their noise. Ties on the last key
    are kept or left by a hash of id and text, equal rows together. Null ids are
    ids like others; other columns don't matter.
    """
    _, weighed, inside = _sample(docs, labels, share)
    return weighed.select("doc_id", F.col("_log_weight").alias("log_weight"), F.col("_key").alias("key"), inside.alias("kept"))


def sampled(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns.

    The cut is found on narrow rows; then the documents are weighed again where
    they are read, which gives the same keys, so no text is shuffled.
    """
    ratios, _, inside = _sample(docs, labels, share)
    plain, names = neutral(docs)
    return _keyed(plain, ratios).filter(inside).select(names)
