"""Exact dedup as a tree-merge of sorted digest runs, in DataFrame functions only.

1. Texts are read once; their digests are written down.
2. Documents are dealt into runs. A run is sorted by digest and holds, for each
   digest, its smallest row and its number of rows.
3. In every round the runs of ``FAN_IN`` partners are exchanged and merged: sorted
   by digest, equal neighbours become one, which keeps the smallest row and the
   sum of the counts. Rows are equal only if digest, length and a second hash
   agree, at every level.
4. The last run's groups go back down to the runs they came from, and the
   documents meet them there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import WHITESPACE, materialize

FAN_IN = 4
ROUNDS = 3
KEY = ("digest", "size", "check")


def _digests(docs: DataFrame, runs: int) -> DataFrame:
    folded = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), WHITESPACE, " ")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("raw"), folded.alias("_t")).select(
        "doc_id", "raw",
        F.unhex(F.sha2("_t", 256)).alias("digest"),
        F.octet_length("_t").alias("size"),
        F.xxhash64("_t").alias("check"),
        F.pmod(F.xxhash64("doc_id", "raw", F.lit(7)), F.lit(runs)).cast("int").alias("run"),
    )


def _merge(runs: DataFrame) -> DataFrame:
    """One run of each run number: sorted, equal neighbours as one row. A group has no more rows than runs merge."""
    equal = Window.partitionBy("run", *KEY)
    place = F.row_number().over(equal.orderBy("least"))
    return runs.withColumn("group_size", F.sum("group_size").over(equal)).withColumn("_place", place).filter("_place = 1").drop("_place")


def grouped(docs: DataFrame, fan_in: int = FAN_IN, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, raw`` (hash of the text as it is), ``digest, group_size`` and ``least`` of each row.

    ``least`` is a struct ``no_id, doc_id, raw``: the smallest row of the group,
    where null ids come last.
    """
    rows = materialize(_digests(docs, fan_in**rounds), "exact-digests")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "raw")
    # combined before the exchange: a digest that a third of the rows share is one row per task and run
    level = local = rows.groupBy("run", *KEY).agg(F.min(own).alias("least"), F.count(F.lit(1)).alias("group_size"))
    for _ in range(rounds):
        level = _merge(level.withColumn("run", (F.col("run") / fan_in).cast("int")))
    # only groups of two or more travel back
    placed = local.select("run", *KEY).join(level.filter("group_size > 1").drop("run"), [*KEY])
    return rows.join(placed, ["run", *KEY], "left").select(
        "doc_id", "raw", "digest", F.coalesce("least", own).alias("least"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Group texts that are identical after whitespace folding.

    Returns one row per input row, whatever other columns ``docs`` has:
    ``doc_id, keep_id, group_size, kept, text_sha256``. Null text counts as
    empty. A repeated ``doc_id`` with equal text counts each time, and all its
    rows are ``kept`` if it is the smallest. Null ids never win over others; a
    group of null ids only has a null ``keep_id`` and all rows are kept.
    """
    keep = F.col("least.doc_id")
    return grouped(docs).select(
        "doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def survivors(docs: DataFrame) -> DataFrame:
    """``doc_id, raw`` of the one row of each group that stays."""
    return grouped(docs).select("least.doc_id", "least.raw").distinct()


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM n
"""
