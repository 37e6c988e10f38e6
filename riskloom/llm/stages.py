"""Stages of the corpus pipeline: each takes ``(spark, docs, sf_dir)`` and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontamination, exact_dedup, minhash, packing, quality
from riskloom.llm.common import modest_batches, neutral, table
from riskloom.llm.queries import PACK_END, tokenizer_path

#: of the stage; op1's own contract is minhash.PERCENT
STAGE_PERCENT = 80


def _rows(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """One row of ``docs`` for each distinct ``doc_id, raw`` of ``keep``, where raw is ``xxhash64(text)``.

    Null ids count as an id. Only of rows that repeat both, one is chosen.
    """
    plain, names = neutral(docs)
    marked = plain.withColumn("_raw", F.xxhash64(F.col("text").cast("string")))
    wanted = keep.select(F.col("doc_id").alias("_id"), F.col("raw").alias("_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_raw").eqNullSafe(F.col("_key"))
    copies = marked.groupBy("doc_id", "_raw").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    kept = marked.join(wanted, same, "left_semi")
    if not copies.isEmpty():
        again = copies.select(F.col("doc_id").alias("_id"), F.col("_raw").alias("_key"))
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "_raw"]))
    return kept.select(names)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality sample takes; rows that repeat an id are judged each by their text.

    Null and empty texts have weight 0 and may be taken; ties and null ids as in ``quality.classify``. An empty
    table stays empty, and no column of ``docs`` clashes with one of the stage.
    """
    modest_batches(spark)
    return quality.sampled(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the smallest id, also where ids are repeated or null."""
    modest_batches(spark)
    return _rows(docs, exact_dedup.survivors(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, linked from a similarity of 0.8; texts without words are no copies of each other."""
    modest_batches(spark)
    return _rows(docs, minhash.near_duplicates(docs, STAGE_PERCENT).filter("stays"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; null and empty texts leak none and stay, rows that repeat an id are judged each."""
    modest_batches(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids and places in sequences of 4096.

    Null and empty texts are a piece of the end id alone; repeated and null ids are documents of their own. An empty table gives no rows.
    """
    modest_batches(spark)
    return packing.pack(docs, tokenizer_path(), 4096, PACK_END, with_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup_stage),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]
