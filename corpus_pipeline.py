"""Corpus pipeline: quality, exact and near dedup, decontamination, packing.

``STAGES`` are applied in turn to ``documents``; what a stage returns is written
as Parquet to the shared folder and read again as the next one's documents. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.common import discard, documents, last_written, materialize, written
from riskloom.llm.stages import STAGES

#: SQL can't express the quality sample, MinHash and packing; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. Scratch tables of a stage go once its result is written; the last stage's stay for the caller."""
    docs, begun = documents(spark, sf_dir), written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        discard(spark, begun, keep=last_written())
    return STAGES[-1][1](spark, docs, sf_dir)
