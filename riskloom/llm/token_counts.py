"""Documents and their token counts in flat token files, by a scan for separators.

A flat stream is a folder of files that hold nothing but ids, block after block,
with an end id after each document. Beside the ids a block names the documents
it closes; nothing tells where they begin or how long they are. The order of the
stream is that of the files' numbers and of the rows in a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import materialize
from riskloom.llm.encoder import WordEncoder, encoded
from riskloom.llm.token_store import narrow

BLOCK_IDS = 1 << 17


def _flat(path: str, end_id: int, width: int, block_ids: int):
    end, full = int(end_id).to_bytes(4, "little"), width * block_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held = WordEncoder.get(path, True), bytearray()
        closed: list[tuple[int, int | None]] = []  # where a document ends in what is held, and its id

        def row(size: int) -> pa.RecordBatch:
            names = [doc for at, doc in closed if at <= size]
            out = pa.RecordBatch.from_arrays([pa.array([bytes(held[:size])], pa.binary()), pa.array([names], pa.list_(pa.int64()))], names=["payload", "doc_ids"])
            closed[:] = [(at - size, doc) for at, doc in closed if at > size]
            del held[:size]
            return out

        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text"), encoder), strict=True):
                held += narrow(raw + end, width)
                closed.append((len(held), doc))
                while len(held) >= full:
                    yield row(full)
        if held:
            yield row(len(held))

    return run


def write_flat(docs: DataFrame, out: str, tokenizer: str, end_id: int, width: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all documents as one flat stream, in the order in which the rows are read.

    No text is shuffled. Blocks of ``block_ids`` unsigned ids of ``width`` bytes
    end wherever they fill up, inside documents too. Strings of special tokens
    in a text are ordinary text, so only separators carry the end id. Null text
    counts as empty; null and repeated ids are documents like others.
    """
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_flat(tokenizer, end_id, width, block_ids), "payload binary, doc_ids array<long>")
        .write.option("compression", "zstd")
        .parquet(out)
    )


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a flat stream: ``part`` (number of the file), ``block`` (row in the file), ``payload, doc_ids``."""
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    blocks = spark.read.schema("payload binary, doc_ids array<long>").parquet(path)
    return blocks.select(part.alias("part"), F.col("_metadata.row_index").alias("block"), "payload", "doc_ids")


def _scan(end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for value in batch.column("payload"):
                ids = np.frombuffer(value.as_buffer() if value.is_valid else b"", f"<u{width}")
                sizes.append(len(ids))
                found.append(np.flatnonzero(ids == end_id))
            for named, at in zip(batch.column("doc_ids"), found, strict=True):
                if named.is_valid and len(named) != len(at):
                    raise ValueError("a block names another number of documents than it closes")
            kept = [n for n in batch.schema.names if n != "payload"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=[*kept, "n_ids", "at"]
            )

    return run


def count_tokens(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """Documents in flat blocks ``part, block, payload`` and, if they are named, ``doc_ids``.

    Each block is searched for the end id in one vectorised pass, once; what is
    found is written down. A prefix scan over the blocks - inside each part,
    then over the parts - gives every block the number of ids and of documents
    before it and the place of the last separator before it, which closes the
    documents that run across blocks. Returns ``ordinal, start, n_tokens,
    terminated`` and ``doc_id`` (null where not named); ids after the last
    separator form a last document that is not ``terminated``. Empty blocks,
    blocks without a payload and empty documents (two separators in a row) are
    fine. A block that names another number of documents than it closes fails.
    """
    if "doc_ids" not in blocks.columns:
        blocks = blocks.withColumn("doc_ids", F.lit(None).cast("array<long>"))
    ddl = "part long, block long, doc_ids array<long>, n_ids long, at array<long>"
    seen = materialize(
        blocks.select(F.col("part").cast("long").alias("part"), F.col("block").cast("long").alias("block"), "doc_ids", "payload").mapInArrow(_scan(end_id, width), ddl), "separators"
    )
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    local = seen.select(
        "part", "block", "n_ids", "at", "doc_ids",
        F.coalesce(F.sum("n_ids").over(inside), zero).alias("ids_before"),
        F.coalesce(F.sum(F.size("at")).over(inside), zero).cast("long").alias("docs_before"),
    ).withColumn("last_own", F.when(F.size("at") > 0, F.col("ids_before") + F.element_at("at", -1)))
    local = local.withColumn("last_before", F.max("last_own").over(inside))
    parts = local.groupBy("part").agg(F.sum("n_ids").alias("ids"), F.sum(F.size("at")).alias("docs"), F.max("last_own").alias("last"))
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per part, which is a file
    bases = (
        parts.withColumn("part_ids", F.coalesce(F.sum("ids").over(across), zero))
        .withColumn("part_docs", F.coalesce(F.sum("docs").over(across), zero))
        .withColumn("part_last", F.max(F.col("part_ids") + F.col("last")).over(across))
        .select("part", "part_ids", "part_docs", "part_last")
    )
    placed = local.join(bases, "part").select(
        (F.col("part_docs") + F.col("docs_before")).alias("first"),
        (F.col("part_ids") + F.col("ids_before")).alias("base"),
        F.coalesce(F.col("part_ids") + F.col("last_before"), F.col("part_last"), F.lit(-1).cast("long")).alias("previous"),
        "at", "n_ids", "doc_ids",
    )
    closed = (
        placed.select("first", "base", "previous", F.posexplode("at").alias("i", "p"), "at", "doc_ids")
        .select(
            (F.col("first") + F.col("i")).alias("ordinal"),
            F.when(F.col("i") == 0, F.col("previous")).otherwise(F.col("base") + F.expr("at[i - 1]")).alias("previous"),
            (F.col("base") + F.col("p")).alias("end"),
            F.expr("doc_ids[i]").alias("doc_id"),
        )
        .select(
            "ordinal", (F.col("previous") + 1).alias("start"), (F.col("end") - F.col("previous") - 1).alias("n_tokens"), F.lit(True).alias("terminated"), "doc_id"
        )
    )
    rest = (
        placed.groupBy()
        .agg(
            F.sum(F.size("at")).alias("docs"), F.sum("n_ids").alias("ids"),
            F.max(F.greatest("previous", F.when(F.size("at") > 0, F.col("base") + F.element_at("at", -1)))).alias("last"),
        )
        .filter("ids > last + 1")
        .select(
            F.col("docs").alias("ordinal"), (F.col("last") + 1).alias("start"), (F.col("ids") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("terminated"),
            F.lit(None).cast("long").alias("doc_id"),
        )
    )
    return closed.unionByName(rest)


def document_counts(spark: SparkSession, flat: str, end_id: int, width: int = 2) -> DataFrame:
    """``doc_id, ordinal, start, n_tokens`` of the documents of a flat stream; the separator is not counted."""
    return count_tokens(read_flat(spark, flat), end_id, width).select("doc_id", "ordinal", "start", "n_tokens")
