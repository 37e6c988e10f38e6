"""Token ids as files: one zstandard frame per document under a shared dictionary.

A store is a folder with two Parquet tables, so that any file system Spark
reaches can hold it:

* ``dictionary``: one row ``dict_hash, dictionary, width, end_id``.
* ``blocks``: a row per block of documents in ascending ``doc_id`` order:
  ``part, block, part_start`` (ids of the part before this block), ``doc_ids``,
  ``counts`` (ids of each document), ``offsets`` (byte offsets of the frames,
  one more than documents), ``frames`` and ``dict_hash``.

Frames are independent: with the offset index one short document is read by
decompressing its few bytes alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import shuffle_partitions
from riskloom.llm.encoder import WordEncoder, encoded

SAMPLE_DOCS = 400
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES = 4 << 20
LEVEL = 1


def narrow(ids: bytes, width: int) -> bytes:
    """Unsigned 32-bit ids in ``width`` bytes each; an id that does not fit is an error."""
    if width == 4:
        return ids
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and wide.max() > 0xFFFF:
        raise ValueError("ids above 65,535 need a width of 4")
    return wide.astype("<u2").tobytes()


def sampled(docs: DataFrame, rows: int, seed: int) -> DataFrame:
    """``doc_id, text`` of at most ``rows`` documents, drawn by a hash of their id.

    Ids are drawn first, so no text travels but those of the sample; of rows
    that repeat an id the one whose text has the smallest hash is taken.
    """
    ids = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    )


def train_dictionary(docs: DataFrame, path: str, end_id: int, width: int) -> bytes:
    """A dictionary of at most ``DICTIONARY_BYTES`` from ``SAMPLE_DOCS`` documents drawn by a hash of their id.

    The sample shapes file sizes only, never the ids that are read back. Tables
    too small to train on give an empty dictionary.
    """

    def sample(batches):
        encoder = WordEncoder.get(path)
        for batch in batches:
            ids = [narrow(b + int(end_id).to_bytes(4, "little"), width) for b in encoded(batch.column("text"), encoder)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])

    drawn = sampled(docs, SAMPLE_DOCS, 41).select("text")
    samples = [bytes(r["ids"]) for r in drawn.mapInArrow(sample, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _compressor(dictionary: bytes):
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data)


def _decompressor(dictionary: bytes):
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=data)


def _write_blocks(path: str, end_id: int, width: int, dictionary: bytes, dict_hash: str):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, compress = WordEncoder.get(path), _compressor(dictionary).compress
        part, block, start = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        counts: list[int] = []
        frames: list[bytes] = []
        size = 0

        def row():
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype(np.int64)
            values = [part, block, start, ids, counts, offsets.tolist(), b"".join(frames), dict_hash]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, _BLOCK.types, strict=True)], schema=_BLOCK
            )

        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text"), encoder), strict=True):
                frame = compress(narrow(raw + end, width))
                ids.append(doc)
                counts.append(len(raw) // 4 + 1)
                frames.append(frame)
                size += len(frame)
                if size >= BLOCK_BYTES:
                    yield row()
                    start += sum(counts)
                    block += 1
                    ids, counts, frames, size = [], [], [], 0
        if ids:
            yield row()

    return run


_BLOCK = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int32()), ("part_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("frames", pa.binary()), ("dict_hash", pa.string()),
    ]
)
_BLOCK_DDL = (
    "part int, block int, part_start long, doc_ids array<long>, counts array<long>, offsets array<long>, frames binary, dict_hash string"
)


def write_token_store(docs: DataFrame, out: str, tokenizer: str, end_id: int, width: int = 2) -> None:
    """Encode ``docs`` (``doc_id, text``) and write them to the folder ``out``.

    Null text counts as empty and becomes the end id alone. Documents are in
    ascending ``doc_id`` order (null ids first, repeated ids side by side).
    ``width`` is the bytes per id in a frame; 2 suits vocabularies up to 65,536
    ids, and a larger id fails.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    dictionary = train_dictionary(docs, tokenizer, end_id, width)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame(
        [(dict_hash, bytearray(dictionary), width, end_id)], "dict_hash string, dictionary binary, width int, end_id int"
    ).coalesce(1).write.parquet(f"{out}/dictionary")
    (
        docs.repartitionByRange(shuffle_partitions(spark), "doc_id")
        .sortWithinPartitions("doc_id")
        .mapInArrow(_write_blocks(tokenizer, end_id, width, dictionary, dict_hash), _BLOCK_DDL)
        .write.option("compression", "none")
        .parquet(f"{out}/blocks")
    )


def _read(width: int, dictionary: bytes, dict_hash: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _decompressor(dictionary).decompress
        for batch in batches:
            for r in range(batch.num_rows):
                if batch.column("dict_hash")[r].as_py() != dict_hash:
                    raise ValueError("block and dictionary do not belong together")
                frames, offsets = batch.column("frames")[r].as_buffer(), batch.column("offsets")[r].values.to_numpy()
                counts = batch.column("counts")[r].values.to_numpy()
                starts = batch.column("part_start")[r].as_py() + np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
                view = memoryview(frames)
                n, crc, ids = [], [], []
                for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    raw = read(view[i:j])
                    wide = np.frombuffer(raw, f"<u{width}").astype("<u4")
                    n.append(len(wide))
                    crc.append(zlib.crc32(wide.tobytes()))
                    if with_ids:
                        ids.append(wide.astype(np.int32))
                if n != counts.tolist():
                    raise ValueError("a frame does not hold the number of ids its block says")
                m = len(n)
                columns = [
                    batch.column("doc_ids")[r].values, pa.array(np.full(m, batch.column("part")[r].as_py(), np.int32)), pa.array(starts),
                    pa.array(n, pa.int64()), pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read_token_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a store: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``.

    ``start`` is the number of ids of all documents before. Only the dictionary
    (at most 64 KB) and one number per part travel to all tasks.
    """
    head = spark.read.parquet(f"{path}/dictionary").first()
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(
        F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    ddl = "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    docs = blocks.mapInArrow(_read(head["width"], bytes(head["dictionary"]), head["dict_hash"], with_ids), ddl)
    return docs.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("local_start") + F.col("part_base")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])
    )
