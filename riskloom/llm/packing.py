"""Best-fit packing planned over the histogram of lengths."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import materialize
from riskloom.llm.encoder import WordEncoder, encoded

#: ids that one part of a length holds at most, more or less
PART_IDS = 4 << 20


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Lengths come from the longest to the shortest. All pieces of a length are
    placed together: into the open sequences with the least room that still
    takes them, as many in each as fit, then into new ones. Open sequences are
    kept as intervals of sequence numbers by the room left.

    Returns runs ``(length, first_rank, count, first_sequence, offset, each)``:
    the piece of that length with rank ``first_rank + i`` goes to sequence
    ``first_sequence + i // each`` at ``offset + i % each * length``. A length
    adds four intervals at most and visits an interval once, and an interval
    takes pieces of less than sqrt(2 size) lengths, so there are fewer than
    ``4 * size * sqrt(2 * size)`` runs however many pieces there are.
    """
    rooms: list[int] = []
    open_at: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in open_at:
                bisect.insort(rooms, room)
                open_at[room] = []
            open_at[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def fill(first: int, room: int, most: int, length=length) -> int:
            """Stack pieces into at most ``most`` sequences from ``first`` on, each with ``room``; how many it used."""
            nonlocal left, rank
            each = room // length
            full, rest = divmod(min(left, each * most), each)
            for at, n, per in ((first, full, each), (first + full, min(rest, 1), rest)):
                if n:
                    runs.append((length, rank, n * per, at, size - room, per))
                    rank, left = rank + n * per, left - n * per
                    put(room - per * length, at, n)
            return full + (rest > 0)

        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                sequences += fill(sequences, size, left)
                break
            room = rooms[i]
            first, count = open_at[room].pop()
            if not open_at[room]:
                del open_at[room]
                rooms.pop(i)
            used = fill(first, room, count)
            put(room, first + used, count - used)
    return runs


def _pieces(path: str, end_id: int, size: int, with_ids: bool):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.get(path)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc, raw in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text"), encoder), strict=True):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * size)):
                    cut = raw[at : at + 4 * size]
                    rows.append((doc, piece, at // 4, len(cut) // 4, zlib.crc32(cut), np.frombuffer(cut, "<i4") if with_ids else None))
                held += len(raw) if with_ids else 0
                if held > 1 << 23:
                    yield _batch(rows, with_ids)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, with_ids)

    return run


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    keep = len(names) if with_ids else 5
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(keep)], names=names[:keep])


def _place(runs: list[tuple[int, int, int, int, int, int]]):
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    keys = (table[:, 0] << 48) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            slot = table[np.searchsorted(keys, (length << 48) + batch.column("rank").to_numpy(), "right") - 1]
            i = batch.column("rank").to_numpy() - slot[:, 1]
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "rank"]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(slot[:, 3] + i // slot[:, 5]), pa.array(slot[:, 4] + i % slot[:, 5] * length)], names=[*names, "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` ids.

    A document is its ids and an end id (null text: the end id alone); only
    documents longer than ``size`` are cut, into pieces of ``size``. Returns one
    row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset`` and, if asked for, ``ids``. Places in a sequence have no gaps and
    start at 0. Rows with repeated or null ids are separate documents; a table
    without rows gives no pieces.

    The driver sees the histogram (at most ``size`` rows) and plans over it; the
    plan's runs, whose number does not follow the number of pieces, go to the
    tasks. Pieces are numbered within their length in parts of about
    ``PART_IDS`` ids, so a length that many documents share is dealt over many
    tasks, and shifted by the sizes of the parts before.
    """
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    pieces = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(tokenizer, end_id, size, with_ids), ddl),
        "packing-pieces",
    )
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan(histogram, size)
    # at most ``size`` rows
    parts = docs.sparkSession.createDataFrame([(n, -(-n * k // PART_IDS)) for n, k in histogram.items()], "length long, parts long")
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(9)), "parts")).drop("parts")
    counts = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = (
        dealt.withColumn("own", own).join(shifts, ["length", "part"])
        .select(*pieces.columns, (F.col("own") - 1 + F.col("shift")).alias("rank"))
    )
    return ranked.mapInArrow(_place(runs), ddl + ", sequence_id long, offset long")
