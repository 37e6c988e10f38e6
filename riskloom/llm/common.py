"""Shared helpers of the corpus operators: scratch tables, ranks, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WHITESPACE = r"[\x20\x09-\x0D]+"


_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    A session of one machine (master ``local``) that names none gets a temporary
    folder, which is remembered in the session; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="riskloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, remembered for ``discard``."""
    _WRITTEN.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def written() -> int:
    """How many scratch tables this session has begun so far."""
    return len(_WRITTEN)


def last_written() -> str:
    return _WRITTEN[-1]


def discard(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Delete the scratch tables begun after the first ``since`` ones, but for the path ``keep``.

    For callers that have written or shown all results: whatever still reads these tables fails.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in [p for p in _WRITTEN[since:] if p != keep]:
        where = hadoop.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _WRITTEN.remove(path)


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors and lets later steps
    use a result several times without computing it again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch; Spark's default is 10,000, which of texts is most of a Python worker's memory.
BATCH_ROWS = 2_000


def modest_batches(spark: SparkSession) -> None:
    """Ask for Arrow batches of ``BATCH_ROWS`` rows where the session still has Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def neutral(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with plain names but for ``doc_id`` and ``text``, and columns that give the old names back.

    Whatever a stage adds then can't clash with a column of the caller.
    """
    own = [n if n.lower() in ("doc_id", "text") else f"column{i}" for i, n in enumerate(docs.columns)]
    return docs.toDF(*own), [F.col(c).alias(n) for c, n in zip(own, docs.columns, strict=True)]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_rank(df: DataFrame, order: list, label: str, rank_col: str = "rank") -> DataFrame:
    """Zero-based global rank by ``order`` without a one-task window.

    Rows are dealt by ranges of the sort key, numbered inside their part, and
    shifted by the number of rows in the parts before it. The parts are written
    once, so that both passes see the same split.
    """
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    parts = materialize(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id()),
        label,
    )
    local = parts.withColumn("_row", F.col("_seq") - F.shiftleft(F.col("_part").cast("long"), 33))
    # one row per part: the window below runs over as many rows as there are parts
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        local.join(F.broadcast(starts), "_part")
        .withColumn(rank_col, F.col("_start") + F.col("_row"))
        .drop("_part", "_seq", "_row", "_n", "_start")
    )


def connected_components(edges: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    ``edges`` has long columns ``a`` and ``b``. Returns ``node, component`` for
    each node of an edge, where ``component`` is the smallest reachable node.
    Each round is a few aggregations and joins on node ids; rounds end when no
    edge changes. Nothing but one count and one checksum reaches the driver.
    """
    spark = edges.sparkSession

    def undirected(e):
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large_star(e):
        both = undirected(e)
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")

    def small_star(e):
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        near = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return near.union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

    def mark(e):
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40)).alias("h")).first()
        return r["n"], r["h"]

    current = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-cc"
    )
    state = mark(current)
    for _ in range(max_rounds):
        if not state[0]:
            break
        current = materialize(small_star(large_star(current)), f"{label}-cc")
        previous, state = state, mark(current)
        if state == previous:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").union(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return table(spark, sf_dir, "documents")
