"""Structured Streaming operators and their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from riskloom.functions.scalars import fingerprint, risk_group


def score_rows(rows: DataFrame, predictor: Column, low: float, high: float) -> DataFrame:
    """SM-01: probability and risk group of each row; the same plan serves batches and streams."""
    return rows.withColumn("p", predictor).withColumn("risk", risk_group("p", low, high))


def changed_only_batch(rows: DataFrame, key: str, order: list[str], cols: list[str], ttl: str | None = None, ts: str | None = None) -> DataFrame:
    """SM-02, batch twin: rows whose fingerprint differs from the previous one of their key, or that come more than ``ttl`` after it (by ``ts``)."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("state_print", fingerprint(cols)).withColumn("_last", F.lag("state_print").over(w))
    emit = F.col("_last").isNull() | (F.col("state_print") != F.col("_last"))
    if ttl:
        marked = marked.withColumn("_seen", F.lag(_millis(ts)).over(w))
        emit = emit | (_millis(ts) - F.col("_seen") > millis(ttl))
    return marked.filter(emit).drop("state_print", "_last", "_seen")


def millis(text: str) -> int:
    """Milliseconds of a duration such as ``90 seconds`` or ``2 hours``."""
    number, unit = text.split()
    return int(float(number) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")])


def _millis(ts: str) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


class _Changed(StatefulProcessor):
    """Last fingerprint of a key and when it was seen. With a TTL an event-time timer forgets a key that has been quiet so long."""

    def __init__(self, order: list[str], columns: list[str], ttl: int | None):
        self.order, self.columns, self.ttl = order, columns, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "f string, t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, seen = self.last.get() if self.last.exists() else (None, None)
        before = seen
        for part in rows:
            part, keep = part.sort_values(self.order), []
            for f, t in zip(part["state_print"], part["state_time"], strict=True):
                stale = self.ttl is not None and seen is not None and t - seen > self.ttl
                keep.append(f != last or stale)
                last, seen = f, int(t)
            yield part.loc[keep, self.columns]
        self.last.update((last, seen))
        if self.ttl is not None:
            if before is not None:
                self.handle.deleteTimer(before + self.ttl + 1)
            self.handle.registerTimer(seen + self.ttl + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[1] + self.ttl < expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def changed_only(stream: DataFrame, key: str, order: list[str], cols: list[str], ttl: str | None = None, ts: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """SM-02: emits a row only when the fingerprint of its key has changed; needs the RocksDB state store.

    With ``ttl`` a key that has had no row for so long by event time ``ts`` starts
    anew: its state goes once the watermark is past, and a row that comes so late
    after the last one is emitted in any case. Rows of a key are taken an Arrow
    batch at a time, in the order of ``order`` inside it, so memory does not follow
    the rows of a key.
    """
    timed = _watermarked(stream, ts, watermark) if ttl else stream
    marked = timed.withColumn("state_print", fingerprint(cols)).withColumn("state_time", _millis(ts) if ttl else F.lit(0).cast("long"))
    return marked.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Changed(order, timed.columns, millis(ttl) if ttl else None), outputStructType=timed.schema, outputMode="Append", timeMode="EventTime" if ttl else "None"
    )


def suppress_active(rows: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """SM-03: rows whose key has no active job; stream against static. How the static side travels is left to Spark, which knows its size."""
    return rows.join(active.select(key).distinct(), key, "left_anti") if not rows.isStreaming else rows.join(
        active.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_outer"
    ).filter("_k is null").drop("_k")


def latest_state(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """SM-04: last value of each key; update mode on streams."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(order, value)).alias(value), F.count(F.lit(1)).alias("n"))


def _watermarked(rows: DataFrame, ts: str, watermark: str) -> DataFrame:
    """Event times without a zone are taken in the session's."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def monitor_window(rows: DataFrame, ts: str, width: str, p: str, low: float, high: float, watermark: str = "1 hour", slide: str | None = None) -> DataFrame:
    """SM-06: n, mean risk and share per group in event-time windows; late rows go past the watermark on streams."""
    g = risk_group(p, low, high)
    timed = _watermarked(rows, ts, watermark) if rows.isStreaming else rows
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return timed.groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_risk"), *[F.avg((g == name).cast("double")).alias(f"share_{name}") for name in ("low", "intermediate", "high")]
    ).select(F.col("w.start").alias("start"), "n", "mean_risk", "share_low", "share_intermediate", "share_high")


def dedup_stream(rows: DataFrame, key: str, ts: str, watermark: str = "1 hour") -> DataFrame:
    """SM-07: one row per id."""
    return _watermarked(rows, ts, watermark).dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])


def read_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def run_available(df: DataFrame, out: str, checkpoint: str) -> None:
    """Processes what is there and stops; output as Parquet."""
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
