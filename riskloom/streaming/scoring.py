"""SM-01 as a chain: harmonise, predict, calibrate and group each arriving feature row by the newest published model.

A release is a numbered set of tables in one folder: model terms, harmonisation
estimates and settings. The settings are written last, so a release is there as a
whole or not at all. Each micro-batch reads the newest one, and its result is a
folder named by the batch, so a batch that runs again replaces its own rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalars import risk_group
from riskloom.operators.calibrate import apply_calibrator
from riskloom.operators.harmonize import harmonize_or_passthrough
from riskloom.operators.solver import predict_linear

SETTINGS = "version long, calibrator string, low double, high double"


def publish(spark: SparkSession, store: str, version: int, model: DataFrame, estimates: DataFrame, calibrator: dict, low: float, high: float) -> None:
    """Write release ``version``: terms (SNK-07), ComBat estimates (HZ-01), a calibrator (CL-06) and the risk limits."""
    model.write.mode("overwrite").parquet(f"{store}/model/version={version}")
    estimates.write.mode("overwrite").parquet(f"{store}/estimates/version={version}")
    spark.createDataFrame([(version, json.dumps(calibrator), low, high)], SETTINGS).coalesce(1).write.mode("append").parquet(f"{store}/settings")


def newest(spark: SparkSession, store: str) -> dict:
    """The settings of the newest release and where its tables are; reading them anew sees what was published meanwhile."""
    row = spark.read.schema(SETTINGS).parquet(f"{store}/settings").orderBy(F.desc("version")).first()
    if row is None:
        raise ValueError("no release is published")
    return row.asDict() | {name: f"{store}/{name}/version={row['version']}" for name in ("model", "estimates")}


def score_release(rows: DataFrame, release: dict) -> DataFrame:
    """``id, version, p, risk, unknown_batch`` of rows ``id, batch, features map<string,double>``.

    Features of a known batch are harmonised, others pass with a flag; a row that
    lacks a term of the model has a null probability and risk.
    """
    spark = rows.sparkSession
    long = rows.select("id", "batch", F.explode_outer("features").alias("feature", "value"))
    even = harmonize_or_passthrough(long, spark.read.parquet(release["estimates"]))
    flags = even.groupBy("id").agg(F.max("unknown_batch").alias("unknown_batch"))
    raw = predict_linear(even.select("id", "feature", "value"), spark.read.parquet(release["model"]), "id").select("id", F.col("p").alias("raw"))
    done = apply_calibrator(flags.join(raw, "id", "left"), "raw", json.loads(release["calibrator"]), "p")
    p = F.when(F.col("raw").isNotNull(), F.col("p"))
    known = F.when(F.col("raw").isNotNull(), risk_group(p, release["low"], release["high"]))
    return done.select("id", F.lit(release["version"]).cast("long").alias("version"), p.alias("p"), known.alias("risk"), "unknown_batch")


def score_batch(rows: DataFrame, batch: int, store: str, out: str) -> None:
    """Score a micro-batch by the newest release into its own folder."""
    score_release(rows, newest(rows.sparkSession, store)).write.mode("overwrite").parquet(f"{out}/batch={batch}")


def score_stream(stream: DataFrame, store: str, out: str, checkpoint: str) -> None:
    """Score what has arrived and stop; goes on from its checkpoint next time."""
    query = stream.writeStream.foreachBatch(lambda rows, batch: score_batch(rows, batch, store, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query.start().awaitTermination()
