"""Batch harmonisation on long tables ``id, batch, feature, value``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.aggregates import SD_FLOOR, batch_profile, dominant, value_counts
from riskloom.operators.contracts import enforce, unknown_batches
from riskloom.operators.joins import small
from riskloom.operators.order import exact_percentiles
from riskloom.sources.scratch import kept


def _overall(long: DataFrame) -> DataFrame:
    sd = F.stddev_pop("value")
    return long.groupBy("feature").agg(F.avg("value").alias("gm"), F.when(sd < SD_FLOOR, 1.0).otherwise(sd).alias("gs"))


def _side(stats: DataFrame) -> DataFrame:
    """Statistics by batch and feature as the side of a join with all rows: kept, as checking their size would compute them once more, and broadcast if few.

    Otherwise the rows would be shuffled by a handful of keys, each of which lands in one task.
    """
    return small(kept(stats))


def batch_zscore(train: DataFrame, test: DataFrame) -> DataFrame:
    """HZ-03: z-scores by training batch, brought back to the training scale; unseen batches use all of training."""
    own = batch_profile(train).select("batch", "feature", "mean", "sd")
    j = test.join(_side(own), ["batch", "feature"], "left").join(_side(_overall(train)), "feature")
    z = (F.col("value") - F.coalesce("mean", "gm")) / F.coalesce("sd", "gs")
    return j.withColumn("value", z * F.col("gs") + F.col("gm")).drop("mean", "sd", "gm", "gs")


def ref_standardize(train: DataFrame, test: DataFrame, ref) -> DataFrame:
    """HZ-04: batches aligned to the reference batch's mean and SD; an unseen batch is taken as the reference; without reference rows all of training is it."""
    own = kept(batch_profile(train).select("batch", "feature", "mean", "sd"))
    r = own.filter(F.col("batch") == F.lit(ref)).select("feature", F.col("mean").alias("rm"), F.col("sd").alias("rs"))
    target = _overall(train).join(r, "feature", "left").select("feature", F.coalesce("rm", "gm").alias("tm"), F.coalesce("rs", "gs").alias("ts"))
    j = test.join(small(own), ["batch", "feature"], "left").join(_side(target), "feature")
    z = (F.col("value") - F.coalesce("mean", "tm")) / F.coalesce("sd", "ts")
    return j.withColumn("value", z * F.col("ts") + F.col("tm")).drop("mean", "sd", "tm", "ts")


def _kernel_means(rounds_of: int = 256):
    """Posterior means of a batch's features: every other feature's estimates, weighted by how well they explain the values.

    The likelihood of a feature's values under another's location and scale
    follows from n, mean and sum of squares, so a block of features against all
    of them is one matrix; weights are levelled by their largest logarithm.
    """

    def run(table: pd.DataFrame) -> pd.DataFrame:
        n, m, squares, g, d = (table[c].to_numpy(float) for c in ("n", "zm", "zq", "g", "d"))
        out_g, out_d = g.copy(), d.copy()
        if len(table) > 1:
            for low in range(0, len(table), rounds_of):
                at = np.arange(low, min(low + rounds_of, len(table)))
                spread = squares[at, None] + n[at, None] * (m[at, None] - g[None, :]) ** 2
                logs = -n[at, None] / 2 * np.log(2 * np.pi * d)[None, :] - spread / (2 * d)[None, :]
                logs[np.arange(len(at)), at] = -np.inf
                w = np.exp(logs - logs.max(axis=1, keepdims=True))
                out_g[at], out_d[at] = w @ g / w.sum(axis=1), w @ d / w.sum(axis=1)
        return pd.DataFrame({"batch": table["batch"], "feature": table["feature"], "pg": out_g, "pd": out_d})

    return run


def combat_fit(
    long: DataFrame, ref=None, shrink: bool = True, mean_only: bool = False, rounds: int = 60, parametric: bool = True, cap: float | None = None, least_batch: int = 0, fill: str = "ignore"
) -> DataFrame:
    """HZ-01: ComBat estimates ``batch, feature, alpha, pooled, gamma, delta, median``.

    Values are standardised by the reference batch's (or grand) mean and pooled
    variance; each batch's location and scale are shrunk to priors taken from
    their moments over features, or, if not ``parametric``, to means of the
    other features' estimates weighted by likelihood. ``ref``: a batch, ``largest``
    or None. ``cap`` holds shrunk locations within so many pooled SDs and scales
    within its square either way. Batches of fewer than ``least_batch`` values of a
    feature are not shrunk. ``fill``: nulls don't count (``ignore``), are an ``error``,
    or become the feature's ``median``, which is kept for HZ-02. Everything after
    the first aggregation works on the batch x feature table.
    """
    if fill == "error":
        enforce(long.filter(F.col("value").isNull() | F.isnan("value")).groupBy("feature").agg(F.count(F.lit(1)).alias("missing")), "missing values")
    clean = long.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    medians = exact_percentiles(clean, "value", {"median": 0.5}, ["feature"]) if fill == "median" else None
    if fill == "median":
        medians = kept(medians)
        clean = clean.join(small(medians), "feature").withColumn("value", F.coalesce("value", "median")).drop("median")
    if ref == "largest":
        ref = dominant(clean.select("id", "batch").distinct(), "batch").first()["batch"]
    s = kept(clean.groupBy("batch", "feature").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")))
    if medians is None:
        medians = s.select("feature").distinct().withColumn("median", F.lit(None).cast("double"))
    if ref is None:
        base = s.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("alpha"), (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("pooled"))
    else:
        base = s.filter(F.col("batch") == F.lit(ref)).select("feature", F.col("m").alias("alpha"), F.col("v").alias("pooled"))
    z = s.join(base, "feature").withColumn("pooled", F.when(F.col("pooled") < SD_FLOOR, 1.0).otherwise(F.col("pooled")))
    z = z.withColumn("g", (F.col("m") - F.col("alpha")) / F.sqrt("pooled")).withColumn("d", F.when(F.lit(mean_only), 1.0).otherwise(F.col("v") / F.col("pooled") * F.col("n") / F.greatest(F.col("n") - 1, F.lit(1))))
    z = z.withColumn("d", F.when(F.col("d") < SD_FLOOR, 1.0).otherwise(F.col("d"))).withColumns({"g0": F.col("g"), "d0": F.col("d")})
    if shrink and parametric:
        prior = z.groupBy("batch").agg(F.avg("g").alias("gb"), F.coalesce(F.var_samp("g"), F.lit(0.0)).alias("t2"), F.avg("d").alias("db"), F.coalesce(F.var_samp("d"), F.lit(0.0)).alias("s2"))
        z = z.join(prior, "batch")
        a = F.when(F.col("s2") > 0, (2 * F.col("s2") + F.col("db") * F.col("db")) / F.col("s2"))
        b = F.when(F.col("s2") > 0, (F.col("db") * F.col("s2") + F.col("db") * F.col("db") * F.col("db")) / F.col("s2"))
        z = z.withColumn("pa", a).withColumn("pb", b)
        start = F.struct(F.col("g").alias("g"), F.col("d").alias("d"))

        def step(acc, _):
            t = F.col("n") * F.col("t2")
            g = F.when(t + acc["d"] > 0, (t * F.col("g") + acc["d"] * F.col("gb")) / (t + acc["d"])).otherwise(F.col("g"))
            squares = (F.col("n") - 1) * F.col("d") + F.col("n") * (F.col("g") - g) * (F.col("g") - g)
            d = F.when(F.col("pa").isNull() | F.lit(mean_only), acc["d"]).otherwise((F.col("pb") + squares / 2) / (F.col("n") / 2 + F.col("pa") - 1))
            return F.struct(g.alias("g"), d.alias("d"))

        z = z.withColumn("e", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)).withColumn("g", F.col("e.g")).withColumn("d", F.col("e.d"))
    elif shrink:
        kinds = dict(z.dtypes)
        sums = z.filter("n > 0").select("batch", "feature", "n", F.col("g").alias("zm"), (F.col("n") * F.col("v") / F.col("pooled")).alias("zq"), "g", "d")
        means = sums.groupBy("batch").applyInPandas(_kernel_means(), f"batch {kinds['batch']}, feature {kinds['feature']}, pg double, pd double")
        z = z.join(means, ["batch", "feature"], "left").withColumn("g", F.coalesce("pg", "g")).withColumn("d", F.lit(1.0) if mean_only else F.coalesce("pd", "d"))
    if shrink and cap is not None:
        z = z.withColumn("g", F.least(F.greatest("g", F.lit(-cap)), F.lit(cap))).withColumn("d", F.least(F.greatest("d", F.lit(1 / cap**2)), F.lit(cap**2)))
    enough = F.col("n") >= least_batch
    z = z.withColumn("g", F.when(enough, F.col("g")).otherwise(F.col("g0"))).withColumn("d", F.when(enough, F.col("d")).otherwise(F.col("d0")))
    is_ref = F.col("batch") == F.lit(ref) if ref is not None else F.lit(False)
    return z.join(medians, "feature").select(
        "batch", "feature", "alpha", "pooled", F.when(is_ref, 0.0).otherwise(F.col("g")).alias("gamma"), F.when(is_ref, 1.0).otherwise(F.col("d")).alias("delta"), "median"
    )


def combat_apply(long: DataFrame, estimates: DataFrame, check: bool = True, fill: bool = False) -> DataFrame:
    """HZ-02: stored estimates applied; unknown batches, and features without estimates in their batch, are an error.

    Without the check their values become null; no row is lost. ``fill`` puts the
    training median where a value is missing, also for features that an id lacks
    altogether.
    """
    estimates = kept(estimates)
    if check:
        enforce(unknown_batches(long, estimates, "batch"), "unknown batches")
        enforce(long.select("batch", "feature").distinct().join(estimates, ["batch", "feature"], "left_anti"), "features without estimates")
    if fill:
        ids = long.select("id", "batch").distinct().join(small(estimates.select("batch", "feature", F.col("median").alias("_m"))), "batch")
        long = ids.join(long, ["id", "batch", "feature"], "left").withColumn("value", F.coalesce(F.when(~F.isnan("value"), F.col("value")), F.col("_m"))).drop("_m")
    j = long.join(small(estimates.drop("median")), ["batch", "feature"], "left")
    z = ((F.col("value") - F.col("alpha")) / F.sqrt("pooled") - F.col("gamma")) / F.sqrt("delta")
    return j.withColumn("value", z * F.sqrt("pooled") + F.col("alpha")).drop("alpha", "pooled", "gamma", "delta")


def harmonize_eligible(long: DataFrame, least: int = 3, ref=None) -> DataFrame:
    """HZ-05: only batches of ``least`` ids or more, if there are two of them; a flag says which rows changed."""
    sizes = value_counts(long.select("id", "batch").distinct(), "batch").filter(F.col("n") >= least).select("batch")
    sizes = kept(sizes)
    if sizes.limit(2).count() < 2:
        return long.withColumn("harmonized", F.lit(False))
    big = long.join(small(sizes), "batch", "left_semi")
    rest = long.join(small(sizes), "batch", "left_anti")
    done = combat_apply(big, combat_fit(big, ref), check=False).withColumn("harmonized", F.lit(True))
    return done.unionByName(rest.withColumn("harmonized", F.lit(False)))


def harmonize_or_passthrough(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """SM-05: harmonised where the batch is known, raw with a flag elsewhere; works on streams."""
    j = rows.join(_side(estimates.drop("median")), ["batch", "feature"], "left")
    z = ((F.col("value") - F.col("alpha")) / F.sqrt("pooled") - F.col("gamma")) / F.sqrt("delta")
    return j.withColumn("unknown_batch", F.col("alpha").isNull()).withColumn("value", F.coalesce(z * F.sqrt("pooled") + F.col("alpha"), F.col("value"))).drop("alpha", "pooled", "gamma", "delta")
