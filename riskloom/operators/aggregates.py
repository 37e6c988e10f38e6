"""Aggregations: profiles, confusion counts, calibration and replicate summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SD_FLOOR = 1e-12


def column_profile(long: DataFrame) -> DataFrame:
    """AG-01: per feature of ``(feature, value)``; population spread, exact median (halfway between the middle values).

    Medians and distinct counts come from the counts by value, ordered in ranges,
    so no feature's values meet in one task.
    """
    from riskloom.operators.order import ordered_cumsum

    v = F.col("value")
    sums = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg(v.isNull().cast("double")).alias("missing"), F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("sd"), F.var_pop(v).alias("variance"), F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("_known"),
    )
    counts = long.filter(v.isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_c"))
    placed = ordered_cumsum(counts, "value", ["_c"], ["feature"]).join(sums.select("feature", "_known"), "feature")
    holds = lambda at: (F.col("cum__c") > at) & (F.col("cum__c") - F.col("_c") <= at)
    low, high = F.floor((F.col("_known") - 1) / 2), F.ceil((F.col("_known") - 1) / 2)
    middle = placed.groupBy("feature").agg(
        ((F.max(F.when(holds(low), v)) + F.max(F.when(holds(high), v))) / 2).alias("median"), F.count(F.lit(1)).alias("distinct")
    )
    return sums.join(middle, "feature", "left").select(
        "feature", "n", "missing", "mean", "sd", "variance", "median", "low", "high", F.coalesce("distinct", F.lit(0).cast("long")).alias("distinct"),
        F.when(F.col("_known") > 0, F.coalesce("distinct", F.lit(0)) / F.col("_known")).alias("unique_ratio"),
    )


def batch_profile(long: DataFrame, batch: str = "batch") -> DataFrame:
    """AG-02: mean, population SD (tiny ones count as 1) and n by (batch, feature)."""
    sd = F.stddev_pop("value")
    return long.groupBy(batch, "feature").agg(
        F.avg("value").alias("mean"), F.when(sd < SD_FLOOR, 1.0).otherwise(sd).alias("sd"), F.count("value").alias("n")
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """AG-03."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def dominant(df: DataFrame, col: str) -> DataFrame:
    """AG-03: the most frequent label, the smallest one on ties."""
    return value_counts(df.filter(F.col(col).isNotNull()), col).orderBy(F.desc("n"), col).limit(1)


def class_summary(df: DataFrame, event: str, *by: str) -> DataFrame:
    """AG-04."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(event).cast("long").alias("events"), (F.count(F.lit(1)) - F.sum(event)).cast("long").alias("non_events"), F.avg(event).alias("prevalence")
    )


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """AG-05: rates from counts; undefined shares are null, F1 and MCC are 0 then."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    share = lambda a, b: F.when(b > 0, a / b)
    sens, spec = share(tp, tp + fn), share(tn, tn + fp)
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return {
        "sensitivity": sens, "specificity": spec, "ppv": share(tp, tp + fp), "npv": share(tn, tn + fn), "balanced": (sens + spec) / 2,
        "f1": F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0),
        "mcc": F.when(product > 0, (tp * tn - fp * fn) / F.sqrt(product)).otherwise(0.0),
    }


def confusion(df: DataFrame, event: str, score: str, threshold: float, *by: str) -> DataFrame:
    """AG-05: counts and rates at one threshold (``score >= threshold``)."""
    y, hit = F.col(event) == 1, F.col(score) >= threshold
    count = lambda c: F.count(F.when(c, 1))
    counts = df.groupBy(*by).agg(count(y & hit).alias("tp"), count(~y & hit).alias("fp"), count(y & ~hit).alias("fn"), count(~y & ~hit).alias("tn"))
    return counts.withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def _mean(c: Column, weight: str | None) -> Column:
    """Mean of ``c`` over rows that count ``weight`` times; nulls don't count."""
    return F.sum(c * F.col(weight)) / F.sum(F.when(c.isNotNull(), F.col(weight))) if weight else F.avg(c)


def proper_scores(df: DataFrame, event: str, p: str, *by: str, eps: float = 1e-8, weight: str | None = None) -> DataFrame:
    """AG-06: Brier score and log loss; ``weight`` says how often a row counts."""
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    y = F.col(event)
    return df.groupBy(*by).agg(
        _mean((F.col(p) - y) * (F.col(p) - y), weight).alias("brier"), _mean(-(y * F.log(q) + (1 - y) * F.log(1 - q)), weight).alias("log_loss")
    )


def _equal_width(p: str, k: int) -> Column:
    """Bin number with literal edges i/k; p = 1 is in the last bin."""
    out = F.when(F.col(p) < 1 / k, 0)
    for i in range(2, k):
        out = out.when(F.col(p) < i / k, i - 1)
    return out.otherwise(k - 1)


def calibration_error(df: DataFrame, event: str, p: str, *by: str, k: int = 10, weight: str | None = None) -> DataFrame:
    """AG-07: expected and largest calibration error over equal-width bins; ``weight`` says how often a row counts."""
    bins = df.withColumn("_b", _equal_width(p, k)).groupBy(*by, "_b").agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("n"), F.abs(_mean(F.col(p), weight) - _mean(F.col(event), weight)).alias("gap")
    )
    return bins.groupBy(*by).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


GROUPS = ("low", "intermediate", "high")


def risk_strata(df: DataFrame, event: str, group: Column, weight: str | None = None) -> DataFrame:
    """AG-08: n, events and rate per risk group in fixed order, empty groups included; ``weight`` says how often a row counts."""
    n, events = (F.sum(weight), F.sum(F.col(event) * F.col(weight))) if weight else (F.count(F.lit(1)), F.sum(event))
    counts = df.groupBy(group.alias("risk")).agg(n.alias("n"), events.cast("long").alias("events"))
    order = df.sparkSession.createDataFrame(list(enumerate(GROUPS)), "position int, risk string")
    return order.join(counts, "risk", "left").select(
        "position", "risk", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("events", F.lit(0)).alias("events"), (F.col("events") / F.col("n")).alias("rate")
    )


def score_summary(df: DataFrame, event: str, p: str, *by: str) -> DataFrame:
    """AG-09: mean, median and outer percentiles of a score, and the observed rate; percentiles come from counts by score."""
    from riskloom.operators.order import exact_percentiles

    means = df.groupBy(*by).agg(F.avg(p).alias("mean"), F.avg(event).alias("observed"))
    cuts = exact_percentiles(df, p, {"median": 0.5, "q05": 0.05, "q95": 0.95}, list(by))
    both = means.join(cuts, list(by)) if by else means.crossJoin(F.broadcast(cuts))  # one row each
    return both.select(*by, "mean", "median", "q05", "q95", "observed")


def _met(a: DataFrame, b: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``a`` with the columns of ``b``, which has a row per group; a null group is a group."""
    from riskloom.operators.joins import small

    if not by:
        return a.crossJoin(F.broadcast(b))  # one row
    named = b.withColumnsRenamed({c: f"_by{i}" for i, c in enumerate(by)})
    same = None
    for i, c in enumerate(by):
        same = F.col(c).eqNullSafe(F.col(f"_by{i}")) if same is None else same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return a.join(small(named), same, "left").drop(*[f"_by{i}" for i in range(len(by))])


def _counted(long: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``by..., value, _c``: rows by value, nulls too, so that each group is there; kept, as the statistics of a group come from it."""
    from riskloom.sources.scratch import kept

    return kept(long.groupBy(*by, F.col("value").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("_c")))


def replicate_summary(long: DataFrame, *by: str) -> DataFrame:
    """AG-10: mean, median, percentile interval and valid count of ``value``.

    Rows are counted by value once, and percentiles come from the counts in ranges,
    so no group's values meet in one task.
    """
    from riskloom.operators.order import exact_percentiles

    counts = _counted(long, by)
    valid = F.sum(F.when(F.col("value").isNotNull(), F.col("_c")))
    means = counts.groupBy(*by).agg((F.sum(F.col("value") * F.col("_c")) / valid).alias("mean"), F.coalesce(valid, F.lit(0)).cast("long").alias("valid"))
    cuts = exact_percentiles(counts, "value", {"median": 0.5, "low": 0.025, "high": 0.975}, list(by), "_c")
    return _met(means, cuts, by).select(*by, "mean", "median", "low", "high", "valid")


def consensus(long: DataFrame, *by: str) -> DataFrame:
    """AG-11: median, median absolute deviation, mean, SD, range and count over methods; all from rows counted by value."""
    from riskloom.operators.order import exact_percentiles
    from riskloom.sources.scratch import kept

    v, c = F.col("value"), F.col("_c")
    counts = _counted(long, by)
    centre = kept(exact_percentiles(counts, "value", {"median": 0.5}, list(by), "_c"))
    valid = F.sum(F.when(v.isNotNull(), c))
    sums = _met(counts.groupBy(*by).agg((F.sum(v * c) / valid).alias("mean"), (F.max("value") - F.min("value")).alias("range"), F.coalesce(valid, F.lit(0)).cast("long").alias("n")), centre, by)
    apart = kept(_met(counts, sums.select(*by, "mean", "median"), by).withColumn("away", F.abs(v - F.col("median"))))
    spread = apart.groupBy(*by).agg(F.sqrt(F.sum((v - F.col("mean")) * (v - F.col("mean")) * c) / valid).alias("sd"))
    mad = exact_percentiles(apart, "away", {"mad": 0.5}, list(by), "_c")
    return _met(_met(sums, spread, by), mad, by).select(*by, "median", "mad", "mean", "sd", "range", "n")


def paired_differences(long: DataFrame, replicate: str, model: str, reference: str) -> DataFrame:
    """AG-12: difference of each model to the reference on shared replicates, summarised."""
    ref = long.filter(F.col(model) == reference).select(replicate, F.col("value").alias("_ref"))
    diff = long.filter(F.col(model) != reference).join(ref, replicate).select(model, (F.col("value") - F.col("_ref")).alias("value"))
    return replicate_summary(diff, model)


def histogram(df: DataFrame, col: str, k: int, *by: str) -> DataFrame:
    """AG-13: equal-width counts between smallest and largest value; the last bin is closed."""
    ends = df.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    joined = df.join(ends, list(by)) if by else df.crossJoin(F.broadcast(ends))
    b = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor((F.col(col) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / k)), F.lit(k - 1)))
    return joined.groupBy(*by, b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def cv_stats(profile: DataFrame) -> DataFrame:
    """AG-14: coefficients of variation over the features of a profile."""
    cv = F.when(F.col("mean") != 0, F.col("sd") / F.abs(F.col("mean")))
    return profile.select(cv.alias("cv")).agg(
        F.avg("cv").alias("mean_cv"), F.percentile("cv", 0.5).alias("median_cv"), F.count(F.when(F.col("cv") > 0.5, 1)).alias("above_half"), F.count(F.when(F.col("cv") > 1, 1)).alias("above_one")
    )


def selection_frequency(df: DataFrame, run: str, feature: str) -> DataFrame:
    """AG-16: share of runs that chose each feature."""
    runs = df.agg(F.countDistinct(run).alias("_runs"))
    return df.groupBy(feature).agg(F.countDistinct(run).alias("times")).crossJoin(F.broadcast(runs)).select(feature, "times", (F.col("times") / F.col("_runs")).alias("frequency"))


def threshold_summary(cuts: DataFrame, t: str = "t") -> DataFrame:
    """AG-16: smallest, median and largest threshold over runs."""
    return cuts.agg(F.min(t).alias("low"), F.percentile(t, 0.5).alias("median"), F.max(t).alias("high"), F.count(t).alias("runs"))


def spread_summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """AG-17, AG-21: mean, SD, smallest and largest value."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"))


def date_bounds(df: DataFrame, day: str, *by: str) -> DataFrame:
    """AG-18."""
    return df.groupBy(*by).agg(F.date_format(F.min(day), "yyyy-MM-dd").alias("first"), F.date_format(F.max(day), "yyyy-MM-dd").alias("last"))


def rule_prevalence(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """AG-19: rows that meet each rule and rows where it is known."""
    one = df.agg(*[F.struct(F.count(F.when(c, 1)).alias("met"), F.count(c).alias("known")).alias(n) for n, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"{n}.met").alias("met"), F.col(f"{n}.known").alias("known")) for n in rules])).alias("r")).select("r.*")


def step_summary(df: DataFrame, ok: Column, value: str, *by: str) -> DataFrame:
    """AG-20."""
    return df.groupBy(*by).agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.avg(F.when(ok, F.col(value))).alias("mean_value"))


def rollup_report(df: DataFrame, event: str, dims: list[str]) -> DataFrame:
    """AG-22: totals at every level of ``dims`` in one pass."""
    return df.rollup(*dims).agg(F.count(F.lit(1)).alias("n"), F.sum(event).cast("long").alias("events"), F.grouping_id().alias("level"))
