"""Discrimination, comparison and interval estimation from fixed scores and replicate tables."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import hash_key, normal_cdf
from riskloom.operators.order import cumulative_counts, ordered_cumsum, score_counts
from riskloom.operators.resample import bootstrap_weights, permute_labels
from riskloom.sources.scratch import kept


def auc(df: DataFrame, event: str, score: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """EV-01: area under the ROC curve, ties half; ``weight`` counts rows; one class gives null.

    Rows are counted by distinct score, so a bootstrap replicate is a weight
    column, not a copy of the rows.
    """
    by = by or []
    if weight:
        df = df.filter(F.col(weight) > 0)
    c = ordered_cumsum(score_counts(df, event, score, by, weight), "score", ["neg"], by)
    pairs = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    total = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return c.groupBy(*by).agg(F.when(total > 0, pairs / total).alias("auc"), F.sum("pos").cast("long").alias("pos"), F.sum("neg").cast("long").alias("neg"))


def univariate_auc(long: DataFrame, event: str) -> DataFrame:
    """FS-07: directionless AUC per feature; fewer than 5 rows or one class gives 0.5."""
    a = auc(long, event, "value", ["feature"])
    best = F.greatest(F.col("auc"), 1 - F.col("auc"))
    return a.select("feature", F.when((F.col("pos") + F.col("neg") < 5) | F.col("auc").isNull(), 0.5).otherwise(best).alias("auc"))


def placements(df: DataFrame, event: str, scores: list[str]) -> DataFrame:
    """``event, n, features``: of each score the share of the other class that it beats, ties half, for ``n`` rows alike. Rows without an event or a score are left out.

    Rows are counted by event and scores first, so that rows alike are one from there
    on. Running counts of the other class are the placements, and all scores meet
    their rows in one join.
    """
    known = df.select(F.col(event).cast("int").alias("event"), *[F.col(s).cast("double").alias(f"s{i}") for i, s in enumerate(scores)]).dropna()
    rows = kept(known.groupBy(*known.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("row", F.monotonically_increasing_id()))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(f"s{i}").alias("s")) for i in range(len(scores))])).alias("c")
    long = rows.select("row", "event", "n", each).select("row", "event", "n", "c.m", "c.s")
    counts = kept(score_counts(long, "event", "s", ["m"], "n"))
    cums = ordered_cumsum(counts, "score", ["pos", "neg"], ["m"])
    sizes = rows.agg(F.sum(F.col("n") * F.col("event")).alias("_p"), F.sum(F.col("n") * (1 - F.col("event"))).alias("_n"))
    beats = cums.crossJoin(F.broadcast(sizes)).select(
        "m", F.col("score").alias("s"), ((F.col("cum_neg") - F.col("neg") / 2) / F.col("_n")).alias("v1"), (1 - (F.col("cum_pos") - F.col("pos") / 2) / F.col("_p")).alias("v0")
    )
    v = F.when(F.col("event") == 1, F.col("v1")).otherwise(F.col("v0"))
    met = long.join(beats, ["m", "s"]).select("row", "event", "n", "m", v.alias("v"))
    return met.groupBy("row", "event", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "v"))), lambda x: x["v"]).alias("features")).select("event", "n", "features")


def delong_covariance(df: DataFrame, event: str, scores: list[str]):
    """EV-03: AUCs of all scores and their covariance matrix, from one pass of k x k sums per class."""
    from riskloom.operators.screen import moment_sums

    k, aucs, cov = len(scores), None, 0.0
    # the products of columns scaled by the root of n count each row n times; the first column counts rows
    root = F.sqrt("n")
    vectors = kept(placements(df, event, scores).select("event", F.concat(F.array(root), F.transform("features", lambda v: v * root)).alias("features")))
    for y in (1, 0):
        xy = moment_sums(vectors.filter(F.col("event") == y), k + 1)[5]
        size, x, xy = float(xy[0, 0]), xy[0, 1:], xy[1:, 1:]
        if round(size) < 2:
            return np.full(k, np.nan), np.full((k, k), np.nan)
        mean = x / size
        aucs = mean if y else aucs
        cov = cov + (xy - size * np.outer(mean, mean)) / (size - 1) / size
    return aucs, cov


def delong_pairs(df: DataFrame, event: str, scores: list[str]) -> DataFrame:
    """EV-03 for all pairs of scores: ``a, b, auc_a, auc_b, variance, delta, z, p``; null without variance."""
    aucs, cov = delong_covariance(df, event, scores)
    out = []
    for i in range(len(scores)):
        for j in range(i + 1, len(scores)):
            known = not math.isnan(aucs[i])
            variance = float(cov[i, i] + cov[j, j] - 2 * cov[i, j]) if known else None
            out.append((scores[i], scores[j], float(aucs[i]) if known else None, float(aucs[j]) if known else None, variance))
    pairs = df.sparkSession.createDataFrame(out, "a string, b string, auc_a double, auc_b double, variance double")
    # sums of many placements leave a rest of rounding where scores agree
    z = F.when(F.col("variance") > 1e-15, (F.col("auc_a") - F.col("auc_b")) / F.sqrt("variance"))
    return pairs.withColumn("delta", F.col("auc_a") - F.col("auc_b")).withColumn("z", z).withColumn("p", 2 * (1 - normal_cdf(F.abs("z"))))


def delong(df: DataFrame, event: str, a: str, b: str) -> DataFrame:
    """EV-03: two correlated AUCs, their difference, z and two-sided p; null without variance. No id is needed."""
    return delong_pairs(df, event, [a, b]).drop("a", "b")


def interval(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Percentile interval of replicate values; nulls don't count."""
    return df.groupBy(*by).agg(F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high"), F.count(value).alias("valid"))


def replicate_aucs(df: DataFrame, event: str, scores: list[str], key: str, reps: int, seed=0) -> DataFrame:
    """AUC of each score in and out of the bag of each stratified replicate; all scores share the replicates.

    Rows are drawn once and counted by replicate and score, in and out of the bag
    side by side; what follows reads these counts only.
    """
    w = bootstrap_weights(df.select(key, event, *[F.col(s).cast("double").alias(f"_s{i}") for i, s in enumerate(scores)]), key, event, reps, seed, [f"_s{i}" for i in range(len(scores))])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(f"_s{i}").alias("score")) for i in range(len(scores))])).alias("c")
    long = w.select("rep", "weight", F.col(event).alias("_y"), each).select("rep", "weight", "_y", "c.m", "c.score").filter("score is not null")
    out, y = (F.col("weight") == 0).cast("int"), F.col("_y")
    each_sum = {"in_pos": (1, F.col("weight")), "in_neg": (0, F.col("weight")), "out_pos": (1, out), "out_neg": (0, out)}
    counts = kept(long.groupBy("m", "rep", "score").agg(*[F.sum(F.when(y == c, v).otherwise(0)).alias(n) for n, (c, v) in each_sum.items()]))
    cums = ordered_cumsum(counts, "score", ["in_neg", "out_neg"], ["m", "rep"])

    def area(bag: str, m: int) -> Column:
        mine = lambda c: F.sum(F.when(F.col("m") == m, c))
        pairs = mine(F.col(f"{bag}_pos") * (F.col(f"cum_{bag}_neg") - F.col(f"{bag}_neg") / 2))
        total = mine(F.col(f"{bag}_pos")).cast("double") * mine(F.col(f"{bag}_neg")).cast("double")
        return F.when(total > 0, pairs / total).alias(f"{bag}_{scores[m]}")

    return cums.groupBy("rep").agg(*[area(bag, m) for m in range(len(scores)) for bag in ("in", "out")])


def bootstrap_auc_interval(df: DataFrame, event: str, score: str, key: str, reps: int, seed=0) -> DataFrame:
    """EV-04."""
    r = replicate_aucs(df, event, [score], key, reps, seed)
    return interval(r, f"in_{score}").crossJoin(F.broadcast(auc(df, event, score).select("auc")))


def auc_by_domain(df: DataFrame, event: str, score: str, domain: str, key: str, reps: int, seed=0) -> DataFrame:
    """EV-02: ``domain, auc, pos, neg, low, high, valid``: AUC of each domain with its interval over replicates drawn by class inside each domain."""
    strata = df.withColumn("_stratum", F.concat_ws("|", F.col(domain).cast("string"), F.col(event).cast("string")))
    drawn = kept(bootstrap_weights(strata, key, "_stratum", reps, seed, [event, score, domain]).filter("weight > 0").select("rep", event, score, domain, "weight"))
    each = auc(drawn, event, score, ["rep", domain], "weight")
    return auc(df, event, score, [domain]).join(interval(each, "auc", domain), domain, "left")


def paired_auc_delta(df: DataFrame, event: str, a: str, b: str, key: str, reps: int, seed=0) -> DataFrame:
    """EV-05: observed difference, percentile interval, p = 2 min(P(d <= 0), P(d >= 0)) capped at 1."""
    d = replicate_aucs(df, event, [a, b], key, reps, seed).select((F.col(f"in_{a}") - F.col(f"in_{b}")).alias("d"))
    p = F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double"))))
    observed = auc(df, event, a).select(F.col("auc").alias("_a")).crossJoin(F.broadcast(auc(df, event, b).select(F.col("auc").alias("_b"))))
    return interval(d, "d").crossJoin(F.broadcast(d.agg(p.alias("p")))).crossJoin(F.broadcast(observed.select((F.col("_a") - F.col("_b")).alias("delta"))))


def auc_632(apparent: Column, oob: Column) -> Column:
    """EV-06."""
    return 0.368 * apparent + 0.632 * oob


def auc_632plus(apparent: Column, oob: Column, eps: float = 1e-12) -> Column:
    """EV-07: per replicate, weight from the relative overfitting rate."""
    et, eo = 1 - apparent, 1 - oob
    rate = F.least(F.greatest((eo - et) / F.greatest(0.5 - et, F.lit(eps)), F.lit(0.0)), F.lit(1.0))
    w = 0.632 / (1 - 0.368 * rate)
    return 1 - ((1 - w) * et + w * eo)


def auc_632plus_fixed(df: DataFrame, event: str, score: str, key: str, reps: int, seed=0) -> DataFrame:
    """EV-08: variant for scores that are not fitted."""
    oob = replicate_aucs(df, event, [score], key, reps, seed).agg(F.avg(f"out_{score}").alias("oob"))
    both = oob.crossJoin(F.broadcast(auc(df, event, score).select(F.col("auc").alias("apparent"))))
    gap = F.col("apparent") - 0.5
    rate = F.when(F.abs(gap) > 1e-12, F.least(F.greatest((F.col("apparent") - F.col("oob")) / gap, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    w = F.least(F.greatest(0.632 / (1 - 0.368 * rate), F.lit(0.632)), F.lit(1.0))
    return both.withColumn("estimate", (1 - w) * F.col("apparent") + w * F.col("oob"))


def normal_interval(df: DataFrame, value: str, *by: str, of_mean: bool = False) -> DataFrame:
    """EV-09: mean +- 1.96 SD, or of the mean."""
    sd = F.stddev_samp(value) / (F.sqrt(F.count(value)) if of_mean else F.lit(1.0))
    return df.groupBy(*by).agg((F.avg(value) - 1.96 * sd).alias("low"), (F.avg(value) + 1.96 * sd).alias("high"))


def bias_corrected_interval(df: DataFrame, value: str, observed: float) -> tuple[float, float]:
    """EV-09: bias-corrected percentiles; plain ones if all replicates lie on one side."""
    share = df.agg(F.avg((F.col(value) < observed).cast("double")).alias("s")).first()["s"]
    dist, probs = NormalDist(), [0.025, 0.975]
    if share and share < 1:
        z0 = dist.inv_cdf(share)
        probs = [dist.cdf(2 * z0 + dist.inv_cdf(p)) for p in probs]
    low, high = df.select(F.percentile(value, probs).alias("q")).first()["q"]
    return low, high


def smoothed_draws(df: DataFrame, value: str, least: int = 10_000, seed=0) -> DataFrame:
    """EV-09: kernel-smoothed replicate values: at least ``least`` draws, each a value plus Gaussian noise of Scott's bandwidth.

    Noise comes from md5 of the value and the number of the draw (Box-Muller); ten replicates or fewer stay as they are.
    """
    r = df.agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd")).first()
    if r["n"] <= 10:
        return df.select(value)
    each = -(-max(least, 10 * r["n"]) // r["n"])
    u = lambda what: (F.conv(F.substring(hash_key(F.lit(f"{seed}|{what}"), F.col(value), F.col("_draw")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * 3.141592653589793 * u("b"))
    draws = df.filter(F.col(value).isNotNull()).withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(each))))
    return draws.select((F.col(value) + noise * (r["sd"] * r["n"] ** -0.2)).alias(value))


def t_cdf(t: float, df: int) -> float:
    """Student's t for whole degrees of freedom, by its finite trigonometric sum."""
    angle = math.atan2(t, math.sqrt(df))
    sine, cosine = math.sin(angle), math.cos(angle)
    term, total = (cosine, cosine) if df % 2 else (1.0, 1.0)
    for k in range(3 if df % 2 else 2, df - 1, 2):
        term *= cosine * cosine * (k - 1) / k
        total += term
    if df % 2:
        share = 2 / math.pi * (angle + (sine * total if df > 1 else 0.0))
    else:
        share = sine * total
    return (1 + share) / 2


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t by bisection; normal beyond 10,000 degrees of freedom."""
    if df > 10_000:
        return NormalDist().inv_cdf(p)
    low, high = -1e4, 1e4
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def corrected_t_interval(scores: DataFrame, value: str, n_train: int, n_test: int) -> DataFrame:
    """EV-10: interval of a cross-validated mean with the variance correction for overlapping training sets.

    The mean alone with fewer than two scores.
    """
    r = scores.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).first()
    half = t_quantile(0.975, r["n"] - 1) * r["sd"] * math.sqrt(1 / r["n"] + n_test / n_train) if r["n"] > 1 else None
    ends = (None, None) if half is None else (max(0.0, r["mean"] - half), min(1.0, r["mean"] + half))
    return scores.sparkSession.createDataFrame([(r["mean"], *ends)], "mean double, low double, high double")


def permutation_test(df: DataFrame, event: str, score: str, key: str, reps: int, seed=0, method: str = "plus_one") -> DataFrame:
    """EV-12 for a fixed score: AUCs of permuted labels against the observed one."""
    rows = df.select(key, score).join(permute_labels(df, key, event, reps, seed), key)
    null = auc(rows, "permuted", score, ["rep"]).crossJoin(F.broadcast(auc(df, event, score).select(F.col("auc").alias("observed"))))
    hits, n = F.count_if(F.col("auc") >= F.col("observed")), F.count(F.lit(1))
    p = (hits + 1) / (n + 1) if method == "plus_one" else hits / n
    return null.agg(F.first("observed").alias("observed"), p.alias("p"), F.avg("auc").alias("null_mean"), F.stddev_pop("auc").alias("null_sd"))


def oob_cutpoints(df: DataFrame, event: str, score: str, key: str, reps: int, seed=0) -> DataFrame:
    """EV-14: cut-offs chosen in the bag and applied unchanged out of it, per replicate and mode."""
    from riskloom.operators.order import best_thresholds, threshold_sweep

    rows = kept(bootstrap_weights(df, key, event, reps, seed, [score]).select("rep", event, score, "weight"))
    sweep = threshold_sweep(rows.filter("weight > 0"), event, score, ["rep"], "weight")
    cuts = best_thresholds(sweep, by=["rep"]).select("rep", "mode", "threshold")
    hit, y = F.col(score) >= F.col("threshold"), F.col(event) == 1
    return rows.filter("weight = 0").join(F.broadcast(cuts), "rep").groupBy("rep", "mode", "threshold").agg(
        (F.count_if(y & hit) / F.count_if(y)).alias("sensitivity"), (F.count_if(~y & ~hit) / F.count_if(~y)).alias("specificity"), F.count(F.lit(1)).alias("n")
    )


def roc_band(df: DataFrame, event: str, score: str, key: str, reps: int, seed=0, steps: int = 100) -> DataFrame:
    """EV-17: median and percentiles of the bootstrap TPR at each point of an FPR grid; the first point is 0.

    The TPR at a grid point is interpolated between the ROC points around it.
    Of the points between two grid points only the first and the last matter, so a
    replicate is reduced to ``steps + 1`` cells before its points meet in order.
    """
    from pyspark.sql.window import Window

    drawn = kept(bootstrap_weights(df, key, event, reps, seed, [score]).filter("weight > 0").select("rep", event, score, "weight"))
    c = cumulative_counts(drawn, event, score, ["rep"], "weight")
    curve = c.select("rep", (F.col("fp") / F.col("n")).alias("x"), (F.col("tp") / F.col("p")).alias("y"))
    points = curve.groupBy("rep", "x").agg(F.max("y").alias("y"))
    own = F.struct("x", "y")
    cells = points.groupBy("rep", F.floor(F.col("x") * steps).cast("int").alias("g")).agg(F.min(own).alias("low"), F.max(own).alias("high"))
    grid = cells.select("rep").distinct().select("rep", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("g"))
    order = Window.partitionBy("rep").orderBy("g")
    met = grid.join(cells, ["rep", "g"], "left").withColumns({
        "before": F.last("high", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), "after": F.first("low", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    t = F.col("g") / steps
    x0, y0 = F.coalesce("before.x", F.lit(0.0)), F.coalesce("before.y", F.lit(0.0))
    y = F.when(F.col("after.x") > x0, y0 + (F.col("after.y") - y0) * (t - x0) / (F.col("after.x") - x0)).otherwise(F.col("after.y"))
    all_ = met.select("rep", "g", F.when(F.col("g") == 0, 0.0).otherwise(y).alias("tpr"))
    return all_.groupBy("g").agg(F.percentile("tpr", 0.5).alias("median"), F.percentile("tpr", 0.025).alias("low"), F.percentile("tpr", 0.975).alias("high")).withColumn("fpr", F.col("g") / steps)


def risk_limits(df: DataFrame, event: str, p: str, least_share: float = 0.05, least: int = 5, weight: str | None = None, curve: DataFrame | None = None) -> tuple[float, float]:
    """Limits of low and high risk: the thresholds with the least and the largest Youden index, put in order; the percentiles 33 and 66 where a group would be too small.

    ``weight`` says how often a row counts; ``curve``: its ``cumulative_counts``, if they are known.
    """
    from riskloom.operators.order import exact_percentiles, sweep_of

    known = df.filter(F.col(p).isNotNull() & F.col(event).isNotNull())
    y = F.round(F.col("sensitivity") + F.col("specificity") - 1, 12)
    curve = kept(cumulative_counts(known, event, p, weight=weight)) if curve is None else curve
    # of equal ones the smallest threshold
    best = sweep_of(curve.select("score", "tp", "fp", "p", "n")).filter(y.isNotNull()).agg(
        F.min(F.struct(y.alias("y"), "threshold")).alias("least"), F.max(F.struct(y.alias("y"), (-F.col("threshold")).alias("t"))).alias("most")
    ).first()
    if best["least"] is not None:
        low, high = sorted((best["least"]["threshold"], -best["most"]["t"]))
        times = F.col(weight) if weight else F.lit(1)
        count = lambda c: F.sum(F.when(c, times).otherwise(0))
        r = known.agg(F.sum(times).alias("n"), count(F.col(p) <= low).alias("low"), count(F.col(p) > high).alias("high")).first()
        if min(r["low"], r["high"]) >= max(least, int(least_share * r["n"])):
            return low, high
    return tuple(exact_percentiles(known, p, {"low": 0.33, "high": 0.66}, weight=weight).first())


def evaluate_score(df: DataFrame, event: str, p: str, key: str | None = None, reps: int = 20, seed=0) -> DataFrame:
    """EV-16: one row of discrimination, calibration, proper scores, operating point and risk strata.

    ``n, events, auc`` (with ``key`` its bootstrap interval ``auc_low, auc_high``),
    Brier and other proper scores, calibration error, intercept and slope, the
    Youden point with its sensitivity and specificity, the limits of low and high
    risk, and ``strata``: n, events and rate of each risk group. Rows without an
    event or score are left out; with one class what needs two is null.

    Rows are counted by event and score once, and running counts by score are kept; but
    for the replicates all parts read these two tables, so that the plan of a part is small.
    """
    from riskloom.operators import aggregates as A
    from riskloom.operators.calibrate import calibration_slope
    from riskloom.operators.order import running_counts

    df = df.filter(F.col(p).isNotNull() & F.col(event).isNotNull())
    rows = kept(df.groupBy(event, p).agg(F.count(F.lit(1)).alias("_n")))
    curve = kept(running_counts(rows, event, p, weight="_n"))
    low, high = risk_limits(rows, event, p, weight="_n", curve=curve)
    group = F.when(F.col(p) <= low, "low").when(F.col(p) <= high, "intermediate").otherwise("high")
    strata = A.risk_strata(rows, event, group, "_n").agg(F.array_sort(F.collect_list(F.struct("position", "risk", "n", "events", "rate"))).alias("strata"))
    n = F.sum("_n")
    sums = rows.agg(
        F.coalesce(n, F.lit(0)).alias("n"), F.sum(F.col(event) * F.col("_n")).cast("long").alias("events"), (F.sum(F.col(p) * F.col("_n")) / n).alias("mean"), (F.sum(F.col(event) * F.col("_n")) / n).alias("observed"),
    )
    # fp counts from above, so n - fp are the non-events below a score; of equal Youden indices the largest threshold
    total = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    tpr, fpr = F.try_divide("tp", "p"), F.try_divide("fp", "n")
    key_of = F.struct(F.round(tpr - fpr, 12).alias("y"), F.col("score").alias("t"))
    areas = curve.agg(
        F.when(total > 0, F.sum(F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") / 2)) / total).alias("auc"), F.sum("pos").cast("long").alias("pos"), F.sum("neg").cast("long").alias("neg"),
        F.when(total > 0, F.max_by(F.struct("score", (tpr - fpr).alias("youden"), tpr.alias("tpr"), fpr.alias("fpr")), key_of)).alias("_w"),
    ).select("auc", "pos", "neg", F.col("_w.score").alias("youden_threshold"), "_w.youden", F.col("_w.tpr").alias("youden_sensitivity"), (1 - F.col("_w.fpr")).alias("youden_specificity"))
    parts = [areas, sums, A.proper_scores(rows, event, p, weight="_n"), A.calibration_error(rows, event, p, weight="_n"), calibration_slope(rows, event, p, weight="_n"), strata]
    if key:
        parts.append(interval(kept(replicate_aucs(df, event, [p], key, reps, seed)), f"in_{p}").select(F.col("low").alias("auc_low"), F.col("high").alias("auc_high")))
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out.withColumns({"low_threshold": F.lit(low), "high_threshold": F.lit(high)}).select(
        "auc", "pos", "neg", "n", "events", "brier", "log_loss", "ece", "mce", "mean", "observed", "intercept", "slope", "youden_threshold", "youden", "youden_sensitivity", "youden_specificity",
        "low_threshold", "high_threshold", "strata", *(["auc_low", "auc_high"] if key else []),
    )
