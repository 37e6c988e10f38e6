"""Calibration: sigmoid, isotonic and intercept fits from sums; application; bands.

Isotonic curves are pooled in parallel. For a level c the scores whose fitted
value exceeds c are those behind the smallest of cum(events) - c * cum(rows), so
one aggregation over running totals finds, for many levels at once, places that no
pool crosses. The stretches between them are pooled on their own, and no task
holds a curve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.scalars import logit, sigmoid
from riskloom.operators.joins import interp
from riskloom.operators.order import RANGES, ordered_cumsum
from riskloom.sources.scratch import kept


def newton_by(df: DataFrame, event: str, x: str, by: list[str], rounds: int = 50, tol: float = 1e-8, weight: str | None = None) -> dict[tuple, tuple[float, float]]:
    """Intercept and slope of ``event`` on ``x`` for each group of ``by``.

    Rows are counted by group, event and ``x`` once. Each round is one aggregation of
    five sums per group; groups are models, folds or replicates, so their two
    parameters are all that is broadcast. A group's ``x`` is centred and scaled first:
    margins or log-odds that hardly differ make intercept and slope as good as one
    direction, along which clipped steps run without getting anywhere.
    """
    df = kept(df.groupBy(*by, event, x).agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("double").alias("_w")))
    w, known = F.col("_w"), F.when(F.col(x).isNotNull(), F.col("_w"))
    spark, types = df.sparkSession, dict(df.dtypes)

    def met(values: dict, *names: str) -> DataFrame:
        """Rows with the numbers of their group."""
        params = spark.createDataFrame([(*k, *v) for k, v in values.items()], ", ".join([f"{b} {types[b]}" for b in by] + [f"{n} double" for n in names]))
        return df.join(F.broadcast(params), by) if by else df.crossJoin(F.broadcast(params))

    key_of = lambda r: tuple(r[b] for b in by)
    means = {key_of(r): r for r in df.groupBy(*by).agg(F.try_divide(F.sum(w * F.col(x)), F.sum(known)).alias("m"), F.min(event).alias("low"), F.max(event).alias("high")).collect()}
    beta, scale = {k: (0.0, 0.0) for k in means}, {k: (0.0, 1.0) for k in means}
    # without both classes, or with one value, there is no optimum to get to, and x stays as it is
    two = {k: (r["m"],) for k, r in means.items() if r["m"] is not None and r["low"] != r["high"]}
    if two:
        off = F.col(x) - F.col("_m")
        for r in met(two, "_m").groupBy(*by).agg(F.sqrt(F.try_divide(F.sum(w * off * off), F.sum(known))).alias("sd")).collect():
            mean = two[key_of(r)][0]
            if r["sd"] is not None and r["sd"] > 1e-12 * max(1.0, abs(mean)):
                scale[key_of(r)] = (mean, r["sd"])
    for _ in range(rounds):
        rows = met({k: (*beta[k], *scale[k]) for k in beta}, "_a", "_b", "_m", "_s").withColumn("_z", (F.col(x) - F.col("_m")) / F.col("_s"))
        z = F.col("_z")
        p = sigmoid(F.col("_a") + F.col("_b") * z, 500.0)
        v, e = w * p * (1 - p), w * (F.col(event) - p)
        sums = rows.groupBy(*by).agg(F.sum(e).alias("g0"), F.sum(e * z).alias("g1"), F.sum(v).alias("h00"), F.sum(v * z).alias("h01"), F.sum(v * z * z).alias("h11"))
        worst = 0.0
        for r in sums.collect():
            key = key_of(r)
            h = np.array([[r["h00"] + 1e-10, r["h01"]], [r["h01"], r["h11"] + 1e-10]])
            step = np.clip(np.linalg.solve(h, [r["g0"], r["g1"]]), -5, 5)
            beta[key] = (beta[key][0] + float(step[0]), beta[key][1] + float(step[1]))
            worst = max(worst, float(np.abs(step).max()))
        if worst < tol:
            break
    return {k: (a - b * scale[k][0] / scale[k][1], b / scale[k][1]) for k, (a, b) in beta.items()}


def fit_sigmoid(df: DataFrame, event: str, p: str) -> tuple[float, float]:
    """CL-01: unpenalised logistic fit on the log-odds."""
    return newton_by(df.select(event, logit(p).alias("_x")), event, "_x", [])[()]


def calibration_slope(df: DataFrame, event: str, p: str, *by: str, eps: float = 1e-12, weight: str | None = None) -> DataFrame:
    """CL-07: intercept and slope of the event on logit(p), per group; ``weight`` says how often a row counts."""
    beta = newton_by(df.select(*by, event, logit(p, eps).alias("_x"), *([weight] if weight else [])), event, "_x", list(by), weight=weight)
    types = dict(df.dtypes)
    return df.sparkSession.createDataFrame([(*k, *v) for k, v in beta.items()], ", ".join([f"{b} {types[b]}" for b in by] + ["intercept double", "slope double"]))


def fit_intercept_only(df: DataFrame, event: str, p: str, rounds: int = 100, tol: float = 1e-8) -> float:
    """CL-03: the shift of the log-odds that makes mean risk and event rate equal."""
    shift, x = 0.0, df.select(event, logit(p).alias("_x"))
    for _ in range(rounds):
        q = sigmoid(F.col("_x") + shift, 500.0)
        r = x.agg(F.sum(F.col(event) - q).alias("g"), F.sum(q * (1 - q)).alias("h")).first()
        step = r["g"] / max(r["h"], 1e-12)
        shift += step
        if abs(step) < tol:
            break
    return shift


def isotonic_curves(counts: DataFrame, by: list[str], ranges: int = RANGES) -> tuple[DataFrame, DataFrame]:
    """Monotone least-squares curves of many groups from ``by..., x, pos, n``, one row per score.

    Returns pools ``by..., stretch, low, high, y, n`` and ``by..., bounds``: scores that
    no pool of the group crosses, at most ``ranges`` - 1.
    """
    cum = kept(ordered_cumsum(counts.filter("n > 0"), "x", ["pos", "n"], by))
    totals = cum.groupBy(*by).agg(F.sum("n").alias("_total"))
    # levels to cut at: between the rates of equal shares of the rows
    share = F.least(F.floor(F.col("cum_n") / F.col("_total") * ranges), F.lit(ranges - 1))
    rates = cum.join(F.broadcast(totals), by).groupBy(*by, share.alias("_b")).agg((F.sum("pos") / F.sum("n")).alias("_y"))
    sorted_ = rates.groupBy(*by).agg(F.array_sort(F.collect_set("_y")).alias("_s"))
    pairs = F.zip_with(F.slice("_s", 1, F.greatest(F.size("_s") - 1, F.lit(0))), F.slice("_s", 2, F.size("_s")), lambda a, b: a + (b - a) * 0.5)
    levels = sorted_.select(*by, F.explode(pairs).alias("_c"))
    height = F.col("cum_pos") - F.col("_c") * F.col("cum_n")
    # the least height, then where it is: numbers are aggregated by hash, a struct would be sorted with a row per score and level;
    # a height above 0 everywhere: the whole curve lies above the level
    levels = kept(levels)
    least = kept(cum.join(F.broadcast(levels), by).groupBy(*by, "_c").agg(F.min(height).alias("_h")).filter("_h < 0"))
    low = cum.join(F.broadcast(least), by).filter(height == F.col("_h")).groupBy(*by, "_c").agg(F.min("x").alias("_x"))
    bounds = kept(totals.select(*by).join(low.groupBy(*by).agg(F.array_sort(F.collect_set("_x")).alias("_a")), by, "left").select(*by, F.coalesce("_a", F.array().cast("array<double>")).alias("bounds")))
    placed = _stretch(cum.select(*by, "x", "pos", "n"), "x", bounds, by)
    types = dict(placed.dtypes)
    keys = [*by, "stretch"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, pools = None, []

        def out() -> pd.DataFrame:
            made = pd.DataFrame([[*key, q[0], q[1], q[2] / q[3], q[3]] for q in pools], columns=[*keys, "low", "high", "y", "n"])
            return made

        for rows in batches:
            for *k, x, e, n in rows[[*keys, "x", "pos", "n"]].itertuples(index=False):
                if tuple(k) != key:
                    if pools:
                        yield out()
                    key, pools = tuple(k), []
                pools.append([x, x, e, n])
                while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
                    left, right = pools[-2], pools.pop()
                    pools[-1] = [left[0], right[1], left[2] + right[2], left[3] + right[3]]
        if pools:
            yield out()

    schema = ", ".join([f"{b} {types[b]}" for b in by] + ["stretch int, low double, high double, y double, n double"])
    ordered = placed.repartition(*keys).sortWithinPartitions(*keys, "x").select(*keys, "x", F.col("pos").cast("double").alias("pos"), F.col("n").cast("double").alias("n"))
    return kept(ordered.mapInPandas(walk, schema)), bounds


def _stretch(df: DataFrame, x: str, bounds: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the ``stretch`` of its group that ``x`` lies in: the number of bounds below it."""
    return df.join(F.broadcast(bounds), by).withColumn("stretch", F.size(F.filter("bounds", lambda b: b < F.col(x)))).drop("bounds")


def evaluate_curves(queries: DataFrame, x: str, pools: DataFrame, bounds: DataFrame, by: list[str], out: str) -> DataFrame:
    """``queries`` (``by..., x``, each once) with the value of their group's curve: pools are level, between them it is linear, beyond the ends constant.

    A query meets the breakpoints before and after it inside its stretch; where a
    stretch has none on one side, that of the next stretch counts, of which a
    group has few.
    """
    ends = F.array_distinct(F.array(F.col("low"), F.col("high")))
    points = pools.select(*by, "stretch", F.explode(ends).alias("_x"), F.col("y").alias("_y"))
    asked = _stretch(queries.select(*by, F.col(x).alias("_x")), "_x", bounds, by).withColumn("_y", F.lit(None).cast("double"))
    point = F.when(F.col("_y").isNotNull(), F.struct(F.col("_x").alias("x"), F.col("_y").alias("y")))
    part = Window.partitionBy(*by, "stretch")
    # at equal places breakpoints come first in both directions
    up = part.orderBy("_x", F.col("_y").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    down = part.orderBy(F.desc("_x"), F.col("_y").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = points.select(*by, "stretch", "_x", "_y").unionByName(asked.select(*by, "stretch", "_x", "_y"))
    near = both.withColumns({"_p": F.last(point, ignorenulls=True).over(up), "_n": F.last(point, ignorenulls=True).over(down)}).filter("_y is null")
    edges = points.groupBy(*by, "stretch").agg(F.min(F.struct(F.col("_x").alias("x"), F.col("_y").alias("y"))).alias("_first"), F.max(F.struct(F.col("_x").alias("x"), F.col("_y").alias("y"))).alias("_last"))
    # stretches with queries only take part, too
    all_ = edges.join(asked.select(*by, "stretch").distinct(), [*by, "stretch"], "full")
    whole = Window.partitionBy(*by or [F.lit(0)]).orderBy("stretch")
    beside = all_.select(
        *by, "stretch", F.last("_last", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(whole.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    met = near.join(F.broadcast(beside), [*by, "stretch"]).withColumns({"_p": F.coalesce("_p", "_before"), "_n": F.coalesce("_n", "_after")})
    slope = F.when(F.col("_n.x") > F.col("_p.x"), F.col("_p.y") + (F.col("_x") - F.col("_p.x")) * (F.col("_n.y") - F.col("_p.y")) / (F.col("_n.x") - F.col("_p.x"))).otherwise(F.col("_p.y"))
    value = F.when(F.col("_p").isNull(), F.col("_n.y")).when(F.col("_n").isNull(), F.col("_p.y")).otherwise(slope)
    return met.select(*by, F.col("_x").alias(x), value.alias(out))


def fit_isotonic(df: DataFrame, event: str, p: str, weight: str | None = None, ranges: int = RANGES) -> DataFrame:
    """CL-02: breakpoints ``x, y`` of the monotone least-squares fit, on rows counted by distinct score."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    counts = df.filter(F.col(p).isNotNull() & F.col(event).isNotNull()).groupBy(F.lit(0).alias("_all"), F.col(p).cast("double").alias("x")).agg(F.sum(w * F.col(event)).alias("pos"), F.sum(w).alias("n"))
    pools, _ = isotonic_curves(counts, ["_all"], ranges)
    return pools.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("x"), "y")


def apply_calibrator(df: DataFrame, p: str, calibrator: dict, out: str) -> DataFrame:
    """CL-06: ``identity``, ``sigmoid`` (intercept, slope) or ``isotonic`` (x, y), inside [0, 1]."""
    kind = calibrator["type"]
    if kind == "identity":
        return df.withColumn(out, F.col(p))
    if kind == "sigmoid":
        return df.withColumn(out, sigmoid(F.lit(float(calibrator["intercept"])) + F.lit(float(calibrator["slope"])) * logit(p)))
    if kind == "isotonic":
        points = df.sparkSession.createDataFrame(list(zip(calibrator["x"], calibrator["y"], strict=True)), "x double, y double")
        return interp(df, p, points, out).withColumn(out, F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0)))
    raise ValueError(f"unknown calibrator {kind}")


def select_calibrator(df: DataFrame, event: str, p: str) -> DataFrame:
    """CL-04: Brier score of each kind on the full data, the best first; rows are counted by event and score once, and all else reads the counts."""
    df = kept(df.groupBy(F.col(event), F.col(p).cast("double").alias(p)).agg(F.count(F.lit(1)).cast("double").alias("_n")))
    a, b = newton_by(df.select(event, logit(p).alias("_x"), "_n"), event, "_x", [], weight="_n")[()]
    points = fit_isotonic(df, event, p, "_n")
    fits = {
        "identity": df.withColumn("_c", F.col(p)), "sigmoid": apply_calibrator(df, p, {"type": "sigmoid", "intercept": a, "slope": b}, "_c"),
        "isotonic": interp(df, p, points, "_c"),
    }
    out = None
    for kind, fitted in fits.items():
        square = (F.col("_c") - F.col(event)) * (F.col("_c") - F.col(event))
        row = fitted.agg((F.sum(F.col("_n") * square) / F.sum(F.when(square.isNotNull(), F.col("_n")))).alias("brier")).select(F.lit(kind).alias("kind"), "brier")
        out = row if out is None else out.unionByName(row)
    return out.orderBy("brier", "kind")


#: Folds whose sums are one aggregation.
FOLDS_AT_ONCE = 40


def _fold_newton(counts: DataFrame, folds: list, rounds: int = 50, tol: float = 1e-8) -> dict:
    """Intercept and slope of the rows outside each fold, from ``fold, x, pos, n``; a round is one aggregation, and no row is copied."""
    beta = {f: (0.0, 0.0) for f in folds}
    open_ = list(folds)
    for _ in range(rounds):
        sums = []
        for i, f in enumerate(open_):
            a, b = beta[f]
            q = sigmoid(F.lit(a) + F.lit(b) * F.col("x"), 500.0)
            out = F.col("fold").eqNullSafe(F.lit(f))
            n, pos = F.when(out, 0.0).otherwise(F.col("n")), F.when(out, 0.0).otherwise(F.col("pos"))
            e, v = pos - n * q, n * q * (1 - q)
            sums += [F.sum(e).alias(f"g0_{i}"), F.sum(e * F.col("x")).alias(f"g1_{i}"), F.sum(v).alias(f"h0_{i}"), F.sum(v * F.col("x")).alias(f"h1_{i}"), F.sum(v * F.col("x") * F.col("x")).alias(f"h2_{i}")]
        r, still = counts.agg(*sums).first(), []
        for i, f in enumerate(open_):
            h = np.array([[r[f"h0_{i}"] + 1e-10, r[f"h1_{i}"]], [r[f"h1_{i}"], r[f"h2_{i}"] + 1e-10]])
            step = np.clip(np.linalg.solve(h, [r[f"g0_{i}"], r[f"g1_{i}"]]), -5, 5)
            beta[f] = (beta[f][0] + float(step[0]), beta[f][1] + float(step[1]))
            if np.abs(step).max() >= tol:
                still.append(f)
        open_ = still
        if not open_:
            break
    return beta


def cross_calibrate(df: DataFrame, event: str, p: str, fold: str, method: str = "sigmoid", ranges: int = RANGES) -> DataFrame:
    """CL-05: a ``sigmoid`` or ``isotonic`` fit on the other folds, applied to the held-out one; clipped to [0, 1].

    Rows are counted once by fold and score; what lies outside a fold is all
    counts less its own. A fold whose complement has one class keeps its scores.
    """
    kind = dict(df.dtypes)[fold]
    known = df.filter(F.col(p).isNotNull() & F.col(event).isNotNull())
    counts = kept(known.groupBy(F.col(fold).alias("fold"), F.col(p).cast("double").alias("p")).agg(F.sum(event).cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n")))
    each = {r["fold"]: (r["pos"], r["n"]) for r in counts.groupBy("fold").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).collect()}
    pos, n = sum(v[0] for v in each.values()), sum(v[1] for v in each.values())
    folds = sorted((f for f, (a, b) in each.items() if 0 < pos - a < n - b), key=str)
    spark = df.sparkSession
    if method == "sigmoid":
        beta: dict = {}
        for low in range(0, len(folds), FOLDS_AT_ONCE):
            beta |= _fold_newton(counts.withColumn("x", logit("p")), folds[low : low + FOLDS_AT_ONCE])
        params = spark.createDataFrame([(f, *beta[f]) for f in folds], f"_f {kind}, _a double, _b double")
        met = df.join(F.broadcast(params), F.col(fold).eqNullSafe(F.col("_f")), "left")
        fitted = sigmoid(F.col("_a") + F.col("_b") * logit(p))
        drop = ["_f", "_a", "_b"]
    elif method == "isotonic":
        listed = spark.createDataFrame([(f,) for f in folds], f"_f {kind}").agg(F.collect_list(F.struct("_f")).alias("_l")) if folds else None
        if listed is None:
            return df.withColumn("calibrated", F.when(F.col(p).isNotNull(), F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0))))
        by_score = counts.groupBy("p").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.collect_list(F.struct("fold", "pos", "n")).alias("own"))
        outside = by_score.crossJoin(F.broadcast(listed)).select("p", "pos", "n", "own", F.explode("_l").alias("_o"))  # one row of folds
        mine = F.filter("own", lambda o: o["fold"].eqNullSafe(F.col("_o._f")))
        less = lambda c: F.col(c) - F.coalesce(F.get(mine, F.lit(0))[c], F.lit(0.0))
        # folds go by a number, as their values may be null
        number = {f: i for i, f in enumerate(folds)}
        numbers = spark.createDataFrame([(f, i) for f, i in number.items()], f"_f {kind}, _g int")
        complement = outside.select(F.col("_o._f").alias("_f0"), F.col("p").alias("x"), less("pos").alias("pos"), less("n").alias("n")).join(F.broadcast(numbers), F.col("_f0").eqNullSafe(F.col("_f"))).select("_g", "x", "pos", "n")
        pools, bounds = isotonic_curves(complement, ["_g"], ranges)
        asked = counts.join(F.broadcast(numbers), F.col("fold").eqNullSafe(F.col("_f"))).select("_g", F.col("p").alias("x"))
        values = evaluate_curves(asked, "x", pools, bounds, ["_g"], "_v").join(F.broadcast(numbers), "_g").select("_f", F.col("x").alias("_x"), "_v")
        met = df.join(values, F.col(fold).eqNullSafe(F.col("_f")) & (F.col(p).cast("double") == F.col("_x")), "left")
        fitted, drop = F.col("_v"), ["_f", "_x", "_v"]
    else:
        raise ValueError(f"unknown method {method}")
    value = F.least(F.greatest(F.coalesce(fitted, F.col(p)), F.lit(0.0)), F.lit(1.0))
    return met.withColumn("calibrated", F.when(F.col(p).isNotNull(), value)).drop(*drop)


def reliability_band(df: DataFrame, event: str, p: str, key: str, reps: int, seed=0, steps: int = 100, ranges: int = RANGES) -> DataFrame:
    """CL-08: mean and percentiles of bootstrap isotonic curves on a grid of ``steps + 1`` points.

    All replicates are one plan: rows are counted by score and replicate, curves are
    pooled in stretches, and grid points meet them there.
    """
    from riskloom.operators.resample import bootstrap_weights, replicates

    rows = bootstrap_weights(df.select(key, event, F.col(p).cast("double").alias("x")), key, event, reps, seed, ["x"]).filter("weight > 0")
    counts = kept(rows.groupBy("rep", "x").agg(F.sum(F.col("weight") * F.col(event)).cast("double").alias("pos"), F.sum("weight").cast("double").alias("n")))
    pools, bounds = isotonic_curves(counts, ["rep"], ranges)
    grid = replicates(df.sparkSession, reps).withColumn("g", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / steps)))
    curves = evaluate_curves(grid, "g", pools, bounds, ["rep"], "value")
    return curves.groupBy("g").agg(F.avg("value").alias("mean"), F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"))
