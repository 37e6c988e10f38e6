"""Models: single fits, tuning, out-of-fold scores, ensembles and stability selection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import hash_key, sigmoid
from riskloom.operators.contracts import ContractError
from riskloom.operators.evaluate import auc
from riskloom.operators.permute import key_of
from riskloom.operators.resample import bootstrap_weights, class_order, placed_by_class, possible_folds, repeated_kfold, stratified_holdout, subsample
from riskloom.operators.screen import correlated_groups, fdp_threshold, rank_correlations
from riskloom.operators.solver import Fit, Shuffle, fit_logistic_replicates, held_out_aucs, replicate_scores
from riskloom.operators.together import together
from riskloom.sources.scratch import kept


def vector_rows(long: DataFrame) -> DataFrame:
    """``id, event, features`` with features in the order of their names; nulls stay, and fits take them as their mean."""
    packed = F.sort_array(F.collect_list(F.struct("feature", "value")))
    return long.groupBy("id", "event").agg(F.transform(packed, lambda s: s["value"]).alias("features"))


def array_rows(arrays: DataFrame) -> DataFrame:
    """``vector_rows`` of ``id, event, features`` whose features are positions: an array is shuffled whole, not a row per value.

    Arrays of the same id and class are merged by position; one without values is no row.
    """
    placed = F.flatten(F.transform("_all", lambda a: F.transform(a, lambda v, i: F.struct(i.alias("feature"), v.alias("value")))))
    merged = F.transform(F.sort_array(placed), lambda s: s["value"])
    each = arrays.filter(F.size("features") > 0).groupBy("id", "event").agg(F.collect_list("features").alias("_all"))
    return each.select("id", "event", F.when(F.size("_all") == 1, F.get("_all", F.lit(0))).otherwise(merged).alias("features"))


def with_weights(rows: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """Adds ``weights``: position r is the weight of replicate r."""
    each = weights.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("rep", F.col("weight").cast("double")))).alias("_m"))
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: F.coalesce(F.element_at("_m", r.cast("int")), F.lit(0.0)))
    return rows.join(each, "id").withColumn("weights", at).drop("_m")


def linear_p(fit: dict):
    """Probability of a fit for a ``features`` array, as a column."""
    scale = [float(c / s) for c, s in zip(fit["coef"], fit["sd"], strict=True)]
    base = float(fit["intercept"] - sum(a * m for a, m in zip(scale, fit["mean"], strict=True)))
    dot = F.aggregate(F.zip_with("features", F.array(*[F.lit(a) for a in scale]), lambda x, a: x * a), F.lit(base), lambda s, v: s + v)
    return sigmoid(dot, 500.0)


def fit_logistic(rows: DataFrame, c: float = 1.0, l1_ratio: float = 0.0, balanced: bool = False) -> dict:
    """ML-02."""
    if balanced:
        n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("e")).first()
        w = F.when(F.col("event") == 1, n["n"] / (2 * n["e"])).otherwise(n["n"] / (2 * (n["n"] - n["e"])))
    else:
        w = F.lit(1.0)
    return fit_logistic_replicates(rows.withColumn("weights", F.array(w)), [Fit(0, c, l1_ratio)])[0]


def coded_rows(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows with ``codes`` joined by ``id``, kept, as every step of a fit reads them; ids that repeat or have no codes are an error."""
    out = kept(rows.join(codes.select("id", "codes"), "id"))
    if out.count() != rows.count():
        raise ContractError("ids repeat, or some have no fold")
    return out


def fold_rows(rows: DataFrame, k: int, seed=0) -> DataFrame:
    """Rows with their fold as ``codes``; a fit that holds out ``(0, f)`` leaves out fold f."""
    codes = lambda sizes: {"codes": F.array((F.col("pos") % possible_folds(k, list(sizes.values()))).cast("int"))}
    return placed_by_class(rows, "id", "event", seed, codes)[0]


def nested_codes(rows: DataFrame, k: int, inner: int, repeats: int = 1, seed=0) -> DataFrame:
    """Rows with an outer and an inner fold per repeat in ``codes``: two numbers, however many splits they stand for.

    Inner folds are dealt by class inside each outer fold, so the inner folds of
    any outer training set are even.
    """
    outer = repeated_kfold(rows, "id", "event", k, repeats, seed)
    dealt = class_order(outer, "id", "event", f"{seed}|inner", ["rep", "fold"])
    each = dealt.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rep", "fold", (F.col("pos") % inner).cast("int").alias("inner")))).alias("_c"))
    return coded_rows(rows, each.select("id", F.flatten(F.transform("_c", lambda x: F.array(x["fold"], x["inner"]))).alias("codes")))


def oof_predictions(rows: DataFrame, k: int, c: float = 1.0, l1_ratio: float = 0.0, seed=0) -> DataFrame:
    """ML-11: out-of-fold probabilities; all folds are fitted in one job per step and scored in one pass."""
    folded, fits = fold_rows(rows, k, seed), [Fit(None, c, l1_ratio, ((0, f),)) for f in range(k)]
    return replicate_scores(folded, fits, fit_logistic_replicates(folded, fits), held_out=True).select("id", "event", F.col("fit").alias("fold"), "p")


def best_trials(scored: DataFrame, tasks: list, trials: int, folds: int) -> list[int]:
    """The trial with the largest mean fold AUC of each task, the first on ties; fits are numbered by task, trial and fold."""
    found = {r["fit"]: r["auc"] for r in auc(scored, "event", "p", ["fit"]).select("fit", "auc").collect() if r["auc"] is not None}
    out = []
    for t in range(len(tasks)):
        means = []
        for i in range(trials):
            known = [found[f] for g in range(folds) if (f := (t * trials + i) * folds + g) in found]
            means.append(round(sum(known) / len(known), 12) if known else -1.0)
        out.append(max(range(trials), key=lambda i: (means[i], -i)))
    return out


def nested_oof_predictions(rows: DataFrame, k: int, grid: list[tuple[float, float]], inner: int = 3, repeats: int = 1, seed=0) -> DataFrame:
    """ML-11 with tuning inside each outer fold: ``rep, fold, c, l1_ratio, id, event, p`` of the rows held out.

    All outer folds, inner folds, repeats and (c, l1_ratio) pairs are fitted
    together; what reaches the driver is one AUC per inner fit.
    """
    coded = nested_codes(rows, k, inner, repeats, seed)
    outer = [(r, f) for r in range(repeats) for f in range(k)]
    fits = [Fit(None, *pair, ((2 * r, f), (2 * r + 1, g))) for r, f in outer for pair in grid for g in range(inner)]
    won = best_trials(replicate_scores(coded, fits, fit_logistic_replicates(coded, fits), held_out=True), outer, len(grid), inner)
    last = [Fit(None, *grid[i], ((2 * r, f),)) for (r, f), i in zip(outer, won, strict=True)]
    scored = replicate_scores(coded, last, fit_logistic_replicates(coded, last), held_out=True)
    about = F.array(*[F.struct(F.lit(r).alias("rep"), F.lit(f).alias("fold"), F.lit(float(grid[i][0])).alias("c"), F.lit(float(grid[i][1])).alias("l1_ratio")) for (r, f), i in zip(outer, won, strict=True)])
    return scored.withColumn("_a", F.get(about, F.col("fit"))).select("_a.*", "id", "event", "p")


def numbered_by_class(rows: DataFrame, seed=0, columns: list[str] | None = None) -> tuple[DataFrame, int, int]:
    """Rows with a ``number`` that counts the events first, in a hashed order; the rows and the events. ``columns``: what to keep."""
    number = lambda sizes: {"number": F.when(F.col("event") == 1, F.col("pos")).otherwise(F.col("pos") + F.lit(sizes.get(1, 0)))}
    out, sizes = placed_by_class(rows, "id", "event", f"{seed}|number", number, columns)
    return out, sum(sizes.values()), sizes.get(1, 0)


def permutation_refit(rows: DataFrame, reps: int, frac: float = 0.2, c: float = 1.0, l1_ratio: float = 0.0, seed=0, method: str = "plus_one") -> DataFrame:
    """EV-12: hold-out AUC of fits on permuted labels against that on the labels as they are.

    Labels are dealt anew by a keyed permutation of row numbers, which each task
    computes for its rows: class totals stay, and the first ``frac`` of the places
    of each class are the hold-out. All permutations share every pass, and no
    row is copied. ``method``: (k + 1) / (R + 1), or ``share`` of the permutations
    that reach the observed AUC. Returns ``observed, p, null_mean, null_sd, valid``.
    """
    numbered, n, events = numbered_by_class(rows, seed, ["event", "features"])
    shuffle = Shuffle(n, events, frac)
    fits = [Fit(None, c, l1_ratio, shuffle=key_of(seed, r) or 1 if r else 0) for r in range(reps + 1)]
    a = kept(held_out_aucs(numbered, fits, fit_logistic_replicates(numbered, fits, shuffle=shuffle), shuffle))
    null = a.filter("fit > 0 and auc is not null").crossJoin(F.broadcast(a.filter("fit = 0").select(F.col("auc").alias("observed"))))
    hits, valid = F.count_if(F.col("auc") >= F.col("observed")), F.count(F.lit(1))
    p = (hits + 1) / (valid + 1) if method == "plus_one" else hits / valid
    return null.agg(F.first("observed").alias("observed"), p.alias("p"), F.avg("auc").alias("null_mean"), F.stddev_pop("auc").alias("null_sd"), valid.alias("valid"))


def tune_grid(rows: DataFrame, grid: list[tuple[float, float]], k: int = 3, seed=0) -> DataFrame:
    """ML-03: mean fold AUC of each (c, l1_ratio), the best first, earlier ones on ties; all fits run together."""
    folded, fits = fold_rows(rows, k, seed), [Fit(None, c, r, ((0, f),)) for c, r in grid for f in range(k)]
    scored = replicate_scores(folded, fits, fit_logistic_replicates(folded, fits), held_out=True)
    trials = rows.sparkSession.createDataFrame([(i, float(c), float(r)) for i, (c, r) in enumerate(grid)], "trial int, c double, l1_ratio double")
    by_trial = auc(scored, "event", "p", ["fit"]).groupBy((F.col("fit") / k).cast("int").alias("trial")).agg(F.avg("auc").alias("auc"))
    return trials.join(by_trial, "trial").select("trial", "c", "l1_ratio", "auc").orderBy(F.desc("auc"), "trial")


def random_trials(n: int, seed=0) -> list[tuple[float, float]]:
    """ML-04: log-uniform c in [1e-3, 1e3] and uniform l1_ratio from hashes."""
    import hashlib

    u = lambda i, what: int(hashlib.md5(f"{seed}|{what}|{i}".encode()).hexdigest()[:8], 16) / 2**32
    return [(10 ** (6 * u(i, "c") - 3), u(i, "l1")) for i in range(n)]


def soft_vote(preds: DataFrame) -> DataFrame:
    """ML-09."""
    return preds.groupBy("id").agg(F.first("event").alias("event"), F.avg("p").alias("p"))


def _assembled(rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("x", array_to_vector("features")).withColumn("label", F.col("event").cast("double"))


def class_weight(rows: DataFrame, weight: str | None = None):
    """n / (2 n_c) of each row's class, as a column; times ``weight``, which also counts rows."""
    times = F.col(weight) if weight else F.lit(1.0)
    r = rows.agg(F.sum(times).alias("n"), F.sum(F.col("event") * times).alias("e")).first()
    n, e = float(r["n"] or 0), float(r["e"] or 0)
    return times * F.when(F.col("event") == 1, n / (2 * max(e, 1e-12))).otherwise(n / (2 * max(n - e, 1e-12)))


def fit_forest(rows: DataFrame, trees: int = 50, depth: int = 5, seed: int = 1, balanced: bool = False):
    """ML-06: ``balanced`` gives both classes the same weight."""
    from pyspark.ml.classification import RandomForestClassifier

    data = _assembled(rows).withColumn("w", class_weight(rows) if balanced else F.lit(1.0))
    return RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="w", numTrees=trees, maxDepth=depth, seed=seed).fit(data)


def tune_forest(rows: DataFrame, depths: list[int], trees: int = 50, k: int = 3, balanced: bool = True, seed=0) -> DataFrame:
    """ML-06: mean fold AUC of each depth, the best first, the smaller on ties."""
    folded, out = fold_rows(rows, k, seed), None
    for depth in depths:
        for f in range(k):
            held = F.col("codes")[0] == f
            scores = ml_scores(fit_forest(folded.filter(~held), trees, depth, balanced=balanced), folded.filter(held))
            one = auc(scores, "event", "p").select(F.lit(depth).alias("depth"), F.lit(f).alias("fold"), "auc")
            out = one if out is None else out.unionByName(one)
    return kept(out).groupBy("depth").agg(F.avg("auc").alias("auc")).orderBy(F.desc(F.round("auc", 12)), "depth")


def fit_boosted(rows: DataFrame, rounds: int = 30, depth: int = 3, seed=0, weight: str | None = None):
    """ML-07: early stopping on a tenth of the training rows drawn by hash; events weigh non-events / events. ``weight`` says how often a row counts."""
    from pyspark.ml.classification import GBTClassifier

    times = F.col(weight) if weight else F.lit(1)
    n = rows.agg(F.sum(times).alias("n"), F.sum(F.col("event") * times).alias("e")).first()
    w = times * F.when(F.col("event") == 1, (n["n"] - n["e"]) / max(1, n["e"])).otherwise(1.0)
    dev = F.conv(F.substring(hash_key(F.lit(str(seed)), F.col("id")), 1, 4), 16, 10).cast("int") % 10 == 0
    data = _assembled(rows).withColumn("w", w).withColumn("dev", dev)
    return GBTClassifier(featuresCol="x", labelCol="label", weightCol="w", validationIndicatorCol="dev", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=1).fit(data)


#: Up to so many partitions an evaluation of the loss is one stage. Values that a task gets at least, and those that let tasks become more.
FLAT, LEAST_VALUES, MOST_VALUES = 5, 1 << 19, 1 << 23


def loss_partitions(values: int) -> int:
    """Partitions for the few hundred passes of a fit over ``values`` numbers: tasks are not much shorter than their start takes."""
    return max(1, min(FLAT, -(-values // LEAST_VALUES)), -(-values // MOST_VALUES))


def fit_linear_svc(rows: DataFrame):
    """ML-08: linear SVC; its margins get probabilities from a sigmoid fit."""
    from pyspark.ml.classification import LinearSVC

    values = rows.agg(F.sum(F.size("features"))).first()[0] or 0
    data = _assembled(rows).select("x", "label").coalesce(loss_partitions(values))
    return LinearSVC(featuresCol="x", labelCol="label", regParam=0.01, maxIter=50).fit(data)


def split_rows(rows: DataFrame, frac: float = 0.3, seed=0) -> tuple[DataFrame, DataFrame]:
    """Training rows and a stratified hold-out (SP-04), kept in one table; ``rows`` are made once."""
    rows = kept(rows)
    ids = stratified_holdout(rows, "id", "event", frac, 1, seed).select("id").distinct().withColumn("_out", F.lit(True))
    parted = kept(rows.join(ids, "id", "left"))
    return parted.filter("_out is null").drop("_out"), parted.filter("_out").drop("_out")


def ml_scores(model, rows: DataFrame, platt: tuple[float, float] | None = None) -> DataFrame:
    """``id, event, p``; margins go through the sigmoid ``platt`` (intercept, slope) if given, else the plain one."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(_assembled(rows))
    col = "probability" if "probability" in out.columns else "rawPrediction"
    v = vector_to_array(col)[1]
    a, b = platt or (0.0, 1.0)
    return out.select("id", "event", (v if col == "probability" else sigmoid(F.lit(float(a)) + F.lit(float(b)) * v)).alias("p"))


def margins(model, rows: DataFrame) -> DataFrame:
    """``event, _x``: margins of a model."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(_assembled(rows)).select("event", vector_to_array("rawPrediction")[1].alias("_x"))


def fit_platt(rows: DataFrame, k: int = 3, seed=0, fit: Callable = fit_linear_svc) -> tuple[float, float]:
    """ML-08: the sigmoid of a margin model, from margins of rows that the fit of their fold has not seen."""
    from riskloom.operators.calibrate import newton_by

    folded = fold_rows(rows, k, seed)

    def left_out(f: int) -> DataFrame:
        held = F.col("codes")[0] == f
        return margins(fit(folded.filter(~held)), folded.filter(held))

    out = reduce(DataFrame.unionByName, together(rows.sparkSession, [lambda f=f: left_out(f) for f in range(k)]))
    return newton_by(kept(out), "event", "_x", [])[()]


@dataclass(frozen=True)
class ModelSpec:
    """UD-03: a named model: ``fit(rows)`` gives ``score(rows) -> id, event, p``. ``linear`` ones get no extra features."""

    name: str
    fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]
    linear: bool = True


def _linear_spec(name: str, c: float, l1_ratio: float) -> ModelSpec:
    def fit(rows):
        found = fit_logistic(rows, c, l1_ratio)
        return lambda new: new.select("id", "event", linear_p(found).alias("p"))

    return ModelSpec(name, fit)


def _svc(rows):
    model, platt = together(rows.sparkSession, [lambda: fit_linear_svc(rows), lambda: fit_platt(rows)])
    return lambda new: ml_scores(model, new, platt)


def _ml_spec(fitter, **settings):
    def fit(rows):
        model = fitter(rows, **settings)
        return lambda new: ml_scores(model, new)

    return fit


MODELS: dict[str, ModelSpec] = {
    s.name: s
    for s in (
        _linear_spec("ridge", 1.0, 0.0), _linear_spec("lasso", 0.5, 1.0), _linear_spec("elastic_net", 1.0, 0.5), ModelSpec("linear_svc", _svc),
        ModelSpec("forest", _ml_spec(fit_forest, trees=20), False), ModelSpec("boosted", _ml_spec(fit_boosted, rounds=10), False),
    )
}


def register_model(spec: ModelSpec) -> None:
    """UD-03: add a model family; names are unique."""
    if spec.name in MODELS:
        raise ValueError(f"model {spec.name} is registered twice")
    MODELS[spec.name] = spec


def compare_models(rows: DataFrame, specs: dict, k: int = 3, seed=0) -> DataFrame:
    """ML-14: out-of-fold AUC of named (c, l1_ratio) specs on the same rows and folds."""
    folded, fits = fold_rows(rows, k, seed), [Fit(None, *s, ((0, f),)) for s in specs.values() for f in range(k)]
    scored = replicate_scores(folded, fits, fit_logistic_replicates(folded, fits), held_out=True)
    names = F.array(*[F.lit(n) for n in specs])
    return auc(scored.withColumn("model", F.get(names, (F.col("fit") / k).cast("int"))), "event", "p", ["model"]).select("model", "auc", "pos", "neg")


def compare_feature_sets(long: DataFrame, sets: dict[str, list], k: int = 3, least: int = 20, c: float = 1.0, l1_ratio: float = 0.0, seed=0) -> DataFrame:
    """ML-14: ``model, features, n, events, auc, brier, skipped`` of named feature sets on the ids that have all their features.

    A feature is a mask of one shared vector, so all sets and folds are fitted
    together. Where fewer than ``least`` ids are complete, or a class has fewer than
    two, no set is fitted; a set none of whose features is known is skipped alone.
    """
    from riskloom.operators.aggregates import proper_scores

    spark = long.sparkSession
    named = long.select("id", "event", F.col("feature").cast("string").alias("feature"), "value").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    wanted = sorted({str(f) for fs in sets.values() for f in fs})
    have = sorted(r["feature"] for r in named.filter(F.col("feature").isin(wanted)).select("feature").distinct().collect())
    rows = vector_rows(named.filter(F.col("feature").isin(have))).filter(F.size("features") == len(have)) if have else None
    masks = {name: tuple(have.index(str(f)) for f in fs if str(f) in have) for name, fs in sets.items()}
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("e")).first() if rows is not None else {"n": 0, "e": 0}
    n, e = counts["n"], counts["e"] or 0
    run = [name for name in sets if masks[name] and n >= least and min(e, n - e) >= 2]
    about = spark.createDataFrame([(name, len(masks[name]), n, int(e), name not in run) for name in sets], "model string, features int, n long, events long, skipped boolean")
    if not run:
        return about.select("model", "features", "n", "events", F.lit(None).cast("double").alias("auc"), F.lit(None).cast("double").alias("brier"), "skipped")
    folded = fold_rows(kept(rows), k, seed)
    fits = [Fit(None, c, l1_ratio, ((0, f),), mask=masks[name]) for name in run for f in range(k)]
    scored = replicate_scores(folded, fits, fit_logistic_replicates(folded, fits), held_out=True)
    named_scores = kept(scored.withColumn("model", F.get(F.array(*[F.lit(x) for x in run]), (F.col("fit") / k).cast("int"))))
    found = auc(named_scores, "event", "p", ["model"]).select("model", "auc").join(proper_scores(named_scores, "event", "p", "model").select("model", "brier"), "model")
    return about.join(found, "model", "left").select("model", "features", "n", "events", "auc", "brier", "skipped")


def evaluate_resampled(rows: DataFrame, reps: int, c: float = 1.0, l1_ratio: float = 0.0, seed=0) -> DataFrame:
    """EV-13: in-bag and out-of-bag AUC of refitted models per bootstrap replicate, with the .632+ estimate."""
    from riskloom.operators.evaluate import auc_632plus

    weighted = kept(with_weights(rows, bootstrap_weights(rows, "id", "event", reps, seed), reps))
    fits = [Fit(r, c, l1_ratio) for r in range(reps)]
    scored = replicate_scores(weighted, fits, fit_logistic_replicates(weighted, fits))
    inside = auc(scored, "event", "p", ["fit"], "weight").select("fit", F.col("auc").alias("in_bag"))
    outside = auc(scored.filter("weight = 0"), "event", "p", ["fit"]).select("fit", F.col("auc").alias("oob"), (F.col("pos") + F.col("neg")).alias("n_oob"))
    both = inside.join(outside, "fit").select("in_bag", "oob", "n_oob", F.col("fit").alias("rep"))
    return both.withColumn("auc_632plus", auc_632plus(F.col("in_bag"), F.col("oob")))


def l1_shrink(rows: DataFrame, stats: DataFrame, candidates: int, panel: int, c: float = 0.5) -> DataFrame:
    """FS-10: ``feature, coef, auc`` of at most ``panel`` features.

    The ``candidates`` best features by WN-10 are fitted with an L1 penalty; those
    with a coefficient come first, by its size, and the list is filled up by AUC.
    ``stats`` has ``feature, auc, r, distinct``; features of ``rows`` are in the
    order of their names.
    """
    from riskloom.operators.order import rank_features

    names = [r["feature"] for r in stats.select("feature").orderBy("feature").collect()]
    chosen = [r["feature"] for r in rank_features(stats).orderBy("place").limit(candidates).select("feature").collect()]
    at = [names.index(f) for f in chosen]
    fit = fit_logistic(rows.withColumn("features", F.array(*[F.get("features", F.lit(i)) for i in at])), c, 1.0)
    coefs = rows.sparkSession.createDataFrame([(f, float(b)) for f, b in zip(chosen, fit["coef"], strict=True)], f"feature {dict(stats.dtypes)['feature']}, coef double")
    return coefs.join(stats.select("feature", "auc"), "feature").orderBy(F.desc(F.abs("coef") > 0), F.desc(F.abs("coef")), F.desc("auc"), "feature").limit(panel)


def group_masks(names: list[str], groups: dict[str, list[str]], rep: int, seed) -> tuple[int, ...]:
    """Positions of the features of a subsample: one of each group, drawn by a hash."""
    chosen = [sorted(members)[key_of(seed, rep, group) % len(members)] for group, members in sorted(groups.items())]
    return tuple(sorted(names.index(f) for f in chosen))


def stability_selection(
    long: DataFrame, reps: int, lambdas: list[float], seed=0, kind: str = "permutation", l1_ratio: float = 1.0, hard: float | None = None, group_percentile: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """FS-12: selection frequency of real and decoy features over subsamples and L1 strengths, and the FDP+ threshold.

    Decoys are permuted copies or knockoffs (``kind``). A feature's score is its
    largest frequency over the strengths (``l1_ratio`` below 1: elastic net). All
    subsamples and strengths are fitted together. ``hard`` is used as the
    threshold instead. With ``group_percentile`` features whose absolute rank
    correlation lies above that percentile of all pairs share a group (FS-14), and each
    subsample sees one feature of a group; one that it does not see is not
    selected in it.
    """
    from riskloom.operators.screen import decoy_features, knockoff_features

    decoys = {"permutation": decoy_features, "knockoff": knockoff_features}[kind]
    named = long.withColumn("feature", F.col("feature").cast("string"))
    both = named.select("id", "event", "feature", "value").unionByName(decoys(named, seed))
    real = [r["feature"] for r in named.select("feature").distinct().collect()]
    names = sorted({*real, *[f"decoy_{n}" for n in real]}, key=str.encode)
    groups = None
    if group_percentile is not None:
        both = kept(both)
        groups = correlated_groups(*rank_correlations(both), group_percentile)
    masks = [None if groups is None else group_masks(names, groups, r, seed) for r in range(reps)]
    # gathered once, by numbers in place of names; the subsamples read ids and classes of these rows
    places = long.sparkSession.createDataFrame(list(enumerate(names)), "_i int, feature string")
    rows = kept(vector_rows(both.join(F.broadcast(places), "feature").select("id", "event", F.col("_i").alias("feature"), "value")))
    w = subsample(rows, "id", "event", 0.75, reps, seed).select("rep", "id", F.col("balance").alias("weight"))
    fits = fit_logistic_replicates(kept(with_weights(rows, w, reps)), [Fit(r, c, l1_ratio, mask=masks[r]) for c in lambdas for r in range(reps)])
    scores = {n: 0.0 for n in names}
    for i in range(len(lambdas)):
        part = fits[i * reps : (i + 1) * reps]
        for j, n in enumerate(names):
            scores[n] = max(scores[n], sum(abs(f["coef"][j]) > 1e-8 for f in part) / reps)
    freq = long.sparkSession.createDataFrame([(n, float(s), n.startswith("decoy_")) for n, s in scores.items()], "feature string, frequency double, decoy boolean")
    if hard is not None:
        cut = freq.filter(F.col("frequency") >= hard).agg(F.lit(float(hard)).alias("t"), F.count_if("decoy").alias("decoys"), F.count_if(~F.col("decoy")).alias("real"))
        return freq, cut.withColumn("fdp", (1 + F.col("decoys")) / F.greatest(F.lit(1), F.col("real")))
    return freq, fdp_threshold(freq, 0.1, 1.0, 0.05)


def stability_runs(long: DataFrame, runs: int, reps: int, lambdas: list[float], least: float = 0.5, seed=0, **settings) -> tuple[DataFrame, DataFrame]:
    """FS-12 over several runs with subsamples and decoys of their own, and AG-16.

    Returns ``feature, times, frequency, chosen`` - the share of runs whose threshold
    a real feature reaches, and whether that is ``least`` or more - and ``run, t,
    decoys, real, fdp``. ``settings`` go to ``stability_selection``.
    """
    spark, picked, cuts = long.sparkSession, None, None
    names = long.select(F.col("feature").cast("string").alias("feature")).distinct()
    for r in range(runs):
        freq, cut = stability_selection(long, reps, lambdas, f"{seed}|{r}", **settings)
        cut = kept(cut.select(F.lit(r).alias("run"), "t", "decoys", "real", "fdp"))
        one = freq.filter("not decoy").crossJoin(F.broadcast(cut)).filter("frequency >= t").select("run", "feature")
        picked = one if picked is None else picked.unionByName(one)
        cuts = cut if cuts is None else cuts.unionByName(cut)
    times = picked.groupBy("feature").agg(F.countDistinct("run").alias("times"))
    share = F.coalesce("times", F.lit(0)) / F.lit(runs)
    return names.join(times, "feature", "left").select("feature", F.coalesce("times", F.lit(0)).alias("times"), share.alias("frequency"), (share >= least).alias("chosen")), cuts
