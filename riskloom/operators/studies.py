"""Studies: compositions of splits, screening, selection, fits and intervals.

Rows are ``id, event, features`` and long tables ``id, event, feature, value``.
Loops run over folds, replicates or configurations, which are parameters; what
happens inside a step is distributed. All fits of one kind share their passes. What
several steps read is written down, so plans don't grow with the steps.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import aggregates as A
from riskloom.operators import harmonize as H
from riskloom.operators import models as M
from riskloom.operators import order as O
from riskloom.operators import resample as R
from riskloom.operators import screen as FS
from riskloom.operators.evaluate import auc, bootstrap_auc_interval, univariate_auc
from riskloom.operators.solver import Fit, fit_firth, fit_logistic_replicates, replicate_scores
from riskloom.operators.together import together
from riskloom.sources.scratch import kept
from riskloom.sources.tables import commit_result, committed, configuration_key, open_configurations

GRID = ((0.05, 0.0), (1.0, 0.0), (1.0, 0.5))


def _split_rows(rows: DataFrame, test: DataFrame, splits: int) -> DataFrame:
    """``rows`` with ``weights``: 0 in the splits (``rep``) of ``test`` that hold the row out, else 1."""
    out = test.groupBy("id").agg(F.collect_set("rep").alias("_out"))
    held = F.coalesce("_out", F.array().cast("array<int>"))
    at = F.transform(F.sequence(F.lit(0), F.lit(splits - 1)), lambda r: F.when(F.array_contains(held, r), 0.0).otherwise(1.0))
    return kept(rows.join(out, "id", "left").withColumn("weights", at).drop("_out"))


def _held_out(rows: DataFrame, splits: int, c: float, l1_ratio: float) -> DataFrame:
    """``fit, id, event, p`` of the rows that each split holds out; imputation and scaling see training rows only."""
    fits = [Fit(r, c, l1_ratio) for r in range(splits)]
    return kept(replicate_scores(rows, fits, fit_logistic_replicates(rows, fits), held_out=True))


def _with_brier(scores: DataFrame, by: list[str]) -> DataFrame:
    return auc(scores, "event", "p", by).join(A.proper_scores(scores, "event", "p", *by).select(*by, "brier"), by)


def _spread(values: DataFrame, value: str) -> DataFrame:
    """Mean, median, SD, percentile and normal interval of replicate values."""
    half = 1.96 * F.stddev_pop(value) / F.sqrt(F.count(value))
    return values.agg(
        F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.stddev_pop(value).alias("sd"), F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high"),
        (F.avg(value) - half).alias("normal_low"), (F.avg(value) + half).alias("normal_high"), F.count(value).alias("valid"),
    )


def simple_bootstrap(rows: DataFrame, reps: int, c: float = 1.0, l1_ratio: float = 0.0, seed=0) -> DataFrame:
    """EV-11: AUC out of the bag of unstratified replicates, without correction: ``mean, median, sd, ..., valid``."""
    draws = R.bootstrap_weights(rows.select("id", F.lit(0).alias("_all")), "id", "_all", reps, seed)
    weighted = kept(M.with_weights(rows, draws, reps))
    return _spread(auc(_held_out(weighted, reps, c, l1_ratio), "event", "p", ["fit"]), "auc")


def monte_carlo_cv(rows: DataFrame, reps: int, frac: float = 0.3, c: float = 1.0, l1_ratio: float = 0.0, seed=0) -> DataFrame:
    """EV-18: hold-out AUC over random splits and the mean Brier score; splits with fewer than two test events don't count."""
    splits = _split_rows(rows, R.stratified_holdout(rows, "id", "event", frac, reps, seed), reps)
    each = kept(_with_brier(_held_out(splits, reps, c, l1_ratio), ["fit"]).filter("pos >= 2 and auc is not null"))
    return _spread(each, "auc").crossJoin(F.broadcast(each.agg(F.avg("brier").alias("mean_brier"))))


def _coded(rows: DataFrame, splits: int, c: float, l1_ratio: float, position: int = 0) -> DataFrame:
    """``fit, id, event, p`` of the rows that each value of a code holds out."""
    fits = [Fit(None, c, l1_ratio, ((position, r),)) for r in range(splits)]
    return replicate_scores(rows, fits, fit_logistic_replicates(rows, fits), held_out=True)


def leave_out_evaluation(rows: DataFrame, group: str, c: float = 1.0, l1_ratio: float = 0.0, boot: int = 20, seed=0) -> DataFrame:
    """EV-19: each group of ``group`` (or each row, with a unique one) is scored by a fit on the others; one pooled AUC, interval and Brier score.

    A row carries the number of its group, whatever the number of groups. Rows without a group are an error.
    """
    folds = kept(R.leave_one_group_out(rows, group))
    n = folds.count()
    codes = rows.select("id", group).join(folds, group).select("id", F.array(F.col("fold").cast("int")).alias("codes"))
    scores = kept(_coded(M.coded_rows(rows.drop(group), codes), n, c, l1_ratio))
    pooled = bootstrap_auc_interval(scores, "event", "p", "id", boot, seed)
    return pooled.crossJoin(F.broadcast(A.proper_scores(scores, "event", "p").select("brier"))).withColumn("folds", F.lit(n))


def oof_summary(scores: DataFrame, boot: int = 20, seed=0) -> DataFrame:
    """Fold AUCs of ``fit, id, event, p`` summarised, with the AUC of each row's mean score and its stratified interval."""
    names = {"auc": "pooled_auc", "low": "pooled_low", "high": "pooled_high"}
    folds, pooled = together(scores.sparkSession, [
        lambda: _spread(auc(scores, "event", "p", ["fit"]), "auc"),
        lambda: bootstrap_auc_interval(kept(M.soft_vote(scores)), "event", "p", "id", boot, seed).drop("valid").withColumnsRenamed(names),
    ])
    return folds.crossJoin(F.broadcast(pooled))


def repeated_cv_evaluation(rows: DataFrame, k: int = 5, repeats: int = 2, c: float = 1.0, l1_ratio: float = 0.0, boot: int = 20, seed=0, grid: list | None = None, inner: int = 3) -> DataFrame:
    """EV-20: repeated stratified cross-validation with train-only preprocessing; with ``grid`` each outer fold is tuned on its own training rows."""
    if grid:
        scores = M.nested_oof_predictions(rows, k, grid, inner, repeats, seed).withColumn("fit", F.col("rep") * k + F.col("fold"))
        return oof_summary(kept(scores.select("fit", "id", "event", "p")), boot, seed)
    dealt = R.repeated_kfold(rows, "id", "event", k, repeats, seed)
    codes = dealt.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rep", "fold"))), lambda x: x["fold"]).alias("codes"))
    coded = M.coded_rows(rows, codes)
    fits = [Fit(None, c, l1_ratio, ((r, f),)) for r in range(repeats) for f in range(k)]
    return oof_summary(kept(replicate_scores(coded, fits, fit_logistic_replicates(coded, fits), held_out=True)), boot, seed)


def validation_suite(rows: DataFrame, methods: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> tuple[DataFrame, DataFrame]:
    """EV-15: ``method, value`` of several schemes, each a one-row table whose ``mean`` (or ``auc``) counts, and their AG-11 consensus."""
    methods = methods or {
        "bootstrap": lambda r: simple_bootstrap(r, 6), "monte_carlo": lambda r: monte_carlo_cv(r, 6), "repeated_cv": lambda r: repeated_cv_evaluation(r, 3, 1, boot=4),
        "632plus": lambda r: M.evaluate_resampled(r, 6).agg(F.avg("auc_632plus").alias("mean")),
    }

    def run(name: str) -> DataFrame:
        result = methods[name](rows)
        return kept(result.select(F.lit(name).alias("method"), F.col("mean" if "mean" in result.columns else "auc").alias("value")))

    # the schemes don't depend on each other
    out = kept(reduce(DataFrame.unionByName, together(rows.sparkSession, [lambda n=n: run(n) for n in methods])))
    return out, A.consensus(out)


def _names(long: DataFrame) -> list:
    return [r["feature"] for r in long.select("feature").distinct().orderBy("feature").collect()]


def _only(long: DataFrame, features: list) -> DataFrame:
    return long.filter(F.col("feature").isin(features))


def _split(long: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training rows and the rows whose ``id`` is in ``ids``."""
    return kept(long.join(ids.select("id"), "id", "left_anti")), kept(long.join(ids.select("id"), "id", "left_semi"))


def select_panel(train: DataFrame, reps: int, lambdas: list[float], most: int, seed=0, kind: str = "permutation") -> list:
    """FS-12 and FS-13 on training rows: features whose frequency reaches the threshold, the most frequent ``most`` at most; the single best if none does."""
    freq, cut = M.stability_selection(train, reps, lambdas, seed, kind)
    limit = cut.first()["t"]
    ranked = [(r["feature"], r["frequency"]) for r in freq.filter("not decoy").orderBy(F.desc("frequency"), "feature").collect()]
    return [f for f, share in ranked if share >= limit][:most] or [ranked[0][0]]


def tuned_fit(train: DataFrame, grid=GRID, k: int = 3, seed=0):
    """ML-03 on training rows, then ML-02 with the winner: ``(score, c, l1_ratio)``."""
    rows = kept(M.vector_rows(train))
    best = M.tune_grid(rows, list(grid), k, seed).first()
    fit = M.fit_logistic(rows, best["c"], best["l1_ratio"])
    return (lambda new: M.vector_rows(new).select("id", "event", M.linear_p(fit).alias("p"))), best["c"], best["l1_ratio"]


def _text_features(long: DataFrame) -> DataFrame:
    return long.select("id", "event", F.col("feature").cast("string").alias("feature"), "value")


def _over_folds(spark, run: Callable[[int], tuple[DataFrame, list]], splits: int, seed) -> tuple[DataFrame, DataFrame]:
    """The summary of EV-20 over the scores of ``run(n)`` and the frequency of its ``(n, feature)``; folds don't depend on each other and run side by side."""
    each = together(spark, [lambda n=n: run(n) for n in range(splits)])
    scores = reduce(DataFrame.unionByName, [one for one, _ in each])
    picks = spark.createDataFrame([pick for _, picks in each for pick in picks], "run int, feature string")
    return oof_summary(kept(scores), seed=seed), A.selection_frequency(picks, "run", "feature")


def nested_selection_cv(long: DataFrame, k: int = 3, repeats: int = 1, reps: int = 4, lambdas: tuple[float, ...] = (0.1,), most: int = 10, seed=0) -> tuple[DataFrame, DataFrame]:
    """ML-12: selection, tuning and fit inside every training fold; the summary of EV-20 and how often each feature was chosen."""
    long = kept(_text_features(long))
    ids = long.select("id", "event").distinct()
    folds = kept(R.repeated_kfold(ids, "id", "event", k, repeats, seed))

    def run(n: int) -> tuple[DataFrame, list]:
        train, test = _split(long, folds.filter((F.col("rep") == n // k) & (F.col("fold") == n % k)))
        panel = select_panel(train, reps, list(lambdas), most, f"{seed}|{n}")
        score, _, _ = tuned_fit(_only(train, panel), seed=f"{seed}|{n}")
        return score(_only(test, panel)).withColumn("fit", F.lit(n)), [(n, f) for f in panel]

    return _over_folds(long.sparkSession, run, k * repeats, seed)


RIDGES = ((0.01, 0.0), (0.1, 0.0), (1.0, 0.0))


def component_ensemble(rows: DataFrame, k: int = 3, bags: int = 1, seed=0, inner: int = 3, rounds: int = 5) -> DataFrame:
    """ML-13: per fold and bag a tuned logistic model, the best ridge, a Firth fit and boosted trees; probabilities averaged, ``id, event, p``.

    A bag is a weight per row - how often it was drawn from the fold's training
    rows - so a row is in one inner fold only, and what judges a fit never trained
    it. Folds, bags, inner folds and grids are fitted together.
    """
    coded = M.nested_codes(rows, k, inner, 1, seed)
    if bags > 1:
        draws = None
        for f in range(k):
            train = coded.filter(F.col("codes")[0] != f)
            for b in range(bags):
                one = R.bootstrap_weights(train, "id", "event", 1, f"{seed}|{f}|{b}").select(F.lit(f * bags + b).alias("rep"), "id", "weight")
                draws = one if draws is None else draws.unionByName(one)
        coded = kept(M.with_weights(coded, draws, k * bags))
    tasks = [(f, b) for f in range(k) for b in range(bags)]
    place = lambda f, b: f * bags + b if bags > 1 else None

    def tuned(grid) -> list[Fit]:
        fits = [Fit(place(f, b), *pair, ((0, f), (1, g))) for f, b in tasks for pair in grid for g in range(inner)]
        won = M.best_trials(replicate_scores(coded, fits, fit_logistic_replicates(coded, fits), held_out=True), tasks, len(grid), inner)
        return [Fit(place(f, b), *grid[i], ((0, f),)) for (f, b), i in zip(tasks, won, strict=True)]

    last = tuned(GRID) + tuned(RIDGES)
    votes = replicate_scores(coded, last, fit_logistic_replicates(coded, last), held_out=True).select("id", "event", "p")
    for f, b in tasks:
        test, train = coded.filter(F.col("codes")[0] == f), coded.filter(F.col("codes")[0] != f)
        times = None
        if bags > 1:
            train, times = train.withColumn("_times", F.get("weights", F.lit(f * bags + b))).filter("_times > 0"), "_times"
        parts = [test.select("id", "event", M.linear_p(fit_firth(train, weight=times)).alias("p")), M.ml_scores(M.fit_boosted(train, rounds, seed=f"{seed}|{f}|{b}", weight=times), test)]
        for part in parts:
            votes = votes.unionByName(part)
    return M.soft_vote(votes)


SWEEP_KEY = ["lambda", "threshold", "model"]
SWEEP = "lambda double, threshold double, model string, features int, auc double"


def config_sweep(long: DataFrame, lambdas: list[float], thresholds: list[float], specs: dict[str, tuple[float, float]], done: DataFrame | None = None, reps: int = 4, k: int = 3, seed=0, store: str | None = None) -> DataFrame:
    """ML-15: out-of-fold AUC of each selection strength, frequency threshold and model, the best first.

    ``done`` (``lambda, threshold, model`` and results) names configurations that
    have a result; they are not run again. With ``store`` each result is committed
    there as it comes, and what is there is taken up, so a sweep that was killed goes
    on behind its last result; all results are returned. A strength's selection is
    shared by its thresholds, a panel's folds by its models.
    """
    long, spark = kept(_text_features(long)), long.sparkSession
    grid = spark.createDataFrame([(float(a), float(t), m) for a in lambdas for t in thresholds for m in specs], "lambda double, threshold double, model string")
    if done is not None:
        grid = open_configurations(grid, done, SWEEP_KEY)
    before = None
    if store:
        before = kept(committed(spark, store, SWEEP))
        grid = open_configurations(grid, before, SWEEP_KEY)
    todo: dict[float, dict[float, list[str]]] = {}
    for r in grid.orderBy("lambda", "threshold", "model").collect():
        todo.setdefault(r["lambda"], {}).setdefault(r["threshold"], []).append(r["model"])
    out = spark.createDataFrame([], SWEEP) if before is None else before
    for strength, by_threshold in todo.items():
        freq = [(r["feature"], r["frequency"]) for r in M.stability_selection(long, reps, [strength], seed)[0].filter("not decoy").orderBy("feature").collect()]
        for threshold, names in by_threshold.items():
            panel = [f for f, share in freq if share >= threshold] or [max(freq, key=lambda x: x[1])[0]]
            result = M.compare_models(kept(M.vector_rows(_only(long, panel))), {n: specs[n] for n in names}, k, seed)
            one = kept(result.select(F.lit(strength).alias("lambda"), F.lit(threshold).alias("threshold"), "model", F.lit(len(panel)).alias("features"), "auc"))
            if store:
                for name in names:
                    commit_result(one.filter(F.col("model") == name), store, configuration_key({"lambda": strength, "threshold": threshold, "model": name}, SWEEP_KEY))
            out = out.unionByName(one)
    return out.orderBy(F.desc("auc"), "lambda", "threshold", "model")


def multi_model_panel(long: DataFrame, panel: list, extra_k: int = 5, frac: float = 0.3, seed=0, families: dict[str, M.ModelSpec] | None = None) -> DataFrame:
    """ML-16: hold-out AUC and Brier score of the registered model families on a frozen panel.

    Families that are not linear also get the ``extra_k`` features after the panel
    by absolute correlation with the event on the training rows.
    """
    long, families = kept(long), families or M.MODELS
    ids = long.select("id", "event").distinct()
    train, test = _split(long, R.stratified_holdout(ids, "id", "event", frac, 1, seed))
    frequency = FS.point_biserial(train).withColumnRenamed("r", "frequency")
    frozen = long.sparkSession.createDataFrame([(f,) for f in panel], f"feature {dict(long.dtypes)['feature']}")
    wider = panel + [r["feature"] for r in O.extend_panel(frequency, frozen, extra_k).collect()]
    # the families read one of two sets of features
    needed = [(linear, part) for linear in {s.linear for s in families.values()} for part in (train, test)]
    made = together(long.sparkSession, [lambda u=panel if linear else wider, p=part: kept(M.vector_rows(_only(p, u))) for linear, part in needed])
    vectors = {linear: made[2 * i : 2 * i + 2] for i, (linear, _) in enumerate(needed[::2])}

    def run(name: str, spec: M.ModelSpec) -> DataFrame:
        fitted, judged = vectors[spec.linear]
        return spec.fit(fitted)(judged).select(F.lit(name).alias("model"), F.lit(len(panel if spec.linear else wider)).alias("features"), "id", "event", "p")

    # the scores of all families are made once and summarised together
    scores = kept(reduce(DataFrame.unionByName, together(long.sparkSession, [lambda n=n, s=s: run(n, s) for n, s in families.items()])))
    out = _with_brier(scores, ["model"]).join(F.broadcast(scores.groupBy("model").agg(F.first("features").alias("features"))), "model")
    return out.select("model", "features", "auc", "brier", "pos", "neg")


def univariate_boosted_cv(long: DataFrame, k: int = 3, repeats: int = 1, panel: int = 7, multiplier: float = 1.0, most: int = 30, group: DataFrame | None = None, seed=0, rounds: int = 400) -> tuple[DataFrame, DataFrame]:
    """ML-18: per fold NZV filter, univariate ranking, the best k by events, L1 shrinkage to the panel and boosted trees.

    Returns the summary of EV-20 over mean out-of-fold scores, and how often
    each feature was in a panel. ``group`` (``id, group``) keeps groups whole;
    repeats then deal them anew by a hashed name. Early stopping ends the trees of a
    fold, ``rounds`` at the latest. A row carries the numbers of the folds that hold it
    out, so the table is written once, however many folds there are.
    """
    long = kept(long)
    ids = kept(long.select("id", "event").distinct())
    if group is None:
        folds = R.repeated_kfold(ids, "id", "event", k, repeats, seed).select("rep", "fold", "id")
    else:
        named, folds = ids.join(group, "id", "left"), None
        for r in range(repeats):
            dealt = R.stratified_group_kfold(named.withColumn("_g", F.concat(F.md5(F.concat(F.lit(f"{seed}|{r}|"), F.col("group").cast("string"))), F.lit("|"), F.col("group").cast("string"))), "_g", "event", k)
            one = named.withColumn("_g", F.coalesce(F.concat(F.md5(F.concat(F.lit(f"{seed}|{r}|"), F.col("group").cast("string"))), F.lit("|"), F.col("group").cast("string")), F.lit("UNKNOWN")))
            one = one.join(dealt.select(F.col("group").alias("_g"), "fold"), "_g").select(F.lit(r).alias("rep"), "fold", "id")
            folds = one if folds is None else folds.unionByName(one)
    held = folds.groupBy("id").agg(F.collect_set((F.col("rep") * k + F.col("fold")).cast("int")).alias("_held"))
    long = kept(long.join(held, "id", "left"))

    def run(n: int) -> tuple[DataFrame, list]:
        out = F.coalesce(F.array_contains("_held", n), F.lit(False))
        train, test = (long.filter(c).drop("_held") for c in (~out, out))
        profile = kept(A.column_profile(train))
        stats = kept(univariate_auc(train, "event").join(FS.point_biserial(train), "feature").join(profile.select("feature", "distinct"), "feature").join(FS.drop_nzv(train, profile=profile), "feature", "left_semi"))
        names = [r["feature"] for r in stats.select("feature").orderBy("feature").collect()]
        events = train.filter("event = 1").select("id").distinct().count()
        top = O.k_by_events(events, panel, multiplier, most, len(names))
        features = [r["feature"] for r in M.l1_shrink(kept(M.vector_rows(_only(train, names))), stats, top, panel).collect()]
        model = M.fit_boosted(kept(M.vector_rows(_only(train, features))), rounds, seed=f"{seed}|{n}")
        return M.ml_scores(model, M.vector_rows(_only(test, features))).withColumn("fit", F.lit(n)), [(n, str(f)) for f in features]

    return _over_folds(long.sparkSession, run, k * repeats, seed)


def temporal_evaluation(long: DataFrame, day: str, frac: float = 0.25, reps: int = 4, lambdas: tuple[float, ...] = (0.1,), most: int = 10, boot: int = 20, ref=None, seed=0) -> DataFrame:
    """EV-21: everything is learned on the oldest rows (``id, event, batch, day, feature, value``) and judged on the newest.

    Harmonisation (by batch, or to the batch ``ref``), prefilter, selection,
    tuning and fit see training rows only. One row: ``auc, low, high``, the
    chosen number of features, date bounds and class counts of both parts.
    """
    ids = kept(long.select("id", "event", day).distinct())
    parts = kept(R.temporal_holdout(ids, "id", day, frac).select("id", "part"))
    joined = kept(long.join(parts, "id"))
    train, test = joined.filter("part = 'train'"), joined.filter("part = 'test'")
    even = (lambda new: H.batch_zscore(train, new)) if ref is None else (lambda new: H.ref_standardize(train, new, ref))
    old, new = (kept(_text_features(even(x))) for x in (train, test))
    filtered, _ = FS.prefilter(old, least_variance=1e-6)
    panel = select_panel(kept(filtered.select("id", "event", "feature", "value")), reps, list(lambdas), most, seed)
    score, _, _ = tuned_fit(_only(old, panel), seed=seed)
    result = bootstrap_auc_interval(kept(score(_only(new, panel))), "event", "p", "id", boot, seed).select("auc", "low", "high")
    about = ids.join(parts, "id").groupBy().pivot("part", ["train", "test"]).agg(
        F.date_format(F.min(day), "yyyy-MM-dd").alias("first"), F.date_format(F.max(day), "yyyy-MM-dd").alias("last"), F.count(F.lit(1)).alias("n"), F.sum("event").alias("events")
    )
    return result.withColumn("features", F.lit(len(panel))).crossJoin(F.broadcast(about))


def domain_evaluation(long: DataFrame, domain: str = "batch", reps: int = 4, lambdas: tuple[float, ...] = (0.1,), most: int = 10, seed=0) -> DataFrame:
    """EV-22: ``part, auc, pos, neg, features``: learned on the dominant domain, judged on it (resubstitution), on all others together and on each."""
    joined = kept(R.domain_holdout(long, domain))
    train = kept(_text_features(joined.filter("part = 'train'")))
    panel = select_panel(train, reps, list(lambdas), most, seed)
    score, _, _ = tuned_fit(_only(train, panel), seed=seed)
    test = joined.filter("part = 'test'")
    scores = kept(score(_only(_text_features(test), panel)).join(test.select("id", domain).distinct(), "id"))
    parts = [auc(score(_only(train, panel)), "event", "p").withColumn("part", F.lit("resubstitution")), auc(scores, "event", "p").withColumn("part", F.lit("pooled"))]
    parts.append(auc(scores, "event", "p", [domain]).withColumn("part", F.concat(F.lit(f"{domain} "), F.col(domain).cast("string"))).drop(domain))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("part", "auc", "pos", "neg", F.lit(len(panel)).alias("features"))
