"""Models, selection, calibration and studies against plain loops, optimum conditions and planted structure."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import scalars as S
from riskloom.operators import calibrate as C
from riskloom.operators import contracts
from riskloom.operators import evaluate as E
from riskloom.operators import harmonize as H
from riskloom.operators import joins as J
from riskloom.operators import models as M
from riskloom.operators import order as O
from riskloom.operators import resample as R
from riskloom.operators import screen as FS
from riskloom.operators import solver as V
from riskloom.operators import studies as ST
from riskloom.streaming import operators as SM

SF = "/root/testdata/sf0.001"


def pair_auc(y, s, w=None):
    y, s, w = np.asarray(y), np.asarray(s), np.ones(len(y)) if w is None else np.asarray(w)
    a, b = s[y == 1][:, None], s[y == 0][None, :]
    ww = w[y == 1][:, None] * w[y == 0][None, :]
    return float((((a > b) + 0.5 * (a == b)) * ww).sum() / ww.sum())


@pytest.fixture(scope="module")
def planted():
    """240 rows, 8 features; f0 and f1 tell the event, f2 follows f0."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 8))
    x[:, 2] = x[:, 0] + 0.05 * rng.normal(size=240)
    y = (rng.random(240) < 1 / (1 + np.exp(-(2.2 * x[:, 0] - 1.6 * x[:, 1])))).astype(int)
    return x, y


@pytest.fixture(scope="module")
def rows(spark, planted):
    x, y = planted
    return spark.createDataFrame([(i, int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))], "id int, event int, features array<double>").persist()


@pytest.fixture(scope="module")
def long(spark, planted):
    x, y = planted
    data = [(i, int(y[i]), i % 3, f"f{j}", float(x[i, j])) for i in range(len(y)) for j in range(x.shape[1])]
    return spark.createDataFrame(data, "id int, event int, batch int, feature string, value double").persist()


@pytest.fixture(scope="module")
def scored(spark, planted):
    x, y = planted
    p = np.round(1 / (1 + np.exp(-x[:, 0])), 2)
    return spark.createDataFrame([(i, int(y[i]), float(p[i]), float(np.round(abs(x[i, 1]) % 1, 1)), i % 4) for i in range(len(y))], "id int, event int, p double, other double, fold int").persist()


def weights_of(scored, reps, seed):
    out = defaultdict(dict)
    for r in R.bootstrap_weights(scored, "id", "event", reps, seed).collect():
        out[r["rep"]][r["id"]] = r["weight"]
    return out


def test_t_quantiles():
    known = {1: 12.7062, 2: 4.3027, 3: 3.1824, 6: 2.4469, 11: 2.2010, 29: 2.0452, 61: 1.9996, 119: 1.9801, 2000: 1.9612}
    for df, want in known.items():
        assert E.t_quantile(0.975, df) == pytest.approx(want, abs=1e-4)


def test_corrected_t(spark):
    v = [0.7, 0.75, 0.8, 0.72]
    r = E.corrected_t_interval(spark.createDataFrame([(x,) for x in v], "v double"), "v", 75, 25).first()
    half = 3.182446 * np.std(v, ddof=1) * math.sqrt(1 / 4 + 1 / 3)
    assert (r["mean"], r["low"], r["high"]) == pytest.approx((np.mean(v), max(0, np.mean(v) - half), min(1, np.mean(v) + half)), abs=1e-5)


def test_group_folds_are_balanced(spark):
    rng = np.random.default_rng(1)
    groups = [(g, int(rng.random() < 0.3)) for g, n in enumerate([200, 90, 80, 60, *rng.integers(1, 20, 60)]) for _ in range(n)]
    df = spark.createDataFrame([(None if g == 7 else f"g{g}", e) for g, e in groups], "g string, event int")
    for greedy in (1000, 10):
        folds = R.stratified_group_kfold(df, "g", "event", 4, greedy)
        assert folds.count() == len({g for g, _ in groups}) and folds.filter("group = 'UNKNOWN'").count() == 1
        sums = folds.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("events").alias("e")).collect()
        assert len(sums) == 4 and sum(r["n"] for r in sums) == len(groups)
        shares = [r["e"] / sum(e for _, e in groups) for r in sums]
        assert max(shares) - min(shares) < (0.12 if greedy > 100 else 0.3)


def test_identifiers_by_decomposition(spark):
    import re
    import unicodedata

    def plain(s):
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
        return "_".join(t for t in re.split("[^a-z0-9]+", s) if t and t not in {"mr", "mrs", "ms", "mme", "mlle", "mle", "dr", "prof", "monsieur", "madame", "m"})

    names = ["Monsieur Šimek", "Łódź Dr. Ångström", "mle  Zoë-Ann", "ﬁn ½ x²", "éclair", "Pr Ñandú", "ｆｕｌｌ width", "ẞ ß", "Ỳ ǅ"]
    got = spark.createDataFrame([(n,) for n in names], "x string").select(S.canonical_id("x", "_")).collect()
    assert [r[0] for r in got] == [plain(n) for n in names]


def test_harmonised_rows_are_not_lost(spark):
    long = spark.createDataFrame([(i, i % 2, f, float(i * f % 7)) for i in range(30) for f in (1, 2)], "id int, batch int, feature int, value double")
    estimates = H.combat_fit(long.filter("feature = 1"), shrink=False)
    with pytest.raises(contracts.ContractError, match="features"):
        H.combat_apply(long, estimates)
    assert H.combat_apply(long, estimates, check=False).count() == 60
    few = long.filter("id < 3 or batch = 0")
    flags = {r["harmonized"] for r in H.harmonize_eligible(few, 3).select("harmonized").collect()}
    assert flags == {False}
    assert H.harmonize_eligible(long, 3).filter("harmonized").count() == 60


def test_interpolation_with_many_points(spark):
    x = np.sort(np.random.default_rng(0).random(200))
    y = np.cumsum(x)
    points = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    q = [0.0, 0.31, 0.99, 1.5, None]
    got = [r["y"] for r in J.interp(spark.createDataFrame([(v,) for v in q], "q double").coalesce(1), "q", points).collect()]
    assert got[:4] == pytest.approx(np.interp(q[:4], x, y)) and got[4] is None
    with pytest.raises(contracts.ContractError):
        J.pairs(spark.range(J.GRID_ROWS + 1), "id")


def test_numbered_by_ranges(spark):
    rng = np.random.default_rng(2)
    data = [(int(rng.integers(0, 3)), int(i)) for i in rng.permutation(500)]
    for tie in ("n", "s"):
        df = spark.createDataFrame([(d, n, f"{n:05d}") for d, n in data], "d int, n int, s string")
        got = [r["n"] for r in O.numbered(df, "d", tie).orderBy("position").collect()]
        assert got == [n for _, n in sorted(data)]


def test_adaptive_bins(spark, scored):
    got = defaultdict(list)
    for r in O.adaptive_bins(scored, "event", "p", "fold", 15, 6).orderBy("fold", "bin").collect():
        got[r["fold"]].append((r["n"], r["events"], r["low"], r["high"]))
    for fold in range(4):
        counts = defaultdict(lambda: [0, 0])
        for r in scored.filter(F.col("fold") == fold).collect():
            counts[r["p"]][0] += 1
            counts[r["p"]][1] += r["event"]
        want, n, e, low = [], 0, 0, None
        for s in sorted(counts):
            low = s if low is None else low
            n, e = n + counts[s][0], e + counts[s][1]
            if n >= 15 or e >= 6:
                want.append((n, e, low, s))
                n, e, low = 0, 0, None
        if n:
            want.append((n, e, low, s))
        assert got[fold] == want


def test_replicate_statistics(spark, scored):
    data = scored.orderBy("id").collect()
    y, p, o = (np.array([r[c] for r in data]) for c in ("event", "p", "other"))
    reps = weights_of(scored, 6, "b")
    w = [np.array([reps[r][i] for i in range(len(y))]) for r in range(6)]
    d = [pair_auc(y, p, x) - pair_auc(y, o, x) for x in w]
    got = E.paired_auc_delta(scored, "event", "p", "other", "id", 6, "b").first()
    assert (got["low"], got["high"], got["delta"]) == pytest.approx((*np.percentile(d, [2.5, 97.5]), pair_auc(y, p) - pair_auc(y, o)))
    cuts = {(r["rep"], r["mode"]): r for r in E.oob_cutpoints(scored, "event", "p", "id", 6, "b").collect()}
    for r in range(6):
        best = None
        for t in sorted({0.0, 1.0, *p[w[r] > 0].tolist()}):
            hit = p >= t
            tp, fp, fn, tn = ((w[r] * m).sum() for m in ((y == 1) & hit, (y == 0) & hit, (y == 1) & ~hit, (y == 0) & ~hit))
            sens, spec, product = tp / (tp + fn), tn / (tn + fp), (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
            mcc = (tp * tn - fp * fn) / math.sqrt(product) if product else 0.0
            key = (sens >= 0.9, round(mcc, 12), round((sens + spec) / 2, 12), round(sens, 12), -round(abs(t - 0.5), 12), -t)
            best = max(best, (key, t)) if best else (key, t)
        got = cuts[r, "rule_out"]
        out, hit = w[r] == 0, p >= best[1]
        assert got["threshold"] == best[1] and got["sensitivity"] == pytest.approx((out & (y == 1) & hit).sum() / (out & (y == 1)).sum())
    grid = np.arange(21) / 20
    curves = []
    for x in w:
        points = {0.0: 0.0}
        for t in sorted(set(p[x > 0]), reverse=True):
            fpr = (x * ((y == 0) & (p >= t))).sum() / (x * (y == 0)).sum()
            points[fpr] = max(points.get(fpr, 0.0), (x * ((y == 1) & (p >= t))).sum() / (x * (y == 1)).sum())
        curves.append(np.interp(grid, sorted(points), [points[k] for k in sorted(points)]))
    band = {r["g"]: r["median"] for r in E.roc_band(scored, "event", "p", "id", 6, "b", 20).collect()}
    for g in range(1, 21):
        assert band[g] == pytest.approx(float(np.median([c[g] for c in curves])), abs=1e-9)


def test_one_row_evaluation(scored):
    data = scored.collect()
    r = E.evaluate_score(scored, "event", "p").first()
    assert r["auc"] == pytest.approx(pair_auc([x["event"] for x in data], [x["p"] for x in data]))
    assert r["brier"] == pytest.approx(np.mean([(x["p"] - x["event"]) ** 2 for x in data]))


def test_smoothed_intervals(spark):
    v = np.random.default_rng(3).normal(0.7, 0.05, 200)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    drawn = E.smoothed_draws(df, "v").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).first()
    sd = np.std(v, ddof=1)
    assert drawn["n"] >= 10_000 and drawn["m"] == pytest.approx(v.mean(), abs=0.003) and drawn["s"] == pytest.approx(sd * math.sqrt(1 + 200**-0.4), rel=0.03)
    low, high = E.bias_corrected_interval(E.smoothed_draws(df, "v"), "v", float(v.mean()))
    assert low < 0.62 and high > 0.78
    assert E.smoothed_draws(df.limit(5), "v").count() == 5


def test_cross_calibration_and_slopes(spark, scored):
    got = C.cross_calibrate(scored, "event", "p", "fold")
    for fold in range(4):
        a, b = C.fit_sigmoid(scored.filter(F.col("fold") != fold), "event", "p")
        want = S.sigmoid(F.lit(a) + F.lit(b) * S.logit("p"))
        assert got.filter(F.col("fold") == fold).filter(F.abs(F.col("calibrated") - want) > 1e-6).count() == 0
    for r in C.calibration_slope(scored, "event", "p", "fold").collect():
        part = [(x["event"], x["p"]) for x in scored.filter(F.col("fold") == r["fold"]).collect()]
        x = np.array([math.log(max(p, 1e-12) / max(1 - p, 1e-12)) for _, p in part])
        e = np.array([y for y, _ in part]) - 1 / (1 + np.exp(-(r["intercept"] + r["slope"] * x)))
        assert abs(e.sum()) < 1e-3 and abs((e * x).sum()) < 1e-2


def test_reliability_band(spark, scored):
    band = C.reliability_band(scored, "event", "p", "id", 4, "b", 20).orderBy("g").collect()
    means = [r["mean"] for r in band]
    assert len(band) == 21 and all(a <= b + 1e-12 for a, b in zip(means, means[1:])) and 0 <= means[0] <= means[-1] <= 1
    one = C.reliability_band(scored, "event", "p", "id", 1, "b", 20).orderBy("g")
    w = R.bootstrap_weights(scored, "id", "event", 1, "b").select("id", "weight")
    points = C.fit_isotonic(scored.join(w, "id").filter("weight > 0"), "event", "p", "weight")
    want = J.interp(one.select("g"), "g", points).orderBy("g").collect()
    assert [r["mean"] for r in one.collect()] == pytest.approx([r["y"] for r in want], abs=1e-9)


def fold_fit(rows, folds, f, c, l1):
    train = rows.join(folds.filter(F.col("fold") != f).select("id"), "id", "left_semi")
    fit = M.fit_logistic(train, c, l1)
    return {r["id"]: (r["event"], r["p"]) for r in rows.join(folds.filter(F.col("fold") == f).select("id"), "id", "left_semi").select("id", "event", M.linear_p(fit).alias("p")).collect()}


def test_out_of_fold_and_tuning(spark, rows):
    folds = R.stratified_kfold(rows, "id", "event", 3, "t").persist()
    want = [fold_fit(rows, folds, f, 0.3, 0.5) for f in range(3)]
    got = {r["id"]: r["p"] for r in M.oof_predictions(rows, 3, 0.3, 0.5, "t").collect()}
    assert len(got) == 240
    for part in want:
        assert [got[i] for i in part] == pytest.approx([p for _, p in part.values()], abs=1e-6)
    mean = np.mean([pair_auc([y for y, _ in part.values()], [p for _, p in part.values()]) for part in want])
    trials = M.tune_grid(rows, [(0.001, 1.0), (0.3, 0.5)], 3, "t").collect()
    assert trials[0]["trial"] == 1 and trials[0]["auc"] == pytest.approx(mean) and trials[1]["auc"] == pytest.approx(0.5, abs=0.2)
    every = [x for part in want for x in part.values()]
    two = {r["model"]: r["auc"] for r in M.compare_models(rows, {"a": (0.3, 0.5), "b": (1.0, 0.0)}, 3, "t").collect()}
    assert two["a"] == pytest.approx(pair_auc([y for y, _ in every], [p for _, p in every]), abs=1e-6) and two.keys() == {"a", "b"}
    grid = M.random_trials(20, "r")
    assert len(set(grid)) == 20 and all(1e-3 <= c <= 1e3 and 0 <= r <= 1 for c, r in grid)


def test_missing_values_count_as_the_training_mean(spark):
    x = [1.0, 2.0, None, 4.0, 6.0, None, 3.0, 5.0]
    y = [0, 0, 0, 1, 1, 1, 0, 1]
    mean = np.mean([v for v in x if v is not None])
    make = lambda v: spark.createDataFrame([(i, b, [a]) for i, (a, b) in enumerate(zip(v, y))], "id int, event int, features array<double>")
    a, b = M.fit_logistic(make(x)), M.fit_logistic(make([float(mean) if v is None else v for v in x]))
    assert a["mean"][0] == pytest.approx(mean) and a["coef"][0] * b["sd"][0] / a["sd"][0] == pytest.approx(b["coef"][0], rel=0.2)


def test_resampled_evaluation(spark, rows):
    got = {r["rep"]: r for r in M.evaluate_resampled(rows, 4, 1.0, 0.0, "e").collect()}
    reps = weights_of(rows, 4, "e")
    data = {r["id"]: r for r in rows.collect()}
    for r in range(4):
        bag = spark.createDataFrame([(i, data[i]["event"], data[i]["features"], [float(w)]) for i, w in reps[r].items()], "id int, event int, features array<double>, weights array<double>")
        fit = V.fit_logistic_replicates(bag, [V.Fit(0)])[0]
        p = {x["id"]: x["p"] for x in rows.select("id", M.linear_p(fit).alias("p")).collect()}
        out = [i for i, w in reps[r].items() if not w]
        oob = pair_auc([data[i]["event"] for i in out], [p[i] for i in out])
        assert got[r]["oob"] == pytest.approx(oob, abs=1e-6) and got[r]["n_oob"] == len(out) and min(oob, got[r]["in_bag"]) - 1e-9 <= got[r]["auc_632plus"] <= max(oob, got[r]["in_bag"]) + 1e-9


def test_model_families(spark, long):
    got = {r["model"]: r for r in ST.multi_model_panel(long, ["f0", "f1"], 2, 0.3, "p").collect()}
    assert got.keys() == set(M.MODELS) and all(r["auc"] > 0.75 and r["brier"] < 0.25 for r in got.values())
    assert {r["features"] for r in got.values()} == {2, 4}
    with pytest.raises(ValueError, match="twice"):
        M.register_model(M.MODELS["ridge"])


def test_selection(spark, rows, long, planted):
    freq, cut = M.stability_selection(long, 6, [0.1], "s")
    share = {r["feature"]: r["frequency"] for r in freq.collect()}
    assert len(share) == 16 and share["f1"] == 1.0 and share["f0"] + share["f2"] >= 0.9 and max(s for f, s in share.items() if f not in ("f0", "f1", "f2")) < 0.9 and 0.1 <= cut.first()["t"] <= 1.0
    stats = E.univariate_auc(long, "event").join(FS.point_biserial(long), "feature").join(FS.column_profile(long).select("feature", "distinct"), "feature")
    panel = [(r["feature"], r["coef"]) for r in M.l1_shrink(rows, stats, 5, 4, 0.02).collect()]
    assert len(panel) == 4 and {f for f, _ in panel[:2]} <= {"f0", "f1", "f2"} and all(abs(a) >= abs(b) for (_, a), (_, b) in zip(panel, panel[1:]) if b)
    groups = defaultdict(set)
    for r in FS.correlation_groups(FS.spearman_matrix(long), 0.9).collect():
        groups[r["group"]].add(r["feature"])
    assert dict(groups) == {"f0": {"f0", "f2"}}
    x, y = planted
    wide = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x[:, :3], y)], "a double, b double, c double, event int")
    z, t = (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0), y - y.mean()
    for lam in (0.1, 0.01):
        b = np.array([r["coef"] for r in FS.lasso_path(wide, ["a", "b", "c"], "event", [0.1, 0.01]).filter(F.col("lambda") == lam).orderBy("feature").collect()])
        g = z.T @ (t - z @ b) / len(y)
        assert all(abs(gj - lam * np.sign(bj)) < 1e-6 if bj else abs(gj) <= lam + 1e-6 for gj, bj in zip(g, b))


def test_spearman_equals_pairs(spark, long, planted):
    x, _ = planted
    rank = np.argsort(np.argsort(x, axis=0), axis=0).astype(float)
    want = np.abs(np.corrcoef(rank.T))
    for r in FS.spearman_matrix(long).collect():
        assert r["r"] == pytest.approx(want[int(r["a"][1:]), int(r["b"][1:])], abs=1e-9)


def test_decoys(spark, long, planted):
    x, y = planted
    permuted = FS.decoy_features(long, "d").persist()
    for j in range(8):
        assert sorted(r["value"] for r in permuted.filter(F.col("feature") == f"decoy_f{j}").collect()) == pytest.approx(sorted(x[:, j]))
    rng = np.random.default_rng(7)
    big = rng.normal(size=(3000, 3))
    big[:, 1] = 0.6 * big[:, 0] + 0.8 * big[:, 1]
    rows = spark.createDataFrame([(i, 0, f"f{j}", float(2 * big[i, j] + j)) for i in range(3000) for j in range(3)], "id int, event int, feature string, value double")
    made = FS.knockoff_features(rows, "k").groupBy("id").pivot("feature").agg(F.first("value")).orderBy("id").toPandas().drop(columns="id").to_numpy()
    cov, cross = np.cov(made.T), np.cov(2 * big.T, made.T)[:3, 3:]
    assert np.allclose(cov, np.cov(2 * big.T), atol=0.35) and np.allclose(made.mean(0), (2 * big + np.arange(3)).mean(0), atol=0.15)
    off = ~np.eye(3, dtype=bool)
    assert np.allclose(cross[off], np.cov(2 * big.T)[off], atol=0.35) and (np.diag(cross) < 0.7 * np.diag(np.cov(2 * big.T))).all()


def test_cross_validation_studies(spark, rows, planted):
    one = ST.repeated_cv_evaluation(rows, 3, 2, boot=8, seed="r").first()
    assert one["valid"] == 6 and 0.8 < one["mean"] < 1 and one["low"] <= one["median"] <= one["high"] and one["pooled_low"] <= one["pooled_auc"] + 0.02
    mc = ST.monte_carlo_cv(rows, 5, seed="m").first()
    assert mc["valid"] == 5 and 0.8 < mc["mean"] < 1 and 0 < mc["mean_brier"] < 0.2
    boot = ST.simple_bootstrap(rows, 5, seed="b").first()
    assert boot["valid"] == 5 and 0.8 < boot["mean"] < 1
    out = ST.leave_out_evaluation(rows.withColumn("g", F.col("id") % 5), "g", boot=8, seed="l").first()
    assert out["folds"] == 5 and 0.8 < out["auc"] < 1 and out["low"] < out["auc"] < out["high"]
    shuffled = rows.select("id", (F.crc32(F.col("id").cast("string")) % 2).cast("int").alias("event"), "features").persist()
    assert ST.repeated_cv_evaluation(shuffled, 3, 1, boot=4, seed="r").first()["mean"] < 0.65
    each, consensus = ST.validation_suite(rows, {"a": lambda r: spark.createDataFrame([(0.8,)], "mean double"), "b": lambda r: spark.createDataFrame([(0.6,)], "auc double")})
    assert {tuple(r) for r in each.collect()} == {("a", 0.8), ("b", 0.6)} and consensus.first()["median"] == pytest.approx(0.7)


def test_nested_selection(spark, long):
    noise = long.withColumn("event", (F.crc32(F.col("id").cast("string")) % 2).cast("int")).persist()
    summary, frequency = ST.nested_selection_cv(noise, 2, reps=2, most=3, seed="n")
    # choosing on the test rows too would lift this well above chance
    assert summary.first()["pooled_auc"] < 0.66 and summary.first()["valid"] == 2
    assert all(r["times"] <= 2 and r["frequency"] == r["times"] / 2 for r in frequency.collect())


def test_sweep_resumes(spark, long):
    specs = {"ridge": (1.0, 0.0), "lasso": (0.5, 1.0)}
    full = ST.config_sweep(long, [0.1], [0.5, 0.9], specs, reps=2, k=2, seed="s").persist()
    assert full.count() == 4 and full.first()["auc"] == full.agg(F.max("auc")).first()[0]
    rest = ST.config_sweep(long, [0.1], [0.5, 0.9], specs, full.filter("model = 'ridge'"), reps=2, k=2, seed="s")
    key = lambda d: {(r["threshold"], r["model"]): round(r["auc"], 9) for r in d.collect()}
    assert key(rest) == {k: v for k, v in key(full).items() if k[1] == "lasso"}


def test_ensemble_and_boosted_study(spark, rows, long):
    votes = ST.component_ensemble(rows, 2, seed="c").persist()
    assert votes.count() == 240 and votes.select("id").distinct().count() == 240
    assert E.auc(votes, "event", "p").first()["auc"] > 0.8
    group = long.select("id", (F.col("id") % 12).alias("group")).distinct()
    summary, frequency = ST.univariate_boosted_cv(long, 2, 1, panel=3, group=group, seed="u")
    assert summary.first()["pooled_auc"] > 0.7 and frequency.filter("frequency = 1").count() >= 1


def test_evaluation_elsewhere(spark, long):
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id"))
    r = ST.temporal_evaluation(long.withColumn("day", day), "day", 0.25, reps=2, boot=6, seed="t").first()
    assert r["train_last"] < r["test_first"] and (r["train_n"], r["test_n"]) == (180, 60) and 0.7 < r["auc"] <= 1 and r["low"] <= r["high"]
    parts = {x["part"]: x for x in ST.domain_evaluation(long.filter("batch < 2 or id % 2 = 0"), reps=2, seed="d").collect()}
    assert parts.keys() == {"resubstitution", "pooled", "batch 1", "batch 2"} and parts["pooled"]["auc"] > 0.7
    assert parts["pooled"]["pos"] == parts["batch 1"]["pos"] + parts["batch 2"]["pos"]


def test_more_streams_equal_their_batch_twins(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = lambda: SM.read_stream(spark, str(tmp_path / "in"), events.schema)

    def in_memory(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    got = in_memory(SM.latest_state(stream(), ["user_id"], "ts", "value"), "states", "complete")
    want = SM.latest_state(events, ["user_id"], "ts", "value")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    p = events.withColumn("p", F.col("value") / (F.col("value") + 5))
    windows = in_memory(SM.monitor_window(stream().withColumn("p", F.col("value") / (F.col("value") + 5)), "ts", "1 day", "p", 0.3, 0.6, "3650 days"), "windows", "complete")
    flat = lambda d: sorted((str(r["start"]), r["n"], round(r["mean_risk"], 9)) for r in d.collect())
    assert flat(windows) == flat(SM.monitor_window(p, "ts", "1 day", "p", 0.3, 0.6))
    once = in_memory(SM.dedup_stream(stream(), "user_id", "ts", "3650 days"), "once", "append")
    assert {r["user_id"] for r in once.collect()} == {r["user_id"] for r in events.select("user_id").distinct().collect()} and once.count() == events.select("user_id").distinct().count()
