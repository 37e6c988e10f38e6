"""Fits that share passes, pools and bins in parallel, and comparisons of many scores, against plain loops."""

import itertools
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import calibrate as C
from riskloom.operators import contracts
from riskloom.operators import evaluate as E
from riskloom.operators import models as M
from riskloom.operators import order as O
from riskloom.operators import resample as R
from riskloom.operators import screen as FS
from riskloom.operators import solver as V
from riskloom.operators import studies as ST
from riskloom.operators.permute import key_of, permuted


def pair_auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    a, b = s[y == 1][:, None], s[y == 0][None, :]
    return float(((a > b) + 0.5 * (a == b)).mean())


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 5))
    y = (rng.random(240) < 1 / (1 + np.exp(-(1.8 * x[:, 0] - 1.2 * x[:, 1])))).astype(int)
    return x, y


def table(spark, x, y):
    return spark.createDataFrame([(i, int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))], "id int, event int, features array<double>").repartition(3).persist()


@pytest.fixture(scope="module")
def rows(spark, planted):
    return table(spark, *planted)


def ridge(x, y, c, w=None):
    """A weighted ridge fit by Newton steps on standardised columns; gives a function of probabilities."""
    w = np.ones(len(y)) if w is None else np.asarray(w, float)
    mean = (w @ x) / w.sum()
    sd = np.sqrt((w @ x**2) / w.sum() - mean**2)
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    b, penalty = np.zeros(z.shape[1]), np.diag([0.0] + [1 / c] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (w * (y - p)) - penalty @ b)
    return lambda new: 1 / (1 + np.exp(-np.column_stack([np.ones(len(new)), (new - mean) / sd]) @ b))


# permuted labels


def test_permutation_refit_equals_plain_loops(spark, rows, planted):
    x, y = planted
    numbered, n, events = M.numbered_by_class(rows, "s")
    number = np.array([r["number"] for r in numbered.select("id", "number").orderBy("id").collect()])
    assert sorted(number) == list(range(n)) and set(number[y == 1]) == set(range(events))
    aucs = []
    for r in range(5):
        place = permuted(number, n, key_of("s", r) or 1) if r else number
        label = (place < events).astype(int)
        out = np.where(label == 1, place, place - events) < np.where(label == 1, round(0.2 * events), round(0.2 * (n - events)))
        assert label.sum() == events
        aucs.append(pair_auc(label[out], ridge(x[~out], label[~out], 1.0)(x[out])))
    got = M.permutation_refit(rows, 4, seed="s").first()
    assert got["observed"] == pytest.approx(aucs[0], abs=1e-9) and got["null_mean"] == pytest.approx(np.mean(aucs[1:]), abs=1e-6)
    assert got["p"] == pytest.approx((sum(a >= aucs[0] for a in aucs[1:]) + 1) / 5) and got["valid"] == 4


def test_permutation_refit_tells_noise_from_signal(spark, rows):
    rng = np.random.default_rng(1)
    noise = table(spark, rng.normal(size=(160, 3)), rng.integers(0, 2, 160))
    ps = [M.permutation_refit(noise, 39, seed=s).first()["p"] for s in range(3)]
    assert M.permutation_refit(rows, 39, seed="a").first()["p"] == pytest.approx(1 / 40) and max(ps) > 0.05
    assert M.permutation_refit(rows, 39, seed="a", method="share").first()["p"] == 0


def test_repeated_ids_are_refused(rows):
    with pytest.raises(contracts.ContractError):
        M.fold_rows(rows.union(rows.filter("id < 3")), 3)


# nested folds


def test_nested_tuning_equals_plain_loops(rows, planted):
    x, y = planted
    grid, k, inner = [(0.001, 0.0), (1.0, 0.0)], 3, 2
    codes = {r["id"]: r["codes"] for r in M.nested_codes(rows, k, inner, 2, "n").collect()}
    assert {len(c) for c in codes.values()} == {4}
    codes = np.array([codes[i] for i in range(len(y))])
    got = defaultdict(dict)
    for r in M.nested_oof_predictions(rows, k, grid, inner, 2, "n").collect():
        got[r["rep"], r["fold"], r["c"]][r["id"]] = r["p"]
    assert len(got) == 6
    for (rep, fold, c), scores in got.items():
        train = codes[:, 2 * rep] != fold
        means = []
        for gc, _ in grid:
            aucs = []
            for g in range(inner):
                fit, val = train & (codes[:, 2 * rep + 1] != g), train & (codes[:, 2 * rep + 1] == g)
                aucs.append(pair_auc(y[val], ridge(x[fit], y[fit], gc)(x[val])))
            means.append(np.mean(aucs))
        assert c == grid[int(np.argmax(means))][0]
        want = ridge(x[train], y[train], c)(x[~train])
        assert [scores[i] for i in np.flatnonzero(~train).tolist()] == pytest.approx(want, abs=1e-5)


def test_repeated_cv_with_inner_tuning(rows):
    r = ST.repeated_cv_evaluation(rows, 3, 1, boot=3, seed="x", grid=[(0.01, 0.0), (1.0, 0.0)], inner=2).first()
    assert 0.7 < r["pooled_auc"] <= 1 and r["valid"] == 3


def test_leave_one_row_out_equals_refits(spark, planted):
    x, y = planted[0][:40], planted[1][:40]
    few = table(spark, x, y).withColumn("unit", F.concat(F.lit("u"), F.col("id").cast("string")))
    got = ST.leave_out_evaluation(few, "unit", boot=2, seed="l").first()
    p = [ridge(np.delete(x, i, 0), np.delete(y, i), 1.0)(x[i : i + 1])[0] for i in range(40)]
    assert got["folds"] == 40 and got["auc"] == pytest.approx(pair_auc(y, p), abs=1e-9) and got["brier"] == pytest.approx(np.mean((np.array(p) - y) ** 2), abs=1e-6)


def test_place_in_order(spark):
    names = [f"g{i:04d}" for i in np.random.default_rng(0).permutation(500)]
    got = O.place_in_order(spark.createDataFrame([(n,) for n in names], "g string").repartition(5), ["g"], "place").collect()
    assert {r["g"]: r["place"] for r in got} == {n: i for i, n in enumerate(sorted(names))}


# masks, groups and runs


def test_masked_fits_see_their_features_only(rows, planted):
    x, y = planted
    weighted = rows.withColumn("weights", F.array(F.lit(1.0)))
    a, b = V.fit_logistic_replicates(weighted, [V.Fit(0, mask=(1, 3)), V.Fit(0)])
    assert a["coef"][[0, 2, 4]].tolist() == [0, 0, 0]
    got = 1 / (1 + np.exp(-(a["intercept"] + ((x - a["mean"]) / a["sd"]) @ a["coef"])))
    assert got == pytest.approx(ridge(x[:, [1, 3]], y, 1.0)(x[:, [1, 3]]), abs=1e-5) and np.abs(b["coef"]).min() > 0


@pytest.fixture(scope="module")
def long(spark, planted):
    x, y = planted
    x = np.column_stack([x, x[:, 0] + 0.01 * np.random.default_rng(9).normal(size=len(x))])
    return spark.createDataFrame([(i, int(y[i]), f"f{j}", float(x[i, j])) for i in range(len(y)) for j in range(6)], "id int, event int, feature string, value double").persist()


def test_planted_copies_share_a_group(long):
    names, r = FS.rank_correlations(long)
    groups = FS.correlated_groups(names, r, 93)
    assert groups["f0"] == ["f0", "f5"] and sum(map(len, groups.values())) == 6
    for rep in range(20):
        mask = M.group_masks(names, groups, rep, "m")
        assert len(mask) == len(groups) and len({0, 5} & set(mask)) == 1
    assert len({M.group_masks(names, groups, rep, "m") for rep in range(20)}) == 2


def test_stability_with_groups_and_runs(long):
    freq, cut = M.stability_selection(long, 6, [0.2], "g", group_percentile=98)
    share = {r["feature"]: r["frequency"] for r in freq.collect()}
    # either of the copies is seen in a subsample, never both
    assert share["f0"] + share["f5"] <= 1 + 1e-9 and share["f1"] == 1.0 and cut.count() == 1
    hard = M.stability_selection(long, 4, [0.2], "g", l1_ratio=0.5, hard=0.7)[1].first()
    assert hard["t"] == 0.7 and hard["real"] >= 2
    chosen, cuts = M.stability_runs(long, 2, 4, [0.2], seed="r", hard=0.75)
    got = {r["feature"]: (r["times"], r["frequency"], r["chosen"]) for r in chosen.collect()}
    assert len(got) == 6 and got["f1"] == (2, 1.0, True) and [r["run"] for r in cuts.orderBy("run").collect()] == [0, 1]


# ensembles of bags


def test_bags_are_weights(rows, planted):
    x, y = planted
    scores = {r["id"]: r["p"] for r in ST.component_ensemble(rows, 2, 3, "b", inner=2, rounds=1).collect()}
    assert sorted(scores) == list(range(240)) and pair_auc(y, [scores[i] for i in range(240)]) > 0.7
    coded = M.nested_codes(rows, 2, 2, 1, "b")
    train = coded.filter(F.col("codes")[0] != 0)
    drawn = {r["id"]: r["weight"] for r in R.bootstrap_weights(train, "id", "event", 1, "b|0|0").collect()}
    w = np.array([drawn.get(i, 0) for i in range(240)], float)
    weighted = M.with_weights(coded, R.bootstrap_weights(train, "id", "event", 1, "b|0|0").select(F.lit(0).alias("rep"), "id", "weight"), 1)
    fit = V.fit_logistic_replicates(weighted, [V.Fit(0, 1.0, 0.0, ((1, 1),))])[0]
    code = np.array([r["codes"][1] for r in coded.orderBy("id").collect()])
    used = (w > 0) & (code != 1)
    want = ridge(x[used], y[used], 1.0, w[used])(x)
    assert 1 / (1 + np.exp(-(fit["intercept"] + ((x - fit["mean"]) / fit["sd"]) @ fit["coef"]))) == pytest.approx(want, abs=1e-5)


def test_forest_depths_and_margins(rows):
    got = M.tune_forest(rows, [1, 3], 5, 2).collect()
    assert {r["depth"] for r in got} == {1, 3} and got[0]["auc"] >= got[1]["auc"] > 0.5
    a, b = M.fit_platt(rows, 2)
    assert b > 0 and abs(a) < 3


def test_model_table_round_trip(spark, rows):
    fit = M.fit_logistic(rows)
    names, back = V.model_from_table(V.model_table(spark, "m", list("abcde"), fit), "m")
    assert names == list("abcde") and back["intercept"] == fit["intercept"] and all(np.array_equal(back[c], fit[c]) for c in ("coef", "mean", "sd"))
    with pytest.raises(ValueError):
        V.model_from_table(V.model_table(spark, "m", list("abcde"), fit).filter("term <> '(intercept)'"))


# pools and bins


def pools_of(pairs):
    """Pools by plain loops over ``x: (pos, n)``."""
    out = []
    for x in sorted(pairs):
        pos, n = pairs[x]
        out.append([x, x, pos, n])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            a, b = out[-2], out.pop()
            out[-1] = [a[0], b[1], a[2] + b[2], a[3] + b[3]]
    return out


def curve_of(pairs, at):
    found = pools_of(pairs)
    return np.interp(at, [v for q in found for v in q[:2]], [q[2] / q[3] for q in found for _ in (0, 1)])


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_pools_equal_plain_loops(spark, ranges):
    rng = np.random.default_rng(ranges)
    groups = {
        0: {round(float(x), 3): (int(rng.integers(0, 2)), 1) for x in rng.random(300)},
        1: {float(x): (int(n * min(1, x / 50 + 0.1 * rng.random())), int(n)) for x, n in zip(range(60), rng.integers(1, 9, 60))},
        2: {float(x): (0, 2) for x in range(9)}, 3: {float(x): (int(x > 4), 1) for x in range(9)}, 4: {1.0: (1, 3)}, 5: {float(x): (int(x < 4), 1) for x in range(9)},
    }
    counts = spark.createDataFrame([(g, x, float(p), float(n)) for g, c in groups.items() for x, (p, n) in c.items()], "g int, x double, pos double, n double").repartition(4)
    pools, bounds = C.isotonic_curves(counts, ["g"], ranges)
    got = defaultdict(list)
    for r in pools.orderBy("g", "low").collect():
        got[r["g"]].append([r["low"], r["high"], r["y"], r["n"]])
    for g, c in groups.items():
        want = [[a, b, p / n, n] for a, b, p, n in pools_of(c)]
        assert np.allclose(got[g], want), g
    at = [-1.0, 0.0, 0.123, 0.5, 0.999, 3.5, 4.0, 20.3, 99.0]
    asked = spark.createDataFrame([(g, x) for g in groups for x in at], "g int, x double")
    values = {(r["g"], r["x"]): r["v"] for r in C.evaluate_curves(asked, "x", pools, bounds, ["g"], "v").collect()}
    for g, c in groups.items():
        assert [values[g, x] for x in at] == pytest.approx(curve_of(c, at), abs=1e-12)
    if ranges == 64:
        # the stretches of a long curve are many
        assert pools.filter("g = 1").select("stretch").distinct().count() > 5


@pytest.mark.parametrize("ranges", [1, 64])
def test_isotonic_cross_calibration(spark, ranges):
    rng = np.random.default_rng(3)
    data = [(i, int(rng.random() < p), float(p), [0, 1, 2, None][int(rng.integers(4))]) for i, p in enumerate(np.round(rng.random(300), 2))]
    data += [(1000 + i, 1, 0.5, 9) for i in range(2)] + [(2000, 1, None, 1)]
    df = spark.createDataFrame(data, "id int, event int, p double, fold int")
    got = {r["id"]: r["calibrated"] for r in C.cross_calibrate(df, "event", "p", "fold", "isotonic", ranges).collect()}
    assert len(got) == len(data) and got[2000] is None
    for fold in (0, 1, 2, None, 9):
        rest = defaultdict(lambda: (0, 0))
        for _, y, p, f in data:
            if f != fold and p is not None:
                rest[p] = (rest[p][0] + y, rest[p][1] + 1)
        held = [(i, p) for i, _, p, f in data if f == fold and p is not None]
        assert [got[i] for i, _ in held] == pytest.approx(curve_of(rest, [p for _, p in held]), abs=1e-9)
    with pytest.raises(ValueError):
        C.cross_calibrate(df, "event", "p", "fold", "other")


def test_cross_calibration_of_one_class(spark):
    df = spark.createDataFrame([(i, int(i < 5), i / 10, int(i >= 5)) for i in range(10)], "id int, event int, p double, fold int")
    for method in ("sigmoid", "isotonic"):
        assert C.cross_calibrate(df, "event", "p", "fold", method).filter("calibrated <> p").count() == 0


def bins_of(counts, min_n, min_events):
    out, n, e, low = [], 0, 0, None
    for s in sorted(counts):
        low = s if low is None else low
        n, e = n + counts[s][1], e + counts[s][0]
        if n >= min_n or e >= min_events:
            out.append((n, e, low, s))
            n, e, low = 0, 0, None
    return out + ([(n, e, low, s)] if n else [])


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_bins_do_not_depend_on_ranges(spark, ranges):
    rng = np.random.default_rng(4)
    data = [(int(m), float(round(s, 3)), int(rng.random() < 0.1)) for m, s in zip(rng.integers(0, 3, 900), rng.random(900))] + [(7, 0.5, 1)]
    got = defaultdict(list)
    for r in O.adaptive_bins(spark.createDataFrame(data, "m int, s double, y int").repartition(3), "y", "s", "m", ranges=ranges).orderBy("m", "bin").collect():
        got[r["m"]].append((r["n"], r["events"], r["low"], r["high"]))
    for m in (0, 1, 2, 7):
        counts = defaultdict(lambda: (0, 0))
        for k, s, y in data:
            if k == m:
                counts[s] = (counts[s][0] + y, counts[s][1] + 1)
        assert got[m] == bins_of(counts, 35, 3)


def test_bin_maps_follow_the_walk():
    rng = np.random.default_rng(6)
    n, e = rng.integers(1, 5, 80), rng.integers(0, 2, 80)
    cuts = [0, 1, 33, 33, 80]
    maps = [O.bin_map(n[a:b], e[a:b], 7, 3) for a, b in itertools.pairwise(cuts)]
    for start in itertools.product(range(7), range(3)):
        (r, v), closed, state, total = start, 0, start, 0
        for m, (low, high) in zip(maps, itertools.pairwise(cuts)):
            for a, b in zip(n[low:high], e[low:high]):
                r, v = r + a, v + b
                if r >= 7 or v >= 3:
                    r, v, closed = 0, 0, closed + 1
            state, more = O.walk_from(state, m, 7)
            total += more
            assert (state, total) == ((r, v), closed)


# many scores


def test_delong_of_many_scores(spark, planted):
    x, y = planted
    s = np.round(x[:, :3], 1)
    df = spark.createDataFrame([(int(b), *map(float, a)) for a, b in zip(s, y)] + [(None, 0.0, 0.0, 0.0), (1, None, 0.0, 0.0)], "y int, a double, b double, c double").repartition(3)
    beat = lambda u, others: np.array([np.mean((v > others) + 0.5 * (v == others)) for v in u])
    v1 = np.array([beat(s[y == 1, j], s[y == 0, j]) for j in range(3)])
    v0 = np.array([1 - beat(s[y == 0, j], s[y == 1, j]) for j in range(3)])
    cov = np.cov(v1) / (y == 1).sum() + np.cov(v0) / (y == 0).sum()
    aucs, got = E.delong_covariance(df, "y", ["a", "b", "c"])
    assert aucs == pytest.approx(v1.mean(axis=1)) and np.allclose(got, cov)
    pairs = {(r["a"], r["b"]): r for r in E.delong_pairs(df, "y", ["a", "b", "c"]).collect()}
    for (i, a), (j, b) in itertools.combinations(enumerate("abc"), 2):
        z = (aucs[i] - aucs[j]) / np.sqrt(cov[i, i] + cov[j, j] - 2 * cov[i, j])
        assert pairs[a, b]["z"] == pytest.approx(z) and pairs[a, b]["delta"] == pytest.approx(aucs[i] - aucs[j])
    same = E.delong_pairs(df.withColumn("d", F.col("a") * 2), "y", ["a", "d"]).first()
    assert same["z"] is None and same["delta"] == pytest.approx(0)
