"""Streams with state and releases, harmonisation, resumed sweeps and one-row evaluations, against plain loops and batch twins."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import scalars as S
from riskloom.operators import contracts
from riskloom.operators import evaluate as E
from riskloom.operators import harmonize as H
from riskloom.operators import joins as J
from riskloom.operators import models as M
from riskloom.operators import order as O
from riskloom.operators import solver as V
from riskloom.operators import studies as ST
from riskloom.sources import tables as T
from riskloom.streaming import operators as SM
from riskloom.streaming import scoring as SC

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def pair_auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    a, b = s[y == 1][:, None], s[y == 0][None, :]
    return float(((a > b) + 0.5 * (a == b)).mean())


# streams


def test_changed_only_forgets_quiet_keys(spark, tmp_path):
    """Three runs over one checkpoint: a key past its TTL emits again, whether its state is still there or its timer has fired."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = "id int, user int, ts timestamp, kind string"
    hour = lambda h: f"2024-01-01 {int(h):02d}:{int(h % 1 * 60):02d}:00"
    runs = [
        [(1, 1, 1, "a"), (2, 1, 1.5, "a"), (3, 1, 2, "b"), (4, 2, 1, "a"), (5, 3, 1, "x")],
        # user 1 goes on within two hours; user 2 comes back after four, the same kind; user 9 moves the watermark
        [(6, 1, 3.5, "b"), (7, 2, 5, "a"), (8, 9, 12, "z")],
        [(9, 1, 13, "b"), (10, 3, 14, "x"), (11, 9, 13.5, "z"), (12, 2, 15, "a"), (13, 2, 15.5, "a")],
    ]
    out, every = str(tmp_path / "out"), []
    for i, rows in enumerate(runs):
        rows = [(a, b, hour(h), k) for a, b, h, k in rows]
        every += rows
        df = spark.createDataFrame(rows, "id int, user int, ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
        SM.run_available(SM.changed_only(stream, "user", ["ts", "id"], ["kind"], "2 hours", "ts", "30 minutes"), out, str(tmp_path / "state"))
    batch = spark.createDataFrame(every, "id int, user int, ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    want = {r["id"] for r in SM.changed_only_batch(batch, "user", ["ts", "id"], ["kind"], "2 hours", "ts").collect()}
    assert {r["id"] for r in spark.read.parquet(out).collect()} == want == {1, 3, 4, 5, 7, 8, 9, 10, 12}


@pytest.fixture(scope="module")
def release(spark):
    rng = np.random.default_rng(4)
    long = spark.createDataFrame([(i, i % 2, f, float(rng.normal(3 * (i % 2), 1 + i % 2))) for i in range(80) for f in ("u", "v")], "id int, batch int, feature string, value double")
    fit = {"intercept": 0.3, "coef": np.array([1.1, -0.7]), "mean": np.array([1.0, 1.5]), "sd": np.array([2.0, 1.2])}
    return V.model_table(spark, "m", ["u", "v"], fit), H.combat_fit(long)


def test_scored_stream_equals_the_parts(spark, tmp_path, release):
    model, estimates = release
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    SC.publish(spark, store, 1, model, estimates, {"type": "sigmoid", "intercept": 0.2, "slope": 0.8}, 0.4, 0.6)
    rows = spark.createDataFrame([(i, [0, 1, 7][i % 3], {"u": i / 5, "v": 2 - i / 9} if i != 4 else {"u": 1.0}) for i in range(12)], "id int, batch int, features map<string,double>")
    rows.coalesce(1).write.parquet(str(tmp_path / "in/0"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in/*"))
    SC.score_stream(stream(), store, out, str(tmp_path / "state"))
    e = {(r["batch"], r["feature"]): r for r in estimates.collect()}
    want = {}
    for r in rows.collect():
        eta, known = 0.3, r["batch"] in (0, 1)
        for f, c, m, s in (("u", 1.1, 1.0, 2.0), ("v", -0.7, 1.5, 1.2)):
            v = r["features"].get(f)
            if v is not None and known:
                q = e[r["batch"], f]
                v = ((v - q["alpha"]) / math.sqrt(q["pooled"]) - q["gamma"]) / math.sqrt(q["delta"]) * math.sqrt(q["pooled"]) + q["alpha"]
            eta = None if v is None or eta is None else eta + c * (v - m) / s
        p = None if eta is None else 1 / (1 + math.exp(-(0.2 + 0.8 * eta)))
        want[r["id"]] = (1, p, None if p is None else "low" if p < 0.4 else "intermediate" if p < 0.6 else "high", not known)
    got = {r["id"]: (r["version"], r["p"], r["risk"], r["unknown_batch"]) for r in spark.read.parquet(out).collect()}
    assert got.keys() == want.keys()
    for i, (version, p, risk, unknown) in want.items():
        assert (got[i][0], got[i][2], got[i][3]) == (version, risk, unknown) and got[i][1] == (None if p is None else pytest.approx(p, abs=1e-9))
    # a batch that runs again replaces itself
    SC.score_batch(rows, 0, store, out)
    assert spark.read.parquet(out).count() == 12
    # what is published meanwhile scores the next batch; a release without settings does not count
    SC.publish(spark, store, 2, model.withColumn("coef", F.lit(0.0)), estimates, {"type": "identity"}, 0.4, 0.6)
    model.write.parquet(f"{store}/model/version=3")
    rows.withColumn("id", F.col("id") + 100).coalesce(1).write.parquet(str(tmp_path / "in/1"))
    SC.score_stream(stream(), store, out, str(tmp_path / "state"))
    later = spark.read.parquet(out).filter("id >= 100").collect()
    assert {r["version"] for r in later} == {2} and {r["p"] for r in later} == {0.5, None} and spark.read.parquet(out).count() == 24


# harmonisation


def kernel_by_loops(values):
    """Non-parametric posterior of location and scale by loops: ``values[batch][feature]`` standardised rows."""
    out = {}
    for b, features in values.items():
        g, d = {f: np.mean(x) for f, x in features.items()}, {f: np.var(x, ddof=1) for f, x in features.items()}
        for f, x in features.items():
            logs = {k: -len(x) / 2 * math.log(2 * math.pi * d[k]) - sum((v - g[k]) ** 2 for v in x) / (2 * d[k]) for k in features if k != f}
            top = max(logs.values())
            w = {k: math.exp(v - top) for k, v in logs.items()}
            out[b, f] = sum(w[k] * g[k] for k in w) / sum(w.values()), sum(w[k] * d[k] for k in w) / sum(w.values())
    return out


@pytest.fixture(scope="module")
def batches(spark):
    rng = np.random.default_rng(12)
    shift, spread = rng.normal(size=(5, 64)), rng.uniform(0.5, 2, (5, 64))
    data = [(f"{b}-{i}", b, f, float(rng.normal(shift[b, f], spread[b, f]))) for b in range(5) for i in range(6 + (4 if b == 3 else 0)) for f in range(64)]
    return data, spark.createDataFrame(data, "id string, batch int, feature int, value double").persist()


def test_non_parametric_shrinkage_equals_loops(batches):
    data, long = batches
    values = defaultdict(lambda: defaultdict(list))
    by_feature = defaultdict(list)
    for _, b, f, v in data:
        values[b][f].append(v)
        by_feature[f].append((b, v))
    alpha = {f: np.mean([v for _, v in x]) for f, x in by_feature.items()}
    pooled = {f: np.mean([(v - np.mean(values[b][f])) ** 2 for b, v in x]) for f, x in by_feature.items()}
    want = kernel_by_loops({b: {f: [(v - alpha[f]) / math.sqrt(pooled[f]) for v in x] for f, x in fs.items()} for b, fs in values.items()})
    got = {(r["batch"], r["feature"]): (r["gamma"], r["delta"]) for r in H.combat_fit(long, parametric=False).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-6, abs=1e-9)


def test_harmonisation_options(batches):
    data, long = batches
    largest = H.combat_fit(long, ref="largest", parametric=False)
    assert largest.filter("batch = 3 and (gamma <> 0 or delta <> 1)").count() == 0
    capped = H.combat_fit(long, cap=0.25)
    assert capped.filter("abs(gamma) > 0.25 or delta > 0.0625 and delta > 16 or delta < 0.0625").count() == 0
    raw, few = H.combat_fit(long, shrink=False), H.combat_fit(long, least_batch=8)
    both = few.join(raw.withColumnsRenamed({"gamma": "g", "delta": "d"}).select("batch", "feature", "g", "d"), ["batch", "feature"])
    assert both.filter("batch <> 3 and abs(gamma - g) > 1e-12").count() == 0 and both.filter("batch = 3 and abs(gamma - g) > 1e-9").count() > 0


def test_missing_values_become_medians(spark, batches):
    _, long = batches
    holes = long.withColumn("value", F.when(F.col("id").isin("1-1", "2-3") & (F.col("feature") == 5), None).otherwise(F.col("value")))
    with pytest.raises(contracts.ContractError):
        H.combat_fit(holes, fill="error")
    estimates = H.combat_fit(holes, fill="median")
    known = [r["value"] for r in holes.filter("feature = 5 and value is not null").collect()]
    assert estimates.filter("feature = 5").first()["median"] == pytest.approx(np.median(known))
    lacking = holes.filter("not (id = '4-2' and feature = 9)")
    done = H.combat_apply(lacking, estimates, fill=True)
    assert done.count() == long.count() and done.filter("value is null").count() == 0
    full = H.combat_apply(long.join(estimates.select("batch", "feature", "median"), ["batch", "feature"]).withColumn("value", F.when((F.col("id") == "4-2") & (F.col("feature") == 9), F.col("median")).otherwise(F.col("value"))).drop("median"), estimates)
    pick = "id = '4-2' and feature = 9"
    assert done.filter(pick).first()["value"] == pytest.approx(full.filter(pick).first()["value"])


# sweeps


def test_killed_sweep_goes_on(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4))
    y = (rng.random(90) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    long = spark.createDataFrame([(i, int(y[i]), f"f{j}", float(x[i, j])) for i in range(90) for j in range(4)], "id int, event int, feature string, value double").persist()
    store, specs, ran = str(tmp_path / "sweep"), {"ridge": (1.0, 0.0)}, []
    plain = M.compare_models

    def compare(rows, names, *rest):
        if len(ran) == 2:
            raise KeyboardInterrupt
        ran.append(sorted(names))
        return plain(rows, names, *rest)

    monkeypatch.setattr(M, "compare_models", compare)
    settings = {"lambdas": [0.05, 0.2], "thresholds": [0.5, 0.75], "specs": specs, "reps": 2, "k": 2, "seed": "s"}
    with pytest.raises(KeyboardInterrupt):
        ST.config_sweep(long, **settings, store=store)
    assert T.committed(spark, store, ST.SWEEP).count() == 2
    # a folder without its mark is of a writer that was killed
    (tmp_path / "sweep" / "configuration=half").mkdir()
    ran.clear()
    resumed = sorted(map(tuple, ST.config_sweep(long, **settings, store=store).collect()))
    assert len(ran) == 2 and len(resumed) == 4
    monkeypatch.setattr(M, "compare_models", plain)
    assert [r[:4] for r in resumed] == [r[:4] for r in sorted(map(tuple, ST.config_sweep(long, **settings).collect()))]
    ran.clear()
    assert ST.config_sweep(long, **settings, store=store).count() == 4 and not ran


# evaluations


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(6)
    p = np.round(rng.random(300), 2)
    y = (rng.random(300) < p).astype(int)
    data = [(i, int(y[i]), float(p[i]), ["a", "b", "c"][i % 3]) for i in range(300)]
    return data, spark.createDataFrame(data, "id int, event int, p double, site string").persist()


def test_one_row_evaluation(scored):
    data, df = scored
    y, p = np.array([r[1] for r in data]), np.array([r[2] for r in data])
    r = E.evaluate_score(df, "event", "p", "id", 8, "e").first()
    assert (r["n"], r["events"]) == (300, y.sum()) and r["auc"] == pytest.approx(pair_auc(y, p)) and r["auc_low"] <= r["auc"] <= r["auc_high"]
    best = max({(round((p[y == 1] >= t).mean() - (p[y == 0] >= t).mean(), 12), t) for t in p})
    assert r["youden_threshold"] == best[1] and r["youden_sensitivity"] + r["youden_specificity"] - 1 == pytest.approx(best[0])
    assert r["brier"] == pytest.approx(np.mean((p - y) ** 2)) and 0.5 < r["slope"] < 2
    low, high = r["low_threshold"], r["high_threshold"]
    assert low < high and (p <= low).sum() >= 15 and (p > high).sum() >= 15
    assert [(s["risk"], s["n"]) for s in r["strata"]] == [("low", (p <= low).sum()), ("intermediate", ((p > low) & (p <= high)).sum()), ("high", (p > high).sum())]


def test_auc_by_domain(scored):
    data, df = scored
    got = {r["site"]: r for r in E.auc_by_domain(df, "event", "p", "site", "id", 10, "d").collect()}
    for site in "abc":
        y, p = zip(*[(r[1], r[2]) for r in data if r[3] == site])
        assert got[site]["auc"] == pytest.approx(pair_auc(y, p)) and got[site]["low"] <= got[site]["auc"] <= got[site]["high"] and got[site]["valid"] == 10


def test_exact_percentiles(scored, spark):
    data, df = scored
    for q in (0.0, 0.05, 0.33, 0.5, 0.975, 1.0):
        got = {r["site"]: r["x"] for r in O.exact_percentiles(df, "p", {"x": q}, ["site"]).collect()}
        for site in "abc":
            assert got[site] == pytest.approx(np.quantile([r[2] for r in data if r[3] == site], q))
    odd = spark.createDataFrame([(None, 1.0), (None, 3.0), ("g", None), ("g", 2.0)], "g string, v double")
    assert {r["g"]: r["x"] for r in O.exact_percentiles(odd, "v", {"x": 0.5}, ["g"]).collect()} == {None: 2.0, "g": 2.0}


def test_feature_sets_on_the_common_cohort(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 4))
    y = (rng.random(120) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    data = [(i, int(y[i]), f"f{j}", None if (i < 10 and j == 2) else float(x[i, j])) for i in range(120) for j in range(4)]
    long = spark.createDataFrame(data, "id int, event int, feature string, value double")
    got = {r["model"]: r for r in M.compare_feature_sets(long, {"first": ["f0"], "noise": ["f1", "f3"], "holes": ["f0", "f2"], "none": ["g"]}, 3, seed="f").collect()}
    assert {r["n"] for r in got.values()} == {110} and got["none"]["skipped"] and got["none"]["auc"] is None and not got["holes"]["skipped"]
    assert got["first"]["auc"] > 0.75 > 0.65 > got["noise"]["auc"] and (got["holes"]["features"], got["noise"]["features"]) == (2, 2)
    # the masked fits equal fits on the set alone
    rows = M.vector_rows(long.filter("feature = 'f0' and id >= 10"))
    assert got["first"]["auc"] == pytest.approx(E.auc(M.oof_predictions(rows, 3, seed="f"), "event", "p", ["fold"]).agg(F.avg("auc")).first()[0], abs=0.1)
    few = M.compare_feature_sets(long.filter("id < 25"), {"first": ["f0"], "holes": ["f2"]}, least=20).collect()
    assert all(r["skipped"] and r["auc"] is None for r in few)


def test_flags_reports_and_titles(spark):
    df = spark.createDataFrame([(i,) for i in range(4)], "id int")
    flags = spark.createDataFrame([(0, " Yes"), (1, "1"), (2, "no")], "id int, flag string")
    assert tuple(J.flagged_report(df, flags, "id", "flag").first()) == (2, 2) and J.filter_flagged(df, flags, "id", "flag", check=True).count() == 2
    with pytest.raises(contracts.ContractError, match="dropped 4"):
        J.filter_flagged(df, flags.filter("id = 2"), "id", "flag", check=True)
    names = spark.createDataFrame([("Docteur Dupont",), ("Mle Dupont",), ("Professeur É. Doctor",)], "x string")
    assert [tuple(r) for r in names.select(S.canonical_id("x"), S.canonical_id("x", "_")).collect()] == [("dupont", "docteur_dupont"), ("mledupont", "dupont"), ("e", "professeur_e_doctor")]
