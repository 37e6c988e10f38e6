"""Operators by closed form, invariants and edge cases; oracle SQL on the smallest tables."""

import itertools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import registry
from riskloom.functions import scalars as S
from riskloom.operators import aggregates as A
from riskloom.operators import calibrate as C
from riskloom.operators import contracts
from riskloom.operators import evaluate as E
from riskloom.operators import harmonize as H
from riskloom.operators import joins as J
from riskloom.operators import order as O
from riskloom.operators import resample as R
from riskloom.operators import screen as FS
from riskloom.operators import solver as V
from riskloom.sources import tables as T
from riskloom.streaming import operators as SM

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.random(400), 2)
    y = (rng.random(400) < p).astype(int)
    return spark.createDataFrame([(i, int(a), float(b), float(round(b * b, 3))) for i, (a, b) in enumerate(zip(y, p, strict=True))], "id int, event int, p double, s double").cache()


def auc_by_pairs(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))


def test_auc_and_antisymmetry(scored):
    want = auc_by_pairs([(r["event"], r["p"]) for r in scored.collect()])
    assert E.auc(scored, "event", "p").first()["auc"] == pytest.approx(want)
    assert E.auc(scored.withColumn("m", -F.col("p")), "event", "m").first()["auc"] == pytest.approx(1 - want)
    assert E.auc(scored.filter("event = 1"), "event", "p").first()["auc"] is None


def test_results_do_not_depend_on_partitions(scored):
    one = [tuple(r) for r in O.midrank(scored, "p").orderBy("id").select("id", "rank").collect()]
    for n in (1, 7):
        assert [tuple(r) for r in O.midrank(scored.repartition(n).orderBy(F.rand(3)), "p").orderBy("id").select("id", "rank").collect()] == one


def test_delong_is_antisymmetric(scored):
    a, b = E.delong(scored, "event", "p", "s").first(), E.delong(scored, "event", "s", "p").first()
    if a["z"] is not None:
        assert a["z"] == pytest.approx(-b["z"]) and a["p"] == pytest.approx(b["p"])
    v = scored.withColumn("n", F.col("id") % 7 / 7.0)
    r = E.delong(v, "event", "p", "n").first()
    assert 0 <= r["p"] <= 1 and r["auc_a"] == pytest.approx(E.auc(v, "event", "p").first()["auc"])


def test_bootstrap_weights(scored):
    w = R.bootstrap_weights(scored, "id", "event", 5, 1)
    sizes = {r["event"]: r["n"] for r in scored.groupBy("event").agg(F.count("*").alias("n")).collect()}
    for r in w.groupBy("rep", "event").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect():
        assert r["w"] == sizes[r["event"]] == r["n"]


def test_folds_partition_rows(scored):
    f = R.stratified_kfold(scored, "id", "event", 5, 2)
    assert f.count() == 400 and f.select("id").distinct().count() == 400
    spread = f.groupBy("event", "fold").agg(F.count("*").alias("n")).groupBy("event").agg((F.max("n") - F.min("n")).alias("d")).collect()
    assert all(r["d"] <= 1 for r in spread)
    with pytest.raises(contracts.ContractError):
        R.stratified_kfold(scored.filter("event = 1"), "id", "event", 5)


def test_wilson_and_rates(spark):
    low, high = S.wilson_interval(F.lit(7), F.lit(33))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert (r["l"], r["h"]) == pytest.approx((0.10676021533020799, 0.3775164499215069))
    rates = A.rates(F.lit(18), F.lit(8), F.lit(18), F.lit(151))
    r = spark.range(1).select(rates["mcc"].alias("mcc"), rates["f1"].alias("f1")).first()
    assert (r["mcc"], r["f1"]) == pytest.approx((0.5132496994556273, 0.5806451612903226))


def test_text_parsing(spark):
    v = spark.createDataFrame([("Mme Élodie-Anne DUPONT",), ("dupont_elodie anne",), ("Dr. José  Ñuñez",), (None,), ("",), ("Mme",)], "x string")
    assert [r[0] for r in v.select(S.canonical_id("x", "_")).collect()] == ["elodie_anne_dupont", "dupont_elodie_anne", "jose_nunez", None, "", ""]
    n = spark.createDataFrame([("1,5",), (" 2 ",), ("nan",), ("",), ("abc",), (None,)], "x string")
    assert [r[0] for r in n.select(S.safe_double("x")).collect()] == [1.5, 2.0, None, None, None, None]
    d = spark.createDataFrame([("20240131",), ("2024-01-31",), ("31/01/2024",), ("notadate",), (None,)], "x string")
    assert [str(r[0]) for r in d.select(S.parse_date_multi("x")).collect()] == ["2024-01-31"] * 3 + ["None"] * 2


def test_solver_meets_the_optimum(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1])))).astype(int)
    rows = spark.createDataFrame([(int(b), [float(v) for v in a], [1.0, float(i % 2)]) for i, (a, b) in enumerate(zip(x, y, strict=True))], "event int, features array<double>, weights array<double>")
    fits = [V.Fit(0, 0.05, 0.6), V.Fit(1, 2.0, 0.0)]
    for fit, got in zip(fits, V.fit_logistic_replicates(rows, fits), strict=True):
        w = np.ones(300) if fit.weight == 0 else np.arange(300) % 2
        z = (x - got["mean"]) / got["sd"]
        p = 1 / (1 + np.exp(-(got["intercept"] + z @ got["coef"])))
        g = fit.c * z.T @ (w * (p - y)) + (1 - fit.l1_ratio) * got["coef"]
        assert abs((w * (p - y)).sum()) < 1e-3 and got["converged"]
        for gj, bj in zip(g, got["coef"], strict=True):
            assert (abs(gj + fit.l1_ratio * np.sign(bj)) < 1e-3) if bj else abs(gj) <= fit.l1_ratio + 1e-3


def test_firth_is_finite_on_separable_data(spark):
    rows = spark.createDataFrame([(int(i >= 10), [float(i)]) for i in range(20)], "event int, features array<double>")
    f = V.fit_firth(rows)
    assert np.isfinite(f["coef"]).all() and 0 < f["coef"][0] < 20


def test_calibration(scored):
    brier = {r["kind"]: r["brier"] for r in C.select_calibrator(scored, "event", "s").collect()}
    assert brier["isotonic"] <= brier["identity"] + 1e-12
    a, b = C.fit_sigmoid(scored, "event", "p")
    q = scored.filter("p > 0 and p < 1").select((F.col("event") - S.sigmoid(F.lit(a) + F.lit(b) * S.logit("p"))).alias("e"))
    assert abs(q.agg(F.avg("e")).first()[0]) < 0.05


def test_combat(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, f, float(rng.normal(i % 3, 1 + i % 3))) for i in range(240) for f in range(5)]
    long = spark.createDataFrame(rows, "id int, batch int, feature int, value double")
    plain = H.combat_apply(long, H.combat_fit(long, shrink=False))
    means = plain.groupBy("feature").agg((F.max("value") - F.min("value")).alias("x")).count()
    assert means == 5
    spread = plain.groupBy("batch", "feature").agg(F.avg("value").alias("m")).groupBy("feature").agg((F.max("m") - F.min("m")).alias("d")).collect()
    assert all(r["d"] < 1e-9 for r in spread)
    ref = H.combat_apply(long, H.combat_fit(long, ref=1)).filter("batch = 1").join(long.withColumnRenamed("value", "old"), ["id", "batch", "feature"])
    assert ref.filter("abs(value - old) > 1e-9").count() == 0
    with pytest.raises(contracts.ContractError):
        H.combat_apply(long, H.combat_fit(long.filter("batch < 2")))


def test_prune_order(spark):
    corr = spark.createDataFrame([("a", "b", 0.99), ("a", "c", 0.1), ("b", "c", 0.98)], "a string, b string, r double")
    var = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 1.0)], "feature string, variance double")
    assert FS.prune_correlated(corr, var) == ["b"]


def test_joins_and_contracts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    with pytest.raises(contracts.ContractError):
        J.join_one_to_one(a, a.union(a), "k")
    with pytest.raises(contracts.ContractError):
        J.map_ids(a, spark.createDataFrame([(1, "P", 0)], "k int, new string, o int"), "k", "new", "o")
    with pytest.raises(contracts.ContractError):
        J.filter_id(a, "k", 9)
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(a, ["k", "z"])
    points = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0)], "x double, y double")
    got = J.interp(spark.createDataFrame([(-1.0,), (0.5,), (2.0,), (None,)], "q double"), "q", points)
    assert [r["y"] for r in got.collect()] == [1.0, 2.0, 3.0, None]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "names.txt").write_text("a\n\n b \n")
    assert T.read_name_list(spark, str(tmp_path / "names.txt")) == ["a", "b"]
    (tmp_path / "t.json").write_text('{"low_threshold": 0.7, "high_threshold": 0.2, "x": {"y": [1]}}')
    config = T.read_json_config(spark, str(tmp_path / "t.json"))
    assert (config["low_threshold"], config["high_threshold"]) == (0.2, 0.7)
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.json").write_text('{"id": "1", "s": "ok"}')
    (docs / "b.json").write_text("{broken")
    (docs / "c.json").write_text('{"s": "no id"}')
    assert [r["id"] for r in T.read_entity_docs(spark, str(docs), "id string, s string", "id").collect()] == ["1"]
    assert T.latest_file(spark, str(docs), "*.json").endswith(".json")
    (tmp_path / "c.csv").write_text('pid,age,bmi\n A1 ,"50,5",x\n ,1,2\n')
    assert [tuple(r) for r in T.read_covariates(spark, str(tmp_path / "c.csv"), [], ["age", "bmi"], "pid").collect()] == [("A1", 50.5, None)]
    T.write_table(spark.range(3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    T.write_metrics_json(spark.createDataFrame([(1, float("nan"))], "a int, b double"), str(tmp_path / "m"))
    assert spark.read.schema("a int, b double").json(str(tmp_path / "m")).first()["b"] is None
    T.append_manifest(spark, str(tmp_path / "runs"), "r1", {"seed": 1}, {"rows": 2})
    assert spark.read.parquet(str(tmp_path / "runs")).first()["counts"]["rows"] == 2


def test_streams_equal_their_batch_twins(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = SM.read_stream(spark, str(tmp_path / "in"), events.schema)
    run = lambda df, n: (SM.run_available(df, str(tmp_path / n), str(tmp_path / f"{n}-state")), spark.read.parquet(str(tmp_path / n)))[1]
    p = F.col("value") / (F.col("value") + 5)
    assert run(SM.score_rows(stream, p, 0.3, 0.6), "score").groupBy("risk").count().orderBy("risk").collect() == SM.score_rows(events, p, 0.3, 0.6).groupBy("risk").count().orderBy("risk").collect()
    active = events.filter("value > 9").select("user_id")
    assert run(SM.suppress_active(stream, active, "user_id"), "idle").count() == SM.suppress_active(events, active, "user_id").count()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    one = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    got = run(SM.changed_only(one, "user_id", ["ts", "event_id"], ["event_type"]), "changed")
    want = SM.changed_only_batch(events, "user_id", ["ts", "event_id"], ["event_type"])
    assert {r["event_id"] for r in got.select("event_id").collect()} == {r["event_id"] for r in want.select("event_id").collect()}


def test_normal_cdf(spark):
    r = spark.range(1).select(S.normal_cdf(F.lit(1.2)).alias("a"), S.normal_cdf(F.lit(-1.2)).alias("b")).first()
    assert r["a"] == pytest.approx(0.5 * math.erfc(-1.2 / math.sqrt(2)), abs=1e-6) and r["a"] + r["b"] == pytest.approx(1)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["ag08_risk_strata", "wn04_cut_points", "wn06_quantile_bins", "ev03_delong", "ev04_bootstrap_interval", "ev10_corrected_t", "fn01_canonical_ids", "fn02_safe_double", "ag01_column_profile", "fs11_decoys", "src09_entity_docs", "hz02_combat_apply", "sp11_permuted_labels", "vx01_cut_region"])
def test_oracle(spark, db, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = db.sql(registry.oracles()[name]).df()[list(got.columns)]
    key = lambda r: tuple("" if v is None or v != v else str(v) for v in r)
    a, b = sorted(map(tuple, got.values.tolist()), key=key), sorted(map(tuple, want.values.tolist()), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all((u == v) or (u != u and v != v) or u is None or v is None or u == pytest.approx(v, abs=2e-6) for u, v in zip(x, y, strict=True))


def test_every_oracle_has_a_query():
    assert set(registry.oracles()) <= set(registry.queries())


def test_embedding_queries_without_sql_use_all_values(spark):
    from riskloom.plans import models

    found = registry.queries()
    assert models.rows(spark, SF).select(F.size("features")).distinct().collect()[0][0] == 64
    assert found["hz01_combat_shrunk"](spark, SF).select("feature").distinct().count() == 64
    assert found["fs05_06_prefilter"](spark, SF).agg(F.max("n")).collect()[0][0] == 64
