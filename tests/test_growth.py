"""Steps whose plans must not shuffle, sort or gather more than the input's growth."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import aggregates as A
from riskloom.operators import calibrate as C
from riskloom.operators import evaluate as E
from riskloom.operators import harmonize as H
from riskloom.operators import models as M
from riskloom.operators import resample as R
from riskloom.operators import screen as FS
from riskloom.operators import solver as V
from riskloom.operators.contracts import ContractError
from riskloom.sources import scratch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def unaided(spark):
    """Spark broadcasts nothing by its own choice, as with tables whose size it does not know."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_levels_are_found_without_a_sort(spark, monkeypatch):
    plans, keep = [], C.kept
    monkeypatch.setattr(C, "kept", lambda df, *label: (plans.append(plan(df)), keep(df, *label))[1])
    counts = spark.range(200).select((F.col("id") % 2).cast("int").alias("g"), (F.col("id") / 200).alias("x"), (F.col("id") * 37 % 5).cast("double").alias("pos"), F.lit(5.0).alias("n"))
    C.isotonic_curves(counts, ["g"])
    assert plans and not [p for p in plans if "SortAggregate" in p]


@pytest.mark.parametrize("step", ["zscore", "reference", "combat", "passthrough", "eligible"])
def test_rows_meet_statistics_without_a_shuffle(unaided, step):
    long = unaided.createDataFrame([(i, i % 3, f, float(i * (2 + len(f)) % 11)) for i in range(60) for f in ("a", "bc")], "id long, batch int, feature string, value double")
    train = long.filter("batch < 2")
    done = {
        "zscore": lambda: H.batch_zscore(train, long), "reference": lambda: H.ref_standardize(train, long, 1), "combat": lambda: H.combat_apply(long, H.combat_fit(long)),
        "passthrough": lambda: H.harmonize_or_passthrough(long, H.combat_fit(train)), "eligible": lambda: H.harmonize_eligible(long),
    }[step]()
    assert "SortMergeJoin" not in plan(done) and "Exchange hashpartitioning" not in plan(done)
    assert done.count() == long.count()


def test_summaries_gather_no_group(spark):
    rows = [("a", v) for v in (1.0, 2.0, 2.0, 7.0, None)] + [("b", None), (None, 3.0), (None, 5.0), ("c", math.inf), ("c", math.inf)]
    long = spark.createDataFrame(rows, "g string, value double")
    for made in (A.replicate_summary(long, "g"), A.consensus(long, "g")):
        assert "percentile(" not in plan(made)
    got = {r["g"]: tuple(r)[1:] for r in A.replicate_summary(long, "g").collect()}
    assert got["a"] == pytest.approx((3.0, 2.0, 1.075, 6.625, 4)) and got["b"] == (None, None, None, None, 0)
    assert got[None][:2] == (4.0, 4.0) and got["c"][1:] == (math.inf, math.inf, math.inf, 2)
    mads = {r["g"]: (r["median"], r["mad"], r["sd"], r["range"], r["n"]) for r in A.consensus(long, "g").collect()}
    assert mads["a"] == pytest.approx((2.0, 0.5, math.sqrt(5.5), 6.0, 4)) and mads["b"] == (None, None, None, None, 0) and mads[None] == (4.0, 1.0, 1.0, 2.0, 2)


def test_replicates_are_drawn_once(spark):
    """AUCs read counts by replicate and score; no draw is left in their plan. Nine replicates take three numbers of four."""
    rows = spark.range(90).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("event"), (F.col("id") * 7 % 31).cast("double").alias("score"))
    made = E.replicate_aucs(rows, "event", ["score"], "id", 9, "s")
    assert "md5" not in plan(made)
    weights = R.bootstrap_weights(rows, "id", "event", 9, "s", ["score"]).toPandas()
    sums = weights.groupby(["rep", "event"])["weight"].sum().unstack()
    assert len(weights) == 810 and (sums[1] == 30).all() and (sums[0] == 60).all()
    for r in made.collect():
        one = weights[weights["rep"] == r["rep"]]
        for name, w in (("in_score", one["weight"]), ("out_score", (one["weight"] == 0).astype(int))):
            pos, neg = one["event"] == 1, one["event"] == 0
            beats = [a * b * ((s > t) + (s == t) / 2) for s, a in zip(one["score"][pos], w[pos], strict=True) for t, b in zip(one["score"][neg], w[neg], strict=True)]
            assert r[name] == pytest.approx(sum(beats) / (w[pos].sum() * w[neg].sum()))


def test_placements_and_fits_read_rows_alike_once(spark, monkeypatch):
    rows = spark.range(400).select((F.col("id") % 3 == 0).cast("int").alias("event"), (F.col("id") % 4 / 8 + 0.1).alias("p"), (F.col("id") % 2 / 2).alias("q"))
    assert E.placements(rows, "event", ["p", "q"]).agg(F.count(F.lit(1)), F.sum("n")).first() == (8, 400)
    sizes, keep = [], C.kept
    monkeypatch.setattr(C, "kept", lambda df, *label: (sizes.append(df.count()), keep(df, *label))[1])
    C.newton_by(rows, "event", "p", [])
    assert sizes == [8]


def test_left_out_rows_are_shuffled_as_packed_numbers(spark, monkeypatch):
    """AUCs equal those of single scores over many ranges, ties and tasks' parts; the shuffle has no row per score."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 2)).round(1)
    rows = spark.createDataFrame([(i, int(rng.random() < 0.4), [float(v) for v in a], [i % 3]) for i, a in enumerate(x)], "id int, event int, features array<double>, codes array<int>").repartition(5).persist()
    fits = [V.Fit(None, 1.0, 0.0, ((0, f),)) for f in range(3)] + [V.Fit(None, 1e-9, 1.0, ((0, 0),))]
    fitted = V.fit_logistic_replicates(rows, fits)
    want = {r["fit"]: tuple(r) for r in E.auc(V.replicate_scores(rows, fits, fitted, held_out=True), "event", "p", ["fit"]).collect()}
    monkeypatch.setattr(V, "RANGE_ROWS", 100)
    monkeypatch.setattr(V, "GATHERED", 700)
    made = V.held_out_aucs(rows, fits, fitted)
    assert plan(made).count("MapInArrow") == 1 and "score" not in plan(made)
    got = {r["fit"]: tuple(r) for r in made.collect()}
    assert sorted(got) == [0, 1, 2, 3] and all(got[f] == pytest.approx(want[f]) for f in got) and want[3][1] == pytest.approx(0.5)


def test_numbers_and_folds_join_nothing_by_id(unaided, monkeypatch):
    """Places equal those of ``class_order``; rows are shuffled by parts of the hash alone, and bad ids are seen."""
    plans, keep = [], scratch.kept
    monkeypatch.setattr(scratch, "kept", lambda df, *label: (plans.append(plan(df)), keep(df, *label))[1])
    rows = unaided.range(300).select("id", (F.col("id") % 3 == 0).cast("int").alias("event"), F.array(F.col("id").cast("double")).alias("features"))
    numbered, n, events = M.numbered_by_class(rows, "s")
    folded = M.fold_rows(rows, 4, "s")
    assert len(plans) == 2 and not [p for p in plans if "SortMergeJoin" in p]
    at = {r["id"]: r["pos"] for r in R.class_order(rows.select("id", "event"), "id", "event", "s|number").collect()}
    assert (n, events) == (300, 100) and all(r["number"] == at[r["id"]] + (0 if r["event"] else 100) for r in numbered.collect())
    folds = {r["id"]: [r["fold"]] for r in R.stratified_kfold(rows, "id", "event", 4, "s").collect()}
    assert folded.columns == ["id", "event", "features", "codes"] and {r["id"]: r["codes"] for r in folded.collect()} == folds
    null = rows.withColumn("event", F.when(F.col("id") > 0, F.col("event")))
    # the same id in both classes, in one class, without a class, without an id
    for bad in (rows.union(rows.filter("id = 5").withColumn("event", F.lit(1))), rows.union(rows.filter("id = 6")), null, rows.withColumn("id", F.when(F.col("id") > 0, F.col("id")))):
        for step in (lambda b: M.numbered_by_class(b, "s"), lambda b: M.fold_rows(b, 3, "s")):
            with pytest.raises(ContractError):
                step(bad)


def test_features_are_placed_without_a_search_per_value(spark, monkeypatch):
    """No map that is searched for each feature; ids that lack features count where they have both, a feature twice is an error."""
    plans, sums = [], FS.moment_sums
    monkeypatch.setattr(FS, "moment_sums", lambda v, p: (plans.append(plan(v)), sums(v, p))[1])
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5)).round(1)
    x[:, 3] = x[:, 0] + 0.1 * x[:, 1]
    long = [(i, i % 2, f"f{j}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if (i, j) not in ((4, 1), (7, 1), (7, 4))]
    table = spark.createDataFrame(long, "id long, event int, feature string, value double").repartition(4)
    names, r = FS.rank_correlations(table)
    FS.knockoff_features(table, "k").collect()
    assert len(plans) == 2 and not [p for p in plans if "element_at" in p or "map_from_entries" in p]
    wide = pd.DataFrame(long, columns=["id", "event", "feature", "value"]).pivot(index="id", columns="feature", values="value").rank()
    assert names == list(wide.columns) and r == pytest.approx(np.abs(wide.corr().to_numpy()), abs=1e-12)
    with pytest.raises(Exception, match="a feature twice"):
        FS.rank_correlations(table.union(table.filter("id = 3 and feature = 'f2'")))


def logistic(x, y, rounds=100):
    """Intercept and slope by plain Newton steps."""
    z, b = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z, z.T @ (y - p))
    return b


def test_margins_that_hardly_differ_get_the_event_rate(spark):
    """An SVC of few events has margins close to -1; their sigmoid is that of the same margins spread out."""
    rng = np.random.default_rng(8)
    u = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(2.2 - 0.7 * u))).astype(int)
    groups = {"wide": u, "close": -1 + 1e-6 * u, "same": np.full(500, -1.0)}
    rows = spark.createDataFrame([(g, int(e), float(v)) for g, x in groups.items() for e, v in zip(y, x, strict=True)] + [("one", 1, 0.5), ("one", 1, 0.7)], "g string, event int, x double")
    found = C.newton_by(rows, "event", "x", ["g"])
    p = {g: 1 / (1 + np.exp(-(found[g,][0] + found[g,][1] * x))) for g, x in groups.items()}
    a, b = logistic(u, y)
    want = 1 / (1 + np.exp(-(a + b * u)))
    assert found["wide",] == pytest.approx((a, b), abs=1e-9) and np.allclose(p["wide"], want, atol=1e-9)
    assert np.allclose(p["close"], want, atol=1e-6) and np.allclose(p["same"], y.mean(), atol=1e-6)
    assert sum(found["one",]) > 5
    single = C.newton_by(rows.filter("g = 'close'"), "event", "x", [])[()]
    assert single == pytest.approx(found["close",], rel=1e-6)


def test_arrays_are_gathered_whole(spark):
    """Rows equal those gathered from one row per value, also for ids that repeat; no value is a row of the shuffle."""
    rows = [(1, 0, [1.0, None, 3.0]), (2, 1, [4.0, math.inf]), (2, 1, [7.0, 1.0, 0.5]), (2, 0, [9.0]), (3, 1, []), (4, 1, None), (5, None, [2.0]), (None, 0, [5.0, 6.0])]
    arrays = spark.createDataFrame(rows, "id long, event int, features array<double>")
    made = M.array_rows(arrays)
    assert "Generate" not in plan(made)
    long = arrays.select("id", "event", F.posexplode("features").alias("feature", "value"))
    want = sorted(map(tuple, M.vector_rows(long).collect()), key=str)
    assert sorted(map(tuple, made.collect()), key=str) == want and len(want) == 5 and made.columns == ["id", "event", "features"]


def test_a_split_makes_its_rows_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(200).select("id", (F.col("id") % 4 == 0).cast("int").alias("event"), F.array(F.col("id") / 2).alias("features"))
    train, test = M.split_rows(rows.mapInArrow(count, rows.schema), 0.3, "s")
    held = {r["id"] for r in R.stratified_holdout(rows, "id", "event", 0.3, 1, "s").collect()}
    assert {r["id"] for r in test.collect()} == held and {r["id"] for r in train.collect()} == set(range(200)) - held and len(held) == 60
    assert train.columns == test.columns == rows.columns and made.value == 200


def test_passes_of_an_svc_have_no_more_stages_than_rows_need(spark, monkeypatch):
    """Few rows are in few partitions however many files they came from; many are not in one task."""
    from pyspark.ml.classification import LinearSVC

    parts = []
    monkeypatch.setattr(LinearSVC, "fit", lambda self, data: (parts.append(data.rdd.getNumPartitions()), data.count())[1])
    rows = spark.range(0, 40_000, 1, 16).select("id", (F.col("id") % 2).cast("int").alias("event"), F.array_repeat(F.col("id") / 7, 64).alias("features"))
    assert M.fit_linear_svc(rows) == 40_000 and M.fit_linear_svc(rows.filter("id < 5000")) == 5000 and parts == [5, 1]
    assert [M.loss_partitions(n) for n in (0, 1 << 19, 1 << 20, 1 << 25, 1 << 26, 1 << 33)] == [1, 1, 2, 5, 8, 1024]


def test_draws_are_not_gathered_on_the_driver(spark):
    """Draws are made from a few lines, so a plan takes them for a small table; they have a row per row of the input."""
    rows = spark.range(90).select("id", (F.col("id") % 3 == 0).cast("int").alias("event"), (F.col("id") * 7 % 31 / 31).alias("score"))
    weights = R.bootstrap_weights(rows, "id", "event", 4, "s", ["score"])
    weights.collect()
    assert not [line for line in plan(weights).splitlines() if "Join" in line and "_at#" in line and "SortMergeJoin" not in line] and "SortMergeJoin [_at#" in plan(weights)


def test_an_evaluation_counts_rows_alike_once(spark, monkeypatch):
    """But for the replicates all parts read rows counted by event and score; they equal plain sums, and one class gives nulls."""
    made, keep = [], E.kept
    monkeypatch.setattr(E, "kept", lambda df, *label: (made.append(keep(df, *label)), made[-1])[1])
    rows = spark.range(600).select("id", (F.crc32(F.col("id").cast("string")) % 5 <= F.col("id") % 4).cast("int").alias("event"), ((F.col("id") % 8 + 1) / 10).alias("p"))
    r = E.evaluate_score(rows, "event", "p").first()
    y, p = rows.select("event", "p").toPandas().to_numpy().T
    assert [(df.count(), df.columns) for df in made] == [(16, ["event", "p", "_n"]), (8, ["score", "tp", "fp", "p", "n", "pos", "neg"])]
    wins = [(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]]
    gaps = [(abs(p[b].mean() - y[b].mean()), b.sum()) for b in (np.isclose(p, k / 10) for k in range(1, 9))]
    assert (r["n"], r["events"], r["pos"], r["neg"]) == (600, y.sum(), y.sum(), 600 - y.sum()) and r["auc"] == pytest.approx(np.mean(wins))
    assert (r["brier"], r["mean"], r["observed"]) == pytest.approx((np.mean((p - y) ** 2), p.mean(), y.mean())) and r["log_loss"] == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    assert (r["ece"], r["mce"]) == pytest.approx((sum(g * n for g, n in gaps) / 600, max(g for g, _ in gaps)))
    assert sum(s["n"] for s in r["strata"]) == 600 and sum(s["events"] for s in r["strata"]) == y.sum()
    one = E.evaluate_score(rows.withColumn("event", F.lit(0)), "event", "p").first()
    assert (one["n"], one["events"], one["auc"], one["youden"], one["youden_threshold"]) == (600, 0, None, None, None) and one["brier"] == pytest.approx(np.mean(p**2))
