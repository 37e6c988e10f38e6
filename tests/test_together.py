"""Steps that don't depend on each other run side by side, and shared inputs are made once."""

import threading

import pytest
from pyspark.sql import functions as F

from riskloom.operators import models as M
from riskloom.operators import studies as ST
from riskloom.operators.together import together


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def meeting(n):
    """A call that returns once ``n`` threads have made it; alone it fails after a while."""
    barrier = threading.Barrier(n)
    return lambda: barrier.wait(timeout=60)


@pytest.fixture(scope="module")
def long(spark):
    rows = [(i, i % 2, f"f{j}", float((i * (7 + j)) % 11 + (i % 2 if j == 0 else 0))) for i in range(60) for j in range(3)]
    return spark.createDataFrame(rows, "id long, event int, feature string, value double").persist()


def test_results_keep_their_order_and_errors_are_raised(spark):
    assert together(spark, [lambda n=n: spark.range(n).count() for n in (5, 1, 3)]) == [5, 1, 3]
    assert together(spark, []) == [] and together(spark, [lambda: 1]) == [1]
    with pytest.raises(ZeroDivisionError):
        together(spark, [lambda: 1, lambda: 1 / 0])


def test_folds_of_nested_selection_run_side_by_side(long, monkeypatch):
    meet = meeting(3)
    monkeypatch.setattr(ST, "select_panel", lambda *args: (meet(), ["f0", "f1"])[1])
    summary, frequency = ST.nested_selection_cv(long, 3, 1, seed="n")
    assert {r["feature"]: r["times"] for r in frequency.collect()} == {"f0": 3, "f1": 3}
    assert summary.first()["valid"] == 3


def test_selection_gathers_rows_once(long, monkeypatch):
    plans, draw = [], M.subsample
    monkeypatch.setattr(M, "subsample", lambda df, *args: (plans.append(plan(df)), draw(df, *args))[1])
    freq, _ = M.stability_selection(long, 2, [0.5], "s")
    assert len(plans) == 1 and "collect_list" not in plans[0] and "decoy_" not in plans[0]
    assert sorted(r["feature"] for r in freq.collect()) == ["decoy_f0", "decoy_f1", "decoy_f2", "f0", "f1", "f2"]


def test_families_and_their_folds_run_side_by_side(long, monkeypatch):
    """All families of a panel are fitted at the same time, and so are the folds of a margin model; scores are summarised once."""
    plain = lambda rows: lambda new: new.select("id", "event", (F.col("features")[0] / 20).alias("p"))
    meet, steps = meeting(3), []
    families = {n: M.ModelSpec(n, lambda rows: (meet(), plain(rows))[1], linear) for n, linear in (("a", True), ("b", True), ("c", False))}
    brier = ST._with_brier
    monkeypatch.setattr(ST, "_with_brier", lambda scores, by: (steps.append(by), brier(scores, by))[1])
    got = {r["model"]: r for r in ST.multi_model_panel(long, ["f0", "f1"], 1, 0.3, "p", families).collect()}
    assert {m: r["features"] for m, r in got.items()} == {"a": 2, "b": 2, "c": 3} and steps == [["model"]]
    # the first feature is the same for all
    assert len({(r["auc"], r["brier"], r["pos"], r["neg"]) for r in got.values()}) == 1 and got["a"]["pos"] == got["a"]["neg"] == 9


def test_folds_of_margins_run_side_by_side(spark, long, monkeypatch):
    meet = meeting(3)
    monkeypatch.setattr(M, "margins", lambda model, rows: rows.select("event", F.col("features")[0].alias("_x")))
    a, b = M.fit_platt(M.vector_rows(long), 3, "s", fit=lambda rows: meet())
    assert a == pytest.approx(a) and b > 0


def test_folds_of_the_boosted_study_run_side_by_side(spark, long, monkeypatch):
    """Folds meet, and a fold's columns are profiled once."""
    meet, profiles, profile = meeting(2), [], ST.A.column_profile
    counted = lambda df: (profiles.append(1), profile(df))[1]
    monkeypatch.setattr(ST.A, "column_profile", counted)
    monkeypatch.setattr(ST.FS, "column_profile", counted)
    monkeypatch.setattr(ST.M, "fit_boosted", lambda rows, *args, **kw: meet())
    monkeypatch.setattr(ST.M, "ml_scores", lambda model, rows: rows.select("id", "event", (F.col("features")[0] / 20).alias("p")))
    summary, frequency = ST.univariate_boosted_cv(long, 2, 1, panel=2, seed="u")
    assert len(profiles) == 2 and summary.first()["valid"] == 2 and frequency.count() >= 2


def test_validation_schemes_run_side_by_side(spark, long):
    meet = meeting(3)
    value = lambda name, v: lambda rows: (meet(), spark.createDataFrame([(v,)], f"{name} double"))[1]
    each, consensus = ST.validation_suite(long, {"a": value("mean", 0.5), "b": value("auc", 0.7), "c": value("mean", 0.9)})
    assert {tuple(r) for r in each.collect()} == {("a", 0.5), ("b", 0.7), ("c", 0.9)} and consensus.first()["median"] == 0.7


def test_boosted_folds_do_the_whole_job(spark, long, monkeypatch):
    """The query has five folds five times over, and early stopping ends the trees; the table is not copied for each fold."""
    from riskloom import registry

    asked, rounds, tables, fit, keep = [], [], [], M.fit_boosted, ST.kept
    monkeypatch.setattr(M, "fit_boosted", lambda rows, n, **settings: (rounds.append(n), fit(rows, n, **settings))[1])
    monkeypatch.setattr(ST, "kept", lambda df, *label: (tables.append(df.columns), keep(df, *label))[1])
    summary, frequency = ST.univariate_boosted_cv(long, 2, 1, panel=2, seed="u")
    assert rounds == [400, 400] and summary.first()["valid"] == 2 and sum("value" in t for t in tables) == 2
    monkeypatch.setattr(ST, "univariate_boosted_cv", lambda v, *a, **b: (asked.append(a), (summary, frequency))[1])
    registry.queries()["ml18_univariate_boosted"](spark, "/root/testdata/sf0.001")
    assert asked == [(5, 5)]
