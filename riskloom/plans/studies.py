"""EV-11, EV-15, EV-18 to EV-22, ML-12, ML-13, ML-15, ML-16, ML-18, UD-03: studies on embeddings. Fits have no SQL; tests check their properties."""

from pyspark.sql import functions as F

from riskloom.operators import models as M
from riskloom.operators import screen as FS
from riskloom.operators import studies as ST
from riskloom.plans.bindings import LINES, lines, vectors
from riskloom.plans.models import rows
from riskloom.registry import query
from riskloom.sources.scratch import kept, scratch_path


def dated(spark, d):
    """Embeddings with a date: ids are spread over a year."""
    return vectors(spark, d).withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 365).cast("int")))


@query("ev11_simple_bootstrap")
def ev11(spark, d):
    return ST.simple_bootstrap(kept(rows(spark, d)), 20, seed="e")


@query("ev15_validation_suite")
def ev15(spark, d):
    each, consensus = ST.validation_suite(kept(rows(spark, d)))
    return each.crossJoin(F.broadcast(consensus.select("median", "mad", "range")))


@query("ev18_monte_carlo_cv")
def ev18(spark, d):
    return ST.monte_carlo_cv(kept(rows(spark, d)), 10, seed="m")


@query("ev19_leave_out")
def ev19(spark, d):
    batch = vectors(spark, d).select("id", "batch").distinct()
    return ST.leave_out_evaluation(kept(rows(spark, d).join(batch.withColumn("part", F.crc32(F.col("id").cast("string")) % 6), "id").drop("batch")), "part", seed="l")


@query("ev20_repeated_cv")
def ev20(spark, d):
    return ST.repeated_cv_evaluation(kept(rows(spark, d)), 5, 2, seed="r")


@query("ev20_nested_cv")
def ev20n(spark, d):
    return ST.repeated_cv_evaluation(rows(spark, d), 3, 1, seed="r", grid=[(0.05, 0.0), (1.0, 0.0)], inner=2)


@query("ev21_temporal")
def ev21(spark, d):
    # batches of these vectors follow their labels, so a part of the ids is the batch here
    return ST.temporal_evaluation(dated(spark, d).withColumn("batch", (F.col("id") % 3).cast("int")), "day", seed="t")


@query("ev22_domain")
def ev22(spark, d):
    return ST.domain_evaluation(vectors(spark, d).withColumn("batch", (F.crc32(F.col("id").cast("string")) % 4).cast("int")), seed="d")


@query("ml12_nested_selection")
def ml12(spark, d):
    summary, frequency = ST.nested_selection_cv(vectors(spark, d), seed="n")
    return frequency.crossJoin(F.broadcast(summary.select("mean", "pooled_auc", "pooled_low", "pooled_high")))


@query("ml13_component_ensemble")
def ml13(spark, d):
    return ST.component_ensemble(kept(rows(spark, d)), 2, 2, seed="c", inner=2)


@query("ml15_config_sweep")
def ml15(spark, d):
    return ST.config_sweep(vectors(spark, d), [0.1], [0.5, 0.75], {"ridge": (1.0, 0.0), "lasso": (0.5, 1.0)}, seed="s")


@query("ml15_resumed_sweep")
def ml15r(spark, d):
    """A sweep whose first half is committed already."""
    store, v = scratch_path(spark, "sweep"), vectors(spark, d)
    ST.config_sweep(v, [0.1], [0.5], {"ridge": (1.0, 0.0)}, seed="s", store=store)
    return ST.config_sweep(v, [0.1], [0.5, 0.75], {"ridge": (1.0, 0.0)}, seed="s", store=store)


@query("ml16_multi_model_panel")
def ml16(spark, d):
    v = kept(vectors(spark, d))
    panel = [r["feature"] for r in FS.point_biserial(v).orderBy(F.desc("r"), "feature").limit(7).collect()]
    return ST.multi_model_panel(v, panel, seed="p")


@query("ml18_univariate_boosted")
def ml18(spark, d):
    summary, frequency = ST.univariate_boosted_cv(vectors(spark, d), 5, 5, seed="u")
    return frequency.crossJoin(F.broadcast(summary.select("mean", "pooled_auc", "pooled_low", "pooled_high")))


@query("ud03_registered_model")
def ud03(spark, d):
    r = kept(rows(spark, d))
    return M.MODELS["elastic_net"].fit(r)(r)


@query("fn18_select_features", f"WITH {LINES} SELECT id, p, q, price, disc, tax FROM lines")
def fn18(spark, d):
    v = lines(spark, d).withColumn("diagnostics_n", F.lit(1))
    return v.select("id", *FS.select_features(v, "id", metadata=("event", "batch"), parts=("qty",)))
