"""FS-*: screening and selection on embeddings and lines."""

from pyspark.sql import functions as F

from riskloom.operators import evaluate as E
from riskloom.operators import joins as J
from riskloom.operators import models as M
from riskloom.operators import order as O
from riskloom.operators import screen as FS
from riskloom.plans.aggregates import _LONG, long_lines
from riskloom.plans.bindings import LINES, lines, r6, vectors, vectors_sql
from riskloom.registry import query
from riskloom.sources.scratch import kept


@query("fs01_drop_missing", f"WITH {LINES}, {_LONG} SELECT feature, round(avg(CAST(value IS NULL AS INT)), 6) AS missing FROM long GROUP BY feature HAVING avg(CAST(value IS NULL AS INT)) <= 0.05")
def fs01(spark, d):
    return FS.drop_missing(long_lines(spark, d), 0.05).select("feature", r6("missing", "missing"))


@query("fs02_impute", f"WITH {LINES}, {_LONG}, m AS (SELECT feature, quantile_cont(value, 0.5) AS fill FROM long GROUP BY feature) SELECT id, feature, coalesce(value, fill) AS value FROM long JOIN m USING (feature)")
def fs02(spark, d):
    return FS.impute(long_lines(spark, d))[0].select("id", "feature", "value")


@query("fs03_low_variance", f"WITH {LINES}, {_LONG}, m AS (SELECT feature, quantile_cont(value, 0.5) AS fill FROM long GROUP BY feature) SELECT feature, round(var_pop(coalesce(value, fill)), 4) AS variance FROM long JOIN m USING (feature) GROUP BY feature HAVING var_pop(coalesce(value, fill)) > 0.01")
def fs03(spark, d):
    return FS.drop_low_variance(long_lines(spark, d)).select("feature", F.round("variance", 4).alias("variance"))


@query("fs04_spearman", f"""WITH {vectors_sql()}, r AS (SELECT id, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS r FROM vectors)
SELECT x.feature AS a, y.feature AS b, round(abs(corr(x.r, y.r)), 6) AS r FROM r x JOIN r y ON x.id = y.id AND x.feature < y.feature GROUP BY ALL""")
def fs04(spark, d):
    return FS.spearman_matrix(vectors(spark, d)).select("a", "b", r6("r", "r"))


@query("fs05_06_prefilter")
def fs06(spark, d):
    return FS.prefilter(vectors(spark, d), 0.3, 0.001, 0.3)[1]


@query("fs07_univariate_auc", f"""WITH {vectors_sql()}, k AS (SELECT feature, event, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS r FROM vectors),
a AS (SELECT feature, (sum(CASE WHEN event = 1 THEN r END) - CAST(sum(event) AS DOUBLE) * (sum(event) + 1) / 2) / (CAST(sum(event) AS DOUBLE) * sum(1 - event)) AS a FROM k GROUP BY feature) SELECT feature, round(greatest(a, 1 - a), 6) AS auc FROM a""")
def fs07(spark, d):
    return E.univariate_auc(vectors(spark, d), "event").select("feature", r6("auc", "auc"))


@query("fs08_point_biserial", f"WITH {vectors_sql()} SELECT feature, round(abs(coalesce(corr(value, event), 0)), 6) AS r FROM vectors GROUP BY feature")
def fs08(spark, d):
    return FS.point_biserial(vectors(spark, d)).select("feature", r6("r", "r"))


@query("fs09_nzv", f"WITH {LINES}, {_LONG} SELECT feature FROM long GROUP BY feature HAVING var_pop(value) > 1e-8 AND count(DISTINCT value) / count(value) >= 0.01")
def fs09(spark, d):
    return FS.drop_nzv(long_lines(spark, d))


@query("tk02_event_k", f"WITH {vectors_sql()}, s AS (SELECT feature, round(abs(corr(value, event)), 6) AS r FROM vectors GROUP BY feature) SELECT feature, r FROM s ORDER BY r DESC, feature LIMIT 9")
def tk02(spark, d):
    k = O.k_by_events(3, 7, 3.0, 40, 64)
    s = FS.point_biserial(vectors(spark, d)).select("feature", r6("r", "r"))
    return O.top_k(s, [F.desc("r"), "feature"], k)


@query("fs10_l1_shrink")
def fs10(spark, d):
    v = vectors(spark, d)
    profile = FS.column_profile(v).select("feature", "distinct")
    stats = kept(E.univariate_auc(v, "event").join(FS.point_biserial(v), "feature").join(profile, "feature"))
    return M.l1_shrink(kept(M.vector_rows(v)), stats, 40, 7)


@query("fs11_knockoffs")
def fs11k(spark, d):
    return FS.knockoff_features(vectors(spark, d), "k")


@query("fs11_decoys", f"""WITH {vectors_sql()}, s AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY md5(concat('d|from|', feature, '|', id)), id) AS k FROM vectors), t AS (SELECT id, feature, row_number() OVER (PARTITION BY feature ORDER BY md5(concat('d|to|', feature, '|', id)), id) AS k FROM vectors)
SELECT t.id, concat('decoy_', t.feature) AS feature, s.value FROM t JOIN s USING (feature, k)""")
def fs11(spark, d):
    return FS.decoy_features(vectors(spark, d), "d").select("id", "feature", "value")


@query("fs12_stability_selection")
def fs12(spark, d):
    return M.stability_selection(vectors(spark, d), 6, [0.05, 0.2], "s")[0]


@query("fs13_fdp_threshold", f"""WITH {LINES}, f AS (SELECT batch, qty, avg(event) AS frequency, batch > 4 AS decoy FROM lines GROUP BY ALL), g AS (SELECT 0.1 + range * 0.05 AS t FROM range(19)),
c AS (SELECT t, count(*) FILTER (WHERE frequency >= t AND decoy) AS decoys, count(*) FILTER (WHERE frequency >= t AND NOT decoy) AS real FROM f, g GROUP BY t)
SELECT round(t, 6) AS t, decoys, "real", round((1 + decoys) / greatest(1, "real"), 6) AS fdp FROM c ORDER BY round((1 + decoys) / greatest(1, "real"), 12), t LIMIT 1""")
def fs13(spark, d):
    f = lines(spark, d).groupBy("batch", "qty").agg(F.avg("event").alias("frequency")).withColumn("decoy", F.col("batch") > 4)
    return FS.fdp_threshold(f, 0.1, 1.0, 0.05).select(r6("t", "t"), "decoys", "real", r6("fdp", "fdp"))


@query("fs14_correlation_groups")
def fs14(spark, d):
    return FS.correlation_groups(FS.spearman_matrix(vectors(spark, d)), 0.1)


@query("fs15_consensus", f"WITH {LINES}, v AS (SELECT batch AS run, qty AS feature FROM lines GROUP BY ALL HAVING avg(event) > 0.25), f AS (SELECT feature, count(*) AS times, round(count(*) / (SELECT count(DISTINCT run) FROM v), 6) AS frequency FROM v GROUP BY feature) SELECT * FROM f WHERE frequency >= 0.5 ORDER BY frequency DESC, feature LIMIT 6")
def fs15(spark, d):
    v = lines(spark, d).groupBy(F.col("batch").alias("run"), F.col("qty").alias("feature")).agg(F.avg("event").alias("rate")).filter("rate > 0.25").drop("rate")
    return FS.consensus_features(v, 0.5, 6).withColumn("frequency", F.round("frequency", 6))


@query("fs16_lasso_path")
def fs16(spark, d):
    return FS.lasso_path(lines(spark, d), ["price", "qty", "disc", "tax"], "event", [0.1, 0.01, 0.001])


@query("fs17_whitelist", f"WITH {LINES} SELECT id, qty, tax FROM lines")
def fs17(spark, d):
    from riskloom.sources.tables import select_by_names

    return select_by_names(lines(spark, d), "id", ["qty", "unknown", "tax"])[0]


@query("ml17_standardize", f"WITH {vectors_sql()} SELECT id, feature, round((value - avg(value) OVER (PARTITION BY feature)) / stddev_pop(value) OVER (PARTITION BY feature), 5) + 0.0 AS z FROM vectors")
def ml17(spark, d):
    v = vectors(spark, d)
    overall = v.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    none = v.limit(0).select("batch", "feature", F.col("value").alias("mean"), F.col("value").alias("sd"))
    return J.broadcast_stats(v, none, overall).select("id", "feature", (F.round("z", 5) + 0.0).alias("z"))
