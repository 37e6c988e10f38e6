"""HZ-*: harmonisation of lines by batch."""

from pyspark.sql import functions as F

from riskloom.operators import aggregates as A
from riskloom.operators import harmonize as H
from riskloom.plans.aggregates import _LONG, long_lines
from riskloom.plans.bindings import LINES, r6, vectors
from riskloom.registry import query

_P = "p AS (SELECT batch, feature, avg(value) AS m, stddev_pop(value) AS s FROM long WHERE batch < 5 GROUP BY ALL), g AS (SELECT feature, avg(value) AS gm, stddev_pop(value) AS gs FROM long WHERE batch < 5 GROUP BY feature)"


def _parts(spark, d):
    v = long_lines(spark, d).filter("value is not null").select("id", "batch", "feature", "value")
    return v.filter("batch < 5"), v


@query("hz03_batch_zscore", f"WITH {LINES}, {_LONG}, {_P} SELECT id, feature, round((value - coalesce(m, gm)) / coalesce(s, gs) * gs + gm, 4) + 0.0 AS value FROM long LEFT JOIN p USING (batch, feature) JOIN g USING (feature) WHERE value IS NOT NULL")
def hz03(spark, d):
    train, test = _parts(spark, d)
    return H.batch_zscore(train, test).select("id", "feature", (F.round("value", 4) + 0.0).alias("value"))


@query("hz04_ref_standardize", f"WITH {LINES}, {_LONG}, {_P}, r AS (SELECT feature, m AS tm, s AS ts FROM p WHERE batch = 2) SELECT id, feature, round((value - coalesce(m, tm)) / coalesce(s, ts) * ts + tm, 4) + 0.0 AS value FROM long LEFT JOIN p USING (batch, feature) JOIN r USING (feature) WHERE value IS NOT NULL")
def hz04(spark, d):
    train, test = _parts(spark, d)
    return H.ref_standardize(train, test, 2).select("id", "feature", (F.round("value", 4) + 0.0).alias("value"))


@query("hz01_combat_unshrunk", f"""WITH {LINES}, {_LONG}, s AS (SELECT batch, feature, count(value) AS n, avg(value) AS m, var_pop(value) AS v FROM long GROUP BY ALL), b AS (SELECT feature, sum(n * m) / sum(n) AS alpha, sum(n * v) / sum(n) AS pooled FROM s GROUP BY feature)
SELECT batch, feature, round((m - alpha) / sqrt(pooled), 6) + 0.0 AS gamma, round(v / pooled * n / (n - 1), 6) AS delta FROM s JOIN b USING (feature)""")
def hz01(spark, d):
    e = H.combat_fit(_parts(spark, d)[1], shrink=False)
    return e.select("batch", "feature", r6("gamma", "gamma"), r6("delta", "delta"))


@query("hz01_combat_shrunk")
def hz01s(spark, d):
    return H.combat_fit(vectors(spark, d), ref=1).drop("median")


@query("hz01_combat_nonparametric")
def hz01n(spark, d):
    return H.combat_fit(vectors(spark, d), ref="largest", parametric=False, cap=5.0)


@query("hz02_combat_apply", f"""WITH {LINES}, {_LONG}, s AS (SELECT batch, feature, count(value) AS n, avg(value) AS m, var_pop(value) AS v FROM long GROUP BY ALL), b AS (SELECT feature, sum(n * m) / sum(n) AS alpha, sum(n * v) / sum(n) AS pooled FROM s GROUP BY feature)
SELECT id, feature, round(((value - alpha) / sqrt(pooled) - (m - alpha) / sqrt(pooled)) / sqrt(v / pooled * n / (n - 1)) * sqrt(pooled) + alpha, 4) + 0.0 AS value FROM long JOIN s USING (batch, feature) JOIN b USING (feature) WHERE value IS NOT NULL""")
def hz02(spark, d):
    v = _parts(spark, d)[1]
    return H.combat_apply(v, H.combat_fit(v, shrink=False)).select("id", "feature", (F.round("value", 4) + 0.0).alias("value"))


@query("hz05_eligible")
def hz05(spark, d):
    return H.harmonize_eligible(vectors(spark, d).select("id", "batch", "feature", "value")).groupBy("batch", "harmonized").agg(F.count(F.lit(1)).alias("n"))


@query("hz06_report")
def hz06(spark, d):
    v = vectors(spark, d)
    before = A.cv_stats(A.column_profile(v)).withColumn("stage", F.lit("before"))
    return before.unionByName(A.cv_stats(A.column_profile(H.combat_apply(v, H.combat_fit(v)))).withColumn("stage", F.lit("after")))


@query("sm05_passthrough", f"WITH {LINES}, {_LONG} SELECT id, feature, batch > 4 AS unknown_batch FROM long WHERE value IS NOT NULL")
def sm05(spark, d):
    train, test = _parts(spark, d)
    return H.harmonize_or_passthrough(test, H.combat_fit(train)).select("id", "feature", "unknown_batch")
