"""AG-*: aggregations."""

from pyspark.sql import functions as F

from riskloom.functions import scalars as S
from riskloom.operators import aggregates as A
from riskloom.operators import joins as J
from riskloom.operators import order as O
from riskloom.plans.bindings import LABELLED, LINES, labelled, lines, r6, table, vectors, vectors_sql
from riskloom.registry import query

_LONG = "long AS (SELECT id, event, batch, unnest(['price', 'qty', 'disc', 'tax']) AS feature, unnest([price, qty, CASE WHEN disc > 0 THEN disc END, tax]) AS value FROM lines)"


def long_lines(spark, d):
    v = lines(spark, d).withColumn("disc", F.when(F.col("disc") > 0, F.col("disc")))
    return J.to_long(v, ["id", "event", "batch"], ["price", "qty", "disc", "tax"])


@query("ag01_column_profile", f"""WITH {LINES}, {_LONG} SELECT feature, count(*) AS n, round(avg(CAST(value IS NULL AS INT)), 6) AS missing, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd,
  round(quantile_cont(value, 0.5), 6) AS median, min(value) AS low, max(value) AS high, count(DISTINCT value) AS "distinct", round(count(DISTINCT value) / count(value), 6) AS unique_ratio FROM long GROUP BY feature""")
def ag01(spark, d):
    p = A.column_profile(long_lines(spark, d))
    return p.select("feature", "n", r6("missing", "missing"), F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), r6("median", "median"), "low", "high", "distinct", r6("unique_ratio", "unique_ratio"))


@query("ag02_batch_profile", f"WITH {LINES}, {_LONG} SELECT batch, feature, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, count(value) AS n FROM long GROUP BY ALL")
def ag02(spark, d):
    return A.batch_profile(long_lines(spark, d)).select("batch", "feature", r6("mean", "mean"), r6("sd", "sd"), "n")


@query("ag03_dominant", f"WITH {LINES} SELECT batch, count(*) AS n FROM lines GROUP BY batch ORDER BY n DESC, batch LIMIT 1")
def ag03(spark, d):
    return A.dominant(lines(spark, d), "batch")


@query("ag04_class_summary", f"WITH {LABELLED} SELECT lang, count(*) AS n, CAST(sum(event) AS BIGINT) AS events, CAST(count(*) - sum(event) AS BIGINT) AS non_events, round(avg(event), 6) AS prevalence FROM labelled GROUP BY lang")
def ag04(spark, d):
    return A.class_summary(labelled(spark, d), "event", "lang").withColumn("prevalence", F.round("prevalence", 6))


_RATES = """round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(tp / nullif(tp + fp, 0), 6) AS ppv, round(tn / nullif(tn + fn, 0), 6) AS npv,
  round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) + 0.0 AS mcc"""


@query("ag05_confusion", f"""WITH {LINES}, c AS (SELECT batch, CAST(count(*) FILTER (WHERE event = 1 AND p >= 0.4) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE event = 0 AND p >= 0.4) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (WHERE event = 1 AND p < 0.4) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE event = 0 AND p < 0.4) AS DOUBLE) AS tn FROM lines GROUP BY batch)
SELECT batch, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, {_RATES} FROM c""")
def ag05(spark, d):
    c = A.confusion(lines(spark, d), "event", "p", 0.4, "batch")
    return c.select("batch", "tp", "fp", "fn", "tn", *[r6(k, k) for k in ("sensitivity", "specificity", "ppv", "npv", "balanced", "f1", "mcc")])


@query("ag06_proper_scores", f"WITH {LINES} SELECT batch, round(avg((p - event) * (p - event)), 6) AS brier, round(avg(-(event * ln(greatest(least(p, 1 - 1e-8), 1e-8)) + (1 - event) * ln(1 - greatest(least(p, 1 - 1e-8), 1e-8)))), 6) AS log_loss FROM lines GROUP BY batch")
def ag06(spark, d):
    s = A.proper_scores(lines(spark, d), "event", "p", "batch")
    return s.select("batch", r6("brier", "brier"), r6("log_loss", "log_loss"))


@query("ag07_calibration_error", f"""WITH {LINES}, b AS (SELECT batch, (SELECT count(*) FROM (VALUES (0.1), (0.2), (0.3), (0.4), (0.5), (0.6), (0.7), (0.8), (0.9)) t(e) WHERE lines.p >= CAST(e AS DOUBLE)) AS b, p, event FROM lines),
g AS (SELECT batch, b, count(*) AS n, abs(avg(p) - avg(event)) AS gap FROM b GROUP BY ALL) SELECT batch, round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM g GROUP BY batch""")
def ag07(spark, d):
    return A.calibration_error(lines(spark, d), "event", "p", "batch").select("batch", r6("ece", "ece"), r6("mce", "mce"))


@query("ag09_score_summary", f"WITH {LINES} SELECT batch, round(avg(p), 6) AS mean, round(quantile_cont(p, 0.5), 6) AS median, round(quantile_cont(p, 0.05), 6) AS q05, round(quantile_cont(p, 0.95), 6) AS q95, round(avg(event), 6) AS observed FROM lines GROUP BY batch")
def ag09(spark, d):
    return A.score_summary(lines(spark, d), "event", "p", "batch").select("batch", *[r6(c, c) for c in ("mean", "median", "q05", "q95", "observed")])


@query("ag10_replicate_summary", f"WITH {LINES}, {_LONG} SELECT feature, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, count(value) AS valid FROM long GROUP BY feature")
def ag10(spark, d):
    return A.replicate_summary(long_lines(spark, d), "feature").select("feature", *[r6(c, c) for c in ("mean", "median", "low", "high")], "valid")


@query("ag11_consensus", f"""WITH {LINES}, v AS (SELECT batch, disc AS value FROM lines), m AS (SELECT batch, quantile_cont(value, 0.5) AS median FROM v GROUP BY batch)
SELECT batch, round(any_value(median), 6) AS median, round(quantile_cont(abs(value - median), 0.5), 6) AS mad, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(max(value) - min(value), 6) AS range, count(value) AS n FROM v JOIN m USING (batch) GROUP BY batch""")
def ag11(spark, d):
    c = A.consensus(lines(spark, d).select("batch", F.col("disc").alias("value")), "batch")
    return c.select("batch", *[r6(x, x) for x in ("median", "mad", "mean", "sd", "range")], "n")


@query("ag12_paired", f"""WITH {LINES}, r AS (SELECT batch AS rep, status AS model, avg(p) AS value FROM lines GROUP BY ALL), x AS (SELECT a.value - b.value AS v FROM r a JOIN r b ON a.rep = b.rep AND a.model <> 'F' AND b.model = 'F')
SELECT 'O' AS model, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(v) AS valid FROM x""")
def ag12(spark, d):
    r = lines(spark, d).groupBy(F.col("batch").alias("rep"), F.col("status").alias("model")).agg(F.avg("p").alias("value"))
    return A.paired_differences(r, "rep", "model", "F").select("model", *[r6(c, c) for c in ("mean", "median", "low", "high")], "valid")


@query("ag13_histogram", f"""WITH {LINES}, e AS (SELECT min(price) AS lo, max(price) AS hi FROM lines) SELECT CAST(least(floor((price - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM lines, e GROUP BY 1""")
def ag13(spark, d):
    return A.histogram(lines(spark, d), "price", 20)


@query("ag14_cv_stats", f"""WITH {vectors_sql()}, p AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS sd FROM vectors GROUP BY feature), c AS (SELECT sd / abs(mean) AS cv FROM p)
SELECT round(avg(cv), 4) AS mean_cv, round(quantile_cont(cv, 0.5), 4) AS median_cv, count(*) FILTER (WHERE cv > 0.5) AS above_half, count(*) FILTER (WHERE cv > 1) AS above_one FROM c""")
def ag14(spark, d):
    c = A.cv_stats(A.column_profile(vectors(spark, d)))
    return c.select(F.round("mean_cv", 4).alias("mean_cv"), F.round("median_cv", 4).alias("median_cv"), "above_half", "above_one")


@query("ag15_family_counts", """WITH v AS (SELECT CASE page_id % 3 WHEN 0 THEN 'log' WHEN 1 THEN 'wavelet' ELSE 'original' END AS image, CASE page_id % 2 WHEN 0 THEN 'glcm' ELSE 'shape' END AS kind FROM pages)
SELECT image, kind, count(*) AS n FROM v GROUP BY ALL""")
def ag15(spark, d):
    image = F.when(F.col("page_id") % 3 == 0, "log_").when(F.col("page_id") % 3 == 1, "wavelet_").otherwise("original_")
    a, b = S.feature_family(F.concat(image, F.when(F.col("page_id") % 2 == 0, "glcm_x").otherwise("shape_x")))
    return table(spark, d, "pages").groupBy(a.alias("image"), b.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("ag16_selection_frequency", f"WITH {LINES}, v AS (SELECT batch AS run, qty AS feature FROM lines GROUP BY ALL HAVING avg(event) > 0.25) SELECT feature, count(*) AS times, round(count(*) / (SELECT count(DISTINCT run) FROM v), 6) AS frequency FROM v GROUP BY feature")
def ag16(spark, d):
    v = lines(spark, d).groupBy(F.col("batch").alias("run"), F.col("qty").alias("feature")).agg(F.avg("event").alias("rate")).filter("rate > 0.25").drop("rate")
    return A.selection_frequency(v, "run", "feature").withColumn("frequency", F.round("frequency", 6))


@query("ag16_run_thresholds", f"WITH {LINES}, r AS (SELECT batch AS run, round(max(q) FILTER (WHERE event = 1), 6) AS t FROM lines GROUP BY batch) SELECT min(t) AS low, quantile_cont(t, 0.5) AS median, max(t) AS high, count(t) AS runs FROM r")
def ag16t(spark, d):
    runs = lines(spark, d).filter("event = 1").groupBy(F.col("batch").alias("run")).agg(F.round(F.max("q"), 6).alias("t"))
    return A.threshold_summary(runs)


@query("ag17_21_spread", f"WITH {vectors_sql()} SELECT feature, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS low, max(value) AS high FROM vectors GROUP BY feature")
def ag17(spark, d):
    return A.spread_summary(vectors(spark, d), "value", "feature").select("feature", r6("mean", "mean"), r6("sd", "sd"), "low", "high")


@query("ag18_date_bounds", "SELECT o_orderpriority, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders GROUP BY 1")
def ag18(spark, d):
    return A.date_bounds(table(spark, d, "orders"), "o_orderdate", "o_orderpriority")


@query("ag19_rule_prevalence", f"WITH {LINES} SELECT 'old' AS rule, count(*) FILTER (WHERE qty >= 25) AS met, count(qty) AS known FROM lines UNION ALL SELECT 'cheap', count(*) FILTER (WHERE disc > 0 AND disc <= 0.03), count(*) FILTER (WHERE disc > 0) FROM lines")
def ag19(spark, d):
    disc = F.when(F.col("disc") > 0, F.col("disc"))
    return A.rule_prevalence(lines(spark, d), {"old": F.col("qty") >= 25, "cheap": disc <= 0.03})


@query("ag20_step_summary", "SELECT event_type, count(*) FILTER (WHERE value > 5) AS succeeded, count(*) FILTER (WHERE NOT value > 5) AS failed, round(avg(value) FILTER (WHERE value > 5), 6) AS mean_value FROM events GROUP BY event_type")
def ag20(spark, d):
    return A.step_summary(table(spark, d, "events"), F.col("value") > 5, "value", "event_type").withColumn("mean_value", F.round("mean_value", 6))


@query("ag22_rollup", f"WITH {LINES} SELECT status, batch, count(*) AS n, CAST(sum(event) AS BIGINT) AS events, CAST(grouping_id(status, batch) AS BIGINT) AS level FROM lines GROUP BY ROLLUP (status, batch)")
def ag22(spark, d):
    return A.rollup_report(lines(spark, d), "event", ["status", "batch"])


_SWEEP = """c AS (SELECT p AS score, sum(event) AS pos, sum(1 - event) AS neg FROM lines GROUP BY p),
w AS (SELECT score AS threshold, CAST(sum(pos) OVER o AS DOUBLE) AS tp, CAST(sum(neg) OVER o AS DOUBLE) AS fp, CAST(sum(pos) OVER () AS DOUBLE) AS tot_p, CAST(sum(neg) OVER () AS DOUBLE) AS tot_n FROM c WINDOW o AS (ORDER BY score DESC)),
s AS (SELECT threshold, tp, fp, tot_p - tp AS fn, tot_n - fp AS tn FROM w UNION ALL SELECT 0.0, max(tot_p), max(tot_n), 0, 0 FROM w HAVING min(threshold) > 0 UNION ALL SELECT 1.0, 0, 0, max(tot_p), max(tot_n) FROM w HAVING max(threshold) < 1),
m AS (SELECT *, tp / nullif(tp + fn, 0) AS sens, tn / nullif(tn + fp, 0) AS spec, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 12) AS mcc FROM s),
b AS (SELECT *, round((sens + spec) / 2, 12) AS bal FROM m),
cuts AS ((SELECT 'rule_out' AS mode, * FROM b ORDER BY sens >= 0.9 DESC, mcc DESC, bal DESC NULLS LAST, round(sens, 12) DESC NULLS LAST, round(abs(threshold - 0.5), 12), threshold LIMIT 1)
  UNION ALL (SELECT 'rule_in', * FROM b ORDER BY spec >= 0.9 DESC, mcc DESC, bal DESC NULLS LAST, round(spec, 12) DESC NULLS LAST, round(abs(threshold - 0.5), 12), threshold LIMIT 1))"""


def cut_points(spark, d):
    return O.best_thresholds(O.threshold_sweep(lines(spark, d), "event", "p"))


@query("ag08_risk_strata", f"""WITH {LINES}, {_SWEEP}, t AS (SELECT min(threshold) AS lo, max(threshold) AS hi FROM cuts),
g AS (SELECT CASE WHEN p < lo THEN 'low' WHEN p < hi THEN 'intermediate' ELSE 'high' END AS risk, event FROM lines, t),
n AS (SELECT risk, count(*) AS n, CAST(sum(event) AS BIGINT) AS events FROM g GROUP BY risk)
SELECT CAST(position AS INT) AS position, risk, coalesce(n, 0) AS n, coalesce(events, 0) AS events, round(events / n, 6) AS rate FROM (VALUES (0, 'low'), (1, 'intermediate'), (2, 'high')) o(position, risk) LEFT JOIN n USING (risk)""")
def ag08(spark, d):
    """Flagship: how well does a score separate events, and who is ruled out and in by its two cut-offs?"""
    cuts = cut_points(spark, d).agg(F.min("threshold").alias("lo"), F.max("threshold").alias("hi"))
    v = lines(spark, d).crossJoin(F.broadcast(cuts))  # two numbers
    group = F.when(F.col("p") < F.col("lo"), "low").when(F.col("p") < F.col("hi"), "intermediate").otherwise("high")
    return A.risk_strata(v, "event", group).withColumn("rate", F.round("rate", 6))


@query("wn04_cut_points", f"WITH {LINES}, {_SWEEP} SELECT mode, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(mcc, 6) AS mcc FROM cuts")
def wn04(spark, d):
    return cut_points(spark, d).select("mode", "threshold", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")], r6("mcc", "mcc"))


@query("wn03_threshold_sweep", f"WITH {LINES}, {_SWEEP} SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(sens, 6) AS sensitivity, round(spec, 6) AS specificity FROM m")
def wn03(spark, d):
    s = O.threshold_sweep(lines(spark, d), "event", "p")
    return s.select("threshold", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")], r6("sensitivity", "sensitivity"), r6("specificity", "specificity"))
