"""EV-*, CL-*: discrimination, intervals and calibration."""

from pyspark.sql import functions as F

from riskloom.functions import scalars as S
from riskloom.operators import aggregates as A
from riskloom.operators import calibrate as C
from riskloom.operators import evaluate as E
from riskloom.operators import resample as R
from riskloom.plans.bindings import LABELLED, LINES, labelled, lines, r6
from riskloom.plans.resampling import BOOT, _pos
from riskloom.registry import query

_AUC = """(sum(CASE WHEN event = 1 THEN r END) - CAST(sum(event) AS DOUBLE) * (sum(event) + 1) / 2) / nullif(CAST(sum(event) AS DOUBLE) * sum(1 - event), 0)"""


@query("ev01_auc", f"WITH {LINES}, k AS (SELECT event, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM lines) SELECT round({_AUC}, 6) AS auc, CAST(sum(event) AS BIGINT) AS pos, CAST(sum(1 - event) AS BIGINT) AS neg FROM k")
def ev01(spark, d):
    return E.auc(lines(spark, d), "event", "p").select(r6("auc", "auc"), "pos", "neg")


@query("ev02_auc_by_domain", f"WITH {LINES}, k AS (SELECT batch, event, rank() OVER (PARTITION BY batch ORDER BY q) + (count(*) OVER (PARTITION BY batch, q) - 1) / 2 AS r FROM lines) SELECT batch, round({_AUC}, 6) AS auc, CAST(sum(event) AS BIGINT) AS pos, CAST(sum(1 - event) AS BIGINT) AS neg FROM k GROUP BY batch")
def ev02(spark, d):
    return E.auc(lines(spark, d), "event", "q", ["batch"]).select("batch", r6("auc", "auc"), "pos", "neg")


def _placement(score: str, out: str) -> str:
    return f"""CASE WHEN event = 1 THEN ((rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2) - (rank() OVER (PARTITION BY event ORDER BY {score}) + (count(*) OVER (PARTITION BY event, {score}) - 1) / 2)) / sum(1 - event) OVER ()
  ELSE 1 - ((rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2) - (rank() OVER (PARTITION BY event ORDER BY {score}) + (count(*) OVER (PARTITION BY event, {score}) - 1) / 2)) / sum(event) OVER () END AS {out}"""


@query("ev03_delong", f"""WITH {LINES}, v AS (SELECT event, {_placement('p', 'va')}, {_placement('q', 'vb')} FROM lines),
s AS (SELECT event, count(*) AS n, avg(va) AS ma, avg(vb) AS mb, (var_samp(va) + var_samp(vb) - 2 * covar_samp(va, vb)) / count(*) AS part FROM v GROUP BY event)
SELECT round(max(ma) FILTER (WHERE event = 1), 6) AS auc_a, round(max(mb) FILTER (WHERE event = 1), 6) AS auc_b,
  round((max(ma) FILTER (WHERE event = 1) - max(mb) FILTER (WHERE event = 1)) / sqrt(sum(part)), 4) AS z FROM s""")
def ev03(spark, d):
    return E.delong(lines(spark, d), "event", "p", "q").select(r6("auc_a", "auc_a"), r6("auc_b", "auc_b"), F.round("z", 4).alias("z"))


_THREE = {"p": "va", "q": "vb", "(disc * 10 + tax)": "vc"}


@query("ev03_delong_pairs", f"""WITH {LINES}, v AS (SELECT event, {", ".join(_placement(s, n) for s, n in _THREE.items())} FROM lines), l AS (SELECT event, unnest([{{'a': 'p', 'b': 'q', 'x': va, 'y': vb}}, {{'a': 'p', 'b': 'r', 'x': va, 'y': vc}}, {{'a': 'q', 'b': 'r', 'x': vb, 'y': vc}}]) AS u FROM v),
s AS (SELECT u.a AS a, u.b AS b, event, avg(u.x) AS mx, avg(u.y) AS my, (var_samp(u.x) + var_samp(u.y) - 2 * covar_samp(u.x, u.y)) / count(*) AS part FROM l GROUP BY ALL)
SELECT a, b, round(max(mx) FILTER (WHERE event = 1), 6) AS auc_a, round(max(my) FILTER (WHERE event = 1), 6) AS auc_b,
  round((max(mx) FILTER (WHERE event = 1) - max(my) FILTER (WHERE event = 1)) / sqrt(sum(part)), 4) AS z FROM s GROUP BY a, b""")
def ev03p(spark, d):
    v = lines(spark, d).withColumn("r", F.col("disc") * 10 + F.col("tax"))
    return E.delong_pairs(v, "event", ["p", "q", "r"]).select("a", "b", r6("auc_a", "auc_a"), r6("auc_b", "auc_b"), F.round("z", 4).alias("z"))


_REP = f"""x AS (SELECT rep, event, score, weight FROM boot WHERE weight > 0), c AS (SELECT rep, score, sum(CASE WHEN event = 1 THEN weight ELSE 0 END) AS pos, sum(CASE WHEN event = 0 THEN weight ELSE 0 END) AS neg FROM x GROUP BY ALL),
i AS (SELECT rep, pos, neg, sum(neg) OVER (PARTITION BY rep ORDER BY score) AS cum FROM c), ins AS (SELECT rep, sum(pos * (cum - neg / 2)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS a FROM i GROUP BY rep),
y AS (SELECT rep, score, sum(event) AS pos, sum(1 - event) AS neg FROM boot WHERE weight = 0 GROUP BY ALL), o2 AS (SELECT rep, pos, neg, sum(neg) OVER (PARTITION BY rep ORDER BY score) AS cum FROM y),
outs AS (SELECT rep, sum(pos * (cum - neg / 2)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS b FROM o2 GROUP BY rep), reps AS (SELECT rep, a, b FROM ins JOIN outs USING (rep))"""
_APP = f"k AS (SELECT event, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM labelled), app AS (SELECT {_AUC} AS auc FROM k)"


@query("ev04_bootstrap_interval", f"WITH {LABELLED}, {BOOT}, {_REP}, {_APP} SELECT round(quantile_cont(a, 0.025), 6) AS low, round(quantile_cont(a, 0.975), 6) AS high, count(a) AS valid, round(any_value(auc), 6) AS auc FROM reps, app")
def ev04(spark, d):
    return E.bootstrap_auc_interval(labelled(spark, d), "event", "score", "id", 4, "b").select(r6("low", "low"), r6("high", "high"), "valid", r6("auc", "auc"))


@query("ev05_paired_delta")
def ev05(spark, d):
    v = labelled(spark, d).withColumn("other", -F.length("source") * 1.0 - F.col("score") % 7)
    return E.paired_auc_delta(v, "event", "score", "other", "id", 8, "b")


@query("ev06_07_632", f"""WITH {LABELLED}, {BOOT}, {_REP}, e AS (SELECT rep, a, b, least(greatest(((1 - b) - (1 - a)) / greatest(0.5 - (1 - a), 1e-12), 0), 1) AS rate FROM reps)
SELECT rep, round(0.368 * a + 0.632 * b, 6) AS auc_632, round(1 - ((1 - 0.632 / (1 - 0.368 * rate)) * (1 - a) + 0.632 / (1 - 0.368 * rate) * (1 - b)), 6) AS auc_632plus FROM e""")
def ev06(spark, d):
    r = E.replicate_aucs(labelled(spark, d), "event", ["score"], "id", 4, "b")
    a, b = F.col("in_score"), F.col("out_score")
    return r.select("rep", r6(E.auc_632(a, b), "auc_632"), r6(E.auc_632plus(a, b), "auc_632plus"))


@query("ev08_632_fixed", f"""WITH {LABELLED}, {BOOT}, {_REP}, {_APP}, m AS (SELECT avg(b) AS oob, any_value(auc) AS apparent FROM reps, app), rr AS (SELECT *, least(greatest((apparent - oob) / (apparent - 0.5), 0), 1) AS rate FROM m),
ww AS (SELECT *, least(greatest(0.632 / (1 - 0.368 * rate), 0.632), 1) AS w FROM rr) SELECT round(oob, 6) AS oob, round(apparent, 6) AS apparent, round((1 - w) * apparent + w * oob, 6) AS estimate FROM ww""")
def ev08(spark, d):
    return E.auc_632plus_fixed(labelled(spark, d), "event", "score", "id", 4, "b").select(r6("oob", "oob"), r6("apparent", "apparent"), r6("estimate", "estimate"))


@query("ev09_normal_interval", f"WITH {LABELLED}, {BOOT}, {_REP} SELECT round(avg(a) - 1.96 * stddev_samp(a), 6) AS low, round(avg(a) + 1.96 * stddev_samp(a), 6) AS high FROM reps")
def ev09(spark, d):
    r = E.replicate_aucs(labelled(spark, d), "event", ["score"], "id", 4, "b")
    return E.normal_interval(r, "in_score").select(r6("low", "low"), r6("high", "high"))


@query("ev10_corrected_t", f"WITH {LINES}, s AS (SELECT batch, avg(p) AS v FROM lines GROUP BY batch) SELECT round(avg(v), 6) AS mean, round(greatest(0, avg(v) - 2.446911851 * stddev_samp(v) * sqrt(1 / count(v) + 0.25)), 6) AS low, round(least(1, avg(v) + 2.446911851 * stddev_samp(v) * sqrt(1 / count(v) + 0.25)), 6) AS high FROM s")
def ev10(spark, d):
    s = lines(spark, d).groupBy("batch").agg(F.avg("p").alias("v"))
    return E.corrected_t_interval(s, "v", 400, 100).select(r6("mean", "mean"), r6("low", "low"), r6("high", "high"))


_PERM = f"""r AS (SELECT CAST(range AS INT) AS rep FROM range(6)), perm AS (SELECT rep, id, score, CAST({_pos('x', by='1', reps='rep, ')} < (SELECT sum(event) FROM labelled) AS INT) AS event FROM labelled, r),
pk AS (SELECT rep, event, rank() OVER (PARTITION BY rep ORDER BY score) + (count(*) OVER (PARTITION BY rep, score) - 1) / 2 AS r FROM perm), pa AS (SELECT rep, {_AUC} AS a FROM pk GROUP BY rep)"""


@query("ev12_permutation", f"WITH {LABELLED}, {_PERM}, {_APP} SELECT round(any_value(auc), 6) AS observed, round((count(*) FILTER (WHERE a >= auc) + 1) / (count(*) + 1), 6) AS p, round(avg(a), 6) AS null_mean, round(stddev_pop(a), 6) AS null_sd FROM pa, app")
def ev12(spark, d):
    return E.permutation_test(labelled(spark, d), "event", "score", "id", 6, "x").select(*[r6(c, c) for c in ("observed", "p", "null_mean", "null_sd")])


@query("ev14_oob_cutpoints")
def ev14(spark, d):
    v = labelled(spark, d).withColumn("p", F.col("score") / (F.col("score") + 2000))
    return A.replicate_summary(E.oob_cutpoints(v, "event", "p", "id", 8, "b").select("mode", F.col("sensitivity").alias("value")), "mode")


@query("ev16_evaluate_score")
def ev16(spark, d):
    return E.evaluate_score(lines(spark, d), "event", "p", "id", 4, "e")


@query("ev02_domain_intervals")
def ev02i(spark, d):
    return E.auc_by_domain(labelled(spark, d), "event", "score", "lang", "id", 20, "d")


@query("ev17_roc_band")
def ev17(spark, d):
    return E.roc_band(labelled(spark, d), "event", "score", "id", 8, "b")


@query("sp12_shared_replicates", f"WITH {LABELLED}, {BOOT}, {_REP} SELECT rep, round(a, 6) AS in_score, round(b, 6) AS out_score, round(a, 6) AS in_twice, round(b, 6) AS out_twice FROM reps")
def sp12(spark, d):
    v = labelled(spark, d).withColumn("twice", F.col("score") * 2)
    r = E.replicate_aucs(v, "event", ["score", "twice"], "id", 4, "b")
    return r.select("rep", *[r6(c, c) for c in ("in_score", "out_score", "in_twice", "out_twice")])


@query("cl01_sigmoid")
def cl01(spark, d):
    return spark.createDataFrame([C.fit_sigmoid(lines(spark, d), "event", "p")], "intercept double, slope double")


@query("cl02_isotonic")
def cl02(spark, d):
    return C.fit_isotonic(lines(spark, d), "event", "q")


@query("cl03_intercept_only", f"WITH {LINES} SELECT true AS settled, round(avg(event), 6) AS mean_event FROM lines")
def cl03(spark, d):
    v = lines(spark, d)
    shift = C.fit_intercept_only(v, "event", "p")
    fitted = S.sigmoid(S.logit("p") + F.lit(shift))
    return v.agg((F.abs(F.avg(fitted) - F.avg("event")) < 1e-6).alias("settled"), r6(F.avg("event"), "mean_event"))


@query("cl04_select_calibrator")
def cl04(spark, d):
    return C.select_calibrator(lines(spark, d), "event", "p")


@query("cl05_cross_calibrate")
def cl05(spark, d):
    v = lines(spark, d)
    return A.proper_scores(C.cross_calibrate(v, "event", "p", "batch"), "event", "calibrated", "batch")


@query("cl05_cross_isotonic")
def cl05i(spark, d):
    return C.cross_calibrate(lines(spark, d), "event", "p", "batch", "isotonic").select("id", "batch", "calibrated")


@query("cl06_apply_calibrators", f"""WITH {LINES} SELECT id, p AS same, round(1 / (1 + exp(-(-0.5 + 0.8 * ln(p / (1 - p))))), 6) AS sigmoid, round(CASE WHEN q <= 0.2 THEN 0.1 WHEN q < 0.8 THEN 0.1 + (q - 0.2) * ((0.6 - 0.1) / (0.8 - 0.2)) ELSE 0.6 END, 6) AS isotonic FROM lines""")
def cl06(spark, d):
    v = lines(spark, d)
    a = C.apply_calibrator(v, "p", {"type": "identity"}, "same")
    a = C.apply_calibrator(a, "p", {"type": "sigmoid", "intercept": -0.5, "slope": 0.8}, "sigmoid")
    a = C.apply_calibrator(a, "q", {"type": "isotonic", "x": [0.2, 0.8], "y": [0.1, 0.6]}, "isotonic")
    return a.select("id", "same", r6("sigmoid", "sigmoid"), r6("isotonic", "isotonic"))


@query("cl07_calibration_slope")
def cl07(spark, d):
    return C.calibration_slope(lines(spark, d), "event", "p", "batch")


@query("cl08_reliability_band")
def cl08(spark, d):
    return C.reliability_band(labelled(spark, d).withColumn("p", F.col("score") / (F.col("score") + 2000)), "event", "p", "id", 5, "b")


@query("cl09_wilson", f"""WITH {LINES}, c AS (SELECT batch, CAST(sum(event) AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n FROM lines GROUP BY batch), z AS (SELECT batch, x / n AS p, n, {S.Z95} AS z FROM c)
SELECT batch, round(((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round(((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM z""")
def cl09(spark, d):
    low, high = S.wilson_interval("events", "n")
    return A.class_summary(lines(spark, d), "event", "batch").select("batch", r6(low, "low"), r6(high, "high"))
