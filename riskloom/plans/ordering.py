"""WN-*, TK-*: ranks, curves, bins, top-k."""

from pyspark.sql import functions as F

from riskloom.functions.scalars import Z95
from riskloom.operators import joins as J
from riskloom.operators import order as O
from riskloom.plans.bindings import LINES, PEOPLE, lines, people, r6, table, vectors, vectors_sql
from riskloom.registry import query


@query("wn01_midrank", f"WITH {LINES} SELECT id, rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2 AS rank FROM lines")
def wn01(spark, d):
    return O.midrank(lines(spark, d), "qty").select("id", F.col("rank").cast("double").alias("rank"))


@query("wn01_midrank_by", f"WITH {LINES} SELECT id, rank() OVER (PARTITION BY batch ORDER BY qty) + (count(*) OVER (PARTITION BY batch, qty) - 1) / 2 AS rank FROM lines")
def wn01b(spark, d):
    return O.midrank(lines(spark, d), "qty", ["batch"]).select("id", F.col("rank").cast("double").alias("rank"))


@query("wn02_roc_curve", f"""WITH {LINES}, c AS (SELECT batch, q, sum(event) AS pos, sum(1 - event) AS neg FROM lines GROUP BY ALL),
r AS (SELECT batch, q AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY batch) AS p, sum(neg) OVER (PARTITION BY batch) AS n FROM c WINDOW w AS (PARTITION BY batch ORDER BY q DESC))
SELECT batch, threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM r UNION ALL SELECT DISTINCT batch, NULL, 0.0, 0.0, 0, 0 FROM lines""")
def wn02(spark, d):
    return O.roc_curve(lines(spark, d), "event", "q", ["batch"]).select("batch", "threshold", r6("fpr", "fpr"), r6("tpr", "tpr"), "tp", "fp")


@query("wn05_youden", f"""WITH {LINES}, c AS (SELECT batch, q, sum(event) AS pos, sum(1 - event) AS neg FROM lines GROUP BY ALL),
r AS (SELECT batch, q AS threshold, sum(pos) OVER w / sum(pos) OVER (PARTITION BY batch) AS tpr, sum(neg) OVER w / sum(neg) OVER (PARTITION BY batch) AS fpr FROM c WINDOW w AS (PARTITION BY batch ORDER BY q DESC))
SELECT batch, threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(tpr - fpr, 6) + 0.0 AS youden FROM r QUALIFY row_number() OVER (PARTITION BY batch ORDER BY round(tpr - fpr, 12) DESC, threshold DESC) = 1""")
def wn05(spark, d):
    return O.youden_point(lines(spark, d), "event", "q", ["batch"]).select("batch", "threshold", r6("tpr", "tpr"), r6("fpr", "fpr"), r6("youden", "youden"))


@query("wn05_tertiles", f"WITH {LINES} SELECT round(quantile_cont(p, 1 / 3), 6) AS low, round(quantile_cont(p, 2 / 3), 6) AS high FROM lines")
def wn05t(spark, d):
    return O.tertile_cuts(lines(spark, d), "p").select(r6("low", "low"), r6("high", "high"))


_BINS = f""", s AS (SELECT CAST(bin AS INT) AS bin, CAST(count(*) AS DOUBLE) AS n, sum(event) AS events, avg({{score}}) AS mean_score, avg(event) AS rate, {Z95} AS z FROM b GROUP BY bin)
SELECT bin, CAST(n AS BIGINT) AS n, CAST(events AS BIGINT) AS events, round(mean_score, 6) AS mean_score, round(rate, 6) AS rate,
  round(((rate + z * z / (2 * n)) - z * sqrt(rate * (1 - rate) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round(((rate + z * z / (2 * n)) + z * sqrt(rate * (1 - rate) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM s"""


@query("wn06_quantile_bins", f"""WITH {LINES}, b AS (SELECT ntile(7) OVER (ORDER BY p, id) AS bin, event, p FROM lines){_BINS.format(score="p")}""")
def wn06(spark, d):
    return O.quantile_bins(lines(spark, d), "event", "p", 7, "id").select("bin", "n", "events", *[r6(c, c) for c in ("mean_score", "rate", "low", "high")])


@query("wn06_edge_bins", f"""WITH {LINES}, e AS (SELECT DISTINCT unnest(quantile_cont(qty, [0.2, 0.4, 0.6, 0.8])) AS e FROM lines), b AS (SELECT (SELECT count(*) FROM e WHERE lines.qty > e.e) AS bin, event, qty FROM lines){_BINS.format(score="qty")}""")
def wn06e(spark, d):
    return O.quantile_edge_bins(lines(spark, d), "event", "qty", 5).select("bin", "n", "events", *[r6(c, c) for c in ("mean_score", "rate", "low", "high")])


@query("wn07_adaptive_bins")
def wn07(spark, d):
    return O.adaptive_bins(lines(spark, d), "event", "p", "batch", min_n=350, min_events=150)


@query("wn08_first_per_key", "SELECT c_nationkey, c_custkey, c_name FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) = 1")
def wn08(spark, d):
    return J.first_per_key(table(spark, d, "customer"), ["c_nationkey"], [F.col("c_acctbal"), F.col("c_custkey")]).select("c_nationkey", "c_custkey", "c_name")


@query("wn09_latest_per_key", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def wn09(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return O.latest_per_key(e, ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id", "value")


@query("tk01_panel", f"""WITH {LINES}, f AS (SELECT CAST(qty AS INT) AS feature, count(*) AS frequency FROM lines GROUP BY 1) SELECT feature, frequency FROM f WHERE feature NOT IN (SELECT feature FROM f ORDER BY frequency DESC, feature LIMIT 5) ORDER BY frequency DESC, feature LIMIT 7""")
def tk01(spark, d):
    f = lines(spark, d).groupBy(F.col("qty").cast("int").alias("feature")).agg(F.count(F.lit(1)).alias("frequency"))
    return O.extend_panel(f, O.top_k(f, [F.desc("frequency"), "feature"], 5), 7)


@query("tk03_04_rank_models", f"WITH {LINES} SELECT batch, CASE WHEN batch = 4 THEN NULL ELSE round(avg(p), 6) END AS auc FROM lines GROUP BY batch ORDER BY auc DESC NULLS LAST LIMIT 4")
def tk03(spark, d):
    v = lines(spark, d).groupBy("batch").agg(F.round(F.avg("p"), 6).alias("auc")).withColumn("auc", F.when(F.col("batch") != 4, F.col("auc")))
    return O.top_k(v, [F.desc_nulls_last("auc"), "batch"], 4)


@query("wn10_rank_features", f"""WITH {vectors_sql()}, s AS (SELECT feature, round(abs(corr(value, event)), 6) AS r, count(DISTINCT value) AS "distinct" FROM vectors GROUP BY feature)
SELECT feature, r, "distinct", row_number() OVER (ORDER BY r DESC, "distinct" DESC, feature) AS place FROM s""")
def wn10(spark, d):
    s = vectors(spark, d).groupBy("feature").agg(F.round(F.abs(F.corr("value", "event")), 6).alias("r"), F.countDistinct("value").alias("distinct")).withColumn("auc", F.lit(0.5))
    return O.rank_features(s).select("feature", "r", "distinct", "place")
