"""SM-*: batch twins of the streaming operators; tests run the streams against them."""

import numpy as np
from pyspark.sql import functions as F

from riskloom.operators import harmonize as H
from riskloom.operators import solver as V
from riskloom.operators.joins import to_long
from riskloom.plans.bindings import lines, r6, table
from riskloom.registry import query
from riskloom.sources.scratch import scratch_path
from riskloom.streaming import operators as SM
from riskloom.streaming import scoring as SC


def events(spark, d):
    return table(spark, d, "events")


@query("sm01_score_rows", "SELECT event_id, round(value / (value + 5), 6) AS p, CASE WHEN value / (value + 5) < 0.3 THEN 'low' WHEN value / (value + 5) < 0.6 THEN 'intermediate' ELSE 'high' END AS risk FROM events")
def sm01(spark, d):
    return SM.score_rows(events(spark, d), F.col("value") / (F.col("value") + 5), 0.3, 0.6).select("event_id", r6("p", "p"), "risk")


@query("sm02_changed_only", "SELECT event_id, user_id, event_type FROM events QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type")
def sm02(spark, d):
    return SM.changed_only_batch(events(spark, d), "user_id", ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


@query("sm01_score_chain")
def sm01c(spark, d):
    """Order lines through a published release: harmonised by batch, a linear model, a sigmoid calibrator, three groups."""
    v = lines(spark, d)
    long = to_long(v, ["id", "batch"], ["qty", "tax"])
    store = scratch_path(spark, "releases")
    model = V.model_table(spark, "m", ["qty", "tax"], {"intercept": -0.4, "coef": np.array([0.3, -0.2]), "mean": np.array([25.0, 0.04]), "sd": np.array([14.0, 0.02])})
    SC.publish(spark, store, 1, model, H.combat_fit(long.filter("batch < 5"), shrink=False), {"type": "sigmoid", "intercept": 0.1, "slope": 0.9}, 0.35, 0.45)
    rows = v.select("id", "batch", F.create_map(F.lit("qty"), "qty", F.lit("tax"), "tax").alias("features"))
    return SC.score_release(rows, SC.newest(spark, store))


@query("sm02_changed_or_stale", "SELECT event_id, user_id, event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY lag(event_type) OVER w IS DISTINCT FROM event_type OR epoch_ms(ts) - epoch_ms(lag(ts) OVER w) > 7200000")
def sm02t(spark, d):
    return SM.changed_only_batch(events(spark, d), "user_id", ["ts", "event_id"], ["event_type"], "2 hours", "ts").select("event_id", "user_id", "event_type")


@query("sm03_suppress_active", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 9)")
def sm03(spark, d):
    e = events(spark, d)
    return SM.suppress_active(e.select("event_id", "user_id"), e.filter("event_type = 'error' and value > 9"), "user_id")


@query("sm04_latest_state", "SELECT user_id, event_type, max_by(value, ts) AS value, count(*) AS n FROM events GROUP BY ALL")
def sm04(spark, d):
    return SM.latest_state(events(spark, d), ["user_id", "event_type"], "ts", "value")


@query("sm06_monitor_window", """WITH v AS (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, value / (value + 5) AS p FROM events)
SELECT start, count(*) AS n, round(avg(p), 6) AS mean_risk, round(avg(CAST(p < 0.3 AS INT)), 6) AS share_low, round(avg(CAST(p >= 0.3 AND p < 0.6 AS INT)), 6) AS share_intermediate, round(avg(CAST(p >= 0.6 AS INT)), 6) AS share_high FROM v GROUP BY start""")
def sm06(spark, d):
    w = SM.monitor_window(events(spark, d).withColumn("p", F.col("value") / (F.col("value") + 5)), "ts", "6 hours", "p", 0.3, 0.6)
    return w.select("start", "n", *[r6(c, c) for c in ("mean_risk", "share_low", "share_intermediate", "share_high")])


@query("sm07_dedup", "SELECT DISTINCT user_id FROM events")
def sm07(spark, d):
    return SM.dedup_stream(events(spark, d), "user_id", "ts").select("user_id")
