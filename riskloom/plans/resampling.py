"""SP-*: splits and resamples."""

from pyspark.sql import functions as F

from riskloom.operators import resample as R
from riskloom.plans.bindings import LABELLED, LINES, labelled, lines, table
from riskloom.registry import query


def _pos(seed: str, by: str = "event", reps: str = "") -> str:
    extra = f"|', rep, '|" if reps else "|"
    return f"row_number() OVER (PARTITION BY {reps}{by} ORDER BY md5(concat('{seed}', '{extra}', id)), CAST(id AS VARCHAR)) - 1"


@query("sp01_stratified_kfold", f"WITH {LABELLED} SELECT id, event, CAST(({_pos('7')}) % 5 AS INT) AS fold FROM labelled")
def sp01(spark, d):
    return R.stratified_kfold(labelled(spark, d), "id", "event", 5, 7)


@query("sp02_repeated_kfold", f"WITH {LABELLED}, r AS (SELECT CAST(range AS INT) AS rep FROM range(3)) SELECT rep, id, event, CAST(({_pos('7', reps='rep, ')}) % 4 AS INT) AS fold FROM labelled, r")
def sp02(spark, d):
    return R.repeated_kfold(labelled(spark, d), "id", "event", 4, 3, 7)


@query("sp03_group_kfold")
def sp03(spark, d):
    return R.stratified_group_kfold(table(spark, d, "lineitem").withColumn("event", (F.col("l_returnflag") == "R").cast("int")), "l_suppkey", "event", 5)


@query("sp04_holdout", f"""WITH {LABELLED}, r AS (SELECT CAST(range AS INT) AS rep FROM range(3)), p AS (SELECT rep, id, event, {_pos('h', reps='rep, ')} AS pos, count(*) OVER (PARTITION BY rep, event) AS n FROM labelled, r)
SELECT rep, id, event FROM p WHERE pos < round(0.3 * n)""")
def sp04(spark, d):
    return R.stratified_holdout(labelled(spark, d), "id", "event", 0.3, 3, "h")


@query("sp05_leave_one_group_out", f"WITH {LINES} SELECT batch, row_number() OVER (ORDER BY batch) - 1 AS fold FROM (SELECT DISTINCT batch FROM lines)")
def sp05(spark, d):
    return R.leave_one_group_out(lines(spark, d), "batch")


@query("sp06_temporal_holdout", "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor(0.75 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS part FROM orders")
def sp06(spark, d):
    return R.temporal_holdout(table(spark, d, "orders"), "o_orderkey", "o_orderdate", 0.25).select("o_orderkey", "part")


@query("sp07_domain_holdout", f"WITH {LINES}, t AS (SELECT batch FROM lines GROUP BY batch ORDER BY count(*) DESC, batch LIMIT 1) SELECT id, CASE WHEN batch = (SELECT batch FROM t) THEN 'train' ELSE 'test' END AS part FROM lines")
def sp07(spark, d):
    return R.domain_holdout(lines(spark, d), "batch").select("id", "part")


BOOT = f"""r AS (SELECT CAST(range AS INT) AS rep FROM range(4)), o AS (SELECT id, event, score, {_pos('b')} AS pos, count(*) OVER (PARTITION BY event) AS n FROM labelled),
w AS (SELECT rep, event, CAST(concat('0x', substr(md5(concat('b|', rep, '|', event, '|', pos)), 1, 8)) AS BIGINT) % n AS pos, count(*) AS weight FROM o, r GROUP BY ALL),
boot AS (SELECT r.rep, o.id, o.event, o.score, CAST(coalesce(w.weight, 0) AS INT) AS weight FROM o CROSS JOIN r LEFT JOIN w ON w.rep = r.rep AND w.event = o.event AND w.pos = o.pos)"""


@query("sp08_bootstrap_weights", f"WITH {LABELLED}, {BOOT} SELECT rep, id, event, weight FROM boot")
def sp08(spark, d):
    return R.bootstrap_weights(labelled(spark, d), "id", "event", 4, "b")


@query("sp08_valid_replicates", f"WITH {LABELLED}, {BOOT} SELECT rep, count(*) FILTER (WHERE weight = 0) AS oob FROM boot GROUP BY rep HAVING count(*) FILTER (WHERE weight = 0) >= 10 AND count(DISTINCT event) FILTER (WHERE weight = 0) = 2 AND count(DISTINCT event) FILTER (WHERE weight > 0) = 2")
def sp08v(spark, d):
    return R.valid_replicates(R.bootstrap_weights(labelled(spark, d), "id", "event", 4, "b"), "event")


@query("sp09_poisson_weights", f"""WITH {LINES}, r AS (SELECT CAST(range AS INT) AS rep FROM range(3)), u AS (SELECT rep, id, CAST(CAST(concat('0x', substr(md5(concat('s|', rep, '|', id)), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM lines, r)
SELECT rep, id, CAST(CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.9810118431238462 THEN 3 WHEN u < 0.9963401531726563 THEN 4 WHEN u < 0.9994058151824183 THEN 5 WHEN u < 0.9999167588507119 THEN 6 WHEN u < 0.9999897508033253 THEN 7 ELSE 8 END AS INT) AS weight FROM u""")
def sp09(spark, d):
    return R.poisson_bootstrap_weights(lines(spark, d).select("id"), "id", 3, "s")


@query("sp10_subsample", f"""WITH {LABELLED}, r AS (SELECT CAST(range AS INT) AS rep FROM range(3)), p AS (SELECT rep, id, event, {_pos('u', reps='rep, ')} AS pos, count(*) OVER (PARTITION BY rep, event) AS n FROM labelled, r),
s AS (SELECT rep, id, event FROM p WHERE pos < ceil(0.75 * n)) SELECT rep, id, event, round(count(*) OVER (PARTITION BY rep) / (2 * count(*) OVER (PARTITION BY rep, event)), 6) AS balance FROM s""")
def sp10(spark, d):
    return R.subsample(labelled(spark, d), "id", "event", 0.75, 3, "u").withColumn("balance", F.round("balance", 6))


@query("sp11_permuted_labels", f"WITH {LABELLED}, r AS (SELECT CAST(range AS INT) AS rep FROM range(3)) SELECT rep, id, CAST({_pos('x', by='1', reps='rep, ')} < (SELECT sum(event) FROM labelled) AS INT) AS permuted FROM labelled, r")
def sp11(spark, d):
    return R.permute_labels(labelled(spark, d), "id", "event", 3, "x")
