"""CHK-*: contracts over orders, lines and people."""

from pyspark.sql import functions as F

from riskloom.functions import scalars as S
from riskloom.operators import contracts as C
from riskloom.plans.bindings import LABELLED, LINES, PEOPLE, labelled, lines, people, table
from riskloom.registry import query


@query("chk02_bad_ids", f"WITH {PEOPLE} SELECT name FROM people WHERE name IS NULL OR NOT regexp_full_match(name, 'Customer#0000000[0-4][0-9]')")
def chk02(spark, d):
    return C.bad_ids(people(spark, d), "name", "Customer#0000000[0-4][0-9]")


@query("chk03_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def chk03(spark, d):
    return C.duplicate_keys(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("chk04_counts", f"WITH {LABELLED} SELECT count(*) AS n_rows, CAST(sum(event) AS BIGINT) AS n_events FROM labelled")
def chk04(spark, d):
    return C.count_mismatch(labelled(spark, d), "event", -1, -1)


@query("chk05_incomplete", f"""WITH {LINES} SELECT 'disc' AS name, count(*) FILTER (WHERE disc = 0) AS bad FROM lines UNION ALL SELECT 'qty', count(*) FILTER (WHERE qty > 45) FROM lines""")
def chk05(spark, d):
    v = lines(spark, d).select("price", F.when(F.col("disc") > 0, F.col("disc")).alias("disc"), F.when(F.col("qty") > 45, float("nan")).otherwise(F.col("qty")).alias("qty"))
    return C.incomplete_columns(v, ["price", "disc", "qty"])


@query("chk06_label_conflicts", f"WITH {LABELLED} SELECT id, event AS a, 1 - quality AS b FROM labelled WHERE event <> 1 - quality")
def chk06(spark, d):
    v = labelled(spark, d)
    return C.label_conflicts(v.select("id", "event"), v.select("id", (1 - F.col("quality")).alias("event")), "id", "event")


@query("chk07_single_class", f"WITH {LINES} SELECT day, count(DISTINCT event) AS classes FROM lines GROUP BY day HAVING count(DISTINCT event) < 2")
def chk07(spark, d):
    return C.class_counts(lines(spark, d), "event", "day")


@query("chk08_cardinality", "SELECT o_custkey, count(*) AS n, 'left' AS side FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def chk08(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return C.cardinality_violations(table(spark, d, "orders"), c, "o_custkey")


@query("chk09_unknown_batches", f"WITH {PEOPLE} SELECT DISTINCT nation FROM people WHERE nation NOT IN (SELECT n_name FROM nation WHERE n_nationkey < 15)")
def chk09(spark, d):
    known = table(spark, d, "nation").filter("n_nationkey < 15").select(F.col("n_name").alias("nation"))
    return C.unknown_batches(people(spark, d), known, "nation")


@query("chk10_availability", f"""WITH {LABELLED}, v AS (SELECT CASE WHEN score > 1000 THEN score END AS a, CASE WHEN lang = 'en' THEN lang END AS b FROM labelled)
SELECT 'a' AS spec, count(a) AS complete FROM v UNION ALL SELECT 'both', count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) FROM v""")
def chk10(spark, d):
    v = labelled(spark, d).select(F.when(F.col("score") > 1000, F.col("score")).alias("a"), F.when(F.col("lang") == "en", F.col("lang")).alias("b"))
    return C.availability(v, {"a": ["a"], "both": ["a", "b"]})


@query("chk11_alignment", f"""WITH {PEOPLE} SELECT count(*) AS left_ids, count(*) FILTER (WHERE id % 3 = 0) AS "exact", count(*) FILTER (WHERE id % 3 = 1) AS canonical,
  count(*) FILTER (WHERE id % 3 = 2) AS unmatched, count(*) FILTER (WHERE id % 3 < 2) AS right_ids FROM people""")
def chk11(spark, d):
    p = people(spark, d)
    right = p.filter("id % 3 < 2").select(F.when(F.col("id") % 3 == 0, F.col("name")).otherwise(F.upper("name")).alias("name"))
    return C.alignment_report(p.select("name"), right, "name", S.canonical_id)
