"""JN-*, PRD-*, SO-*: joins, predicates and set operations."""

from pyspark.sql import functions as F

from riskloom.functions import scalars as S
from riskloom.operators import joins as J
from riskloom.plans.bindings import LABELLED, LINES, PEOPLE, labelled, lines, people, r6, table, vectors, vectors_sql
from riskloom.registry import query


@query("jn01_one_to_one", """SELECT o_orderkey, o_custkey, o_totalprice, o_totalprice * 2 AS o_totalprice_right FROM orders""")
def jn01(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return J.join_one_to_one(o, o.select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice")), "o_orderkey")


@query("jn02_outcomes", f"WITH {LINES} SELECT id, qty, grade FROM lines WHERE batch <> 3")
def jn02(spark, d):
    v = lines(spark, d)
    return J.join_outcomes(v.select("id", "qty"), v.filter("batch <> 3"), "id", "grade")[0]


@query("snk02_rejects", f"WITH {LINES} SELECT id FROM lines WHERE batch = 3")
def snk02(spark, d):
    v = lines(spark, d)
    return J.join_outcomes(v.select("id", "qty"), v.filter("batch <> 3"), "id", "grade")[1]


@query("jn03_exact_then_canonical", f"""WITH {PEOPLE} SELECT name, CASE WHEN id % 3 < 2 THEN segment END AS segment, CASE id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'canonical' ELSE 'none' END AS match FROM people""")
def jn03(spark, d):
    p = people(spark, d)
    right = p.filter("id % 3 < 2").select(F.when(F.col("id") % 3 == 0, F.col("name")).otherwise(F.upper(F.replace("name", F.lit("#"), F.lit(" ")))).alias("name"), "segment", "id")
    return J.join_exact_then_canonical(p.select("name"), right, "name", "segment", S.canonical_id, "id")


@query("jn04_map_ids", f"""WITH {PEOPLE} SELECT segment, concat('P', id + 1) AS pseudonym FROM people""")
def jn04(spark, d):
    p = people(spark, d)
    mapping = p.select("name", F.concat(F.lit("P"), F.col("id")).alias("pseudonym"), F.lit(0).alias("o")).union(p.select("name", F.concat(F.lit("P"), F.col("id") + 1), F.lit(1)))
    return J.map_ids(p.select("name", "segment"), mapping, "name", "pseudonym", "o")


@query("jn05_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def jn05(spark, d):
    return J.semi_join(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


@query("jn06_anti", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn06(spark, d):
    return J.anti_join(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


@query("jn07_batch_labels", f"WITH {PEOPLE} SELECT id, CASE WHEN id % 4 = 0 THEN 'UNKNOWN' ELSE nation END AS nation FROM people")
def jn07(spark, d):
    p = people(spark, d)
    return J.join_batch_labels(p.select("id"), p.filter("id % 4 <> 0"), "id", "nation", "UNKNOWN")


@query("jn08_paired", f"WITH {LINES} SELECT id, event, p AS a, q AS b FROM lines WHERE batch <> 2")
def jn08(spark, d):
    v = lines(spark, d)
    other = v.select("id", F.when(F.col("batch") == 2, 1 - F.col("event")).otherwise(F.col("event")).alias("event"), F.col("q").alias("p"))
    return J.join_paired_predictions(v, other, "id", "event", "p")


_STATS = "b AS (SELECT batch, avg(qty) AS m, stddev_pop(qty) AS s FROM lines WHERE batch < 5 GROUP BY batch), g AS (SELECT avg(qty) AS m, stddev_pop(qty) AS s FROM lines)"


@query("jn09_broadcast_stats", f"WITH {LINES}, {_STATS} SELECT id, round((qty - coalesce(b.m, g.m)) / coalesce(b.s, g.s), 6) + 0.0 AS z FROM lines LEFT JOIN b USING (batch), g")
def jn09(spark, d):
    v = lines(spark, d).select("id", "batch", F.lit("qty").alias("feature"), F.col("qty").alias("value"))
    stats = v.filter("batch < 5").groupBy("batch", "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    overall = v.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return J.broadcast_stats(v, stats, overall).select("id", r6("z", "z"))


@query("jn10_grid_pairs", "SELECT a.n_name AS a, b.n_name AS b, r_name FROM nation a JOIN nation b ON a.n_name < b.n_name CROSS JOIN region")
def jn10(spark, d):
    return J.cross_grid(J.pairs(table(spark, d, "nation"), "n_name"), table(spark, d, "region").select("r_name"))


@query("jn11_interpolation", f"""WITH {LINES} SELECT id, round(CASE WHEN q <= 0.1 THEN 0.05 WHEN q < 0.4 THEN 0.05 + (q - 0.1) * ((0.2 - 0.05) / (0.4 - 0.1)) WHEN q < 0.9 THEN 0.2 + (q - 0.4) * ((0.8 - 0.2) / (0.9 - 0.4)) ELSE 0.8 END, 6) AS y FROM lines""")
def jn11(spark, d):
    points = spark.createDataFrame([(0.1, 0.05), (0.4, 0.2), (0.9, 0.8)], "x double, y double")
    return J.interp(lines(spark, d), "q", points).select("id", r6("y", "y"))


@query("jn13_extra_docs", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'Unknown' END AS event_type FROM events")
def jn13(spark, d):
    e = table(spark, d, "events")
    return J.join_extra_docs(e.select("event_id"), e.filter("event_id % 3 = 0"), "event_id", "event_type")


@query("prd01_report", f"WITH {LABELLED} SELECT count(*) FILTER (WHERE quality = 1) AS kept, count(*) FILTER (WHERE quality IS DISTINCT FROM 1) AS dropped FROM labelled")
def prd01r(spark, d):
    flags = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, " Yes").otherwise("no").alias("flag"))
    return J.flagged_report(labelled(spark, d).select("id", "score"), flags, "id", "flag")


@query("prd01_flagged", f"WITH {LABELLED} SELECT id, score FROM labelled WHERE quality = 1")
def prd01(spark, d):
    flags = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, " Yes").otherwise("no").alias("flag"))
    return J.filter_flagged(labelled(spark, d).select("id", "score"), flags, "id", "flag")


@query("prd02_complete_case", f"WITH {LABELLED} SELECT id FROM labelled WHERE lang <> 'en' AND score > 500")
def prd02(spark, d):
    v = labelled(spark, d).select("id", F.when(F.col("lang") != "en", F.col("lang")).alias("a"), F.when(F.col("score") > 500, F.col("score")).alias("b"))
    return J.complete_case(v, ["a", "b"]).select("id")


@query("prd03_one_subject", "SELECT event_id, user_id, value FROM events WHERE user_id = 8")
def prd03(spark, d):
    return J.filter_id(table(spark, d, "events").select("event_id", "user_id", "value"), "user_id", 8)


@query("prd04_first_ids", "SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 25")
def prd04(spark, d):
    return J.cap_rows(table(spark, d, "orders"), "o_custkey", 25)


@query("so01_union_by_name", f"WITH {LINES} SELECT id, p, NULL AS q, 'p' AS model FROM lines UNION ALL SELECT id, NULL, q, 'q' FROM lines")
def so01(spark, d):
    v = lines(spark, d)
    return J.union_all_keys([v.select("id", "p", F.lit("p").alias("model")), v.select("id", "q", F.lit("q").alias("model"))]).select("id", "p", "q", "model")


@query("so02_common_names", "SELECT url, page_id FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 2 = 0)")
def so02(spark, d):
    v = table(spark, d, "pages").select("url", "page_id")
    return J.common_names(v, v.filter("page_id % 2 = 0"), "url", "page_id")


@query("so03_missing_names", "SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)")
def so03(spark, d):
    v = table(spark, d, "pages").select("url", "page_id")
    return J.missing_names(v.select("url").distinct(), v.filter("page_id % 2 = 0").select("url").distinct(), "url")


@query("so04_candidates", f"WITH {LINES} SELECT DISTINCT q AS t FROM (SELECT q FROM lines UNION ALL SELECT 0.0 UNION ALL SELECT 1.0)")
def so04(spark, d):
    return J.candidate_thresholds(lines(spark, d), "q")


_NAMES = [f"f{i}" for i in range(64)]


@query("so05_long_wide", f"""WITH {vectors_sql()} SELECT id, {", ".join(f"max(value) FILTER (WHERE feature = {i}) AS {n}" for i, n in enumerate(_NAMES))} FROM vectors GROUP BY id""")
def so05(spark, d):
    wide = J.to_wide(vectors(spark, d), ["id"], "feature", "value", list(range(64))).toDF("id", *_NAMES)
    return J.to_wide(J.to_long(wide, ["id"], _NAMES), ["id"], "feature", "value", _NAMES)
