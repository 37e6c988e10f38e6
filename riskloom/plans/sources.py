"""SRC-*, SNK-*: reading with reconciled names."""

from pyspark.sql import functions as F

from riskloom.operators import contracts as C
from riskloom.operators import models as M
from riskloom.operators import solver as V
from riskloom.plans.bindings import LINES, lines, table
from riskloom.registry import query
from riskloom.sources import tables as T
from riskloom.sources.scratch import scratch_path


@query("src01_features", "SELECT o_orderkey AS id, o_custkey, o_totalprice FROM orders")
def src01(spark, d):
    return T.read_features(spark, f"{d}/orders.parquet", ["patient_id", "O-OrderKey"])


@query("src03_outcomes", "SELECT l_orderkey AS id, l_returnflag AS grade FROM lineitem")
def src03(spark, d):
    return T.read_outcomes(table(spark, d, "lineitem"), ["id", "l_orderkey"], "l_returnflag")


@query("src04_batch_metadata", "SELECT p_partkey AS id, concat(p_brand, '_', p_type) AS batch FROM part")
def src04(spark, d):
    return T.read_batch_metadata(table(spark, d, "part"), ["partkey", "p_partkey"], ["scanner"], ["Manufacturer", "p_brand"], ["p_type"])


@query("src05_keyed_json", "SELECT event_id, 'k' AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v FROM events")
def src05(spark, d):
    return T.read_keyed_json(table(spark, d, "events"), "props", "bigint", ("event_id",))


@query("snk05_resume_grid", f"WITH {LINES}, g AS (SELECT DISTINCT batch, qty FROM lines) SELECT batch, qty FROM g WHERE NOT (qty < 20 AND batch < 3)")
def snk05(spark, d):
    g = lines(spark, d).select("batch", "qty").distinct()
    return T.open_configurations(g, g.filter("qty < 20 and batch < 3"), ["batch", "qty"])


@query("src02_covariates", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer")
def src02(spark, d):
    path = scratch_path(spark, "covariates")
    c = table(spark, d, "customer")
    text = F.replace(F.format_string("%.2f", "c_acctbal"), F.lit("."), F.lit(","))
    T.write_table(c.select(F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("c_custkey"), "c_mktsegment", text.alias("c_acctbal")), path, "csv")
    return T.read_covariates(spark, path, ["c_mktsegment"], ["c_acctbal"], "c_custkey").withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("src06_json_config", f"WITH {LINES} SELECT round(least(max(qty), min(qty)), 6) AS low_threshold, round(greatest(max(qty), min(qty)), 6) AS high_threshold FROM lines")
def src06(spark, d):
    path = scratch_path(spark, "config")
    # written the wrong way round, read in order
    lines(spark, d).agg(F.round(F.max("qty"), 6).alias("low_threshold"), F.round(F.min("qty"), 6).alias("high_threshold")).coalesce(1).write.json(path)
    config = T.read_json_config(spark, path)
    return spark.createDataFrame([(config["low_threshold"], config["high_threshold"])], "low_threshold double, high_threshold double")


@query("src07_name_list", "SELECT n_name AS name FROM nation")
def src07(spark, d):
    path = scratch_path(spark, "names")
    table(spark, d, "nation").select(F.concat(F.lit("  "), "n_name", F.lit(" ")).alias("value")).coalesce(1).write.text(path)
    return spark.createDataFrame([(n,) for n in T.read_name_list(spark, path)], "name string")


@query("src08_latest_file", "SELECT count(*) AS n FROM region")
def src08(spark, d):
    path = scratch_path(spark, "runs")
    table(spark, d, "nation").coalesce(1).write.json(f"{path}/first")
    table(spark, d, "region").coalesce(1).write.json(f"{path}/second")
    return spark.read.json(T.latest_file(spark, f"{path}/*", "*.json")).agg(F.count(F.lit(1)).alias("n"))


@query("src09_entity_docs", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def src09(spark, d):
    path = scratch_path(spark, "entities")
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    # a file per entity, one of them without an id
    (n.unionByName(spark.range(1).select(F.lit(None).cast("long").alias("id"), F.lit("none").alias("name")))
     .withColumn("part", F.coalesce("id", F.lit(-1).cast("long"))).write.partitionBy("part").json(path))
    return T.read_entity_docs(spark, f"{path}/*", "id bigint, name string", "id")


@query("snk01_write_table", "SELECT s_suppkey, s_acctbal FROM supplier")
def snk01(spark, d):
    path = scratch_path(spark, "table")
    T.write_table(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), path)
    return spark.read.parquet(path)


@query("snk03_metrics_json", f"WITH {LINES} SELECT batch, CASE WHEN batch = 3 THEN NULL ELSE round(avg(p), 6) END AS auc FROM lines GROUP BY batch")
def snk03(spark, d):
    path = scratch_path(spark, "metrics")
    mean = F.round(F.avg("p"), 6)
    T.write_metrics_json(lines(spark, d).groupBy("batch").agg(F.when(F.col("batch") == 3, float("nan")).otherwise(mean).alias("auc")), path)
    return spark.read.schema("batch int, auc double").json(path)


@query("snk04_manifest", "SELECT 'orders' AS run, '7' AS seed, count(*) AS n FROM orders")
def snk04(spark, d):
    path = scratch_path(spark, "manifest")
    T.append_manifest(spark, path, "orders", {"seed": 7}, {"rows": table(spark, d, "orders").count()})
    return spark.read.parquet(path).select("run", F.col("parameters")["seed"].alias("seed"), F.col("counts")["rows"].alias("n"))


@query("chk01_require_columns", f"WITH {LINES} SELECT * FROM (SELECT 'event' AS name, count(event) AS known FROM lines UNION ALL SELECT 'disc', count(nullif(disc, 0)) FROM lines UNION ALL SELECT 'grading', NULL) AS c")
def chk01(spark, d):
    v = lines(spark, d).withColumn("disc", F.when(F.col("disc") > 0, F.col("disc")))
    C.require_columns(v, ["event", "disc"])
    return C.column_coverage(v, ["event", "disc", "grading"])


@query("snk07_model_table")
def snk07(spark, d):
    """A fit as a table, written, read back as a model and applied to the rows it was fitted on."""
    v = lines(spark, d).select("id", "event", F.array("q", F.col("disc") * 100).alias("features"))
    path = scratch_path(spark, "model")
    T.write_table(V.model_table(spark, "ridge", ["q", "scaled"], M.fit_logistic(v)), path)
    _, fit = V.model_from_table(spark.read.parquet(path), "ridge")
    return v.select("id", M.linear_p(fit).alias("p"))
