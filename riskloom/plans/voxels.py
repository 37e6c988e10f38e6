"""VX-*: the voxel table derived from order lines."""

from pyspark.sql import functions as F

from riskloom.operators import voxels as V
from riskloom.plans.bindings import VOXELS, r6, voxels
from riskloom.registry import query


def coords(spark, d):
    return voxels(spark, d).groupBy("case").agg((F.min("case") + 4.5).alias("x"), (F.min("case") + 3.2).alias("y"), (F.min("case") + 6).cast("int").alias("z_limit"))


@query("vx01_cut_region", f"""WITH {VOXELS}, c AS (SELECT "case", "case" + 4.5 AS x, "case" + 3.2 AS y, "case" + 6 AS z FROM voxels GROUP BY "case"),
bi AS (SELECT "case", k, arg_min(i, (round(abs(i - x), 9), i)) AS bi FROM voxels JOIN c USING ("case") GROUP BY ALL), bj AS (SELECT "case", k, arg_min(j, (round(abs(j - y), 9), j)) AS bj FROM voxels JOIN c USING ("case") GROUP BY ALL)
SELECT "case", count(*) FILTER (WHERE i < bi OR (j >= bj AND k <= z)) AS kept, count(*) AS total, round(100.0 * count(*) FILTER (WHERE i < bi OR (j >= bj AND k <= z)) / count(*), 6) AS retention
FROM voxels JOIN bi USING ("case", k) JOIN bj USING ("case", k) JOIN c USING ("case") WHERE mask = 1 GROUP BY "case" """)
def vx01(spark, d):
    return V.cut_region(voxels(spark, d), coords(spark, d)).withColumn("retention", F.round("retention", 6))


@query("vx02_bounding_box", f"""WITH {VOXELS}, s AS (SELECT "case", max(i) AS si, max(j) AS sj, max(k) AS sk FROM voxels GROUP BY "case"), b AS (SELECT "case", min(i) AS li, min(j) AS lj, min(k) AS lk, max(i) AS hi, max(j) AS hj, max(k) AS hk FROM voxels WHERE mask = 1 GROUP BY "case")
SELECT "case", greatest(li - 3, 0) AS loi, greatest(lj - 3, 0) AS loj, greatest(lk - 3, 0) AS lok, least(hi + 3, si) AS hii, least(hj + 3, sj) AS hij, least(hk + 3, sk) AS hik FROM b JOIN s USING ("case")""")
def vx02(spark, d):
    return V.bounding_box(voxels(spark, d))


@query("vx02_crop", f"""WITH {VOXELS}, m AS (SELECT "case", i, j, k, value, CAST(mask = 1 AND i BETWEEN 4 AND 9 AND j BETWEEN 3 AND 12 AND k BETWEEN 5 AND 8 AS INT) AS mask FROM voxels),
b AS (SELECT "case", greatest(min(i) - 2, 0) AS li, greatest(min(j) - 2, 0) AS lj, greatest(min(k) - 2, 0) AS lk, max(i) + 2 AS hi, max(j) + 2 AS hj, max(k) + 2 AS hk FROM m WHERE mask = 1 GROUP BY "case")
SELECT "case", i - li AS i, j - lj AS j, k - lk AS k, CASE WHEN mask = 1 THEN value ELSE -1024.0 END AS value, mask FROM m JOIN b USING ("case") WHERE i BETWEEN li AND hi AND j BETWEEN lj AND hj AND k BETWEEN lk AND hk""")
def vx02c(spark, d):
    inner = F.expr("mask = 1 AND i BETWEEN 4 AND 9 AND j BETWEEN 3 AND 12 AND k BETWEEN 5 AND 8").cast("int")
    v = voxels(spark, d).withColumn("mask", inner)
    return V.crop(v, V.bounding_box(v, 2))


@query("vx03_region_stats", f"""WITH {VOXELS} SELECT "case", round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.05), 6) AS p5,
  round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n, round(count(*) * 0.001, 6) AS volume_ml, min(i) AS origin_i FROM voxels WHERE mask = 1 GROUP BY "case" """)
def vx03(spark, d):
    return V.region_stats(voxels(spark, d)).select("case", r6("mean", "mean"), r6("sd", "sd"), "low", "high", r6("median", "median"), r6("p5", "p5"), r6("p95", "p95"), "n", r6("volume_ml", "volume_ml"), "origin_i")


@query("vx04_axis_histogram", f"""WITH {VOXELS}, x AS (SELECT "case", i * 0.5 - 3.0 AS x FROM voxels WHERE mask = 1), e AS (SELECT "case", min(x) AS lo, max(x) AS hi FROM x GROUP BY "case")
SELECT "case", CAST(least(floor((x - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM x JOIN e USING ("case") GROUP BY ALL""")
def vx04(spark, d):
    return V.axis_distribution(voxels(spark, d), F.col("i") * 0.5 - 3.0)[1]


@query("vx05_slice_bounds", f"""WITH {VOXELS}, b AS (SELECT "case", min(k) FILTER (WHERE mask = 1) AS f, max(k) FILTER (WHERE mask = 1) AS l FROM voxels GROUP BY "case") SELECT "case", coalesce(f, 0) AS first, coalesce(l, 0) AS last, CAST(floor((coalesce(f, 0) + coalesce(l, 0)) / 2) AS INT) AS centre FROM b""")
def vx05(spark, d):
    return V.slice_bounds(voxels(spark, d))


@query("vx06_limit_impact", f"""WITH {VOXELS} SELECT "case", count(*) FILTER (WHERE k <= 9) AS preserved, count(*) FILTER (WHERE k > 9) AS cut, round(count(*) FILTER (WHERE k > 9) / count(*), 6) AS rate FROM voxels WHERE mask = 1 GROUP BY "case" """)
def vx06(spark, d):
    return V.limit_impact(voxels(spark, d), 9).withColumn("rate", F.round("rate", 6))


_GRID = """SELECT "case", max(i) AS i, max(j) AS j, max(k) AS k, avg(i) AS x, avg(j) AS y, avg(k) AS z FROM voxels"""


@query("vx07_grid_match", f"""WITH {VOXELS}, a AS ({_GRID} GROUP BY "case"), b AS ({_GRID} WHERE mask = 1 GROUP BY "case")
SELECT a."case", a.i = b.i AND a.j = b.j AND a.k = b.k AND abs(a.x - b.x) <= 1e-5 + 0.005 * abs(b.x) AND abs(a.y - b.y) <= 1e-5 + 0.005 * abs(b.y) AND abs(a.z - b.z) <= 1e-5 + 0.005 * abs(b.z) AS match FROM a JOIN b ON a."case" = b."case" """)
def vx07(spark, d):
    """The grid of all voxels of a case against that of its mask: far ends and centres."""
    grid = lambda v: v.groupBy("case").agg(F.array(F.max("i"), F.max("j"), F.max("k")).alias("shape"), F.array(F.avg("i"), F.avg("j"), F.avg("k")).alias("affine"))
    v = voxels(spark, d)
    return V.grid_match(grid(v), grid(v.filter("mask = 1")), rtol=0.005)
