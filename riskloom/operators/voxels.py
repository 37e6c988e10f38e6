"""Imaging steps as table work on ``case, i, j, k, value, mask``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.aggregates import histogram


def nearest(voxels: DataFrame, coords: DataFrame, axis: str, world, target: str) -> DataFrame:
    """Index along ``axis`` nearest to a world coordinate, the first one on ties, per case and slice."""
    slots = voxels.select("case", "k", axis).distinct().join(coords, "case")
    key = F.struct(F.round(F.abs(world - F.col(target)), 9), F.col(axis))
    return slots.groupBy("case", "k").agg(F.min_by(axis, key).alias(f"b{axis}"))


def cut_region(voxels: DataFrame, coords: DataFrame, spacing: float = 1.0) -> DataFrame:
    """VX-01: mask voxels before the column cut, or after it from the row cut on up to the slice limit; with the share kept per case."""
    bi = nearest(voxels, coords, "i", F.col("i") * spacing, "x")
    bj = nearest(voxels, coords, "j", F.col("j") * spacing, "y")
    j = voxels.filter("mask = 1").join(bi, ["case", "k"]).join(bj, ["case", "k"]).join(coords.select("case", "z_limit"), "case")
    keep = (F.col("i") < F.col("bi")) | ((F.col("j") >= F.col("bj")) & (F.col("k") <= F.coalesce("z_limit", F.lit(1 << 30))))
    return j.groupBy("case").agg(F.count_if(keep).alias("kept"), F.count(F.lit(1)).alias("total"), (100.0 * F.count_if(keep) / F.count(F.lit(1))).alias("retention"))


def bounding_box(voxels: DataFrame, pad: int = 3) -> DataFrame:
    """VX-02: padded range of the mask, clipped to the volume."""
    shape = voxels.groupBy("case").agg(*[F.max(a).alias(f"s{a}") for a in "ijk"])
    box = voxels.filter("mask = 1").groupBy("case").agg(*[F.min(a).alias(f"lo{a}") for a in "ijk"], *[F.max(a).alias(f"hi{a}") for a in "ijk"])
    j = box.join(shape, "case")
    return j.select("case", *[F.greatest(F.col(f"lo{a}") - pad, F.lit(0)).alias(f"lo{a}") for a in "ijk"], *[F.least(F.col(f"hi{a}") + pad, F.col(f"s{a}")).alias(f"hi{a}") for a in "ijk"])


def crop(voxels: DataFrame, box: DataFrame, outside: float = -1024.0) -> DataFrame:
    """VX-02: voxels inside the box; those outside the mask get ``outside``."""
    j = voxels.join(box, "case").filter(" and ".join(f"{a} between lo{a} and hi{a}" for a in "ijk"))
    return j.select("case", *[(F.col(a) - F.col(f"lo{a}")).alias(a) for a in "ijk"], F.when(F.col("mask") == 1, F.col("value")).otherwise(outside).alias("value"), "mask")


def region_stats(voxels: DataFrame, voxel_ml: float = 0.001) -> DataFrame:
    """VX-03."""
    from riskloom.operators.order import exact_percentiles

    v, inside = F.col("value"), voxels.filter("mask = 1")
    sums = inside.groupBy("case").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * voxel_ml).alias("volume_ml"), F.min("i").alias("origin_i"),
    )
    return sums.join(exact_percentiles(inside, "value", {"median": 0.5, "p5": 0.05, "p95": 0.95}, ["case"]), "case", "left")


def axis_distribution(voxels: DataFrame, world) -> tuple[DataFrame, DataFrame]:
    """VX-04: spread of a world coordinate of the mask and its 20-bin histogram, per case."""
    x = voxels.filter("mask = 1").select("case", world.alias("x"))
    spread = x.groupBy("case").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.percentile("x", 0.5).alias("median"), F.stddev_pop("x").alias("sd"))
    return spread, histogram(x, "x", 20, "case")


def slice_bounds(voxels: DataFrame) -> DataFrame:
    """VX-05: first, last and centre slice with mask; zeros where there is none."""
    k = F.when(F.col("mask") == 1, F.col("k"))
    b = voxels.groupBy("case").agg(F.coalesce(F.min(k), F.lit(0)).alias("first"), F.coalesce(F.max(k), F.lit(0)).alias("last"))
    return b.withColumn("centre", F.floor((F.col("first") + F.col("last")) / 2).cast("int"))


def limit_impact(voxels: DataFrame, z: int) -> DataFrame:
    """VX-06."""
    m = voxels.filter("mask = 1")
    return m.groupBy("case").agg(F.count_if(F.col("k") <= z).alias("preserved"), F.count_if(F.col("k") > z).alias("cut"), (F.count_if(F.col("k") > z) / F.count(F.lit(1))).alias("rate"))


def grid_match(a: DataFrame, b: DataFrame, atol: float = 1e-5, rtol: float = 1e-3) -> DataFrame:
    """VX-07: shape and affine entries of two volumes agree; input ``case, shape array, affine array``."""
    j = a.join(b.select("case", F.col("shape").alias("shape_b"), F.col("affine").alias("affine_b")), "case")
    close = F.forall(F.arrays_zip("affine", "affine_b"), lambda s: F.abs(s["affine"] - s["affine_b"]) <= atol + rtol * F.abs(s["affine_b"]))
    return j.select("case", ((F.col("shape") == F.col("shape_b")) & close).alias("match"))


