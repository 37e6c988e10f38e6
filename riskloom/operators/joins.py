"""Joins, row predicates and set operations."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.operators.contracts import ContractError, cardinality_violations, enforce

#: Largest side that is broadcast by hint; beyond it Spark's own choice holds.
BROADCAST_ROWS = 200_000
#: Most breakpoints of a curve, and most that become one expression.
BREAKPOINTS, INLINE = 1_000_000, 32


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_one_to_one(a: DataFrame, b: DataFrame, key: str, suffix: str = "_right", check: bool = True) -> DataFrame:
    """JN-01: inner join of unique keys; clashing names of ``b`` get a suffix."""
    if check:
        enforce(cardinality_violations(a, b, key), "join is not one to one")
    clash = [c for c in b.columns if c != key and c in a.columns]
    return a.join(b.withColumnsRenamed({c: c + suffix for c in clash}), key)


def join_outcomes(features: DataFrame, outcomes: DataFrame, key: str, grade: str) -> tuple[DataFrame, DataFrame]:
    """JN-02: matched rows, and the ids without an outcome."""
    joined = features.join(outcomes.select(key, grade), key, "left")
    return joined.filter(F.col(grade).isNotNull()), joined.filter(F.col(grade).isNull()).select(key)


def first_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """WN-08: first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def join_exact_then_canonical(a: DataFrame, b: DataFrame, key: str, value: str, canonical, order: str) -> DataFrame:
    """JN-03: exact match first; rows left over are tried on the canonical key.

    ``b`` counts with its first row (by ``order``) per key and per canonical key.
    """
    exact = first_per_key(b, [key], [F.col(order)]).select(key, F.col(value).alias("_exact"), F.lit(1).alias("_hit"))
    keyed = b.withColumn("_c", canonical(F.col(key))).filter("_c <> ''")
    loose = first_per_key(keyed, ["_c"], [F.col(order)]).select("_c", F.col(value).alias("_loose"), F.lit(1).alias("_near"))
    joined = a.join(exact, key, "left").withColumn("_c", F.when(F.col("_hit").isNull(), canonical(F.col(key)))).join(loose, "_c", "left")
    kind = F.when(F.col("_hit").isNotNull(), "exact").when(F.col("_near").isNotNull(), "canonical").otherwise("none")
    return joined.withColumn("match", kind).withColumn(value, F.coalesce("_exact", "_loose")).drop("_c", "_exact", "_loose", "_hit", "_near")


def map_ids(df: DataFrame, mapping: DataFrame, key: str, new: str, order: str) -> DataFrame:
    """JN-04: pseudonyms by lookup; the last mapping row of a key wins; unmapped rows are an error."""
    last = first_per_key(mapping, [key], [F.col(order).desc()]).select(key, new)
    joined = df.join(small(last), key, "left")
    enforce(joined.filter(F.col(new).isNull()).select(key), "ids without a pseudonym")
    return joined.drop(key)


def semi_join(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """JN-05."""
    return df.join(ids.select(key), key, "left_semi")


def anti_join(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """JN-06."""
    return df.join(ids.select(key), key, "left_anti")


def join_batch_labels(df: DataFrame, meta: DataFrame, key: str, batch: str, missing: str = "drop") -> DataFrame:
    """JN-07: ``missing`` is ``drop``, ``error`` or a label."""
    joined = df.join(meta.select(key, batch), key, "left")
    if missing == "drop":
        return joined.filter(F.col(batch).isNotNull())
    if missing == "error":
        enforce(joined.filter(F.col(batch).isNull()).select(key), "rows without a batch")
        return joined
    return joined.withColumn(batch, F.coalesce(batch, F.lit(missing)))


def join_paired_predictions(a: DataFrame, b: DataFrame, key: str, event: str, score: str) -> DataFrame:
    """JN-08: scores of two models side by side; rows whose labels disagree go."""
    left = a.select(key, F.col(event).alias(event), F.col(score).alias("a"))
    right = b.select(key, F.col(event).alias("_event"), F.col(score).alias("b"))
    return left.join(right, key).filter(F.col(event) == F.col("_event")).drop("_event")


def broadcast_stats(long: DataFrame, stats: DataFrame, overall: DataFrame, value: str = "value") -> DataFrame:
    """JN-09: z-scores by (batch, feature), from the feature's overall figures where a batch is unknown.

    ``stats`` has ``batch, feature, mean, sd``; ``overall`` has ``feature, mean, sd``.
    """
    own = stats.select("batch", "feature", F.col("mean").alias("_m"), F.col("sd").alias("_s"))
    all_ = overall.select("feature", F.col("mean").alias("_gm"), F.col("sd").alias("_gs"))
    joined = long.join(small(own), ["batch", "feature"], "left").join(small(all_), "feature", "left")
    z = (F.col(value) - F.coalesce("_m", "_gm")) / F.coalesce("_s", "_gs")
    return joined.withColumn("z", z).drop("_m", "_s", "_gm", "_gs")


#: Largest parameter table whose combinations are formed.
GRID_ROWS = 10_000


def _few(df: DataFrame) -> DataFrame:
    if df.limit(GRID_ROWS + 1).count() > GRID_ROWS:
        raise ContractError(f"combinations are for parameter tables of at most {GRID_ROWS} rows")
    return df


def cross_grid(a: DataFrame, b: DataFrame) -> DataFrame:
    """JN-10: all combinations of two parameter tables; a larger second one is an error."""
    return a.crossJoin(F.broadcast(_few(b)))


def pairs(df: DataFrame, col: str) -> DataFrame:
    """JN-10: all pairs a < b of the values of a parameter table; a larger one is an error."""
    df = _few(df)
    a, b = df.select(F.col(col).alias("a")), df.select(F.col(col).alias("b"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b"))


def interp(df: DataFrame, x: str, points: DataFrame, out: str = "y") -> DataFrame:
    """JN-11: piecewise-linear interpolation on sorted ``points(x, y)``, ends clipped.

    Breakpoints are parameters of a fit: at most ``BREAKPOINTS``, which is checked.
    Up to ``INLINE`` of them become one expression; more are searched by bisection,
    an Arrow batch at a time.
    """
    rows = points.select("x", "y").orderBy("x").limit(BREAKPOINTS + 1).collect()
    if not 0 < len(rows) <= BREAKPOINTS:
        raise ContractError(f"interpolation takes 1 to {BREAKPOINTS} breakpoints")
    if len(rows) > INLINE:
        xs, ys = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])

        def look_up(v: pd.Series) -> pd.Series:
            return pd.Series(np.interp(v.to_numpy(float), xs, ys))

        look_up.__annotations__ = {"v": pd.Series, "return": pd.Series}
        return df.withColumn(out, F.when(F.col(x).isNotNull(), F.pandas_udf(look_up, "double")(F.col(x))))
    v, expr = F.col(x), None
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        step = F.lit(a["y"]) + (v - F.lit(a["x"])) * F.lit((b["y"] - a["y"]) / (b["x"] - a["x"]) if b["x"] > a["x"] else 0.0)
        expr = F.when(v < b["x"], step) if expr is None else expr.when(v < b["x"], step)
    last = F.lit(rows[-1]["y"])
    inner = last if expr is None else expr.otherwise(last)
    return df.withColumn(out, F.when(v.isNull(), None).when(v <= rows[0]["x"], F.lit(rows[0]["y"])).otherwise(inner))


def join_extra_docs(df: DataFrame, docs: DataFrame, key: str, field: str) -> DataFrame:
    """JN-13: a field of an entity's document where there is one, else ``Unknown``."""
    return df.join(docs.select(key, field), key, "left").withColumn(field, F.coalesce(field, F.lit("Unknown")))


def _flagged(df: DataFrame, flags: DataFrame, key: str, flag: str) -> DataFrame:
    text = F.lower(F.trim(F.col("_flag").cast("string")))
    joined = df.join(flags.select(key, F.col(flag).alias("_flag")), key, "left")
    return joined.withColumn("_yes", F.coalesce(text.isin("1", "true", "yes", "1.0"), F.lit(False))).drop("_flag")


def filter_flagged(df: DataFrame, flags: DataFrame, key: str, flag: str, check: bool = False) -> DataFrame:
    """PRD-01: rows whose joined flag says yes; with ``check`` none is an error that tells how many were dropped."""
    marked = _flagged(df, flags, key, flag)
    if check and (r := flagged_report(df, flags, key, flag).first())["kept"] == 0:
        raise ContractError(f"no row is flagged; dropped {r['dropped']}")
    return marked.filter("_yes").drop("_yes")


def flagged_report(df: DataFrame, flags: DataFrame, key: str, flag: str) -> DataFrame:
    """PRD-01: ``kept, dropped``."""
    return _flagged(df, flags, key, flag).agg(F.count_if("_yes").alias("kept"), F.count_if(~F.col("_yes")).alias("dropped"))


def complete_case(df: DataFrame, cols: list[str]) -> DataFrame:
    """PRD-02."""
    return df.dropna(subset=cols)


def filter_id(df: DataFrame, key: str, value) -> DataFrame:
    """PRD-03: one subject; none is an error."""
    out = df.filter(F.col(key) == F.lit(value))
    if out.isEmpty():
        raise ContractError(f"no row with {key} = {value}")
    return out


def cap_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """PRD-04: the first ``n`` distinct ids."""
    return df.select(key).distinct().orderBy(key).limit(n)


def union_all_keys(frames: list[DataFrame]) -> DataFrame:
    """SNK-06, SO-01: union by name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_names(a: DataFrame, b: DataFrame, name: str, position: str) -> DataFrame:
    """SO-02: names of both, in the order of ``a``."""
    return a.select(name, position).join(b.select(name).distinct(), name, "left_semi")


def missing_names(required: DataFrame, have: DataFrame, name: str) -> DataFrame:
    """SO-03."""
    return required.select(name).exceptAll(have.select(name)).distinct()


def candidate_thresholds(df: DataFrame, score: str) -> DataFrame:
    """SO-04: distinct scores, 0 and 1."""
    spark = df.sparkSession
    ends = spark.range(2).select(F.col("id").cast("double").alias("t"))
    return df.select(F.col(score).cast("double").alias("t")).union(ends).distinct()


def to_long(df: DataFrame, ids: list[str], cols: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """SO-05."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(ids, cols, name, value)


def to_wide(df: DataFrame, ids: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """SO-05."""
    return df.groupBy(*ids).pivot(name, names).agg(F.first(value))


def any_null(*cols: Column) -> Column:
    return F.greatest(*[c.isNull().cast("int") for c in cols], F.lit(0)) == 1
