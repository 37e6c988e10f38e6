"""Data contracts: each returns a violations DataFrame; ``enforce`` raises if there are any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A contract is violated; the message shows the first rows."""


def enforce(violations: DataFrame, what: str, show: int = 10) -> None:
    rows = violations.limit(show).collect()
    if rows:
        raise ContractError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def require_columns(df: DataFrame, cols: list[str]) -> None:
    """CHK-01."""
    if missing := [c for c in cols if c not in df.columns]:
        raise ContractError(f"missing columns: {', '.join(missing)}")


def column_coverage(df: DataFrame, cols: list[str]) -> DataFrame:
    """CHK-01: ``name, known`` of each required column: its rows that are not null, null for a column that is not there."""
    counts = df.agg(*[F.count(c).alias(c) if c in df.columns else F.lit(None).cast("long").alias(c) for c in cols])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("known")) for c in cols])).alias("c")).select("c.*")


def bad_ids(df: DataFrame, key: str, pattern: str) -> DataFrame:
    """CHK-02: ids that the whole-string pattern does not match, nulls included."""
    return df.filter(F.col(key).isNull() | ~F.col(key).cast("string").rlike(f"^(?:{pattern})$")).select(key)


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """CHK-03."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def count_mismatch(df: DataFrame, event: str, rows: int, events: int) -> DataFrame:
    """CHK-04."""
    totals = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(event), F.lit(0)).cast("long").alias("n_events"))
    return totals.filter((F.col("n_rows") != rows) | (F.col("n_events") != events))


def incomplete_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """CHK-05: columns with null, NaN or infinite values and how many; one pass over the rows."""
    def bad(c):
        x = F.col(c)
        number = dict(df.dtypes)[c] in ("double", "float")
        return x.isNull() | ((F.isnan(x) | (F.abs(x) == float("inf"))) if number else F.lit(False))

    one = df.agg(*[F.coalesce(F.sum(bad(c).cast("long")), F.lit(0)).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("bad")) for c in cols])).alias("r")).select("r.*").filter("bad > 0")


def label_conflicts(a: DataFrame, b: DataFrame, key: str, event: str) -> DataFrame:
    """CHK-06."""
    left, right = a.select(key, F.col(event).alias("a")), b.select(key, F.col(event).alias("b"))
    return left.join(right, key).filter(~F.col("a").eqNullSafe(F.col("b")))


def class_counts(df: DataFrame, event: str, *by: str) -> DataFrame:
    """CHK-07: groups that hold one class only."""
    counts = df.groupBy(*by).agg(F.countDistinct(event).alias("classes"))
    return counts.filter("classes < 2")


def cardinality_violations(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """CHK-08: keys that are not unique on a side of a one-to-one join."""
    side = lambda df, name: duplicate_keys(df, key).withColumn("side", F.lit(name))
    return side(a, "left").unionByName(side(b, "right"))


def unknown_batches(df: DataFrame, known: DataFrame, batch: str) -> DataFrame:
    """CHK-09."""
    return df.select(batch).distinct().join(known.select(batch), batch, "left_anti")


def availability(df: DataFrame, specs: dict[str, list[str]]) -> DataFrame:
    """CHK-10: rows complete for each named set of columns; one pass."""
    full = lambda cols: F.count(F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in cols], F.lit(0)) == 0, 1))
    one = df.agg(*[full(cols).alias(name) for name, cols in specs.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("spec"), F.col(n).alias("complete")) for n in specs])).alias("r")).select("r.*")


def alignment_report(left: DataFrame, right: DataFrame, key: str, canonical) -> DataFrame:
    """CHK-11: rows and distinct ids of both sides, exact, canonical-only and unmatched ids of the left."""
    a = left.select(F.col(key).alias("k"), canonical(F.col(key)).alias("c")).distinct()
    b = right.select(F.col(key).alias("k"), canonical(F.col(key)).alias("c")).distinct()
    exact = b.select("k", F.lit(1).alias("exact"))
    loose = b.select("c").distinct().withColumn("loose", F.lit(1))
    joined = a.join(exact, "k", "left").join(loose, "c", "left")
    counts = joined.agg(
        F.count(F.lit(1)).alias("left_ids"), F.count("exact").alias("exact"),
        F.count(F.when(F.col("exact").isNull() & F.col("loose").isNotNull(), 1)).alias("canonical"),
        F.count(F.when(F.col("exact").isNull() & F.col("loose").isNull(), 1)).alias("unmatched"),
    )
    return counts.crossJoin(b.agg(F.count(F.lit(1)).alias("right_ids")))  # one row by one row
