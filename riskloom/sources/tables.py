"""Readers that reconcile names, and writers with manifests."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.scalars import safe_double
from riskloom.operators.contracts import ContractError


def _canonical(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def resolve(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate that is a column, by exact name, then by letters and digits only."""
    for c in candidates:
        if c in columns:
            return c
    loose = {_canonical(c.strip()): c for c in reversed(columns)}
    return next((loose[_canonical(c)] for c in candidates if _canonical(c) in loose), None)


def read_features(spark: SparkSession, path: str, ids: list[str], fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """SRC-01: id column renamed to ``id``; numeric columns are features, others go."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", fmt == "csv")).format(fmt).load(path)
    key = resolve(df.columns, ids)
    if key is None:
        raise ContractError(f"none of {ids} is a column")
    return df.select(F.col(f"`{key}`").alias("id"), *[F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != key])


def read_covariates(spark: SparkSession, path: str, text_columns: list[str], number_columns: list[str], key: str) -> DataFrame:
    """SRC-02: all columns read as text; numbers parsed with decimal commas; blank ids go."""
    df = spark.read.option("header", True).csv(path)
    cleaned = df.select(F.trim(key).alias("id"), *[F.trim(c).alias(c) for c in text_columns], *[safe_double(c).alias(c) for c in number_columns])
    return cleaned.filter("id is not null and id <> ''")


def read_outcomes(df: DataFrame, ids: list[str], grade: str) -> DataFrame:
    """SRC-03."""
    key = resolve(df.columns, ids)
    if key is None or grade not in df.columns:
        raise ContractError("outcomes need an id and a grade")
    return df.select(F.col(key).alias("id"), F.col(grade).cast("string").alias("grade"))


def read_batch_metadata(df: DataFrame, ids: list[str], batch: list[str], maker: list[str], model: list[str]) -> DataFrame:
    """SRC-04: batch column by name, else manufacturer and model joined."""
    df = df.toDF(*[c.strip() for c in df.columns])
    key, b = resolve(df.columns, ids), resolve(df.columns, batch)
    if b is not None:
        return df.select(F.col(key).alias("id"), F.trim(F.col(b).cast("string")).alias("batch"))
    m, n = resolve(df.columns, maker), resolve(df.columns, model)
    if m is None or n is None:
        raise ContractError("neither a batch nor manufacturer and model")
    return df.select(F.col(key).alias("id"), F.concat_ws("_", F.trim(F.col(m).cast("string")), F.trim(F.col(n).cast("string"))).alias("batch"))


def read_keyed_json(df: DataFrame, text: str, value_type: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """SRC-05: one JSON object per row of text, keyed by subject, as rows ``id`` and the value's fields, with the columns ``keep``."""
    parsed = df.select(*keep, F.from_json(text, f"map<string, {value_type}>").alias("m")).select(*keep, F.explode("m").alias("id", "v"))
    return parsed.select(*keep, "id", "v.*") if value_type.startswith("struct") else parsed


def read_json_config(spark: SparkSession, path: str) -> dict:
    """SRC-06: nested JSON as a dictionary; risk thresholds are put in order."""
    row = spark.read.option("multiLine", True).json(path).first().asDict(recursive=True)
    if {"low_threshold", "high_threshold"} <= row.keys() and row["low_threshold"] > row["high_threshold"]:
        row["low_threshold"], row["high_threshold"] = row["high_threshold"], row["low_threshold"]
    return row


def read_name_list(spark: SparkSession, path: str) -> list[str]:
    """SRC-07: non-empty trimmed lines; none is an error."""
    names = [r["value"].strip() for r in spark.read.option("wholetext", False).text(path).collect()]
    names = [n for n in names if n]
    if not names:
        raise ContractError("empty name list")
    return names


def select_by_names(df: DataFrame, key: str, names: list[str]) -> tuple[DataFrame, list[str]]:
    """FS-17: listed columns in list order, and the unknown names."""
    return df.select(key, *[n for n in names if n in df.columns]), [n for n in names if n not in df.columns]


def latest_file(spark: SparkSession, folder: str, pattern: str) -> str:
    """SRC-08: newest file by modification time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    row = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()
    if row["p"] is None:
        raise ContractError(f"no file like {pattern}")
    return row["p"]


def read_entity_docs(spark: SparkSession, folder: str, schema: str, key: str) -> DataFrame:
    """SRC-09: one JSON document per file; broken ones and those without id are skipped."""
    df = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("multiLine", True).json(folder)
    return df.filter(F.col("_corrupt_record").isNull() & F.col(key).isNotNull()).drop("_corrupt_record")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK-01."""
    df.write.mode("overwrite").option("header", True).format(fmt).save(path)


def write_metrics_json(df: DataFrame, path: str) -> None:
    """SNK-03: NaN becomes null."""
    clean = [F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*clean).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_manifest(spark: SparkSession, path: str, run: str, parameters: dict, counts: dict) -> None:
    """SNK-04: one row per run."""
    row = [(run, {k: str(v) for k, v in parameters.items()}, {k: int(v) for k, v in counts.items()})]
    spark.createDataFrame(row, "run string, parameters map<string,string>, counts map<string,bigint>").withColumn("written", F.current_timestamp()).write.mode("append").parquet(path)


def open_configurations(grid: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """SNK-05: configurations without a result."""
    return grid.join(done.select(*key), key, "left_anti")


def configuration_key(row: dict, key: list[str]) -> str:
    """A file name for a configuration: its values by name, hashed."""
    return hashlib.sha256("|".join(f"{k}={row[k]!r}" for k in key).encode()).hexdigest()[:24]


def commit_result(result: DataFrame, store: str, name: str) -> None:
    """SNK-05: the result of one configuration, in a folder of its own that is replaced as a whole."""
    result.coalesce(1).write.mode("overwrite").parquet(f"{store}/configuration={name}")


def committed(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """SNK-05: results of the configurations that were committed; a folder that a killed run left half written has no success mark and does not count."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(store)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [str(s.getPath()) for s in fs.listStatus(root) if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS"))] if fs.exists(root) else []
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)
