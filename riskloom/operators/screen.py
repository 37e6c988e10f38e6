"""Feature screening and selection on long tables ``id, event, feature, value``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.aggregates import column_profile, selection_frequency
from riskloom.operators.joins import small
from riskloom.operators.order import exact_percentiles, midrank
from riskloom.operators.resample import class_order
from riskloom.operators.solver import add_up, coordinate_descent, matrix, packed


def impute(long: DataFrame, strategy: str = "median", fitted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """FS-02: nulls replaced by the feature's median, mean or mode, learned here or given as ``feature, fill``."""
    if fitted is None:
        if strategy == "median":
            fitted = exact_percentiles(long, "value", {"fill": 0.5}, ["feature"])
        else:
            how = {"mean": F.avg("value"), "mode": F.mode("value")}[strategy]
            fitted = long.groupBy("feature").agg(how.alias("fill"))
    return long.join(small(fitted), "feature", "left").withColumn("value", F.coalesce("value", "fill")).drop("fill"), fitted


def drop_missing(long: DataFrame, most: float) -> DataFrame:
    """FS-01: features whose missing share is at most ``most``."""
    return column_profile(long).filter(F.col("missing") <= most).select("feature", "missing")


def drop_low_variance(long: DataFrame, least: float = 0.01) -> DataFrame:
    """FS-03: features whose population variance after median imputation is above ``least``."""
    filled, _ = impute(long)
    return filled.groupBy("feature").agg(F.var_pop("value").alias("variance")).filter(F.col("variance") > least)


def ranks(long: DataFrame) -> DataFrame:
    """Midranks of the values of each feature; equal values are counted first."""
    return midrank(long.filter("value is not null"), "value", ["feature"], "r").select("id", "feature", "r")


def gathered(long: DataFrame, names: list, value: str, keys: list[str]) -> DataFrame:
    """``keys..., at, features``: the values of a row and the positions of their features in ``names``, in any order; see ``placed_matrix``."""
    places = long.sparkSession.createDataFrame(list(enumerate(names)), f"_i int, feature {dict(long.dtypes)['feature']}")
    both = F.collect_list(F.struct("_i", F.col(value).cast("double").alias("_v")))
    return long.join(F.broadcast(places), "feature").groupBy(*keys).agg(both.alias("_m")).select(*keys, F.col("_m._i").alias("at"), F.col("_m._v").alias("features"))


def placed_matrix(batch: pa.RecordBatch, p: int) -> np.ndarray:
    """Rows of ``gathered`` as a matrix; what a row lacks is NaN, a feature twice is an error. A value costs one store, however many features there are."""
    at, values = batch.column("at"), batch.column("features")
    row = np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy()))
    place = row * p + at.flatten().to_numpy()
    if len(place) and np.bincount(place).max() > 1:
        raise ValueError("a row has a feature twice")
    out = np.full(batch.num_rows * p, np.nan)
    out[place] = values.flatten().to_numpy(zero_copy_only=False)
    return out.reshape(batch.num_rows, p)


def moment_sums(vectors: DataFrame, p: int) -> np.ndarray:
    """``6 x p x p`` sums over rows of ``features``: n, x, y, xx, yy and xy for each pair of columns where both are known.

    Each task multiplies matrices of its rows; what is shuffled is one packed array per task.
    Rows with ``at`` are those of ``gathered``.
    """
    placed = "at" in vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, p, p))
        for batch in batches:
            if batch.num_rows:
                x = placed_matrix(batch, p) if placed else matrix(batch.column("features"))
                have, x = (~np.isnan(x)).astype(float), np.nan_to_num(x)
                total += np.array([have.T @ have, x.T @ have, have.T @ x, (x * x).T @ have, have.T @ (x * x), x.T @ x])
        yield packed(total.reshape(1, -1))

    return add_up(vectors.select("at", "features") if placed else vectors.select("features"), 1, run)[0].reshape(6, p, p)


def rank_correlations(long: DataFrame) -> tuple[list, np.ndarray]:
    """Feature names and their absolute rank correlations, over the ids that have both; the driver sees one matrix of sums."""
    names = [r["feature"] for r in long.select("feature").distinct().orderBy("feature").collect()]
    p = len(names)
    n, x, y, xx, yy, xy = moment_sums(gathered(ranks(long), names, "r", ["id"]), p)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (n * xy - x * y) / np.sqrt((n * xx - x * x) * (n * yy - y * y))
    return names, np.abs(np.nan_to_num(r, posinf=0.0, neginf=0.0))


def spearman_matrix(long: DataFrame) -> DataFrame:
    """FS-04: absolute rank correlation of all feature pairs a < b."""
    names, r = rank_correlations(long)
    p, kind = len(names), dict(long.dtypes)["feature"]
    return long.sparkSession.createDataFrame([(names[i], names[j], float(r[i, j])) for i in range(p) for j in range(i + 1, p)], f"a {kind}, b {kind}, r double")


def correlated_groups(names: list, r: np.ndarray, percentile: float) -> dict:
    """FS-14: features linked by correlations above the ``percentile`` of all pairs, by the first of each group."""
    p = len(names)
    if p < 2:
        return {n: [n] for n in names}
    linked = r > np.percentile(r[np.triu_indices(p, 1)], percentile)
    label = np.arange(p)
    while True:
        # the smallest label among a feature and those it is linked to
        low = np.minimum(label, np.where(linked, label[None, :], p).min(axis=1))
        if (low == label).all():
            break
        label = low
    out: dict = {}
    for i, g in enumerate(label):
        out.setdefault(names[g], []).append(names[i])
    return out


def prune_correlated(corr: DataFrame, variance: DataFrame, most: float = 0.95) -> list:
    """FS-05: names dropped by the ordered walk over pairs above ``most``; the lower variance goes, the second on ties.

    Only the pairs above the limit, ordered, come to the driver; the walk depends on
    its own earlier decisions.
    """
    v1, v2 = variance.select(F.col("feature").alias("a"), F.col("variance").alias("va")), variance.select(F.col("feature").alias("b"), F.col("variance").alias("vb"))
    dropped: set = set()
    for r in corr.filter(F.col("r") > most).join(v1, "a").join(v2, "b").orderBy("a", "b").toLocalIterator():
        if r["a"] not in dropped and r["b"] not in dropped:
            dropped.add(r["a"] if r["va"] < r["vb"] else r["b"])
    return sorted(dropped)


def prefilter(long: DataFrame, most_missing: float = 0.3, least_variance: float = 0.01, most_corr: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """FS-06: the three filters in turn; the kept rows (imputed) and a report of removed counts."""
    spark = long.sparkSession
    have = long.select("feature").distinct().count()
    a = long.join(small(drop_missing(long, most_missing).select("feature")), "feature", "left_semi")
    n1 = a.select("feature").distinct().count()
    filled, _ = impute(a)
    variance = drop_low_variance(a, least_variance)
    b = filled.join(small(variance.select("feature")), "feature", "left_semi")
    n2 = variance.count()
    gone = prune_correlated(spearman_matrix(b), variance, most_corr)
    kept = b.filter(~F.col("feature").isin(gone)) if gone else b
    report = spark.createDataFrame([("missing", have - n1), ("variance", n1 - n2), ("correlation", len(gone)), ("kept", n2 - len(gone))], "stage string, n int")
    return kept, report


def point_biserial(long: DataFrame, event: str = "event") -> DataFrame:
    """FS-08."""
    return long.groupBy("feature").agg(F.abs(F.coalesce(F.corr("value", event), F.lit(0.0))).alias("r"))


def drop_nzv(long: DataFrame, least_variance: float = 1e-8, least_ratio: float = 0.01, profile: DataFrame | None = None) -> DataFrame:
    """FS-09: features with variance and enough distinct values; all of them if none passes. ``profile``: that of ``long``, if it is known."""
    p = column_profile(long) if profile is None else profile
    ok = (F.col("variance") > least_variance) & (F.col("unique_ratio") >= least_ratio)
    flagged = p.select("feature", ok.alias("ok"))
    none = flagged.agg((F.count_if(F.col("ok")) == 0).alias("none"))
    return flagged.crossJoin(F.broadcast(none)).filter("ok or none").select("feature")


def decoy_features(long: DataFrame, seed=0) -> DataFrame:
    """FS-11: one permuted copy of each feature: the value at a place of one md5 order goes to the id at that place of another.

    Places come from salted parts of the md5 range, so no feature is sorted in one task.
    """
    rows = long.select("id", "event", "feature", "value", F.lit(0).alias("_all"))
    place = lambda what: class_order(rows, "id", "_all", f"{seed}|{what}", ["feature"])
    values = place("from").select("feature", "value", "pos")
    return place("to").select("id", "event", "feature", "pos").join(values, ["feature", "pos"]).select("id", "event", F.concat(F.lit("decoy_"), F.col("feature").cast("string")).alias("feature"), "value")


def knockoff_features(long: DataFrame, seed=0, ridge: float = 1e-3) -> DataFrame:
    """FS-11: equicorrelated Gaussian knockoffs, as ``decoy_`` features.

    Mean and covariance are one pass of sums (shrunk towards the diagonal by
    ``ridge``, so that more features than rows are fine). Each row's knockoff is
    its conditional mean plus noise that comes from a hash of its id. Ids that
    lack a feature count with its mean.
    """
    names = [r["feature"] for r in long.select("feature").distinct().orderBy("feature").collect()]
    p = len(names)
    wide = gathered(long, names, "value", ["id", "event"]).select("id", "event", F.xxhash64("id", F.lit(str(seed))).alias("h"), "at", "features")
    n, x, y, _, _, xy = moment_sums(wide, p)
    n = np.maximum(n, 1)
    mean = np.diag(x) / np.diag(n)
    cov = xy / n - (x / n) * (y / n)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-24))
    corr = (1 - ridge) * cov / np.outer(sd, sd) + ridge * np.eye(p)
    s = min(1.0, 2 * float(np.linalg.eigvalsh(corr).min()))
    s = max(s, 1e-6) * 0.999
    pull = np.eye(p) - s * np.linalg.inv(corr)
    values, vectors = np.linalg.eigh(2 * s * np.eye(p) - s * s * np.linalg.inv(corr))
    spread = vectors * np.sqrt(np.maximum(values, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.nan_to_num((placed_matrix(batch, p) - mean) / sd)
            noise = hash_normal(batch.column("h").to_numpy(), p)
            out = (z @ pull.T + noise @ spread.T) * sd + mean
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * p), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("event"), flat], names=["id", "event", "decoys"])

    types = dict(long.dtypes)
    made = wide.mapInArrow(run, f"id {types['id']}, event {types['event']}, decoys array<double>")
    labels = F.array(*[F.lit(f"decoy_{n}") for n in names])
    return made.select("id", "event", F.posexplode("decoys").alias("i", "value")).select("id", "event", F.get(labels, F.col("i")).alias("feature"), "value")


def hash_normal(hashes: np.ndarray, p: int) -> np.ndarray:
    """``p`` standard normal numbers per hash (Box-Muller on a 64-bit mixer)."""

    def uniform(k: int) -> np.ndarray:
        x = hashes.astype(np.int64).view(np.uint64)[:, None] + np.arange(k * p, (k + 1) * p, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53 + 2.0**-54

    return np.sqrt(-2 * np.log(uniform(0))) * np.cos(2 * np.pi * uniform(1))


def fdp_threshold(freq: DataFrame, start: float, stop: float, step: float) -> DataFrame:
    """FS-13: threshold with the smallest FDP+ = (1 + decoys >= t) / max(1, real features >= t), the lowest on ties."""
    n = round((stop - start) / step)
    grid = freq.sparkSession.range(n + 1).select((F.lit(start) + F.col("id") * step).alias("t"))
    hit = freq.crossJoin(F.broadcast(grid)).withColumn("hit", F.col("frequency") >= F.col("t"))  # features by a short grid
    counts = hit.groupBy("t").agg(F.count_if(F.col("hit") & F.col("decoy")).alias("decoys"), F.count_if(F.col("hit") & ~F.col("decoy")).alias("real"))
    fdp = (1 + F.col("decoys")) / F.greatest(F.lit(1), F.col("real"))
    return counts.withColumn("fdp", fdp).orderBy(F.round("fdp", 12), "t").limit(1)


def correlation_groups(corr: DataFrame, least: float | None = None, max_rounds: int = 100, percentile: float | None = None) -> DataFrame:
    """FS-14: components of features linked by correlations of ``least`` or more, or above the ``percentile`` of all pairs, by smallest-name label passing.

    Labels - one per feature - come to the driver once a round; rounds are no
    more than the longest chain and end at ``max_rounds`` with an error.
    """
    if percentile is not None:
        cut = exact_percentiles(corr, "r", {"t": percentile / 100}).first()
        edges = corr.filter(F.col("r") > (cut["t"] if cut else 1.0)).select("a", "b")
    else:
        edges = corr.filter(F.col("r") >= least).select("a", "b")
    both = edges.union(edges.select("b", "a")).toDF("a", "b").persist()
    schema = f"a {dict(corr.dtypes)['a']}, g {dict(corr.dtypes)['a']}"
    known = {r["a"]: r["a"] for r in both.select("a").distinct().collect()}
    for _ in range(max_rounds):
        labels = corr.sparkSession.createDataFrame(list(known.items()), schema)
        low = both.join(F.broadcast(labels.select(F.col("a").alias("b"), "g")), "b").groupBy("a").agg(F.min("g").alias("g"))
        new = {r["a"]: min(known[r["a"]], r["g"]) for r in low.collect()}
        if new == known:
            both.unpersist()
            return labels.toDF("feature", "group")
        known = new
    raise RuntimeError(f"groups did not settle in {max_rounds} rounds")


def consensus_features(selected: DataFrame, least: float, cap: int) -> DataFrame:
    """FS-15."""
    f = selection_frequency(selected, "run", "feature").filter(F.col("frequency") >= least)
    return f.orderBy(F.desc("frequency"), "feature").limit(cap)


def lasso_path(rows: DataFrame, features: list[str], target: str, lambdas: list[float]) -> DataFrame:
    """FS-16: squared-loss lasso coefficients on a grid, from one distributed matrix of sums of standardised features. Rows with a null are left out."""
    p = len(features)
    vectors = rows.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*features, target])]).dropna().select(F.array(*[F.col(f"c{i}") for i in range(p + 1)]).alias("features"))
    n, x, _, _, _, xy = moment_sums(vectors, p + 1)
    size = max(float(n[0, 0]), 1.0)
    mean = np.diag(x) / size
    cov = xy / size - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd[sd < 1e-12] = 1.0
    gram, right = np.eye(p + 1), np.zeros(p + 1)
    gram[1:, 1:] = cov[:p, :p] / np.outer(sd[:p], sd[:p])
    right[1:] = cov[:p, p] / sd[:p]
    out, beta = [], np.zeros(p + 1)
    for lam in sorted(lambdas, reverse=True):
        beta = coordinate_descent(gram, right, lam, 0.0, beta)
        out += [(lam, f, float(b)) for f, b in zip(features, beta[1:], strict=True)]
    return rows.sparkSession.createDataFrame(out, "lambda double, feature string, coef double")


def select_features(df: DataFrame, key: str, metadata: tuple[str, ...] = (), prefixes: tuple[str, ...] = ("diagnostics_",), parts: tuple[str, ...] = (), texture_only: bool = False) -> list[str]:
    """FN-18: names of the feature columns: numeric, neither the id nor metadata, without the given beginnings and parts.

    ``texture_only`` keeps names that hold one of the texture classes.
    """
    # fixed values: texture classes of image features
    textures = ("glcm", "glrlm", "glszm", "gldm", "ngtdm")
    out = []
    for f in df.schema:
        name = f.name.lower()
        if not isinstance(f.dataType, T.NumericType) or f.name == key or f.name in metadata:
            continue
        if name.startswith(prefixes) or any(p in name for p in parts) or (texture_only and not any(t in name for t in textures)):
            continue
        out.append(f.name)
    return out
