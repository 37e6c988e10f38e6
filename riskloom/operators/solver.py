"""Many weighted elastic-net logistic fits over the same rows in one distributed pass per step.

Rows carry an event, a feature vector and what tells fits apart: weights
(bootstrap multiplicity, subsample, class weight), codes (folds of any nesting:
a fit names the codes it leaves out) or a row number, from which a keyed
permutation gives a fit labels and a hold-out of its own. So a row does not grow
with the folds or permutations. In each proximal-Newton step the tasks add up,
for every fit, the weighted Gram matrix and right-hand side of the quadratic
model; Spark sums these packed arrays by fit, and the driver solves all p x p
problems together. No row reaches the driver, and lineage does not grow, as each
step starts from the same input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.operators.permute import permuted

CHUNK_BYTES = 64 << 20


@dataclass(frozen=True)
class Fit:
    """One fit: the position of its weight (None: all rows count one), inverse penalty ``c`` and share of the L1 part.

    ``hold``: pairs of a position in ``codes`` and a value; rows with one of them
    don't train. The rows held out are those with the last one and none of the
    others. ``shuffle``: its labels are ``event`` dealt anew by this key (0: as they
    are), see ``Shuffle``. ``mask``: features it may use, None for all.
    """

    weight: int | None = None
    c: float = 1.0
    l1_ratio: float = 0.0
    hold: tuple[tuple[int, int], ...] = ()
    shuffle: int | None = None
    mask: tuple[int, ...] | None = None


@dataclass(frozen=True)
class Shuffle:
    """Numbers of a table whose column ``number`` counts its ``events`` first: a permuted place below ``events`` is an event.

    The first ``frac`` of the places of each class are the hold-out.
    """

    rows: int
    events: int
    frac: float

    def deal(self, number: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
        """Labels and hold-out of rows for a key."""
        place = permuted(number, self.rows, key) if key else number
        y = place < self.events
        first = np.where(y, place, place - self.events)
        return y.astype(float), first < np.where(y, round(self.frac * self.events), round(self.frac * (self.rows - self.events)))


class Batch:
    """Rows of a batch as the fits see them."""

    def __init__(self, batch: pa.RecordBatch, shuffle: Shuffle | None):
        names = batch.schema.names
        self.x, self.y = matrix(batch.column("features")), batch.column("event").to_numpy().astype(float)
        self.w = matrix(batch.column("weights")) if "weights" in names else None
        self.codes = matrix(batch.column("codes"), int) if "codes" in names else None
        self.number = batch.column("number").to_numpy() if "number" in names else None
        self.shuffle, self.n = shuffle, batch.num_rows

    def training(self, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
        """Weights (0: not used) and labels."""
        w = np.ones(self.n) if fit.weight is None else self.w[:, fit.weight]
        for position, value in fit.hold:
            w = np.where(self.codes[:, position] == value, 0.0, w)
        if fit.shuffle is None:
            return w, self.y
        y, out = self.shuffle.deal(self.number, fit.shuffle)
        return np.where(out, 0.0, w), y

    def held_out(self, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
        """Rows that judge a fit, and all labels."""
        if fit.shuffle is not None:
            y, out = self.shuffle.deal(self.number, fit.shuffle)
            return np.flatnonzero(out), y
        if not fit.hold:
            return np.flatnonzero(self.w[:, fit.weight] == 0), self.y
        *others, (position, value) = fit.hold
        out = self.codes[:, position] == value
        for p, v in others:
            out &= self.codes[:, p] != v
        # of a bag's hold-out all rows count, drawn or not
        return np.flatnonzero(out), self.y


def inputs(rows: DataFrame) -> DataFrame:
    """The columns that fits read."""
    return rows.select(*[c for c in ("event", "features", "weights", "codes", "number") if c in rows.columns])


def matrix(column, dtype=float) -> np.ndarray:
    """Rows of numbers; nulls become NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def standardised(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Columns as the fit sees them; a missing value counts as the fit's mean."""
    return np.nan_to_num((x - mean) / sd)


def _sums(fits: list[Fit], beta: np.ndarray | None, mean: np.ndarray | None, sd: np.ndarray | None, shuffle: Shuffle | None = None):
    """Partial sums per fit: moments if there are no coefficients yet, else Gram and right-hand side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, parts = Batch(batch, shuffle), []
            for f, fit in enumerate(fits):
                wf, y = rows.training(fit)
                used = wf > 0
                xf, yf, wf = rows.x[used], y[used], wf[used]
                if beta is None:
                    have, known = ~np.isnan(xf), np.nan_to_num(xf)
                    parts.append(np.concatenate([[wf.sum(), wf @ yf], wf @ have, wf @ known, wf @ (known * known)]))
                    continue
                z = np.column_stack([np.ones(len(xf)), standardised(xf, mean[f], sd[f])])
                eta = np.clip(z @ beta[f], -30, 30)
                p = 1 / (1 + np.exp(-eta))
                v = wf * np.maximum(p * (1 - p), 1e-6)
                parts.append(np.concatenate([((z * v[:, None]).T @ z).ravel(), z.T @ (wf * (yf - p) + v * eta)]))
            block = np.array(parts)
            total = block if total is None else total + block
        if total is not None:
            yield packed(total)

    return run


MERGES = 64
PACKED = "fit long, merge int, s binary"


def packed(total: np.ndarray) -> pa.RecordBatch:
    """A task's sums, one packed row per fit."""
    part = TaskContext.get().partitionId() % MERGES
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(total)), pa.int64()), pa.array([part] * len(total), pa.int32()), pa.array([np.asarray(t, float).tobytes() for t in total], pa.binary())],
        names=["fit", "merge", "s"],
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of sorted packed rows, one after another: a key costs one array of memory, however many tasks sent one."""

    def out(key, total) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["fit", "merge", "s"])

    held, total = None, None
    for batch in batches:
        for key, s in zip(zip(batch.column("fit").to_pylist(), batch.column("merge").to_pylist(), strict=True), batch.column("s"), strict=True):
            value = np.frombuffer(s.as_buffer(), float)
            if key != held:
                if held is not None:
                    yield out(held, total)
                held, total = key, value.copy()
            else:
                total += value
    if held is not None:
        yield out(held, total)


def add_up(rows: DataFrame, fits: int, run) -> np.ndarray:
    """Sums of the packed rows of all tasks, in two rounds; one row per fit reaches the driver."""
    once = rows.mapInArrow(run, PACKED).repartition("fit", "merge").sortWithinPartitions("fit", "merge").mapInArrow(_merge, PACKED)
    all_ = once.withColumn("merge", F.lit(0)).repartition("fit").sortWithinPartitions("fit").mapInArrow(_merge, PACKED)
    out = {r["fit"]: np.frombuffer(bytes(r["s"]), float) for r in all_.collect()}
    return np.array([out[f] for f in range(fits)])


def coordinate_descent(gram: np.ndarray, right: np.ndarray, l1: float, l2: float, start: np.ndarray, rounds: int = 500, tol: float = 1e-9) -> np.ndarray:
    """Minimises b'Gb/2 - r'b + l1 |b| + l2 |b|^2 / 2; entry 0 is the intercept and is not penalised."""
    one = lambda v: np.array([v], float)
    return minimise(gram[None], right[None], one(l1), one(l2), start[None], np.ones((1, len(right)), bool), rounds, tol)[0]


def minimise(gram: np.ndarray, right: np.ndarray, l1: np.ndarray, l2: np.ndarray, start: np.ndarray, free: np.ndarray, rounds: int = 500, tol: float = 1e-9) -> np.ndarray:
    """``coordinate_descent`` for many problems side by side; coefficients that are not ``free`` stay 0."""
    b = np.where(free, start, 0.0)
    diagonal = np.einsum("fjj->fj", gram)
    open_ = np.arange(len(b))
    for _ in range(rounds):
        g, r, d, x = gram[open_], right[open_], diagonal[open_], b[open_]
        gx, worst = np.einsum("fij,fj->fi", g, x), np.zeros(len(open_))
        for j in range(b.shape[1]):
            rho = r[:, j] - gx[:, j] + d[:, j] * x[:, j]
            new = rho / d[:, j] if j == 0 else np.sign(rho) * np.maximum(np.abs(rho) - l1[open_], 0) / np.maximum(d[:, j] + l2[open_], 1e-300)
            step = np.where(free[open_, j], new - x[:, j], 0.0)
            gx += g[:, :, j] * step[:, None]
            x[:, j] += step
            worst = np.maximum(worst, np.abs(step))
        b[open_] = x
        open_ = open_[worst >= tol]
        if not len(open_):
            break
    return b


def fit_logistic_replicates(rows: DataFrame, fits: list[Fit], rounds: int = 50, tol: float = 1e-6, shuffle: Shuffle | None = None) -> list[dict]:
    """ML-01: ``intercept, coef`` (for standardised features), ``mean, sd`` of each fit.

    ``rows`` has ``event int, features array<double>`` and what the fits name:
    ``weights array<double>``, ``codes array<int>``, ``number long`` (with
    ``shuffle``). Minimises ``c * sum(weighted loss) + l1_ratio |b| + (1 - l1_ratio)
    |b|^2 / 2``. Means and population SDs are those of the fit's weighted rows;
    missing values count as its mean, so imputation sees training rows only. Fits
    are worked on in chunks whose sums stay below 64 MB a task.
    """
    first = rows.select(F.size("features").alias("p")).first()
    if first is None:
        raise ValueError("no rows to fit")
    p = first["p"]
    size = max(1, CHUNK_BYTES // (8 * (p + 2) ** 2))
    out: list[dict] = []
    for low in range(0, len(fits), size):
        out += _fit_chunk(inputs(rows), fits[low : low + size], p, rounds, tol, shuffle)
    return out


def _centre(m: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and population SDs of the known values; constant columns get 1."""
    n = np.maximum(m[:, 2 : 2 + p], 1e-12)
    mean = m[:, 2 + p : 2 + 2 * p] / n
    sd = np.sqrt(np.maximum(m[:, 2 + 2 * p :] / n - mean**2, 0))
    sd[sd < 1e-12] = 1.0
    return mean, sd


def _fit_chunk(rows: DataFrame, fits: list[Fit], p: int, rounds: int, tol: float, shuffle: Shuffle | None) -> list[dict]:
    m = add_up(rows, len(fits), _sums(fits, None, None, None, shuffle))
    mean, sd = _centre(m, p)
    rate = np.clip(m[:, 1] / np.maximum(m[:, 0], 1e-12), 1e-6, 1 - 1e-6)
    beta = np.zeros((len(fits), p + 1))
    beta[:, 0] = np.log(rate / (1 - rate))
    free = np.ones((len(fits), p + 1), bool)
    for f, fit in enumerate(fits):
        if fit.mask is not None:
            free[f, 1:] = np.isin(np.arange(p), fit.mask)
    l1, l2 = np.array([f.l1_ratio / f.c for f in fits]), np.array([(1 - f.l1_ratio) / f.c for f in fits])
    open_ = np.arange(len(fits))
    for _ in range(rounds):
        s = add_up(rows, len(open_), _sums([fits[f] for f in open_], beta[open_], mean[open_], sd[open_], shuffle))
        gram, right = s[:, : (p + 1) ** 2].reshape(-1, p + 1, p + 1), s[:, (p + 1) ** 2 :]
        new = minimise(gram, right, l1[open_], l2[open_], beta[open_], free[open_])
        change = np.abs(new - beta[open_]).max(axis=1)
        beta[open_] = np.clip(new, -30, 30)
        open_ = open_[change > tol]
        if not len(open_):
            break
    left = set(open_.tolist())
    return [{"intercept": float(beta[f, 0]), "coef": beta[f, 1:], "mean": mean[f], "sd": sd[f], "converged": f not in left} for f in range(len(fits))]


def fit_firth(rows: DataFrame, rounds: int = 25, tol: float = 1e-4, weight: str | None = None) -> dict:
    """ML-05: Firth-penalised logistic fit of ``event, features``: class-balanced weights that add up to n.

    ``weight`` names a column that says how often a row counts. Each step takes
    two passes: the information matrix, then the score with the hat values as
    correction.
    """
    times = F.col(weight) if weight else F.lit(1)
    c = rows.agg(F.sum(times).alias("n"), F.sum(F.col("event") * times).alias("e")).first()
    n, e = c["n"], c["e"]
    if not e or e == n:
        raise ValueError("one class only")
    weighted = rows.withColumn("weights", F.array(times * F.when(F.col("event") == 1, n / (2 * e)).otherwise(n / (2 * (n - e))))).select("event", "features", "weights")
    one = [Fit(0)]
    p = rows.select(F.size("features").alias("p")).first()["p"]
    mean, sd = (v[0] for v in _centre(add_up(weighted, 1, _sums(one, None, None, None)), p))
    beta = np.zeros(p + 1)

    def score(inverse: np.ndarray, b: np.ndarray):
        def run(batches):
            total = np.zeros(p + 1)
            for batch in batches:
                if not batch.num_rows:
                    continue
                z = np.column_stack([np.ones(batch.num_rows), standardised(matrix(batch.column("features")), mean, sd)])
                w, y = matrix(batch.column("weights"))[:, 0], batch.column("event").to_numpy().astype(float)
                q = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
                h = w * q * (1 - q) * np.einsum("ij,jk,ik->i", z, inverse, z)
                total += z.T @ (w * (y - q) + h * (0.5 - q))
            yield packed(total[None])

        return run

    for _ in range(rounds):
        s = add_up(weighted, 1, _sums(one, beta[None], mean[None], sd[None]))[0]
        inverse = np.linalg.inv(s[: (p + 1) ** 2].reshape(p + 1, p + 1) + 1e-10 * np.eye(p + 1))
        step = np.clip(inverse @ add_up(weighted, 1, score(inverse, beta))[0], -5, 5)
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    return {"intercept": float(beta[0]), "coef": beta[1:], "mean": mean, "sd": sd}


def model_table(spark, name: str, features: list[str], fit: dict) -> DataFrame:
    """SNK-07: a fit as rows ``model, term, coef, mean, sd``; the intercept is a term."""
    rows = [(name, "(intercept)", float(fit["intercept"]), 0.0, 1.0)]
    rows += [(name, f, float(c), float(m), float(s)) for f, c, m, s in zip(features, fit["coef"], fit["mean"], fit["sd"], strict=True)]
    return spark.createDataFrame(rows, "model string, term string, coef double, mean double, sd double")


def model_from_table(model: DataFrame, name: str | None = None) -> tuple[list[str], dict]:
    """SNK-07: feature names, in their order, and the fit of a model's rows; a missing or doubled intercept or term is an error."""
    rows = (model if name is None else model.filter(F.col("model") == name)).collect()
    heads = [r for r in rows if r["term"] == "(intercept)"]
    terms = sorted((r for r in rows if r["term"] != "(intercept)"), key=lambda r: r["term"])
    if len(heads) != 1 or len({r["term"] for r in terms}) != len(terms):
        raise ValueError(f"{len(heads)} intercepts and {len(terms)} terms are not one model")
    column = lambda c: np.array([r[c] for r in terms], float)
    return [r["term"] for r in terms], {"intercept": heads[0]["coef"], "coef": column("coef"), "mean": column("mean"), "sd": column("sd")}


def predict_linear(long: DataFrame, model: DataFrame, key: str, missing: str = "null") -> DataFrame:
    """ML-10: probability of each model for rows ``key, feature, value``; a missing term gives null, or its mean counts."""
    from riskloom.functions.scalars import sigmoid

    terms = model.filter("term <> '(intercept)'")
    heads = model.filter("term = '(intercept)'").select("model", F.col("coef").alias("_b"))
    need = terms.groupBy("model").agg(F.count(F.lit(1)).alias("_need"))
    joined = long.join(terms, F.col("feature") == F.col("term"))
    sums = joined.groupBy(key, "model").agg(F.sum(F.col("coef") * (F.col("value") - F.col("mean")) / F.col("sd")).alias("_s"), F.count("value").alias("_have"))
    full = sums.join(heads.join(need, "model"), "model")
    p = sigmoid(F.col("_b") + F.col("_s"), 500.0)
    return full.select(key, "model", (F.when(F.col("_have") == F.col("_need"), p) if missing == "null" else p).alias("p"))


def _probabilities(fitted: list[dict]):
    """Probabilities of rows for a fit, as a function that tasks take along."""
    scale = np.array([f["coef"] / f["sd"] for f in fitted])
    base = np.array([f["intercept"] for f in fitted])
    mean = np.array([f["mean"] for f in fitted])
    return lambda x, f: 1 / (1 + np.exp(-np.clip(base[f] + np.nan_to_num(x - mean[f]) @ scale[f], -500, 500)))


#: Places that cut the probabilities of a fit, scores that a range aims at, and scores that a task gathers before it hands them on.
CUTS, RANGE_ROWS, GATHERED = 1023, 200_000, 1 << 21


def held_out_aucs(rows: DataFrame, fits: list[Fit], fitted: list[dict], shuffle: Shuffle | None = None) -> DataFrame:
    """``fit, auc, pos, neg`` on the rows that each fit left out, ties half; one class gives null.

    A first pass counts probabilities between fixed cuts, from which each fit gets ranges
    of about ``RANGE_ROWS`` rows. In a second one tasks sort what they have and hand on
    the distinct probabilities of each fit, range and class as packed numbers, which
    are shuffled once. A range gives its pairs, and ranges add up.
    """
    probability = _probabilities(fitted)
    # closer together near the intercept, around which probabilities lie
    spread = np.tan(np.pi * (np.arange(1, CUTS + 1) / (CUTS + 1) - 0.5)) / 8
    steps = np.array([np.abs(f["coef"]).sum() * spread for f in fitted])
    cuts = 1 / (1 + np.exp(-np.clip(np.array([f["intercept"] for f in fitted])[:, None] + steps, -500, 500)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for batch in batches:
            if batch.num_rows:
                view = Batch(batch, shuffle)
                for f, fit in enumerate(fits):
                    use, y = view.held_out(fit)
                    yield f, probability(view.x[use], f), y[use]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(fits), CUTS + 1))
        for f, p, _ in scored(batches):
            total[f] += np.bincount(np.searchsorted(cuts[f], p), minlength=CUTS + 1)
        yield packed(total)

    edges = []
    for f, sizes in enumerate(add_up(inputs(rows), len(fits), count)):
        # a cut is an edge where the rows up to it reach another multiple
        reached = np.floor(np.cumsum(sizes)[:-1] / RANGE_ROWS)
        edges.append(cuts[f][np.flatnonzero(np.diff(reached, prepend=0) > 0)])

    def hand_on(f: int, p: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = []
        for event in (0, 1):
            values, n = np.unique(p[(y == 1) == bool(event)], return_counts=True)
            ends = [0, *np.searchsorted(values, edges[f], "right").tolist(), len(values)]
            for r, (low, high) in enumerate(zip(ends, ends[1:])):
                if high > low:
                    out.append((r, event, values[low:high].tobytes(), b"" if (n[low:high] == 1).all() else n[low:high].astype(np.int64).tobytes()))
        if out:
            r, event, values, n = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(r), pa.int32()), pa.array(r, pa.int32()), pa.array(event, pa.int32()), pa.array(values, pa.binary()), pa.array(n, pa.binary())], names=["fit", "range", "event", "p", "n"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0
        for f, p, y in scored(batches):
            held.setdefault(f, []).append((p, y))
            size += len(p)
            if size >= GATHERED:
                for k, parts in held.items():
                    yield from hand_on(k, *map(np.concatenate, zip(*parts, strict=True)))
                held, size = {}, 0
        for k, parts in held.items():
            yield from hand_on(k, *map(np.concatenate, zip(*parts, strict=True)))

    def pairs(key: tuple, part: pa.Table) -> pa.Table:
        event = np.repeat(part.column("event").to_numpy(), [len(v.as_buffer()) // 8 for v in part.column("p")])
        numbers = lambda v, n: np.frombuffer(n.as_buffer(), np.int64) if len(n.as_buffer()) else np.ones(len(v.as_buffer()) // 8, np.int64)
        p = np.concatenate([np.frombuffer(v.as_buffer(), float) for v in part.column("p")])
        n = np.concatenate([numbers(v, n) for v, n in zip(part.column("p"), part.column("n"), strict=True)])
        values, at = np.unique(p, return_inverse=True)
        pos, neg = (np.bincount(at[event == e], n[event == e], len(values)) for e in (1, 0))
        row = [key[0].as_py(), key[1].as_py(), int(pos.sum()), int(neg.sum()), float(pos @ (np.cumsum(neg) - neg / 2))]
        return pa.table({k: [v] for k, v in zip(("fit", "range", "pos", "neg", "pairs"), row, strict=True)}, pa.schema([("fit", pa.int32()), ("range", pa.int32()), ("pos", pa.int64()), ("neg", pa.int64()), ("pairs", pa.float64())]))

    parts = inputs(rows).mapInArrow(sort, "fit int, range int, event int, p binary, n binary").groupBy("fit", "range").applyInArrow(pairs, "fit int, range int, pos long, neg long, pairs double")
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("fit").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return parts.withColumn("_below", below).groupBy("fit").agg(F.when(total > 0, F.sum(F.col("pairs") + F.col("pos") * F.col("_below")) / total).alias("auc"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def replicate_scores(rows: DataFrame, fits: list[Fit], fitted: list[dict], held_out: bool = False, shuffle: Shuffle | None = None) -> DataFrame:
    """``fit, id, event, weight, p``: every row scored by every fit in one pass; with ``held_out`` only rows that the fit left out.

    ``event`` is the label as the fit sees it.
    """
    probability, types = _probabilities(fitted), dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            view = Batch(batch, shuffle)
            for f, fit in enumerate(fits):
                w, y = view.training(fit)
                use = view.held_out(fit)[0] if held_out else np.arange(batch.num_rows)
                p = probability(view.x[use], f)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(use), f), pa.int32()), batch.column("id").take(pa.array(use)), pa.array(y[use].astype(np.int32)), pa.array(w[use]), pa.array(p)],
                    names=["fit", "id", "event", "weight", "p"],
                )

    read = [c for c in ("id", "event", "features", "weights", "codes", "number") if c in rows.columns]
    return rows.select(*read).mapInArrow(run, f"fit int, id {types['id']}, event int, weight double, p double")
