"""Order statistics at scale: cumulative sums, midranks, ROC, thresholds, bins.

A window without partition runs in one task. Here rows are first counted by
distinct score, and cumulative sums over the scores are taken in two steps:
inside ranges of the score, and over the totals of the ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.scalars import wilson_interval
from riskloom.operators.aggregates import rates
from riskloom.sources.scratch import kept

RANGES = 64


def range_of(df: DataFrame, order: str, ranges: int = RANGES) -> Column:
    """The number of the range of ``order`` a row lies in, as a column; edges are approximate quantiles over all rows."""
    edges = sorted(set(df.select(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10_000).alias("e")).first()["e"] or [])) if ranges > 1 else []

    # number of edges below the value: a short binary search as nested conditions
    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(order) <= F.lit(edges[mid]), place(lo, mid)).otherwise(place(mid + 1, hi))

    return place(0, len(edges))


def ordered_cumsum(df: DataFrame, order: str, sums: list[str], by: list[str] | None = None, descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """Adds ``cum_<s>`` for each column of ``sums``: the running total in the order of ``order`` within ``by``.

    ``order`` must be unique within ``by``. Ranges come from approximate
    quantiles of ``order`` over all rows (a few numbers on the driver); each
    range is one window partition, and the totals of the ranges before it - at
    most ``ranges`` rows per group - are added.
    """
    by = by or []
    parts = df.withColumn("_range", range_of(df, order, ranges))
    sort = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*by, "_range").orderBy(sort).rowsBetween(Window.unboundedPreceding, 0)
    totals = parts.groupBy(*by, "_range").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    range_sort = F.col("_range").desc() if descending else F.col("_range").asc()
    before = Window.partitionBy(*by or [F.lit(0)]).orderBy(range_sort).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "_range"]
    base = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums])
    local = parts.withColumns({f"cum_{s}": F.sum(s).over(inside) for s in sums})
    # a null group is a group
    joined = local.join(base, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]).drop(*[f"_k{i}" for i in range(len(keys))])
    return joined.withColumns({f"cum_{s}": F.col(f"cum_{s}") + F.col(f"_b_{s}") for s in sums}).drop("_range", *[f"_b_{s}" for s in sums])


def score_counts(df: DataFrame, event: str, score: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Events and non-events (weighted) at each distinct score; null scores are left out."""
    w = F.col(weight) if weight else F.lit(1)
    return df.filter(F.col(score).isNotNull() & F.col(event).isNotNull()).groupBy(*(by or []), F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(event) == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(event) == 0, w).otherwise(0)).alias("neg")
    )


def midrank(df: DataFrame, col: str, by: list[str] | None = None, out: str = "rank") -> DataFrame:
    """WN-01: average rank for ties, from 1; null values have no rank."""
    by = by or []
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ordered_cumsum(counts, col, ["_n"], by)
    ranks = ranked.select(*by, col, (F.col("cum__n") - (F.col("_n") - 1) / 2).alias(out))
    return df.join(ranks, [*by, col], "left")


def running_counts(df: DataFrame, event: str, score: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """``cumulative_counts`` with the events and non-events at the score itself, ``pos`` and ``neg``."""
    by = by or []
    counts = score_counts(df, event, score, by, weight)
    cums = ordered_cumsum(counts, "score", ["pos", "neg"], by, descending=True)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    joined = cums.join(totals, by) if by else cums.crossJoin(F.broadcast(totals))
    return joined.select(*by, "score", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"), "p", "n", "pos", "neg")


def cumulative_counts(df: DataFrame, event: str, score: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """tp and fp at ``score >= t`` for each distinct score, with the totals ``p`` and ``n``."""
    return running_counts(df, event, score, by, weight).drop("pos", "neg")


def roc_curve(df: DataFrame, event: str, score: str, by: list[str] | None = None) -> DataFrame:
    """WN-02: points at the distinct scores and the origin (null threshold)."""
    by = by or []
    c = cumulative_counts(df, event, score, by)
    curve = c.select(*by, F.col("score").alias("threshold"), (F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"), "tp", "fp")
    origin = c.select(*by).distinct() if by else c.sparkSession.range(1)
    zero = F.lit(0).cast("long")
    return curve.unionByName(origin.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), zero.alias("tp"), zero.alias("fp")))


def threshold_sweep(df: DataFrame, event: str, score: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """WN-03, JN-12: all rates at the distinct scores, 0 and 1; one pass over cumulative counts."""
    return sweep_of(cumulative_counts(df, event, score, by, weight), by)


def sweep_of(c: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``threshold_sweep`` of ``cumulative_counts``."""
    by = by or []
    totals = c.groupBy(*by).agg(F.first("p").alias("p"), F.first("n").alias("n"), F.max("score").alias("_top"), F.min("score").alias("_low"))
    zero = F.lit(0).cast("long")
    ends = totals.filter("_low > 0").select(*by, F.lit(0.0).alias("score"), F.col("p").alias("tp"), F.col("n").alias("fp"), "p", "n").unionByName(
        totals.filter("_top < 1").select(*by, F.lit(1.0).alias("score"), zero.alias("tp"), zero.alias("fp"), "p", "n")
    )
    rows = c.unionByName(ends).withColumns({"fn": F.col("p") - F.col("tp"), "tn": F.col("n") - F.col("fp")})
    rows = rows.withColumnRenamed("score", "threshold")
    return rows.withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def best_threshold(sweep: DataFrame, mode: str, by: list[str] | None = None, least: float = 0.9) -> DataFrame:
    """WN-04: largest MCC among thresholds that keep ``least`` sensitivity (rule_out) or specificity (rule_in).

    All thresholds compete if none does. Ties: balanced accuracy, the kept
    rate, closeness to 0.5, then the smaller threshold. The winner is the
    maximum of a struct, so no sort of all thresholds is needed.
    """
    return best_thresholds(sweep, (mode,), by, least)


def best_thresholds(sweep: DataFrame, modes: tuple[str, ...] = ("rule_out", "rule_in"), by: list[str] | None = None, least: float = 0.9) -> DataFrame:
    """WN-04 for several modes from one pass over the sweep; a row per mode."""
    by = by or []
    cols = F.struct(*[c for c in sweep.columns if c not in by])
    best = []
    for mode in modes:
        rate = "sensitivity" if mode == "rule_out" else "specificity"
        eligible = (F.coalesce(F.col(rate), F.lit(0.0)) >= least).cast("int")
        key = F.struct(
            eligible.alias("e"), F.round("mcc", 12).alias("m"), F.coalesce(F.round("balanced", 12), F.lit(-1.0)).alias("b"), F.coalesce(F.round(rate, 12), F.lit(-1.0)).alias("r"),
            (-F.round(F.abs(F.col("threshold") - 0.5), 12)).alias("c"), (-F.col("threshold")).alias("t"),
        )
        best.append(F.max_by(cols, key).alias(f"_{mode}"))
    winners = sweep.groupBy(*by).agg(*best)
    rows = F.array(*[F.struct(F.lit(mode).alias("mode"), F.col(f"_{mode}").alias("w")) for mode in modes])
    return winners.select(*by, F.explode(rows).alias("r")).select(*by, "r.mode", "r.w.*")


def youden_point(df: DataFrame, event: str, score: str, by: list[str] | None = None) -> DataFrame:
    """WN-05: the first threshold (from above) with the largest tpr - fpr."""
    by = by or []
    c = roc_curve(df, event, score, by).filter("threshold is not null").withColumn("youden", F.col("tpr") - F.col("fpr"))
    key = F.struct(F.round("youden", 12).alias("y"), F.col("threshold").alias("t"))
    return c.groupBy(*by).agg(F.max_by(F.struct("threshold", "tpr", "fpr", "youden"), key).alias("_w")).select(*by, "_w.*")


def exact_percentiles(df: DataFrame, col: str, probs: dict[str, float], by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """``by..., <name>...``: exact percentiles, between neighbours by their distance, from rows counted by value.

    Values are ordered in ranges, so no group's values meet in one task. Nulls don't count.
    ``weight`` says how often a row counts.
    """
    by = by or []
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("_v")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"))
    totals = counts.groupBy(*by).agg(F.sum("_c").alias("_total"))
    cums = ordered_cumsum(counts, "_v", ["_c"], by)
    same = [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)]
    named = totals.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], "_total")
    condition = same[0] if same else None
    for s in same[1:]:
        condition = condition & s
    placed = cums.join(named, condition) if by else cums.crossJoin(F.broadcast(named))  # one row
    at = lambda rank: F.max(F.when((F.col("cum__c") > rank) & (F.col("cum__c") - F.col("_c") <= rank), F.col("_v")))
    place = lambda q: F.lit(q) * (F.col("_total") - 1)
    ends = placed.groupBy(*by).agg(F.max("_total").alias("_total"), *[at(F.floor(place(q))).alias(f"_lo_{n}") for n, q in probs.items()], *[at(F.ceil(place(q))).alias(f"_hi_{n}") for n, q in probs.items()])
    part = lambda q: place(q) - F.floor(place(q))
    # equal ends are the value itself, infinite ones too
    between = lambda n, q: F.when(F.col(f"_lo_{n}") == F.col(f"_hi_{n}"), F.col(f"_lo_{n}")).otherwise((1 - part(q)) * F.col(f"_lo_{n}") + part(q) * F.col(f"_hi_{n}"))
    return ends.select(*by, *[between(n, q).alias(n) for n, q in probs.items()])


def tertile_cuts(df: DataFrame, score: str) -> DataFrame:
    """WN-05: the fallback cuts at the tertiles."""
    return exact_percentiles(df, score, {"low": 1 / 3, "high": 2 / 3})


def _bin_rows(rows: DataFrame, b: Column, event: str, score: str) -> DataFrame:
    """n, events, mean score, rate and its Wilson interval of each bin."""
    sums = rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(event).cast("long").alias("events"), F.avg(score).alias("mean_score"), F.avg(event).alias("rate"))
    low, high = wilson_interval("events", "n")
    return sums.withColumns({"low": low, "high": high})


def numbered(df: DataFrame, order: str, tie: str, out: str = "position") -> DataFrame:
    """Adds the place of each row in the order of ``order, tie`` without a one-task window.

    Rows that share a value of ``order`` are dealt by ranges of ``tie`` (by its first
    characters, if it is text), numbered inside a range and shifted by the ranges before.
    """
    if dict(df.dtypes)[tie] == "string":
        part = F.substring(tie, 1, 6)
    else:
        edges = sorted(set(df.select(F.percentile_approx(tie, [i / RANGES for i in range(1, RANGES)], 10_000).alias("e")).first()["e"] or []))
        part = F.array_size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(tie))) if edges else F.lit(0)
    rows = df.withColumn("_part", part)
    sizes = rows.groupBy(order, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(order).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(order, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    counts = sizes.groupBy(order).agg(F.sum("_n").alias("_n"))
    starts = ordered_cumsum(counts, order, ["_n"]).select(order, (F.col("cum__n") - F.col("_n")).alias("_start"))
    own = F.row_number().over(Window.partitionBy(order, "_part").orderBy(tie))
    placed = rows.withColumn("_own", own).join(shifts, [order, "_part"]).join(starts, order)
    return placed.withColumn(out, F.col("_start") + F.col("_shift") + F.col("_own")).drop("_start", "_shift", "_own", "_part")


def place_in_order(df: DataFrame, order: list, out: str) -> DataFrame:
    """Adds the place of each row, from 0, in the order of ``order`` without a one-task window.

    Rows are dealt by ranges and written, numbered inside their range, and shifted by the
    sizes of the ranges before: one row per range is all that a single task sees.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id())
    written = kept(ranged).withColumn("_own", F.col("_seq") - F.shiftleft(F.col("_part").cast("long"), 33))
    sizes = written.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return written.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_own")).drop("_part", "_seq", "_own", "_start")


def quantile_bins(df: DataFrame, event: str, score: str, k: int, tie: str) -> DataFrame:
    """WN-06: bins of equal size in score order (the first ones take one row more), with n, events, mean score, rate and its Wilson interval."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    rows = numbered(df, score, tie, "_pos").crossJoin(F.broadcast(total))
    size, extra = F.floor(F.col("_total") / k), F.col("_total") % k
    edge = (size + 1) * extra
    b = F.when(F.col("_pos") <= edge, F.ceil(F.col("_pos") / (size + 1))).otherwise(extra + F.ceil((F.col("_pos") - edge) / size))
    return _bin_rows(rows, b.cast("int"), event, score)


def quantile_edge_bins(df: DataFrame, event: str, score: str, k: int) -> DataFrame:
    """WN-06: bins between quantile edges, right-closed, equal edges dropped."""
    found = exact_percentiles(df, score, {f"e{i}": i / k for i in range(1, k)}).first()
    edges = sorted({e for e in (found or []) if e is not None})
    b = F.lit(0)
    for e in edges:
        b = b + (F.col(score) > e).cast("int")
    return _bin_rows(df, b, event, score)


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame, bool]]:
    """Rows of sorted batches, cut where a key changes: key, rows, whether the key goes on from the batch before."""
    held = None
    for rows in batches:
        if not len(rows):
            continue
        code = rows.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(rows)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            part = rows.iloc[i:j]
            key = tuple(part[keys].iloc[0])
            yield key, part, key == held
            held = key


def bin_map(counts: np.ndarray, events: np.ndarray, min_n: int, min_events: int) -> dict[str, list[int]]:
    """The bin-closing walk over some scores from every state it may start in, in ``min_n + min_events`` numbers of each kind.

    A state is the open bin: fewer than ``min_n`` rows and fewer than
    ``min_events`` events. It closes where either runs full, whichever comes first, and
    from there the walk goes on as from an empty bin. So for each number of rows and
    each number of events the place where it runs full, the bins closed from there on
    and the state at the end say all; ``walk_from`` puts them together.
    """
    m = len(counts)
    n, e = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(events)])
    # an empty bin that opens at i closes with row full[i]; m: never
    full = np.minimum(np.searchsorted(n[1:], n[:-1] + min_n), np.searchsorted(e[1:], e[:-1] + min_events)).tolist()
    closed, ends = [0] * (m + 1), [0] * (m + 1)
    for i in range(m - 1, -1, -1):
        j = full[i]
        closed[i], ends[i] = (1 + closed[j + 1], ends[j + 1]) if j < m else (0, int((n[m] - n[i]) * min_events + e[m] - e[i]))
    rows = np.searchsorted(n[1:], min_n - np.arange(min_n)).tolist()
    hits = np.searchsorted(e[1:], min_events - np.arange(min_events)).tolist()
    at = rows + hits
    return {"full": at, "closed": [1 + closed[j + 1] if j < m else 0 for j in at], "ends": [ends[j + 1] if j < m else -1 for j in at], "sums": [int(n[m]), int(e[m])]}


def walk_from(state: tuple[int, int], found, min_n: int) -> tuple[tuple[int, int], int]:
    """State and closed bins behind a stretch, from the open bin ``(rows, events)`` before it; states at the end are rows times ``min_events`` plus events."""
    n, e = state
    min_events = len(found["full"]) - min_n
    by_rows, by_events = n, min_n + e
    first = by_rows if found["full"][by_rows] <= found["full"][by_events] else by_events
    if found["ends"][first] < 0:
        return (n + found["sums"][0], e + found["sums"][1]), 0
    return divmod(found["ends"][first], min_events), found["closed"][first]


def adaptive_bins(df: DataFrame, event: str, score: str, by: str, min_n: int = 35, min_events: int = 3, ranges: int = RANGES) -> DataFrame:
    """WN-07: bins closed once they hold ``min_n`` rows or ``min_events`` events, in score order per model.

    Rows are counted by distinct score first. Ranges of the score are walked in
    parallel from every state an open bin may have, so a walk over a model's ranges
    tells each its first state and bin. Then the ranges are walked once more, and
    what they hold of a bin is added up.
    """
    counts = score_counts(df, event, score, [by])
    counts = kept(counts.withColumn("range", range_of(counts, "score", ranges)))
    kind = dict(df.dtypes)[by]
    dealt = counts.repartition(by, "range").sortWithinPartitions(by, "range", "score")

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece = 0
        for k, rows, goes_on in _groups(batches, [by, "range"]):
            piece = piece + 1 if goes_on else 0
            one = bin_map((rows["pos"] + rows["neg"]).to_numpy(np.int64), rows["pos"].to_numpy(np.int64), min_n, min_events)
            yield pd.DataFrame({by: [k[0]], "range": [k[1]], "piece": [piece], **{c: [v] for c, v in one.items()}})

    def entries(table: pd.DataFrame) -> pd.DataFrame:
        """The state and bin with which each range of a model begins; a row per range, or more where a range came in several batches."""
        state, number, out = (0, 0), 0, []
        for r in table.sort_values(["range", "piece"]).to_dict("records"):
            if not r["piece"]:
                out.append((r["range"], state[0] * min_events + state[1], number))
            state, closed = walk_from(state, r, min_n)
            number += closed
        made = pd.DataFrame(out, columns=["range", "state", "first"])
        made.insert(0, by, table[by].iloc[0])
        return made

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = events = number = 0
        for _, rows, goes_on in _groups(batches, [by, "range"]):
            if not goes_on:
                number = int(rows["first"].iloc[0])
                n, events = divmod(int(rows["state"].iloc[0]), min_events)
            bins = []
            for c, v in zip((rows["pos"] + rows["neg"]).tolist(), rows["pos"].tolist(), strict=True):
                bins.append(number)
                n, events = n + c, events + v
                if n >= min_n or events >= min_events:
                    n, events, number = 0, 0, number + 1
            yield pd.DataFrame({by: rows[by], "bin": bins, "n": rows["pos"] + rows["neg"], "events": rows["pos"], "score": rows["score"]})

    begin = dealt.mapInPandas(maps, f"{by} {kind}, range int, piece int, full array<int>, closed array<long>, ends array<long>, sums array<long>").groupBy(by).applyInPandas(entries, f"{by} {kind}, range int, state long, first long")
    own = begin.select(F.col(by).alias("_by"), F.col("range").alias("_r"), "state", "first")
    met = counts.join(own, F.col(by).eqNullSafe(F.col("_by")) & (F.col("range") == F.col("_r"))).select(by, "range", "score", "pos", "neg", "state", "first")
    placed = met.repartition(by, "range").sortWithinPartitions(by, "range", "score").mapInPandas(walk, f"{by} {kind}, bin int, n long, events long, score double")
    return placed.groupBy(by, "bin").agg(F.sum("n").alias("n"), F.sum("events").alias("events"), F.min("score").alias("low"), F.max("score").alias("high"))


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """WN-09: the last document of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("_d")).select(*keys, "_d.*")


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """TK-01, TK-04: the first ``k`` rows by ``order``, which must break ties."""
    return df.orderBy(*order).limit(k)


def extend_panel(freq: DataFrame, panel: DataFrame, k: int) -> DataFrame:
    """TK-01: the next ``k`` features by frequency that are not in the panel."""
    return top_k(freq.join(panel.select("feature"), "feature", "left_anti"), [F.desc("frequency"), "feature"], k)


def k_by_events(events: int, panel: int, multiplier: float, max_k: int, p: int) -> int:
    """TK-02."""
    return int(min(max_k, max(panel, multiplier * events), p))


def rank_features(stats: DataFrame) -> DataFrame:
    """WN-10: place by AUC, absolute correlation and distinct count, all descending; features are few."""
    w = Window.orderBy(F.desc("auc"), F.desc("r"), F.desc("distinct"), "feature")
    return stats.withColumn("place", F.row_number().over(w))
