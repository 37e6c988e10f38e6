"""Seeded splits and resamples as assignment tables; order and draws come from md5, so they don't depend on partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.scalars import hash_index, hash_key
from riskloom.operators.contracts import ContractError


def replicates(spark, r: int, name: str = "rep") -> DataFrame:
    return spark.range(r).select(F.col("id").cast("int").alias(name))


def class_order(df: DataFrame, key: str, event: str, seed, by: list[str] | None = None, salts: int = 64) -> DataFrame:
    """Rows with their place ``pos`` (from 0) in the md5 order of their class (and of ``by``), and the class size.

    The md5 is uniform, so its first hex digits deal a class into ``salts``
    ordered parts; rows are numbered inside a part and shifted by the parts
    before, so no class is sorted in one task.
    """
    keyed = df.withColumn("_h", hash_key(F.lit(str(seed)), *[F.col(b) for b in by or []], F.col(key)))
    by = [*(by or []), event]
    # bytes are in the order of their digits and half as long
    keyed = keyed.withColumn("_s", F.floor(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") * salts / 65536).cast("int")).withColumn("_h", F.unhex("_h"))
    sizes = keyed.groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_s")
    shifts = sizes.select(*by, "_s", (F.sum("_n").over(w) - F.col("_n")).alias("_shift"), F.sum("_n").over(Window.partitionBy(*by)).alias("class_size"))
    own = F.row_number().over(Window.partitionBy(*by, "_s").orderBy("_h", key)) - 1
    return keyed.withColumn("_own", own).join(shifts, [*by, "_s"]).withColumn("pos", F.col("_own") + F.col("_shift")).drop("_h", "_s", "_own", "_shift")


def placed_by_class(df: DataFrame, key: str, event: str, seed, made: Callable[[dict], dict[str, Column]], columns: list[str] | None = None, salts: int = 1024) -> tuple[DataFrame, dict]:
    """Rows with what ``made`` derives from their place ``pos`` of ``class_order``, kept, and the class sizes, which ``made`` is given.

    Columns go along with the hash, so rows are shuffled once and meet nothing by key.
    Rows of one key share a hash, so keys that repeat are seen; they, and rows without
    a key or class, are an error. ``columns``: what to keep, all columns by default.
    """
    from riskloom.sources.scratch import kept

    keyed = df.withColumn("_h", hash_key(F.lit(str(seed)), F.col(key)))
    keyed = keyed.withColumn("_s", F.floor(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") * salts / 65536).cast("int")).withColumn("_h", F.unhex("_h"))
    # a row per part and class, and classes are few
    parts = [tuple(r) for r in keyed.groupBy("_s", event).agg(F.count(F.lit(1)), F.count_if(F.col(key).isNull())).collect()]
    if any(y is None or missing for _, y, _, missing in parts):
        raise ContractError(f"rows without {key} or {event}")
    sizes: dict = {}
    shifts: dict[int, dict] = {}
    for s, y, n, _ in sorted(parts):
        shifts.setdefault(s, {})[y] = sizes.get(y, 0)
        sizes[y] = sizes.get(y, 0) + n
    classes, keep = sorted(sizes), columns or df.columns
    before = df.sparkSession.createDataFrame([(s, [at.get(y, 0) for y in classes]) for s, at in shifts.items()], "_s int, _before array<long>")
    order = Window.partitionBy("_s").orderBy("_h")
    counts = [F.count_if(F.col(event) == F.lit(y)).over(order.rowsBetween(Window.unboundedPreceding, 0)) for y in classes[:-1]]
    # the last class has the rows that are in no other
    own, shift = F.row_number().over(order) - sum(counts, F.lit(0)), F.get("_before", F.lit(max(0, len(classes) - 1)))
    for i, c in enumerate(counts):
        own, shift = F.when(F.col(event) == F.lit(classes[i]), c).otherwise(own), F.when(F.col(event) == F.lit(classes[i]), F.get("_before", F.lit(i))).otherwise(shift)
    rows = keyed.select(*dict.fromkeys([*keep, event]), "_h", "_s")
    numbered = rows.withColumn("_own", own).withColumn("_twice", F.coalesce(F.lag("_h").over(order) == F.col("_h"), F.lit(False)))
    placed = numbered.join(F.broadcast(before), "_s").withColumn("pos", F.col("_own") - 1 + shift)
    out = kept(placed.select(*keep, *[c.alias(n) for n, c in made(sizes).items()], "_twice"))
    if out.filter("_twice").limit(1).count():
        raise ContractError(f"{key} repeats")
    return out.drop("_twice"), sizes


def possible_folds(k: int, sizes: list[int]) -> int:
    """``k`` or the size of the smallest class; below 2 is an error."""
    k = min([k, *sizes]) if len(sizes) > 1 else 0
    if k < 2:
        raise ContractError("too few rows in a class for two folds")
    return k


def stratified_kfold(df: DataFrame, key: str, event: str, k: int, seed=0) -> DataFrame:
    """SP-01: ``key, event, fold``; ``k`` shrinks to the smallest class, below 2 is an error."""
    k = possible_folds(k, [r["n"] for r in df.groupBy(event).agg(F.count(F.lit(1)).alias("n")).collect()])
    return class_order(df.select(key, event), key, event, seed).select(key, event, (F.col("pos") % k).cast("int").alias("fold"))


def repeated_kfold(df: DataFrame, key: str, event: str, k: int, repeats: int, seed=0) -> DataFrame:
    """SP-02: SP-01 for each repeat; the repeat is part of the hash key."""
    reps = df.select(key, event).crossJoin(F.broadcast(replicates(df.sparkSession, repeats)))
    return class_order(reps, key, event, seed, ["rep"]).select("rep", key, event, (F.col("pos") % k).cast("int").alias("fold"))


GREEDY_GROUPS = 10_000


def greedy_folds(groups: list[tuple[str, int, int]], k: int) -> dict[str, int]:
    """Fold of each ``(group, n, events)``: the largest first, each to the fold that leaves class shares most even; ties to the emptier fold."""
    totals = [max(1, sum(n - e for _, n, e in groups)), max(1, sum(e for _, _, e in groups))]
    held, out = [[0, 0] for _ in range(k)], {}
    for name, n, e in sorted(groups, key=lambda g: (-g[1], -g[2], g[0])):
        add = ((n - e) / totals[0], e / totals[1])
        # what a fold adds to the sum of squared shares; with fixed totals that sum is least where shares are even
        best = min(range(k), key=lambda f: (round(sum(2 * held[f][c] * add[c] + add[c] ** 2 for c in (0, 1)), 12), held[f][0] + held[f][1], f))
        held[best] = [held[best][c] + add[c] for c in (0, 1)]
        out[name] = best
    return out


def stratified_group_kfold(df: DataFrame, group: str, event: str, k: int, greedy: int = GREEDY_GROUPS) -> DataFrame:
    """SP-03: ``group, n, events, fold``: folds of whole groups with balanced class shares; a missing group is ``UNKNOWN``.

    The ``greedy`` largest groups, whose counts come to the driver, are dealt by
    ``greedy_folds``; if there are more, the others - small by then - follow in md5
    order, apart for groups with and without events.
    """
    name = F.coalesce(F.col(group).cast("string"), F.lit("UNKNOWN")).alias("group")
    counts = df.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.sum(event).cast("long").alias("events"))
    large = [tuple(r) for r in counts.orderBy(F.desc("n"), F.desc("events"), "group").limit(greedy).collect()]
    dealt = df.sparkSession.createDataFrame(list(greedy_folds(large, k).items()), "group string, fold int")
    first = counts.join(F.broadcast(dealt), "group").select("group", "n", "events", "fold")
    if len(large) < greedy:
        return first
    rest = counts.join(F.broadcast(dealt), "group", "left_anti").withColumn("some", (F.col("events") > 0).cast("int"))
    return first.unionByName(class_order(rest, "group", "some", "folds").select("group", "n", "events", (F.col("pos") % k).cast("int").alias("fold")))


def stratified_holdout(df: DataFrame, key: str, event: str, frac: float, reps: int, seed=0) -> DataFrame:
    """SP-04: rows of the hold-out part of each replicate."""
    rows = df.select(key, event).crossJoin(F.broadcast(replicates(df.sparkSession, reps)))
    placed = class_order(rows, key, event, seed, ["rep"])
    return placed.filter(F.col("pos") < F.round(F.lit(frac) * F.col("class_size"))).select("rep", key, event)


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """SP-05: fold number of each group value, in its order; a row may be a group, so groups are numbered by ranges."""
    from riskloom.operators.order import place_in_order

    return place_in_order(df.select(group).distinct(), [group], "fold")


def temporal_holdout(df: DataFrame, key: str, day: str, frac: float) -> DataFrame:
    """SP-06: ``key, day, part``; the oldest floor((1 - frac) n) rows train. Rows without a date are left out."""
    from riskloom.operators.order import numbered

    dated = df.filter(F.col(day).isNotNull()).select(key, day)
    total = dated.agg(F.count(F.lit(1)).alias("_n"))
    rows = numbered(dated.withColumn("_t", F.unix_micros(F.col(day).cast("timestamp"))), "_t", key).crossJoin(F.broadcast(total))
    return rows.select(key, day, F.when(F.col("position") <= F.floor((1 - frac) * F.col("_n")), "train").otherwise("test").alias("part"))


def domain_holdout(df: DataFrame, domain: str, value=None) -> DataFrame:
    """SP-07: ``part`` is train for the dominant (or named) domain, test for the others."""
    from riskloom.operators.aggregates import dominant

    if value is None:
        value = dominant(df, domain).first()[domain]
    return df.withColumn("part", F.when(F.col(domain) == F.lit(value), "train").otherwise("test"))


#: Replicates whose counts share a number of 64 bits, and draws that one row stands for until they are made.
LANES, BLOCK = 4, 1 << 16


def bootstrap_weights(df: DataFrame, key: str, event: str, reps: int, seed=0, carry: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """SP-08: how often each row is drawn in each stratified replicate; rows with weight 0 (out of bag) included.

    A class has one draw per row, the hash of replicate, class and number, so draws
    come from the sizes of the classes. They are counted by place, four replicates
    to a number of 64 bits, 16 bits each, and meet the rows once. ``carry``: columns
    to go along, which saves callers a join by ``key``.
    """
    from riskloom.operators.joins import small
    from riskloom.sources.scratch import kept

    spark, groups = df.sparkSession, -(-reps // LANES)
    classes = df.filter(F.col(event).isNotNull()).groupBy(event).agg(F.count(F.lit(1)).alias("_size"))
    # classes are few; places of all of them are one line
    before = Window.orderBy(event).rowsBetween(Window.unboundedPreceding, -1)
    classes = kept(classes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))))
    blocks = classes.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_size") - 1) / BLOCK))))
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, blocks.count()))
    numbers = F.sequence(F.col("_b") * BLOCK, F.least((F.col("_b") + 1) * BLOCK, F.col("_size")) - 1)
    draws = blocks.repartition(tasks).withColumn("_d", F.explode(numbers)).crossJoin(F.broadcast(replicates(spark, reps)))
    place = F.col("_start") + hash_index(F.col("_size"), F.lit(str(seed)), F.col("rep"), F.col(event), F.col("_d"))
    lane = (F.col("rep") % LANES) * 16
    one = F.call_function("shiftleft", F.lit(1).cast("long"), lane.cast("int"))
    counts = draws.select((place * groups + F.floor(F.col("rep") / LANES)).alias("_at"), one.alias("_w")).groupBy("_at").agg(F.sum("_w").alias("_w"))
    placed = class_order(df.select(key, event, *carry), key, event, seed).join(small(classes.select(event, "_start")), event)
    every = placed.crossJoin(F.broadcast(spark.range(groups).select(F.col("id").alias("_g")))).withColumn("_at", (F.col("_start") + F.col("pos")) * groups + F.col("_g"))
    # the plan takes the draws, which are made from a few lines, for a small table: without the hint all of them would be gathered on the driver and broadcast
    met = every.join(counts.hint("merge"), "_at", "left").withColumn("rep", F.explode(F.sequence((F.col("_g") * LANES).cast("int"), F.least(F.col("_g") * LANES + LANES, F.lit(reps)).cast("int") - 1)))
    weight = F.call_function("shiftright", F.coalesce("_w", F.lit(0).cast("long")), lane.cast("int")).bitwiseAND(F.lit(65535).cast("long"))
    return met.select("rep", key, event, *carry, weight.cast("int").alias("weight"))


def poisson_weight(key: str, rep: Column, seed=0) -> Column:
    """SP-09: an independent Poisson(1) weight from a hash; no shuffle."""
    u = F.conv(F.substring(hash_key(F.lit(str(seed)), rep, F.col(key)), 1, 8), 16, 10).cast("double") / 4294967296.0
    out, total, term = None, 0.0, 0.36787944117144233
    for i in range(8):
        total += term
        out = F.when(u < total, i) if out is None else out.when(u < total, i)
        term /= i + 1
    return out.otherwise(8)


def poisson_bootstrap_weights(df: DataFrame, key: str, reps: int, seed=0) -> DataFrame:
    rows = df.crossJoin(F.broadcast(replicates(df.sparkSession, reps)))
    return rows.withColumn("weight", poisson_weight(key, F.col("rep"), seed))


def valid_replicates(weights: DataFrame, event: str, min_oob: int = 10) -> DataFrame:
    """Replicates with enough rows out of bag and both classes in and out."""
    w = F.col("weight")
    counts = weights.groupBy("rep").agg(
        F.count_if(w == 0).alias("oob"), F.countDistinct(F.when(w == 0, F.col(event))).alias("out_classes"), F.countDistinct(F.when(w > 0, F.col(event))).alias("in_classes")
    )
    return counts.filter((F.col("oob") >= min_oob) & (F.col("out_classes") == 2) & (F.col("in_classes") == 2)).select("rep", "oob")


def subsample(df: DataFrame, key: str, event: str, frac: float, reps: int, seed=0) -> DataFrame:
    """SP-10: without replacement; class-balanced weights n / (2 n_c)."""
    rows = df.select(key, event).crossJoin(F.broadcast(replicates(df.sparkSession, reps)))
    placed = class_order(rows, key, event, seed, ["rep"]).filter(F.col("pos") < F.ceil(F.lit(frac) * F.col("class_size")))
    n_c = placed.groupBy("rep", event).agg(F.count(F.lit(1)).alias("_c"))
    total = n_c.groupBy("rep").agg(F.sum("_c").alias("_n"))
    return placed.join(n_c, ["rep", event]).join(total, "rep").select("rep", key, event, (F.col("_n") / (2 * F.col("_c"))).alias("balance"))


def permute_labels(df: DataFrame, key: str, event: str, reps: int, seed=0) -> DataFrame:
    """SP-11: labels dealt anew in md5 order; class totals stay.

    The rows with the ``n_events`` smallest places get the events; places come
    from salted parts, as in ``class_order``.
    """
    rows = df.select(key, F.lit(0).alias("_all")).crossJoin(F.broadcast(replicates(df.sparkSession, reps)))
    placed = class_order(rows, key, "_all", seed, ["rep"])
    events = df.agg(F.sum(event).alias("_e"))
    return placed.crossJoin(F.broadcast(events)).select("rep", key, (F.col("pos") < F.col("_e")).cast("int").alias("permuted"))
