"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Texts are read once for their number of words. Every source is a line of words:
   its documents in hashed order, end to end, cut into blocks of equal size.
2. Shares follow from weights and sizes; a source's quota is its share in whole
   blocks, more than all of them if its words are repeated.
3. The quotas are dealt to output shards by a tree: a node with the blocks of all
   sources gives its left half a multivariate-hypergeometric draw of them, the
   rest goes right, down to single shards. Every draw has a seed of its own, so
   each shard walks from the root to its leaf alone and all of them agree. What
   the left siblings on the way received is where a shard's blocks of a source
   begin.
4. Blocks are permuted within their source by a keyed bijection; a shard takes
   its stretch of the permuted blocks, so shards are disjoint, and a second
   round begins when all blocks are taken.
5. A shard's pieces are shuffled where they are, by a hash.

Numbers are drawn by inversion around the mode, exact up to rounding at any size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import materialize
from riskloom.operators.permute import key_of, permuted

# fixed values: weights by place among the sources, and how often words may be repeated
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3

SHARDS = 64
BLOCK_WORDS = 256
#: a source has this many blocks at least, or blocks of one word
LEAST_BLOCKS = 1024
LEAST_PARTS = 64
PART_ROWS = 250_000


def targets(sizes: np.ndarray, weights: np.ndarray, most: float = MOST_REPEATS) -> np.ndarray:
    """Shares of all words by weight, none above ``most`` times its size; what is above is shared anew by weight."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    held = np.zeros(len(sizes), bool)
    while True:
        rest, w = sizes.sum() - most * sizes[held].sum(), np.where(held, 0.0, weights)
        share = np.where(held, most * sizes, rest * w / w.sum() if w.sum() else 0.0)
        above = ~held & (share > most * sizes)
        if not above.any():
            return share
        held |= above


def uniform(*key) -> float:
    """A number between 0 and 1 from a key."""
    return (key_of(*key) + 0.5) / 2.0**64


def hypergeometric(good: int, total: int, drawn: int, u: float) -> int:
    """How many of ``good`` among ``total`` are in ``drawn`` draws, at the quantile ``u``."""
    low, high = max(0, drawn - (total - good)), min(good, drawn)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    spread = (drawn * (good / total) * (1 - good / total) * max(0, total - drawn) / max(1, total - 1)) ** 0.5
    reach = int(12 * spread) + 12
    low, high = max(low, mode - reach), min(high, mode + reach)
    x = np.arange(low, high, dtype=float)
    # log of p(x + 1) / p(x); the sums start at the lower end and are levelled at the largest
    step = np.log((good - x) * (drawn - x)) - np.log((x + 1) * (total - good - drawn + x + 1))
    logs = np.concatenate([[0.0], np.cumsum(step)])
    p = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(p, u * p[-1]))


def split(quotas: list[int], drawn: int, seed: str, names: list[str]) -> list[int]:
    """A multivariate-hypergeometric draw of ``drawn`` blocks, source by source."""
    out, total = [], sum(quotas)
    for name, n in zip(names, quotas, strict=True):
        k = hypergeometric(n, total, drawn, uniform(seed, name)) if total else 0
        out.append(k)
        total, drawn = total - n, drawn - k
    return out


def shard_quotas(quotas: list[int], names: list[str], shard: int, shards: int, seed) -> tuple[list[int], list[int]]:
    """Where the blocks of each source begin that a shard takes, and how many there are."""
    low, high, begin, held = 0, shards, [0] * len(quotas), list(quotas)
    while high - low > 1:
        middle = (low + high) // 2
        left = split(held, sum(held) * (middle - low) // (high - low), f"{seed}|{low}|{high}", names)
        if shard < middle:
            high, held = middle, left
        else:
            low, begin, held = middle, [b + k for b, k in zip(begin, left, strict=True)], [n - k for n, k in zip(held, left, strict=True)]
    return begin, held


def _plan(shards: int, seed, weights: tuple[float, ...]):
    """All sources of one table: targets, block sizes and quotas. A group has one row per source."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        # null comes last
        t = table.sort_values(["null", "source"], kind="stable", key=lambda c: c if c.name == "null" else c.map(lambda s: (s or "").encode()))
        w = np.array([weights[i % len(weights)] for i in range(len(t))], float)
        t["target"] = targets(t["source_size"].to_numpy(), w)
        size = t["source_size"].to_numpy().astype(np.int64)
        t["block"] = np.maximum(1, np.minimum(BLOCK_WORDS, size // LEAST_BLOCKS))
        t["blocks"] = -(-size // t["block"])
        t["quota"] = [min(MOST_REPEATS * b, round(float(goal) * b / s)) if s else 0 for goal, b, s in zip(t["target"], t["blocks"].tolist(), size.tolist(), strict=True)]
        return t[["key", "source_size", "target", "block", "blocks", "quota"]]

    return run


def _deal(shards: int, seed):
    def run(table: pd.DataFrame) -> pd.DataFrame:
        t = table.sort_values("key")
        shard = int(t["shard"].iloc[0])
        begin, count = shard_quotas(t["quota"].tolist(), t["key"].tolist(), shard, shards, seed)
        return pd.DataFrame({"key": t["key"], "shard": shard, "begin": begin, "count": count})

    return run


_DRAWS = "array<struct<shard:int,slot:long,from:long,words:long>>"


def _draw(seed):
    """Documents of a part of a source, in order, meet the plan of their source."""

    def run(key, docs: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values(["place", "doc_id", "size"], kind="stable")
        p = plan.iloc[0]
        size = docs["size"].to_numpy().astype(np.int64)
        end = np.cumsum(size) + int(p["base"])
        start, width, blocks, quota = end - size, int(p["block"]), int(p["blocks"]), int(p["quota"])
        first, last = start // width, np.where(size > 0, (end - 1) // width, start // width - 1)
        n = last - first + 1
        doc = np.repeat(np.arange(len(docs)), n)
        block = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[doc]
        low, high = np.maximum(block * width, start[doc]), np.minimum((block + 1) * width, end[doc])
        slot = permuted(block, blocks, key_of(seed, key[0])) if len(block) else block
        begin = np.array(p["begins"], np.int64)
        draws: list[list] = [[] for _ in range(len(docs))]
        for again in range(MOST_REPEATS):
            here = np.flatnonzero(slot + again * blocks < quota)
            at = slot[here] + again * blocks
            shard = np.searchsorted(begin, at, "right") - 1
            for d, s, k, i, w in zip(doc[here].tolist(), shard.tolist(), at.tolist(), (low - start[doc])[here].tolist(), (high - low)[here].tolist(), strict=True):
                draws[d].append({"shard": s, "slot": k, "from": i, "words": w})
        return pd.DataFrame({"doc_id": docs["doc_id"], "place": docs["place"], "size": size, "source_size": int(p["source_size"]), "target": float(p["target"]), "draws": draws})

    return run


def _slim(docs: DataFrame, seed) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = F.col("source").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.concat(source.isNull().cast("int").cast("string"), F.coalesce(source, F.lit(""))).alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), F.xxhash64("doc_id", "text", F.lit(str(seed))).alias("place"),
    )


def draws(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, shards: int = SHARDS, seed=0) -> DataFrame:
    """What the mix takes of each row of ``docs``: ``doc_id, place, size, source_size, target, draws``.

    Sources in the order of their code points, null last, have the ``weights`` in
    turn. They share the words of all documents by weight; no target is above
    three times its source, and what is above is shared anew. A draw is a
    stretch of words: ``shard``, ``slot`` among the source's blocks, ``from`` and
    ``words``. Null text has no words. Repeated ids are rows of their own; equal
    rows lie side by side. Other columns don't matter; an empty table gives no rows.
    """
    rows = materialize(_slim(docs, seed), "mix-sizes")
    parts = max(LEAST_PARTS, -(-rows.count() // PART_ROWS))
    # ranges of the hash, so that parts in a row are documents in hashed order
    part = F.floor((F.col("place") / F.lit(2.0**64) + 0.5) * parts).cast("int").alias("part")
    rows = rows.withColumn("part", F.least(F.greatest(part, F.lit(0)), F.lit(parts - 1)))
    sums = materialize(rows.groupBy("key", "source", "part").agg(F.sum("size").alias("words")), "mix-parts")
    sources = sums.groupBy("key", "source").agg(F.sum("words").alias("source_size")).withColumn("null", F.col("source").isNull())
    plan = materialize(
        sources.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_plan(shards, seed, tuple(weights)), "key string, source_size long, target double, block long, blocks long, quota long"), "mix-plan"
    )
    # a group of the second step has a row per source, too
    dealt = plan.select("key", "quota", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).groupBy("shard").applyInPandas(
        _deal(shards, seed), "key string, shard int, begin long, count long"
    )
    begins = dealt.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "begin"))), lambda x: x["begin"]).alias("begins"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("key", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base")).join(plan, "key").join(begins, "key")
    slim = rows.select("key", "part", "doc_id", "place", "size")
    return slim.groupBy("key", "part").cogroup(bases.groupBy("key", "part")).applyInPandas(
        _draw(seed), f"doc_id long, place long, size long, source_size long, target double, draws {_DRAWS}"
    )


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, shards: int = SHARDS, seed=0) -> DataFrame:
    """The mix itself: ``shard, order, doc_id, source, from, words, text``, each shard in the order of a hash.

    A document's words of a draw are joined by one space. Rows that are equal in
    id and text take their draws together.
    """
    taken = draws(docs, weights, shards, seed).select("doc_id", "place", F.explode("draws").alias("d")).groupBy("doc_id", "place").agg(F.collect_list("d").alias("draws"))
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text", F.lit(str(seed))).alias("place")
    ).dropDuplicates(["doc_id", "place"])
    here = texts.join(taken.withColumnRenamed("doc_id", "_id"), (F.col("doc_id").eqNullSafe(F.col("_id"))) & (texts["place"] == taken["place"])).drop(taken["place"])
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    pieces = here.withColumn("_w", words).select("doc_id", "source", "_w", F.explode("draws").alias("d")).select(
        F.col("d.shard").alias("shard"), F.xxhash64("d.shard", "source", "d.slot", "doc_id", "d.from", F.lit(str(seed))).alias("order"), "doc_id", "source", F.col("d.from").alias("from"),
        F.col("d.words").alias("words"), F.concat_ws(" ", F.slice("_w", (F.col("d.from") + 1).cast("int"), F.col("d.words").cast("int"))).alias("text"),
    )
    return pieces.repartitionByRange(shards, "shard", "order").sortWithinPartitions("shard", "order")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, shards: int = SHARDS, seed=0) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: how many words of each document the mix takes, repeats counted."""
    found = draws(docs, weights, shards, seed)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda s, d: s + d["words"])
    return found.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
