"""MinHash near-dedup with b-bit signatures.

Documents whose sets of 5-word shingles have a Jaccard similarity of at least
``percent / 100`` are linked; components of links are the near-duplicate groups.

* Equal sets form a class first; only one document per class goes on.
* 128 minima per class. 32 bands of 4 minima make buckets; of the minima only
  the low 4 bits are kept, packed into 8 longs.
* Candidates meet in buckets. Their similarity is estimated from counts of
  agreeing 4-bit lanes, corrected for chance agreement (1/16); pairs more than
  five standard deviations below the threshold are dropped.
* The others are confirmed on their full sets. Documents of buckets that stay
  open get 512 minima, which halve the deviation of the estimate.

A pair at 0.85 shares no bucket with probability (1 - 0.85**4)**32 = 6e-11, a pair
at 0.8 with 5e-8.

Buckets are never expanded into all pairs. First every member is compared with
the smallest ids of its buckets, those first that it meets most often, and confirmed links are merged into components.
Only where a bucket still holds several components, the members outside its
largest component are compared, in blocks, with the members of other
components: first the most similar ones, then, after another merge, all that
remain. A link between different components can so not be lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import connected_components, materialize
from riskloom.llm.words import mix, shingle_sets

PERMUTATIONS = 128
BANDS = 32
ROWS = PERMUTATIONS // BANDS
BITS = 4
LONGS = PERMUTATIONS * BITS // 64
FINE = 512
PERCENT = 85
SIGMAS = 5.0
QUERY_BLOCK = 256
MEMBER_BLOCK = 1024
BEST = 4
GROUP = 256

_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(0, 2**31, FINE, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
_B = _RNG.integers(0, 2**32, FINE, dtype=np.uint32)
_SALT = _RNG.integers(0, 2**63, BANDS, dtype=np.uint64)


def minima(sets: list[np.ndarray], k: int = PERMUTATIONS) -> np.ndarray:
    """``len(sets) x k`` minima of non-empty sets."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((k, len(sets)), np.uint32)
    work = np.empty_like(flat)
    for i in range(k):
        np.multiply(flat, _A[i], out=work)
        np.add(work, _B[i], out=work)
        np.minimum.reduceat(work, at, out=out[i])
    return np.ascontiguousarray(out.T)


def bands_of(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(len(m), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(_SALT, (len(m), BANDS)).copy()
    for r in range(ROWS):
        h = mix(h + rows[:, :, r])
    return h.view(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    lanes = (m & np.uint32(15)).astype(np.uint64).reshape(len(m), m.shape[1] * BITS // 64, 16)
    return np.bitwise_or.reduce(lanes << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2).view(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(values.ravel()))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, raw = batch.column("doc_id"), batch.column("raw")
        for low in range(0, batch.num_rows, 1024):
            texts, counts, digests, sig, band = batch.column("text").slice(low, 1024), [], [], [], []
            held: list[np.ndarray] = []

            def flush(held=held, sig=sig, band=band):
                if held:
                    full = [s for s in held if len(s)]
                    m = np.zeros((len(held), PERMUTATIONS), np.uint32)
                    if full:
                        m[[i for i, s in enumerate(held) if len(s)]] = minima(full)
                    sig.append(packed(m))
                    band.append(bands_of(m))
                    held.clear()

            size = 0
            for s in shingle_sets(texts):
                counts.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                held.append(s)
                size += len(s)
                if size > 100_000:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(low, 1024), raw.slice(low, 1024),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.binary()),
                    _lists(np.concatenate(sig)),
                    _lists(np.concatenate(band)),
                ],
                names=["doc_id", "raw", "n_shingles", "digest", "sig", "bands"],
            )


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            sets = list(shingle_sets(batch.column("text").slice(low, 256)))
            cuts = np.searchsorted(np.cumsum([len(s) for s in sets]) // 100_000, np.arange(1 + sum(map(len, sets)) // 100_000))
            groups = [sets[i:j] for i, j in zip(cuts, [*cuts[1:], len(sets)], strict=True) if j > i]
            sig = packed(np.concatenate([minima(g, FINE) for g in groups]))
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(low, 256), _lists(sig)], names=["node", "sig"])


def signatures(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, raw, text``), in its order."""
    return docs.mapInArrow(_signatures, "doc_id long, raw long, n_shingles long, digest binary, sig array<long>, bands array<long>")


def estimate(a: str, b: str):
    """Collision-corrected Jaccard estimate of two packed signatures, as a column."""
    lane = F.lit(0x1111111111111111)
    differ = F.lit(0)
    for i in range(LONGS):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(lane))
    chance = 1.0 / (1 << BITS)
    return ((F.lit(1.0) - differ / F.lit(float(PERMUTATIONS))) - chance) / (1 - chance)


def floor_estimate(percent: int, k: int) -> float:
    j, chance = percent / 100, 1.0 / (1 << BITS)
    agree = chance + (1 - chance) * j
    return j - SIGMAS * (agree * (1 - agree) / k) ** 0.5 / (1 - chance)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            left, right = shingle_sets(batch.column("text_a")), shingle_sets(batch.column("text_b"))
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(keep)], names=["a", "b", "linked"]
            )

    return run


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, label: str) -> DataFrame:
    """``a, b, linked`` for candidate pairs, judged on full shingle sets.

    Texts (``node, text``) meet their pairs in groups: one that many pairs need
    is copied once for every ``GROUP`` of them, so no key holds more pairs.
    """

    def with_text(rows: DataFrame, node: str, out: str) -> DataFrame:
        groups = pairs.groupBy(node).agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups"))
        copies = (
            texts.select(F.col("node").alias(node), F.col("text").alias(out)).join(groups, node)
            .withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        )
        dealt = rows.join(groups, node).withColumn("group", F.pmod(F.xxhash64("a", "b"), F.col("groups")).cast("int")).drop("groups")
        return dealt.join(copies, [node, "group"]).drop("group")

    pairs = pairs.select("a", "b")
    both = with_text(with_text(pairs, "a", "text_a"), "b", "text_b")
    return materialize(both.mapInArrow(_confirm(percent), "a long, b long, linked boolean"), label)


def _cross(best: int | None, floor: float):
    """Compare the queries of a block with its members; runs of a key may span batches."""
    chance = 1.0 / (1 << BITS)
    lane = np.uint64(0x1111111111111111)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        is_query = rows["query"].to_numpy()
        q, m = rows[is_query], rows[~is_query]
        out = []
        empty = {"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "query": np.zeros(0, np.int64), "est": np.zeros(0)}
        if len(q) and len(m):
            ms, mb = np.stack(m["sig"].to_numpy()).view(np.uint64), np.stack(m["bands"].to_numpy())
            mc, md = m["component"].to_numpy(), m["node"].to_numpy()
            key = rows["key"].iloc[0]
            for doc, comp, sig, bands in zip(q["node"], q["component"], q["sig"], q["bands"], strict=True):
                x = ms ^ np.asarray(sig).view(np.uint64)
                x |= x >> np.uint64(1)
                x |= x >> np.uint64(2)
                differ = np.bitwise_count(x & lane).sum(axis=1, dtype=np.int64)
                est = ((1 - differ / FINE) - chance) / (1 - chance)
                hit = np.flatnonzero((est >= floor) & (mc != comp))
                # a pair that meets in several buckets is judged in the first of them
                same = mb[hit] == bands
                hit = hit[mb[hit, same.argmax(axis=1)] == key] if len(hit) else hit
                if best and len(hit) > best:
                    hit = hit[np.argsort(-est[hit], kind="stable")[:best]]
                if len(hit):
                    pair = {"a": np.maximum(md[hit], doc), "b": np.minimum(md[hit], doc), "query": doc, "est": est[hit]}
                    out.append(pd.DataFrame(pair))
        return pd.concat(out) if out else pd.DataFrame(empty)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for rows in batches:
            if not len(rows):
                continue
            keys = list(zip(rows["key"], rows["qb"], rows["mb"], strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if keys[i] != last and held:
                    yield compare(pd.concat(held))
                    held = []
                held.append(rows.iloc[i:j])
                last = keys[i]
        if held:
            yield compare(pd.concat(held))

    return run


def _open_pairs(members: DataFrame, components: DataFrame, sigs: DataFrame, best: int | None, floor: float) -> DataFrame:
    """Candidate pairs between components that still share a bucket."""
    placed = members.join(components, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    parts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    open_buckets = (
        parts.groupBy("key")
        .agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top"))
        .filter("parts > 1")
        .select(
            "key",
            F.col("top.component").alias("largest"),
            F.ceil((F.col("n") - F.col("top.n")) / QUERY_BLOCK).cast("int").alias("nq"),
            F.ceil(F.col("n") / MEMBER_BLOCK).cast("int").alias("nm"),
        )
    )
    rows = placed.select("key", "node", "component").join(open_buckets, "key").join(sigs, "node")
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("nq")).cast("int")
    chunk = F.pmod(F.xxhash64("node", F.lit(5)), F.col("nm")).cast("int")
    keep = ["key", "qb", "mb", "query", "node", "component", "sig", "bands"]
    queries = (
        rows.filter("component <> largest").withColumn("qb", own).withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("nm") - 1)))
        .withColumn("query", F.lit(True))
    )
    others = (
        rows.withColumn("mb", chunk).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).withColumn("query", F.lit(False))
    )
    pairs = (
        queries.select(*keep).union(others.select(*keep)).repartition("key", "qb", "mb").sortWithinPartitions("key", "qb", "mb")
        .mapInPandas(_cross(best, floor), "a long, b long, query long, est double")
    )
    return _top(pairs.distinct(), "query", "est", best).distinct() if best else pairs.select("a", "b").distinct()


def _top(pairs: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The ``n`` best pairs of each document; a document has at most a few dozen here."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order), "a", "b"))
    return pairs.withColumn("_r", rank).filter(F.col("_r") <= n).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Near-duplicate components of ``docs``.

    Returns one row per input row: ``doc_id, n_shingles, component_id, kept,
    links, raw, stays``. ``links`` counts the confirmed links found for the
    row's class on the way to the components; ``raw`` is ``xxhash64(text)`` and
    ``stays`` marks the one ``(doc_id, raw)`` of a component that a dedup keeps
    (rows that repeat both are equal and all carry the mark). Null, empty and
    white-space texts have no shingles and are components of their own. Rows
    that repeat an id are documents of their own, whatever their texts; the
    result does not depend on the order of rows. Rows without an id are linked
    like others, but never name a component: one of such rows only has a null
    ``component_id``, and its rows are kept. Other columns of ``docs`` don't
    matter; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("raw", F.xxhash64("text"))
    # written once, so a row's number stays what it is
    rows = materialize(signatures(docs).withColumn("node", F.monotonically_increasing_id()), "minhash-signatures")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "raw", "node")
    classes = materialize(rows.filter("n_shingles > 0").groupBy("digest").agg(F.min(own).alias("least"), F.count(F.lit(1)).alias("n")), "minhash-classes")
    # a class is known by the number of its smallest row
    heads = classes.select("least.*")
    reps = rows.select("node", "sig", "bands").join(heads.select("node"), "node", "left_semi")
    keyed = reps.select("node", F.explode("bands").alias("key"))
    pivots = keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(keyed.join(pivots, "key"), "minhash-buckets")
    met = members.select("node").distinct()
    sig = materialize(reps.join(met, "node", "left_semi"), "minhash-packed")
    floor = floor_estimate(percent, PERMUTATIONS)
    star = (
        _top(
            members.filter("node <> pivot").groupBy(F.col("node").alias("a"), F.col("pivot").alias("b")).agg(F.count(F.lit(1)).alias("met")),
            "a", "met", BEST,
        )
        .join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
        .join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
        .filter(estimate("sig_a", "sig_b") >= floor)
        .select("a", "b")
    )
    star = materialize(star, "minhash-star")
    wide = members.select("key", "node")
    wanted = heads.join(met, "node", "left_semi").select("node", F.col("doc_id").alias("_id"), F.col("raw").alias("_raw"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("raw") == F.col("_raw"))
    texts = materialize(docs.join(wanted, same).select("node", "text").dropDuplicates(["node"]), "minhash-texts")
    judged = confirm(star, texts, percent, "minhash-links")
    components = connected_components(judged.filter("linked"), "minhash")
    fine = materialize(texts.mapInArrow(_fine, "node long, sig array<long>").join(sig.select("node", "bands"), "node"), "minhash-fine")
    floor = floor_estimate(percent, FINE)
    for best in (BEST, None):
        components = materialize(components, "minhash-components")
        candidates = materialize(_open_pairs(wide, components, fine, best, floor), "minhash-open")
        if candidates.isEmpty():
            # no two components hold a candidate, so the last round has none either
            break
        new = materialize(candidates.join(judged.select("a", "b"), ["a", "b"], "left_anti"), "minhash-new")
        if not new.isEmpty():
            judged = judged.union(confirm(new, texts, percent, "minhash-links"))
            components = connected_components(judged.filter("linked"), "minhash")
    linked = judged.filter("linked")
    links = linked.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    placed = components.join(heads.select("node", own.alias("head")), "node")
    tops = placed.join(placed.groupBy("component").agg(F.min("head").alias("top")), "component").join(links, "node", "left")
    named = (
        classes.withColumn("node", F.col("least.node")).join(tops.select("node", "top", "links"), "node", "left")
        .filter("n > 1 or top is not null").select("digest", F.coalesce("top", "least").alias("head"), "links")
    )
    # a class without copies and links is its own component
    head = F.coalesce("head", own)
    joined = rows.select("doc_id", "raw", "node", "n_shingles", "digest").join(named, "digest", "left").withColumn("head", head)
    same_id = F.col("doc_id").eqNullSafe(F.col("head.doc_id"))
    return joined.select(
        "doc_id", "n_shingles", F.col("head.doc_id").alias("component_id"), same_id.alias("kept"), F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        "raw", (same_id & F.col("raw").eqNullSafe(F.col("head.raw"))).alias("stays"),
    )
