"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, accents off, look-alike letters of other
scripts and digits or signs that stand for letters mapped to plain letters. The
lexicon is learned from labelled documents: whole words and word beginnings whose
share of toxic documents is far above chance, weighted by their log-odds. Phrases
(a term with the word before or after it) that occur in clean training documents
more than in toxic ones are exceptions: the term does not count there. The
weights found are summed and also divided by the length in words; a logistic
model on both sums gives the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import materialize

MAX_TRAIN = 20_000
PREFIXES = (4, 5, 6)
FALSE_RATE = 1.0
FLUSH = 200_000

# fixed values: letters of other scripts that look like Latin ones, and signs used for letters
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "ӏ": "l", "α": "a", "β": "b", "ε": "e", "η": "n",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a", "ⅼ": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}
_INVISIBLE = {0x200B: None, 0x200C: None, 0x200D: None, 0x2060: None, 0xFEFF: None, 0xAD: None}


def _table() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(a): b for a, b in LOOK_ALIKES.items()} | dict(_INVISIBLE)
    for c in range(0xC0, 0x250):
        plain = unicodedata.normalize("NFKD", chr(c).lower())[0]
        if plain.isascii() and c not in table:
            table[c] = plain
    for c in range(0xFF01, 0xFF5F):
        table[c] = chr(c - 0xFEE0).lower()
    for c in range(0x300, 0x370):
        table[c] = None
    return table


_TABLE = _table()
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    return text.lower().translate(_TABLE)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic: Counter = Counter()
    clean: Counter = Counter()

    def flush():
        keys = list(toxic.keys() | clean.keys())
        batch = pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())],
            names=["feature", "toxic", "clean"],
        )
        toxic.clear()
        clean.clear()
        return batch

    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            words = set(_WORD.findall(fold(text.as_py() or "")))
            found = {w + " " for w in words if len(w) > 2}
            for n in PREFIXES:
                found.update(w[:n] for w in words if len(w) > n)
            (toxic if label else clean).update(found)
            if len(toxic) + len(clean) > FLUSH:
                yield flush()
    yield flush()


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Terms and weights from ``text, toxic``. A term that ends in a space is a whole word, others are beginnings.

    A term is kept if its count in toxic documents passes a likelihood-ratio test
    at a level where ``FALSE_RATE`` of all features would pass by chance, and at least half its documents are toxic.
    The terms that pass reach the driver; their number is bounded by the sample
    of labelled documents, not by the corpus.
    """
    n = train.groupBy().agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = int(n["t"] or 0), int(n["n"]) - int(n["t"] or 0)
    if not toxic or not clean:
        return {}
    counts = materialize(
        train.select("text", "toxic").mapInArrow(_features, "feature string, toxic long, clean long")
        .groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")),
        "toxicity-features",
    )
    base = toxic / (toxic + clean)
    bound = 2 * math.log(max(1, counts.count()) / FALSE_RATE)
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    part = lambda x, p: F.when(x > 0, x * F.log(x / ((t + c) * p))).otherwise(0.0)
    ratio = 2 * (part(t, base) + part(c, 1 - base))
    strong = counts.filter(t >= c).withColumn("g", ratio).filter(F.col("g") >= bound)
    found = {
        r["feature"]: math.log((r["t"] + 0.5) / (toxic + 1)) - math.log((r["c"] + 0.5) / (clean + 1)) for r in strong.select("feature", "t", "c").collect()
    }
    lexicon: dict[str, float] = {}
    for term in sorted(found, key=len):
        shorter = [lexicon[term[:i]] for i in range(1, len(term)) if term[:i] in lexicon]
        if not shorter or found[term] > max(shorter) + 1:
            lexicon[term] = found[term]
    return lexicon


def _word_before(text: str, at: int) -> str:
    """The last word that ends before a place, however far away."""
    while at and not _WORD.match(text[at - 1]):
        at -= 1
    end = at
    while at and _WORD.match(text[at - 1]):
        at -= 1
    return text[at:end]


class Matcher:
    """Finds lexicon terms at word starts and leaves out those inside exception phrases."""

    def __init__(self, lexicon: dict[str, float], exceptions: set[str]):
        import ahocorasick

        self.exceptions = exceptions
        self.machine = ahocorasick.Automaton()
        for term, weight in lexicon.items():
            core = term.rstrip(" ")
            old = self.machine.get(core, (0, 0.0, 0.0))
            whole, start = (max(old[1], weight), old[2]) if term.endswith(" ") else (old[1], max(old[2], weight))
            self.machine.add_word(core, (len(core), whole, start))
        self.machine.make_automaton()

    def hits(self, text: str) -> list[tuple[str, float, tuple[str, str]]]:
        """Word, weight and the phrases around it, once per place; the heaviest term of a word counts."""
        if not len(self.machine):
            return []
        best: dict[int, float] = {}
        n = len(text)
        for end, (size, whole, start) in self.machine.iter(text):
            first = end - size + 1
            if first and text[first - 1].isalnum():
                continue
            weight = start
            if whole > weight and (end + 1 == n or not text[end + 1].isalnum()):
                weight = whole
            if weight:
                best[first] = max(best.get(first, 0.0), weight)
        out = []
        for first, weight in best.items():
            word = _WORD.match(text, first).group()
            before, after = _word_before(text, first), _WORD.search(text, first + len(word))
            around = (f"{before} {word}" if before else "", f"{word} {after.group()}" if after else "")
            out.append((word, weight, around))
        return out

    def score(self, text: str | None) -> tuple[float, float]:
        folded = fold(text or "")
        total = sum(w for _, w, around in self.hits(folded) if not self.exceptions.intersection(around))
        return (math.log1p(total), math.log1p(1000 * total / (folded.count(" ") + folded.count("\n") + 10))) if total else (0.0, 0.0)


def learn_exceptions(train: DataFrame, lexicon: dict[str, float]) -> set[str]:
    """Phrases around lexicon terms in clean training documents that toxic ones use less."""

    def phrases(batches):
        matcher = Matcher(lexicon, set())
        for batch in batches:
            found: Counter = Counter()
            for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                for p in {p for _, _, around in matcher.hits(fold(text.as_py() or "")) for p in around if p}:
                    found[p, int(label)] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in found], pa.string()), pa.array([n * y for (_, y), n in found.items()], pa.int64()),
                 pa.array([n * (1 - y) for (_, y), n in found.items()], pa.int64())],
                names=["phrase", "toxic", "clean"],
            )

    if not lexicon:
        return set()
    counts = train.select("text", "toxic").mapInArrow(phrases, "phrase string, toxic long, clean long")
    kept = counts.groupBy("phrase").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).filter("c >= 2 and c > t")
    return {r["phrase"] for r in kept.select("phrase").collect()}


def _sums(lexicon: dict[str, float], exceptions: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon, exceptions)
        for batch in batches:
            pairs = [matcher.score(t.as_py()) for t in batch.column("text")]
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([a for a, _ in pairs], pa.float64()), pa.array([b for _, b in pairs], pa.float64())], names=[*names, "total", "density"]
            )

    return run


def fit_logistic(rows: DataFrame, rounds: int = 25, ridge: float = 1.0) -> list[float]:
    """Intercept and two weights by Newton steps; each step is one aggregation of nine sums."""
    x = [F.lit(1.0), F.col("total"), F.col("density")]
    beta = np.zeros(3)
    for _ in range(rounds):
        z = sum(float(b) * c for b, c in zip(beta, x, strict=True))
        p = 1 / (1 + F.exp(-z))
        gradient = [F.sum((F.col("toxic") - p) * c).alias(f"g{i}") for i, c in enumerate(x)]
        hessian = [F.sum(p * (1 - p) * x[i] * x[j]).alias(f"h{i}{j}") for i in range(3) for j in range(i, 3)]
        r = rows.agg(*gradient, *hessian).first()
        g = np.array([r[f"g{i}"] or 0.0 for i in range(3)]) - ridge * beta * [0.01, 1, 1]
        h = np.array([[r[f"h{min(i, j)}{max(i, j)}"] or 0.0 for j in range(3)] for i in range(3)]) + ridge * np.diag([0.01, 1, 1])
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return beta.tolist()


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out=None, max_train: int = MAX_TRAIN, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Learns from at most ``max_train`` labelled rows (drawn by a hash of their id)
    outside ``held_out``, a column expression over ``doc_id``; by default
    crc32(doc_id as text) mod 3 = 1. Ids with contradicting labels count as
    toxic. Null and empty texts hold no term and get the score of clean texts.
    Without labels of both kinds the lexicon is empty and every score is the
    smoothed base rate. Rows that repeat an id are scored each.
    """
    if held_out is None:
        held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("held_out", held_out)
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    drawn = known.filter(~held_out).orderBy(F.xxhash64("doc_id", F.lit(33)), "doc_id").limit(max_train)
    # the ids are bounded, so they travel and the texts stay
    train = materialize(texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic"), "toxicity-train")
    lexicon = learn_lexicon(train)
    exceptions = learn_exceptions(train, lexicon)
    n = train.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if lexicon:
        fitted = materialize(train.mapInArrow(_sums(lexicon, exceptions), "doc_id long, toxic int, total double, density double"), "toxicity-fit")
        a, b, c = fit_logistic(fitted)
    else:
        rate = ((n["t"] or 0) + 0.5) / (n["n"] + 1)
        a, b, c = math.log(rate / (1 - rate)), 0.0, 0.0
    sums = texts.mapInArrow(_sums(lexicon, exceptions), "doc_id long, held_out boolean, total double, density double")
    score = F.round(1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("total") + F.lit(c) * F.col("density")))), 9)
    return sums.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
