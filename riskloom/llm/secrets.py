"""Secret scans: fixed patterns, and strings that look random to character Markov models.

Two first-order models over characters are trained: one on random strings, one
on ordinary identifiers. A candidate string is a secret if its log-likelihood
ratio per character passes a cut that the ordinary training strings hardly ever
reach. Candidates are runs of letters, digits and joiners of at least
``MIN_CANDIDATE`` characters; shorter strings are too short to tell.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import materialize
from riskloom.llm.token_store import sampled
from riskloom.llm.words import chunks

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

MIN_CANDIDATE = 20
SAMPLE_DOCS = 2_000
GENERATED = 3_000
FALSE_RATE = 0.001
LEAST = 0.25
STEP = 0.001
# fixed values: syllables of made-up ordinary identifiers
SYLLABLES = ("ba", "con", "de", "en", "fi", "ge", "han", "in", "jo", "ka", "lis", "ma", "no", "or", "pa", "que", "re", "sta", "ter", "un", "ver", "with", "ex", "ya", "zo")

ALPHABET = string.ascii_letters + string.digits + "+/_=-"
_CODE = np.full(128, 0, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)
_STATES = len(ALPHABET) + 1
_IN = np.zeros(256, bool)
_IN[[ord(c) for c in ALPHABET]] = True
_IN_HEX = np.zeros(256, bool)
_IN_HEX[[ord(c) for c in "0123456789abcdef"]] = True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, leftmost and not overlapping within a kind."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return out


def _codes(s: str) -> np.ndarray:
    return _CODE[np.frombuffer(s.encode("ascii", "replace"), np.uint8) & 127]


def transitions(strings: Iterable[str]) -> np.ndarray:
    """How often a character follows another one (0: the beginning)."""
    counts = np.zeros((_STATES, _STATES), np.int64)
    for s in strings:
        code = _codes(s)
        np.add.at(counts, (np.concatenate([[0], code[:-1]]), code), 1)
    return counts


class RandomnessModel:
    """Log-likelihood ratio per character of a string, random against ordinary."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray, cut: float = np.inf):
        log = lambda c: np.log((c + 0.2) / (c + 0.2).sum(axis=1, keepdims=True))
        self.ratio = log(random) - log(ordinary)
        self.cut = cut

    def score(self, s: str) -> float:
        if not s:
            return 0.0
        code = _codes(s)
        return float(self.ratio[np.concatenate([[0], code[:-1]]), code].mean())

    def is_secret(self, s: str) -> bool:
        kinds = any(c.isdigit() for c in s) + any(c.islower() for c in s) + any(c.isupper() for c in s)
        return kinds >= 2 and self.score(s) > self.cut


def generated_strings(n: int = GENERATED, seed: int = 5) -> list[str]:
    """Labelled random strings: hexadecimal, alphanumeric and base64, 20 to 64 characters."""
    rng = np.random.default_rng(seed)
    alphabets = [string.hexdigits[:16], string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"]
    return ["".join(rng.choice(list(alphabets[i % 3]), int(rng.integers(20, 65)))) for i in range(n)]


def generated_identifiers(n: int = GENERATED, seed: int = 7) -> list[str]:
    """Labelled ordinary strings, so that tables of few words have some, too: words of syllables, joined by case, lines or dashes, some with a number."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choice(SYLLABLES, int(rng.integers(1, 4)))) for _ in range(int(rng.integers(1, 5)))]
        name = words[0] + "".join(w.title() for w in words[1:]) if i % 3 == 0 else ("_" if i % 3 == 1 else "-").join(words)
        out.append(name + (str(rng.integers(0, 100)) if i % 5 == 0 else ""))
    return out


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of whole texts with their label."""
    for batch in batches:
        seen: dict[str, bool] = {}
        for value in batch.column("text"):
            text = value.as_py() or ""
            spans = base_spans(text)
            for _, i, j in spans:
                seen.update((c, True) for c in _CANDIDATE.findall(text[i:j])[-1:] if len(c) >= MIN_CANDIDATE)
            for i, j in gaps(spans, len(text)):
                for c in _CANDIDATE.findall(text[i:j]):
                    if len(c) >= 4 and (len(c) < MIN_CANDIDATE or not any(x.isdigit() for x in c)):
                        seen.setdefault(c, False)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.bool_())], names=["s", "random"])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, _STATES, _STATES), np.int64)
    for batch in batches:
        for s, random in zip(batch.column("s").to_pylist(), batch.column("random").to_pylist(), strict=True):
            total[int(random)] += transitions([s])
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])


def train_model(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> RandomnessModel:
    """Train on generated strings of both kinds and on the base matches and ordinary words of ``sample_docs`` documents drawn by a hash of their id.

    Base matches are labelled random. Words of letters, digits and joiners outside
    them are labelled ordinary, except long ones with digits, which may be secrets
    themselves. Texts of the sample are read whole; each different string counts
    once. Tasks count transitions, then scores in steps of ``STEP``; only these
    sums reach the driver.
    """
    strings = materialize(
        sampled(docs, sample_docs, 71).select("text").mapInArrow(_label, "s string, random boolean").groupBy("s").agg(F.max("random").alias("random")), "secret-strings"
    )
    total = np.zeros(2 * _STATES * _STATES, np.int64)
    for r in strings.mapInArrow(_matrices, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[r["at"]] = r["n"]
    ordinary, random = total.reshape(2, _STATES, _STATES)
    made = generated_identifiers()
    model = RandomnessModel(random + transitions(generated_strings()), ordinary + transitions(made))

    def steps(batches):
        for batch in batches:
            bins, n = np.unique(np.array([math.floor(model.score(s) / STEP) for s in batch.column("s").to_pylist()], np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n, pa.int64())], names=["step", "n"])

    scores = Counter(math.floor(model.score(s) / STEP) for s in made)
    for r in strings.filter("not random").select("s").mapInArrow(steps, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect():
        scores[r["step"]] += r["n"]
    above, allowed, model.cut = 0, FALSE_RATE * sum(scores.values()), LEAST
    for step, n in sorted(scores.items(), reverse=True):
        above += n
        if above > allowed:
            model.cut = max(LEAST, (step + 1) * STEP)
            break
    return model


def _long_runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, least: int) -> np.ndarray:
    """Rows that hold a run of at least ``least`` bytes of a class."""
    if not len(data):
        return np.zeros(0, np.int64)
    edge = np.diff(np.concatenate([[False], inside[data], [False]]).astype(np.int8))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = first[end - first >= least]
    return np.unique(np.searchsorted(offsets, first, "right") - 1)


def gaps(spans: list[tuple[str, int, int]], size: int) -> list[tuple[int, int]]:
    """What lies between spans, which may overlap."""
    out, at = [], 0
    for _, i, j in sorted(spans, key=lambda s: s[1]):
        if i > at:
            out.append((at, i))
        at = max(at, j)
    return [*out, (at, size)] if at < size else out


def scan_text(text: str, model: RandomnessModel) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and the spans that the model adds outside of them."""
    base = base_spans(text)
    free = gaps(base, len(text))
    starts = [i for i, _ in free]
    added = []
    for m in _CANDIDATE.finditer(text):
        i, j = m.span()
        if j - i >= MIN_CANDIDATE and (g := bisect_right(starts, i) - 1) >= 0 and j <= free[g][1] and model.is_secret(m.group()):
            added.append(("markov", i, j))
    return base, added


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{i}:{j}" for k, i, j in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


_NOTHING = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")


def _scan(model: RandomnessModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_NOTHING] * batch.num_rows
            column = batch.column("text")
            for first, data, offsets in chunks(column):
                lower = data.tobytes().lower()
                look = set(_long_runs(data, offsets, _IN, MIN_CANDIDATE).tolist())
                look.update(_long_runs(data, offsets, _IN_HEX, 24).tolist())
                for word in _KEYWORDS:
                    at = lower.find(word)
                    while at >= 0:
                        d = int(np.searchsorted(offsets, at, "right") - 1)
                        look.add(d)
                        at = lower.find(word, int(offsets[d + 1]))
                # every access match is a run of the wider class, so those rows are in already
                for d in look:
                    base, added = scan_text(column[first + d].as_py(), model)
                    n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                    rows[first + d] = (*n, len(added), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added))
            values = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(list(v), t) for v, t in zip(values, types, strict=True))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"],
            )

    return run


def scan_secrets(docs: DataFrame, model: RandomnessModel | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans`` for each row of ``docs``.

    Spans are places in code points, end exclusive, in the order of their start.
    Null text counts as empty. Rows that repeat an id are scanned each; other
    columns don't matter. ``model`` is trained on ``docs`` if not given. It judges
    strings of ``MIN_CANDIDATE`` characters or more that mix two of digits, small
    and capital letters; others are never added.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model = model or train_model(texts)
    return texts.mapInArrow(
        _scan(model), "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"
    )
