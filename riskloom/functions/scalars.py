"""Column expressions for assembling cohorts and scoring risk. All stay in the JVM."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that are titles (of the spaced and of the joined form), flags and textures as text
HONORIFICS = ("mr", "mrs", "ms", "mme", "mlle", "mle", "dr", "prof", "monsieur", "madame", "m", "mme.", "mlle.", "mr.", "mrs.", "dr.", "prof.")
JOINED_HONORIFICS = ("mr", "mrs", "ms", "mme", "mlle", "dr", "prof", "m", "mme.", "mlle.", "monsieur", "madame", "doctor", "docteur", "docteure", "professeur")
MALE_WORDS = ("m", "male", "homme", "h", "masculin", "man")
FEMALE_WORDS = ("f", "female", "femme", "feminin", "féminin", "woman")
YES_WORDS = ("true", "1", "oui", "yes", "y")
NO_WORDS = ("false", "0", "non", "no", "n")
SOFT_WORDS = ("mou", "soft", "molle")
FIRM_WORDS = ("dur", "hard", "firm", "ferme")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _decomposed() -> dict[str, str]:
    """Letters whose compatibility decomposition starts with a plain one, over the blocks of Latin letters and presentation forms."""
    out = {}
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x2190), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFF5F)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code).lower()) if not unicodedata.combining(c))
        plain = "".join(c if c.isascii() else " " for c in plain.lower())
        if plain != chr(code) and plain.strip():
            out[chr(code)] = plain
    return out


_FOLD = _decomposed()
_SINGLE = {a: b for a, b in _FOLD.items() if len(b) == 1}


def _plain(c) -> Column:
    """Lower case without accents: composed letters by their decomposition, combining marks dropped."""
    text = F.translate(F.lower(_c(c)), "".join(_SINGLE), "".join(_SINGLE.values()))
    for letter, plain in _FOLD.items():
        if len(plain) > 1:
            text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.regexp_replace(text, "[\\u0300-\\u036f]+", "")


def canonical_tokens(c, drop: tuple[str, ...] = HONORIFICS) -> Column:
    """Lower-case accent-free alphanumeric tokens without titles."""
    tokens = F.split(_plain(c), "[^a-z0-9]+")
    return F.filter(tokens, lambda t: (t != "") & ~t.isin(*drop))


def canonical_id(c, joiner: str = "") -> Column:
    """FN-01a/b: identifier without accents, case, punctuation and titles; the joined and the spaced form each have their own titles."""
    return F.array_join(canonical_tokens(c, HONORIFICS if joiner else JOINED_HONORIFICS), joiner)


def canonical_name(c) -> Column:
    """FN-01c: header or value normaliser; titles stay."""
    return F.regexp_replace(F.regexp_replace(_plain(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def safe_double(c) -> Column:
    """FN-02: text to double; decimal comma accepted; blank, nan and bad text become null."""
    text = F.replace(F.trim(_c(c).cast("string")), F.lit(","), F.lit("."))
    number = text.try_cast("double")
    return F.when(F.isnan(number), None).otherwise(number)


def _flag(c, yes: tuple[str, ...], no: tuple[str, ...]) -> Column:
    text = F.lower(F.trim(_c(c).cast("string")))
    number = safe_double(c)
    return F.when(text.isin(*yes), 1).when(text.isin(*no), 0).when(number.isNotNull(), (number > 0).cast("int"))


def male_indicator(c) -> Column:
    """FN-03."""
    return _flag(c, MALE_WORDS, FEMALE_WORDS)


def yes_no(c) -> Column:
    """FN-04."""
    return _flag(c, YES_WORDS, NO_WORDS)


def texture_indicator(c) -> Column:
    """FN-05."""
    text = F.lower(F.trim(_c(c)))
    return F.when(text.isin(*SOFT_WORDS), 1).when(text.isin(*FIRM_WORDS), 0)


def grade_to_event(c, positives: tuple[str, ...]) -> Column:
    """FN-06: unknown and null grades are no events."""
    return F.coalesce(F.upper(F.trim(_c(c))).isin(*positives).cast("int"), F.lit(0))


def first_flag_site(flags: list[tuple[str, Column]], default: str) -> Column:
    """FN-07: name of the first flag that is set."""
    out = None
    for name, flag in flags:
        out = F.when(flag > 0, name) if out is None else out.when(flag > 0, name)
    return out.otherwise(default) if out is not None else F.lit(default)


def any_flag(flags: list[Column], text: Column | None = None, words: tuple[str, ...] = ()) -> Column:
    """FN-07b: 1 if any flag is set; without any flag, if the text holds one of the words."""
    known = F.greatest(*flags) if len(flags) > 1 else flags[0]
    fallback = F.lit(0)
    if text is not None:
        low = F.lower(text)
        for w in words:
            fallback = F.greatest(fallback, F.coalesce(low.contains(w).cast("int"), F.lit(0)))
    return F.when(known.isNotNull(), (known > 0).cast("int")).otherwise(fallback)


def truncated_cube(x, knot: float) -> Column:
    """FN-08: max(x - knot, 0) cubed; null stays null."""
    x = _c(x)
    d = F.when(x.isNotNull(), F.greatest(x - F.lit(knot), F.lit(0.0)))
    return d * d * d


def logit(p, eps: float = 1e-12) -> Column:
    """FN-09: log-odds of a clipped probability; null stays null."""
    q = F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1 - eps))
    return F.when(_c(p).isNotNull(), F.log(q / (1 - q)))


def sigmoid(x, clip: float = 50.0) -> Column:
    """FN-09: inverse of ``logit`` with a clipped argument; null stays null."""
    return F.when(_c(x).isNotNull(), 1 / (1 + F.exp(-F.least(F.greatest(_c(x), F.lit(-clip)), F.lit(clip)))))


@dataclass(frozen=True)
class LogitSpec:
    """A published linear score: intercept, terms and cubes ``(column, knot, weight)``."""

    name: str
    intercept: float
    terms: dict[str, float]
    cubes: tuple[tuple[str, float, float], ...] = field(default_factory=tuple)


def linear_predictor(spec: LogitSpec) -> Column:
    """FN-10: null if any input is null."""
    out = F.lit(spec.intercept)
    for name, weight in spec.terms.items():
        out = out + F.lit(weight) * F.col(name)
    for name, knot, weight in spec.cubes:
        out = out + F.lit(weight) * truncated_cube(name, knot)
    return out


def linear_logit_score(spec: LogitSpec) -> Column:
    return sigmoid(linear_predictor(spec), 500.0)


def point_score(rules: list[tuple[Column, int]]) -> Column:
    """FN-11: sum of the points of the rules that hold; null conditions give none."""
    out = F.lit(0)
    for condition, points in rules:
        out = out + F.when(condition, points).otherwise(0)
    return out


def cut(c, edges: list[float], labels: list[str]) -> Column:
    """FN-12: right-closed bins; below the first or above the last edge is null."""
    c = _c(c)
    out = None
    for low, high, label in zip(edges[:-1], edges[1:], labels, strict=True):
        hit = (c > low) & (c <= high)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def risk_group(p, low: float, high: float, boundary: str = "left") -> Column:
    """FN-13: ``left`` puts a boundary value in the higher group, ``right`` in the lower one."""
    p = _c(p)
    if boundary == "left":
        return F.when(p < low, "low").when(p < high, "intermediate").when(p >= high, "high")
    return F.when(p <= low, "low").when(p <= high, "intermediate").when(p > high, "high")


def batch_group(manufacturer, model, rules: list[tuple[str, str, str]], default: str = "Other") -> Column:
    """FN-14: the first ``(manufacturer part, model part, label)`` whose parts occur."""
    out = None
    for maker, part, label in rules:
        hit = F.lower(_c(manufacturer)).contains(maker) & F.lower(_c(model)).contains(part)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default) if out is not None else F.lit(default)


def concat_batch_id(a, b) -> Column:
    """FN-15."""
    return F.concat_ws("_", F.trim(_c(a)), F.trim(_c(b)))


def parse_date_multi(c) -> Column:
    """FN-16: ISO date or time, then eight digits, then day/month/year; bad text is null."""
    text = F.trim(_c(c).cast("string"))
    return F.coalesce(
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text)),
        F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd"))),
        F.when(text.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_timestamp(text, F.lit("dd/MM/yyyy"))),
    ).cast("date")


FEATURE_CLASSES = ("shape", "firstorder", "glcm", "glrlm", "glszm", "gldm", "ngtdm")


def feature_family(name) -> tuple[Column, Column]:
    """FN-17: image type and class of a feature from its name."""
    n = F.lower(_c(name))
    image = F.when(n.startswith("log"), "log").when(n.startswith("wavelet"), "wavelet").otherwise("original")
    kind = F.regexp_extract(n, "(" + "|".join(FEATURE_CLASSES) + ")", 1)
    return image, F.when(kind == "", "other").otherwise(kind)


def safe_id(c, default: str = "unknown") -> Column:
    """FN-19."""
    cleaned = F.regexp_replace(F.regexp_replace(F.trim(_c(c)), "[^A-Za-z0-9._-]+", "_"), "^[_.]+|[_.]+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(default))


def slug(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def fingerprint(cols: list[str], digest: str = "sha256") -> Column:
    """FN-20: hash of the named fields as key-sorted JSON; nulls are left out."""
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]))
    return F.md5(text) if digest == "md5" else F.sha2(text, 256)


def unit_convert(c, factor: float) -> Column:
    """FN-21."""
    return _c(c) * F.lit(factor)


def coalesce_fields(json, names: list[str]) -> Column:
    """FN-22: the first of alternative JSON fields that is present and not blank."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(_c(json), f"$.{n}")), F.lit("")) for n in names])


Z95 = 1.959963984540054


def wilson_interval(events, n, z: float = Z95) -> tuple[Column, Column]:
    """CL-09: score interval of a share, inside [0, 1]; (0, 0) for n = 0."""
    x, m = _c(events).cast("double"), _c(n).cast("double")
    p = x / m
    centre = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    low = F.when(m > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0)
    high = F.when(m > 0, F.least(F.lit(1.0), centre + half)).otherwise(0.0)
    return low, high


def normal_cdf(z) -> Column:
    """Standard normal distribution function (Abramowitz-Stegun 26.2.17, error below 1e-7)."""
    z = _c(z)
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def hash_key(*parts) -> Column:
    """Order key for seeded resampling: md5 of the parts joined by ``|``."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def hash_index(n: Column, *parts) -> Column:
    """A draw from 0..n-1: the first eight hex digits of the key, modulo n."""
    return F.pmod(F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("long"), n)


def register_sql_functions(spark) -> None:
    """UD-05: FN-08, FN-09 and CL-09 as SQL functions of the session."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION truncated_cube(x DOUBLE, k DOUBLE) RETURNS DOUBLE RETURN power(greatest(x - k, 0D), 3)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION safe_logit(p DOUBLE) RETURNS DOUBLE RETURN ln(least(greatest(p, 1e-12D), 1 - 1e-12D) / (1 - least(greatest(p, 1e-12D), 1 - 1e-12D)))")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION wilson_low(e DOUBLE, n DOUBLE) RETURNS DOUBLE RETURN CASE WHEN n > 0 THEN greatest(0D, "
        f"(e / n + {Z95 * Z95}D / (2 * n) - {Z95}D * sqrt(e / n * (1 - e / n) / n + {Z95 * Z95}D / (4 * n * n))) / (1 + {Z95 * Z95}D / n)) ELSE 0D END"
    )
