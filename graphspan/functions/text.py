"""Scalar functions over text: words, trigrams, similarities, scrubbing.  Built-in functions throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_words(text: Column) -> Column:
    """Maximal runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being worked out once and not for each element that ``use`` looks at."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trigrams(label: Column) -> Column:
    """Three-character windows of the words, joined by and padded with single spaces."""
    padded = F.concat(F.lit(" "), F.array_join(split_words(label), " "), F.lit(" "))
    windows = lambda p: F.when(F.length(p) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - 2, F.lit(1))), lambda i: F.substr(p, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    return _once(padded, windows)


def jaccard(a: Column, b: Column) -> Column:
    """0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def counts(items: Column) -> Column:
    """Sorted array of (item, n)."""
    return _once(items, lambda all_: F.transform(F.array_sort(F.array_distinct(all_)), lambda x: F.struct(x.alias("item"), F.size(F.filter(all_, lambda y: y == x)).cast("double").alias("n"))))


def cosine(a: Column, b: Column) -> Column:
    """Of two count arrays; 0 where either is empty."""
    dot = F.aggregate(a, F.lit(0.0), lambda s, x: s + x["n"] * F.coalesce(F.get(F.filter(b, lambda y: y["item"] == x["item"]), F.lit(0))["n"], F.lit(0.0)))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x["n"] * x["n"]))
    bottom = norm(a) * norm(b)
    return F.when(bottom == 0, 0.0).otherwise(dot / bottom)


def surface(lexical: Column, trigram: Column) -> Column:
    """The better of shared stems and shared trigrams; trigrams count less up to one half."""
    return F.greatest(lexical, F.when(trigram > 0.5, 0.85 * trigram).otherwise(0.6 * trigram))


def fuse(surface_: Column, concept: Column, domain: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(surface_, 0.9 * concept, 0.5 * domain, 0.5 * surface_ + 0.5 * concept))


# What is scrubbed, in this order.  (?U) makes \w, \d and \b know all scripts.
SCRUB = (
    r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    r"(?U)https?://\S+|www\.\S+",
    r"(?U)(?<![\w@])@\w{2,}",
    r"(?U)(?<!\w)\+?\d[\d\s().-]{7,}\d(?!\w)",
    r"(?U)\b\d{9,}\b",
)


def scrub(text: Column, replacement: str = "[redacted]") -> Column:
    out = text
    for pattern in SCRUB:
        out = F.regexp_replace(out, pattern, replacement)
    return F.trim(F.regexp_replace(out, r"\s{2,}", " "))


def contains_pii(text: Column) -> Column:
    out = F.lit(False)
    for pattern in SCRUB:
        out = out | text.rlike(pattern)
    return out


def is_cyrillic(text: Column) -> Column:
    return text.rlike(r"[\x{0400}-\x{04ff}]")


# Ranges of characters by which scripts are told apart.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("cyrillic", 0x0400, 0x04FF), ("greek", 0x0370, 0x03FF), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("devanagari", 0x0900, 0x097F), ("cjk", 0x4E00, 0x9FFF),
    ("kana", 0x3040, 0x30FF), ("hangul", 0xAC00, 0xD7AF),
)


def scripts(text: Column) -> Column:
    """Names of scripts that a text uses."""
    return F.filter(F.array(*[F.when(text.rlike(rf"[\x{{{low:04x}}}-\x{{{high:04x}}}]"), F.lit(n)) for n, low, high in SCRIPTS]), lambda x: x.isNotNull())


def uncovered_scripts(text: Column, covered: tuple[str, ...] = ("latin", "cyrillic")) -> Column:
    return F.array_except(scripts(text), F.array(*[F.lit(c) for c in covered]))


def slug(text: Column, longest: int = 48) -> Column:
    """Runs of letters and digits of ASCII joined by hyphens."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, longest)


def hashed_vectors(features: DataFrame, dim: int = 256) -> DataFrame:
    """label, slot, value: unit vectors of hashed stems (1 each time), classes (1.5) and trigrams (0.3 each time).

    features: label, words (stems in order), grams (array of item, n), classes."""
    items = F.concat(
        F.transform("words", lambda w: F.struct(F.concat(F.lit("s:"), w).alias("token"), F.lit(1.0).alias("v"))),
        F.transform("classes", lambda c: F.struct(F.concat(F.lit("c:"), c).alias("token"), F.lit(1.5).alias("v"))),
        F.transform("grams", lambda g: F.struct(F.concat(F.lit("g:"), g["item"]).alias("token"), (0.3 * g["n"]).alias("v"))),
    )
    slot = F.pmod(F.conv(F.substring(F.sha2("x.token", 256), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
    slots = features.select("label", F.explode(items).alias("x")).groupBy("label", slot.alias("slot")).agg(F.sum("x.v").alias("value"))
    norms = slots.groupBy("label").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return slots.join(norms, "label").select("label", "slot", (F.col("value") / F.col("norm")).alias("value"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rescale(cosine_: Column, floor: float = 0.78, ceiling: float = 0.93) -> Column:
    """An encoder's cosine: 0 up to the floor, 1 from the ceiling on, linear between."""
    return F.when(cosine_ <= floor, 0.0).when(cosine_ >= ceiling, 1.0).otherwise((cosine_ - floor) / (ceiling - floor))
