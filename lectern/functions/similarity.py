"""Similarities and scores as Column expressions. Each keeps its thresholds as parameters or named numbers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import col
from lectern.vocab import DEFAULT_WEIGHTS


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where lengths differ or a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def clamp(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def scale(v: Column, zero: float, full: float) -> Column:
    """0 up to `zero`, 1 from `full`, in proportion between."""
    return clamp((v - zero) / (full - zero))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def local_affinity(themes: Column, terms: Column, names: Column, same_text: Column) -> Column:
    return F.least(F.lit(1.0), 0.55 * themes + 0.30 * terms + 0.15 * names + F.when(same_text, 0.1).otherwise(0.0))


def letters(text: Column | str) -> Column:
    return F.array_distinct(F.split(F.regexp_replace(text, r"[^\p{L}]", ""), ""))


def cognate(a: Column, b: Column, language_a: Column, language_b: Column) -> Column:
    """Jaccard of letter sets, only between languages."""
    return F.when(language_a != language_b, jaccard(letters(a), letters(b))).otherwise(0.0)


def dimensions(themes: Column, terms: Column, names: Column, cognates: Column, same_text: Column) -> dict[str, Column]:
    return {
        "thematic": scale(themes, 0, 0.6),
        "linguistic": F.greatest(scale(terms, 0, 0.35), scale(cognates, 0, 0.35)),
        "historical": F.when(same_text, 0.6).otherwise(0.0),
        "narrative": scale(names, 0, 0.4),
        "theological": scale(themes, 0, 0.5),
    }


def normalised_weights(weights: Mapping[str, float] | None = None) -> dict[str, float]:
    """Weights from 0 to 1 that add up to 1; the defaults where none are given or all are 0."""
    own = {k: min(1.0, max(0.0, float((weights or {}).get(k) or 0))) for k in DEFAULT_WEIGHTS}
    total = sum(own.values())
    if not weights or total == 0:
        return dict(DEFAULT_WEIGHTS)
    return own if abs(total - 1) <= 0.001 else {k: v / total for k, v in own.items()}


def composite(scores: Mapping[str, Column | str], weights: Mapping[str, float] | None = None) -> Column:
    own = normalised_weights(weights)
    out = F.lit(0.0)
    for name in DEFAULT_WEIGHTS:
        out = out + col(scores[name]) * own[name]
    return out


def explanation(scores: Mapping[str, Column | str], weights: Mapping[str, float] | None = None, most: int = 3, least: float = 0.02) -> Column:
    """The dimensions that contribute most: (contribution, dimension), largest first."""
    own = normalised_weights(weights)
    each = F.array(*[F.struct(F.round(col(scores[k]) * own[k], 6).alias("contribution"), F.lit(k).alias("dimension")) for k in DEFAULT_WEIGHTS])
    return F.slice(F.reverse(F.array_sort(F.filter(each, lambda e: e["contribution"] > least))), 1, most)


def cross_reference(n_themes: Column, n_terms: Column, names: Column, cross_text: Column) -> Column:
    """(strength, type) of a derived cross-reference."""
    strength = F.least(F.lit(0.95), 0.4 * F.least(F.lit(1.0), n_themes / 3) + 0.3 * F.least(F.lit(1.0), n_terms / 12) + 0.3 * F.least(F.lit(1.0), names / 0.25))
    kind = F.when(names > 0.2, "narrative").when(cross_text & (n_terms >= 6), "allusion").when(n_terms >= 8, "linguistic").otherwise("thematic")
    return F.struct(strength.alias("strength"), kind.alias("type"))


def alignment(longest_phrase: Column, names: Column, cognates: Column, n_themes: Column) -> Column:
    """(type, strength) of two passages, the strongest evidence first."""
    rungs = [
        (longest_phrase > 30, "direct_quote", 0.85),
        (names > 0.2, "narrative_parallel", 0.6),
        (cognates > 0.4, "linguistic_cognate", 0.55),
        (n_themes >= 2, "thematic_parallel", 0.5),
        (n_themes == 1, "theological_echo", 0.3),
        (longest_phrase > 0, "strong_allusion", 0.35),
    ]
    kind, strength = F.lit("none"), F.lit(0.0)
    for test, name, value in reversed(rungs):
        kind, strength = F.when(test, name).otherwise(kind), F.when(test, value).otherwise(strength)
    return F.struct(kind.alias("type"), strength.alias("strength"))


def quotation_score(longest: Column, total: Column) -> Column:
    """From the longest run of words and the words of all runs."""
    return F.round(F.least(F.lit(1.0), F.sqrt(clamp((longest - 5) / 11)) + F.least(F.lit(0.08), F.greatest(F.lit(0.0), (total - longest) / 80))), 4)


def relation_kind(text_a: Column, text_b: Column, place_a: Column, place_b: Column) -> Column:
    """parallel in one text, duplicate at one place of two texts, else quotation."""
    return F.when(text_a == text_b, "parallel").when(place_a == place_b, "duplicate").otherwise("quotation")


def verdict(silence: Column) -> Column:
    return F.when(1 - silence >= 0.6, "addressed").when(1 - silence >= 0.3, "partial").otherwise("unaddressed")


def candidate_score(rank: Column, coverage: Column, density: Column) -> Column:
    return F.least(F.lit(1.0), rank * (1 - 0.65 * (1 - coverage)) * (1 + 0.15 * density))


def saturated(rank: Column) -> Column:
    return F.least(F.lit(1.0), rank / (rank + 6))


def idf(documents: Column, df: Column) -> Column:
    return F.log((documents + 1) / (df + 1)) + 1


def sublinear(count: Column) -> Column:
    return F.when(count > 0, 1 + F.log(count)).otherwise(0.0)


def lexicon_rank(exact: Column, priority: Column, strong: Column) -> Column:
    return F.when(exact, 0.0).otherwise(100.0) + priority - F.when(strong.isNotNull(), 0.5).otherwise(0.0)
