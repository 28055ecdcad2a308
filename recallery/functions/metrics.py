"""Scores and metrics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallery.functions.text import metric_tokens


def degree_weight(degree: Column) -> Column:
    """How much an entity of that degree counts: 1 / ln(1 + degree), the degree at least 1."""
    return 1.0 / F.log1p(F.greatest(degree.cast("double"), F.lit(1.0)))


def unit(vec: Column) -> Column:
    """A vector over its length (at least 1e-12), as doubles."""
    wide = vec.cast("array<double>")
    norm = F.greatest(F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    return F.transform(wide, lambda x: x / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def clipped(score: Column) -> Column:
    """Not a number and infinite become 0, and so do negative scores."""
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.greatest(score, F.lit(0.0)))


def fused(entity: Column, semantic: Column, we: float, ws: float) -> Column:
    return F.lit(we) * entity + F.lit(ws) * semantic


def token_f1(gold, predicted) -> Column:
    """F1 over distinct tokens: both empty 1, one empty or nothing shared 0."""
    g, p = F.array_distinct(metric_tokens(gold)), F.array_distinct(metric_tokens(predicted))
    ng, np_, both = F.size(g), F.size(p), F.size(F.array_intersect(g, p))
    precision, recall = both / np_, both / ng
    return F.when((ng == 0) & (np_ == 0), 1.0).when((ng == 0) | (np_ == 0) | (both == 0), 0.0).otherwise(2.0 * precision * recall / (precision + recall))


def recall_at(gold: Column, found: Column, empty_gold: str = "one") -> Column:
    """Share of the gold items found, repeats counted; without gold 1, or null with ``empty_gold='skip'``."""
    none = F.lit(1.0) if empty_gold == "one" else F.lit(None).cast("double")
    return F.when(F.coalesce(F.size(gold), F.lit(0)) <= 0, none).otherwise(F.size(F.filter(gold, lambda g: F.array_contains(found, g))) / F.size(gold))


def hit_at(gold: Column, found: Column, empty_gold: str = "one") -> Column:
    none = F.lit(True) if empty_gold == "one" else F.lit(None).cast("boolean")
    return F.when(F.coalesce(F.size(gold), F.lit(0)) <= 0, none).otherwise(F.coalesce(F.arrays_overlap(gold, found), F.lit(False)))


def percent(c: Column) -> Column:
    return F.round(100 * c, 2)
