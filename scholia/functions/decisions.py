"""Decisions of a model as columns: probabilities of yes, of choices and of grades. Payloads are given; the model itself is a pluggable function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.cast("double"), F.lit(0.0))))


def distribution(probabilities: Column) -> Column:
    """A map to a distribution: negative values are 0; all 0 is uniform."""
    clean = F.transform_values(probabilities, lambda _, v: F.greatest(F.lit(0.0), F.coalesce(v.cast("double"), F.lit(0.0))))
    total = F.aggregate(F.map_values(clean), F.lit(0.0), lambda a, v: a + v)
    return F.transform_values(clean, lambda _, v: F.when(total > 0, v / total).otherwise(1.0 / F.size(clean)))


def yes_no(probability: Column) -> Column:
    p = clamp(probability)
    return F.struct(p.alias("probability"), F.when(p >= 0.5, "yes").otherwise("no").alias("label"))


def choice(options: list[str], label: Column, confidence: Column) -> Column:
    """A label with a confidence (0.9 where it has none): the other options share the rest."""
    conf = F.when(confidence.isNull(), 0.9).otherwise(clamp(confidence))
    share = [F.when(label == o, conf).otherwise((1 - conf) / max(1, len(options) - 1)) for o in options]
    dist = distribution(F.map_from_arrays(F.array(*[F.lit(o) for o in options]), F.array(*share)))
    best = F.array_max(F.map_values(dist))
    first = F.coalesce(*[F.when(F.element_at(dist, F.lit(o)) == best, o) for o in options])
    return F.struct(first.alias("label"), best.alias("confidence"), dist.alias("probabilities"))


def grade(levels: int, index: Column, sharpness: float = 1.6) -> Column:
    """A grade (0-based index) spread over its neighbours: expected grade from 1, its normalised value, and the greatest probability."""
    weights = F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: 1 / (1 + F.abs(i - index) * sharpness))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    expected = F.aggregate(F.transform(weights, lambda w, i: w * (i + 1)), F.lit(0.0), lambda a, w: a + w) / total
    return F.struct(expected.alias("score"), clamp((expected - 1) / max(1, levels - 1)).alias("normalized"), (F.array_max(weights) / total).alias("confidence"))


def grade_index(levels: int, raw: Column) -> Column:
    """The index of a score given as a grade from 1, a share from 0 to 1, or a value up to ten; text by its first number; nothing readable is the best grade."""
    v = F.coalesce(raw.try_cast("double"), F.regexp_extract(raw.cast("string"), r"(\d+)", 1).try_cast("double"))
    at = F.when(v.between(1, levels), F.bround(v) - 1).when(v.between(0, 1), F.bround(v * (levels - 1))).otherwise(F.bround(v / 10 * (levels - 1)))
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(levels - 1), at)), F.lit(levels - 1)).cast("int")
