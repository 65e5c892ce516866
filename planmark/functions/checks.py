"""Small yes-or-no tests on values. A null value gives false."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from planmark import reference as ref
from planmark.functions.similarity import ratio_similarity


def in_unit_range(value: Column) -> Column:
    return F.coalesce(value.between(0.0, 1.0), F.lit(False))


def in_percent(value: Column) -> Column:
    return F.coalesce(value.between(0.0, 100.0), F.lit(False))


def known_type(kind: Column) -> Column:
    return F.coalesce(kind.isin(ref.ENTITY_TYPES), F.lit(False))


def fuzzy_match(left: Column, right: Column, threshold: float = 0.85) -> Column:
    """Both lower-cased and trimmed, a matching-block ratio of at least ``threshold``."""
    clean = lambda text: F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return ratio_similarity(clean(left), clean(right)) >= threshold
