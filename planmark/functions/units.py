"""Unit detection, conversion and value parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from planmark import reference as ref
from planmark.functions.text import UNICODE, ascii_digits

ALL_UNITS = {**ref.LENGTH_TO_MM, **ref.WEIGHT_TO_KG}


def _factor(unit: Column, table: dict[str, float]) -> Column:
    pairs = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), unit)


def detect_unit(text: Column) -> Column:
    """First unit in table order that stands as a word or ends the text; an exact unit wins."""
    lowered = F.lower(text)
    exact = F.when(lowered.isin(*ALL_UNITS), lowered)
    found = [
        F.when(lowered.rlike(rf"{UNICODE}\b{re.escape(u)}\b|{re.escape(u)}$"), F.lit(u))
        for u in ALL_UNITS
    ]
    return F.coalesce(exact, *found)


def convert_unit(value: Column, source: Column, target: Column) -> Column:
    """Length to length or weight to weight; null for unknown or mixed units."""
    source, target = F.lower(source), F.lower(target)
    length = value * _factor(source, ref.LENGTH_TO_MM) / _factor(target, ref.LENGTH_TO_MM)
    weight = value * _factor(source, ref.WEIGHT_TO_KG) / _factor(target, ref.WEIGHT_TO_KG)
    return F.coalesce(length, weight)


def to_mm(value: Column, unit: Column) -> Column:
    return value * _factor(F.lower(unit), ref.LENGTH_TO_MM)


def to_kg(value: Column, unit: Column) -> Column:
    return value * _factor(F.lower(unit), ref.WEIGHT_TO_KG)


def dimension_value(text: Column) -> Column:
    """Struct (value, tolerance, unit, is_diameter, value_mm); null where no number is found."""
    group = lambda i: F.regexp_extract(text, UNICODE + ref.DIMENSION_VALUE_PATTERN, i)
    value = ascii_digits(group(2)).try_cast("double")
    tolerance = F.trim(F.replace(ascii_digits(group(3)), F.lit("±"), F.lit(""))).try_cast("double")
    unit = detect_unit(F.nullif(group(4), F.lit("")))
    return F.when(
        value.isNotNull(),
        F.struct(
            value.alias("value"),
            tolerance.alias("tolerance"),
            unit.alias("unit"),
            (group(1) != "").alias("is_diameter"),
            to_mm(value, unit).alias("value_mm"),
        ),
    )


def weight_value(text: Column) -> Column:
    """Struct (value, unit, value_kg)."""
    group = lambda i: F.regexp_extract(text, UNICODE + ref.WEIGHT_VALUE_PATTERN, i)
    value = ascii_digits(group(1)).try_cast("double")
    unit = F.lower(group(2))
    return F.when(
        value.isNotNull(),
        F.struct(value.alias("value"), unit.alias("unit"), to_kg(value, unit).alias("value_kg")),
    )
