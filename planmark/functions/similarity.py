"""String similarity that has no JVM equivalent."""

from __future__ import annotations

import difflib
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@lru_cache(maxsize=100_000)
def _ratio(a: str, b: str) -> float:
    """Blocks repeat across drawings, so a worker process remembers the pairs it met of late."""
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def ratio_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-block ratio 2·M/(a+b); call it only on pairs that survived a cheap filter. Null where a side is null."""
    return pd.Series([None if a is None or b is None else _ratio(a, b) for a, b in zip(left, right)], dtype="float64")
