"""Small helpers of the registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from planmark.session import ensure_checkpoint_dir


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round doubles and write dates and lists as text, so that any engine can compare the rows."""
    out = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind == "double":
            column = F.round(column, special.get(name, digits)) + F.lit(0.0)
        elif kind == "date":
            column = F.date_format(column, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif kind == "array<string>":
            column = F.array_join(column, ",")
        elif kind.startswith("array<"):
            column = F.array_join(F.transform(column, lambda e: e.cast("string")), ",")
        elif kind == "int":
            column = column.cast("bigint")
        out.append(column.alias(name))
    return df.select(*out)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder on the shared file system of the session."""
    return f"{ensure_checkpoint_dir(spark)}/planmark-{name}-{uuid.uuid4().hex}"
