"""Table folders: append, read, overwrite, snapshots and text sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from planmark import schemas
from planmark.operators.cost import within
from planmark.sources import publish


def append_table(df: DataFrame, root: str, table: str, cluster_by: str | None = "drawing_id") -> None:
    """Append rows; inside each file they lie in id order, so id filters skip row groups."""
    rows = df.sortWithinPartitions(cluster_by) if cluster_by else df
    rows.write.mode("append").parquet(f"{root}/{table}")


def read_table(spark: SparkSession, root: str, table: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema or schemas.TABLES[table]).parquet(f"{root}/{table}")


def ingest_tables(tables: dict[str, DataFrame], root: str, batch: str | None = None) -> bool:
    """Add rows to several tables in one step that readers see whole or not at all.

    The usage table is laid out by day, the others in id order. Give a ``batch`` name to make a
    second run of the same delivery harmless; read with ``publish.read_published``.
    """
    laid = {
        name: df.withColumn("day", F.to_date("timestamp")) if name == "llm_usage"
        else df.sortWithinPartitions("drawing_id")
        for name, df in tables.items()
    }
    return publish.publish_tables(laid, root, batch or uuid.uuid4().hex, {"llm_usage": ["day"]})


def rewrite_table(df: DataFrame, root: str, table: str, version: str) -> str:
    """Write a changed table beside the old one and give the new path; readers switch by path."""
    target = f"{root}/{table}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def table_snapshot(tables: dict[str, DataFrame], root: str, version: str) -> DataFrame:
    """Versioned copy of a set of tables with the row counts that were written."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in tables.items():
        target = rewrite_table(df, root, name, version)
        counts.append((name, version, spark.read.parquet(target).count()))
    return spark.createDataFrame(counts, "table string, version string, rows bigint")


def check_delimiter(delimiter: str, strict: bool = False) -> str:
    """One character; never a line break, and in strict mode no tab or quote."""
    if len(delimiter) != 1:
        raise ValueError(f"delimiter must be one character, got {delimiter!r}")
    if delimiter in "\r\n" or (strict and delimiter in "\t\"'"):
        raise ValueError(f"delimiter {delimiter!r} is not allowed")
    return delimiter


def csv_sink(df: DataFrame, path: str, delimiter: str = ",", strict: bool = False) -> None:
    """CSV with header. The commit protocol shows whole results only."""
    (
        df.write.mode("overwrite")
        .option("sep", check_delimiter(delimiter, strict))
        .option("header", "true")
        .option("quoteAll", "true")
        .csv(path)
    )


def json_sink(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def cost_export(usage: DataFrame, start, end, path: str, kind: str = "csv") -> None:
    """Usage rows of a date range."""
    rows = within(usage, start, end)
    if kind == "csv":
        csv_sink(rows, path)
    elif kind == "json":
        json_sink(rows, path)
    else:
        raise ValueError(f"unknown export format {kind!r}")
