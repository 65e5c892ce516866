"""Audit trail and snapshot log."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from planmark import reference as ref
from planmark.operators.ordered import preceding, row_numbers


def audit_stage_durations(audit: DataFrame, **options) -> DataFrame:
    """Per drawing: place of each step, its share of the total time, steps failed so far in the drawing."""
    totals = audit.groupBy("drawing_id").agg(
        F.sum("duration_seconds").alias("total_seconds"),
        F.min_by("stage", F.when(F.col("status") == "failed", F.struct("timestamp", "audit_id"))).alias("failed_stage"),
    )
    placed = row_numbers(audit, ["drawing_id"], "timestamp", "audit_id", "step_no", **options)
    return placed.join(totals, "drawing_id").select(
        "drawing_id", "audit_id", "stage", F.col("step_no").cast("bigint").alias("step_no"),
        "duration_seconds", "total_seconds",
        F.coalesce(F.try_divide("duration_seconds", "total_seconds"), F.lit(0.0)).alias("share"), "failed_stage",
    )


def invalid_stage_transitions(audit: DataFrame, **options) -> DataFrame:
    """Steps that may not follow the step before them; any step may follow a final one."""
    stepped = preceding(audit, ["drawing_id"], "timestamp", "audit_id", "stage", "previous_stage", **options)
    allowed = F.lit(False)
    for stage, following in ref.STAGE_TRANSITIONS.items():
        if following:
            allowed = allowed | ((F.col("previous_stage") == stage) & F.col("stage").isin(following))
    final = [s for s, following in ref.STAGE_TRANSITIONS.items() if not following]
    checked = F.col("previous_stage").isin([s for s in ref.STAGE_TRANSITIONS if s not in final])
    return stepped.where(checked & ~allowed).select("drawing_id", "audit_id", "previous_stage", "stage")


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Newest row per id; columns snapshot_id, version, created."""
    return (
        snapshots.groupBy("snapshot_id")
        .agg(F.max(F.struct("created", "version")).alias("newest"))
        .select("snapshot_id", "newest.version", "newest.created")
    )


def snapshot_retention(snapshots: DataFrame, now: datetime, days: int = 7, most: int = 10) -> DataFrame:
    """Rows to keep: not older than ``days``, at most ``most`` newest per id."""
    newest = Window.partitionBy("snapshot_id").orderBy(F.col("created").desc(), F.col("version").desc())
    return (
        snapshots.where(F.col("created") >= F.lit(now - timedelta(days=days)))
        .withColumn("place", F.row_number().over(newest))
        .where(F.col("place") <= most)
    )


def label_candidates(detections: DataFrame, below: float = 0.7, most: int = 5) -> DataFrame:
    """First few weak shapes of each drawing, for labelling."""
    first = Window.partitionBy("drawing_id").orderBy("detection_id")
    return (
        detections.where(F.col("confidence") < below)
        .select("drawing_id", "detection_id", "class_name", "confidence")
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= most)
    )
