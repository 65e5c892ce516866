"""Table rules, status merges and cascading deletes."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from planmark import reference as ref


@dataclass(frozen=True)
class TableRules:
    """Rules of one table. ``unique`` lists column groups, ``parents`` maps a column to (table, key)."""

    required: tuple[str, ...] = ()
    unit_range: tuple[str, ...] = ()
    not_negative: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    allowed: dict[str, list] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    parents: dict[str, tuple[str, str]] = field(default_factory=dict)


_BOX = {"not_negative": ("bbox.x", "bbox.y"), "positive": ("bbox.width", "bbox.height")}

RULES = {
    "drawings": TableRules(
        required=("drawing_id", "source_file"),
        unit_range=("overall_confidence",),
        allowed={"pipeline_used": ref.PIPELINES, "status": ref.DRAWING_STATUSES},
        unique=(("drawing_id",), ("source_file",)),
    ),
    "text_extractions": TableRules(
        required=("text_id", "drawing_id", "content", "confidence"),
        unit_range=("confidence",),
        allowed={"ocr_engine": ref.OCR_ENGINES, "region_type": ref.REGION_TYPES},
        unique=(("text_id",),),
        parents={"drawing_id": ("drawings", "drawing_id")},
        **_BOX,
    ),
    "entities": TableRules(
        required=("entity_id", "drawing_id", "entity_type", "value", "confidence"),
        unit_range=("confidence",),
        not_negative=("bbox.x", "bbox.y", "bbox.width", "bbox.height"),
        allowed={"entity_type": ref.ENTITY_TYPES, "extraction_method": ref.EXTRACTION_METHODS},
        unique=(("entity_id",),),
        parents={"drawing_id": ("drawings", "drawing_id"), "source_text_id": ("text_extractions", "text_id")},
    ),
    "shape_detections": TableRules(
        required=("detection_id", "drawing_id", "class_name", "confidence", "model_version"),
        unit_range=(
            "confidence", "bbox_normalized.x_center", "bbox_normalized.y_center",
            "bbox_normalized.width", "bbox_normalized.height",
        ),
        unique=(("detection_id",),),
        parents={"drawing_id": ("drawings", "drawing_id")},
        **_BOX,
    ),
    "text_shape_associations": TableRules(
        required=("association_id", "drawing_id", "text_id", "detection_id", "confidence"),
        unit_range=("confidence",),
        not_negative=("distance_pixels",),
        allowed={"relationship_type": ref.RELATIONSHIP_TYPES},
        unique=(("association_id",), ("text_id", "detection_id")),
        parents={
            "drawing_id": ("drawings", "drawing_id"),
            "text_id": ("text_extractions", "text_id"),
            "detection_id": ("shape_detections", "detection_id"),
        },
    ),
    "llm_usage": TableRules(
        required=("usage_id", "drawing_id", "use_case", "provider", "model", "tokens_input", "tokens_output", "cost_usd"),
        not_negative=("tokens_input", "tokens_output", "image_count", "cost_usd"),
        allowed={"use_case": ref.USE_CASES, "provider": ref.PROVIDERS, "model_tier": [0, 1, 2]},
        unique=(("usage_id",),),
        parents={"drawing_id": ("drawings", "drawing_id")},
    ),
    "processing_audit": TableRules(
        required=("audit_id", "drawing_id", "stage", "status"),
        not_negative=("duration_seconds",),
        allowed={"stage": ref.AUDIT_STAGES, "status": ref.AUDIT_STATUSES},
        unique=(("audit_id",),),
        parents={"drawing_id": ("drawings", "drawing_id")},
    ),
    "validation_issues": TableRules(
        required=("issue_id", "drawing_id", "issue_type", "message"),
        allowed={"severity": list(ref.SEVERITY_RANK)},
        unique=(("issue_id",),),
        parents={
            "drawing_id": ("drawings", "drawing_id"),
            "entity_id": ("entities", "entity_id"),
            "detection_id": ("shape_detections", "detection_id"),
            "text_id": ("text_extractions", "text_id"),
        },
    ),
}


def _row_reasons(rules: TableRules) -> list[Column]:
    note = lambda bad, text: F.when(bad, F.lit(text))
    reasons = [note(F.col(c).isNull(), f"{c} is null") for c in rules.required]
    reasons += [note(~F.col(c).between(0.0, 1.0), f"{c} not in 0..1") for c in rules.unit_range]
    reasons += [note(F.col(c) < 0, f"{c} negative") for c in rules.not_negative]
    reasons += [note(F.col(c) <= 0, f"{c} not positive") for c in rules.positive]
    reasons += [note(~F.col(c).isin(values), f"{c} not allowed") for c, values in rules.allowed.items()]
    return reasons


def check_table(df: DataFrame, rules: TableRules, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """Adds ``reasons``, an array that is empty for a good row.

    Row rules cost no shuffle. Duplicates are counted by a pre-aggregated group-by joined back,
    so a key with very many copies stays spread; missing parents show in a left join on the
    distinct parent keys.
    """
    reasons = _row_reasons(rules)
    for i, group in enumerate(rules.unique):
        mark = f"_copies_{i}"
        repeated = df.groupBy(*group).agg(F.count("*").alias(mark)).where(F.col(mark) > 1)
        df = df.join(repeated, list(group), "left")
        reasons.append(F.when(F.col(mark) > 1, F.lit(f"{'+'.join(group)} repeated")))
    for column, (table, key) in rules.parents.items():
        if parents and table in parents:
            known = parents[table].select(F.col(key).alias(f"_p_{column}")).distinct()
            df = df.join(known, F.col(column) == F.col(f"_p_{column}"), "left")
            lost = F.col(column).isNotNull() & F.col(f"_p_{column}").isNull()
            reasons.append(F.when(lost, F.lit(f"{column} without {table}")))
    helpers = [c for c in df.columns if c.startswith(("_copies_", "_p_"))]
    return df.withColumn("reasons", F.array_compact(F.array(*reasons))).drop(*helpers)


def split_good_bad(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = F.size("reasons") == 0
    return checked.where(good).drop("reasons"), checked.where(~good)


def merge_status(drawings: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest change per drawing (columns drawing_id, new_status, changed_at, change_id) wins."""
    latest = changes.where(F.col("new_status").isin(ref.DRAWING_STATUSES)).groupBy("drawing_id").agg(
        F.max_by("new_status", F.struct("changed_at", "change_id")).alias("new_status")
    )
    return (
        drawings.join(latest, "drawing_id", "left")
        .withColumn("status", F.coalesce("new_status", "status"))
        .drop("new_status")
    )


def delete_cascade(
    tables: dict[str, DataFrame], doomed: DataFrame, rules: dict[str, TableRules] | None = None
) -> dict[str, DataFrame]:
    """Tables without the doomed drawings and all their rows.

    Optional references of the rows that stay are emptied where their target goes.
    """
    rules = rules or RULES
    gone = doomed.select("drawing_id").distinct()
    kept = {name: df.join(gone, "drawing_id", "left_anti") for name, df in tables.items()}
    for name, df in kept.items():
        for column, (parent, key) in rules[name].parents.items():
            if column in rules[name].required or parent not in tables or column not in df.columns:
                continue
            lost = tables[parent].join(gone, "drawing_id", "left_semi").select(F.col(key).alias("_gone"))
            df = (
                df.join(lost, F.col(column) == F.col("_gone"), "left")
                .withColumn(column, F.when(F.col("_gone").isNull(), F.col(column)))
                .drop("_gone")
            )
        kept[name] = df
    return kept


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows), one line per table."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
