"""Filtered listings of drawings and usage rows."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from planmark import reference as ref
from planmark.operators.ordered import row_numbers


@dataclass(frozen=True)
class DrawingFilter:
    """Arguments of a drawing query. None means no filter."""

    status: str | None = None
    needs_review: bool | None = None
    min_confidence: float | None = None
    max_confidence: float | None = None
    has_part_number: bool | None = None
    date_from: datetime | None = None
    date_to: datetime | None = None
    sort_by: str | None = None
    sort_order: str | None = None
    limit: int = 100
    offset: int = 0

    def __post_init__(self) -> None:
        if self.status is not None:
            object.__setattr__(self, "status", self.status.lower())
            if self.status not in ref.DRAWING_STATUSES:
                raise ValueError(f"unknown status {self.status!r}")
        for name in ("min_confidence", "max_confidence"):
            value = getattr(self, name)
            if value is not None and not 0.0 <= value <= 1.0:
                raise ValueError(f"{name} must lie in [0, 1], got {value}")
        if None not in (self.min_confidence, self.max_confidence) and self.min_confidence > self.max_confidence:
            raise ValueError("min_confidence exceeds max_confidence")
        if None not in (self.date_from, self.date_to):
            if (self.date_from.tzinfo is None) != (self.date_to.tzinfo is None):
                raise ValueError("dates must both have a time zone, or neither")
            if self.date_from > self.date_to:
                raise ValueError("date_from is after date_to")
        if not 0 <= self.limit <= ref.MAX_PAGE:
            raise ValueError(f"limit must lie in 0..{ref.MAX_PAGE}, got {self.limit}")
        if self.offset < 0 or (self.limit == 0 and self.offset > 0):
            raise ValueError(f"bad offset {self.offset}")
        if self.sort_by is not None and self.sort_by not in ref.SORT_COLUMNS:
            raise ValueError(f"cannot sort by {self.sort_by!r}")
        if self.sort_order is not None:
            object.__setattr__(self, "sort_order", self.sort_order.lower())
            if self.sort_order not in ("asc", "desc"):
                raise ValueError(f"bad sort order {self.sort_order!r}")
            if self.sort_by is None:
                raise ValueError("sort_order needs sort_by")

    @property
    def page_number(self) -> int:
        return 1 if self.limit == 0 else self.offset // self.limit + 1

    def next_page(self) -> DrawingFilter:
        return replace(self, offset=self.offset + self.limit)

    def previous_page(self) -> DrawingFilter:
        return replace(self, offset=max(0, self.offset - self.limit))

    def first_page(self) -> DrawingFilter:
        return replace(self, limit=100, offset=0)

    def merge(self, other: DrawingFilter) -> DrawingFilter:
        """Values set in ``other`` win."""
        given = {f.name: getattr(other, f.name) for f in fields(other)}
        return replace(self, **{k: v for k, v in given.items() if v is not None})

    def active(self) -> dict[str, object]:
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}

    def is_empty(self) -> bool:
        return not set(self.active()) - {"limit", "offset"}

    def conditions(self) -> list[Column]:
        checks = [
            ("status", lambda v: F.col("status") == v),
            ("needs_review", lambda v: F.col("needs_review") == v),
            ("min_confidence", lambda v: F.col("overall_confidence") >= v),
            ("max_confidence", lambda v: F.col("overall_confidence") <= v),
            ("date_from", lambda v: F.col("processing_timestamp") >= F.lit(v)),
            ("date_to", lambda v: F.col("processing_timestamp") <= F.lit(v)),
        ]
        return [make(getattr(self, name)) for name, make in checks if getattr(self, name) is not None]


def matching(drawings: DataFrame, wanted: DrawingFilter, entities: DataFrame | None = None) -> DataFrame:
    """All rows under the filter, without order or page."""
    for condition in wanted.conditions():
        drawings = drawings.where(condition)
    if wanted.has_part_number is not None:
        if entities is None:
            raise ValueError("the part number filter needs the entity table")
        numbered = entities.where(F.col("entity_type") == "PART_NUMBER").select("drawing_id")
        drawings = drawings.join(numbered, "drawing_id", "left_semi" if wanted.has_part_number else "left_anti")
    return drawings


def query_drawings(drawings: DataFrame, wanted: DrawingFilter, entities: DataFrame | None = None) -> DataFrame:
    """One page; newest first unless ``sort_by`` is set, ties by id."""
    found = matching(drawings, wanted, entities)
    if wanted.sort_by is None:
        order = [F.col("processing_timestamp").desc()]
    else:
        column = F.col(wanted.sort_by)
        order = [column.desc() if wanted.sort_order == "desc" else column.asc()]
    page = found.orderBy(*order, "drawing_id").offset(wanted.offset)
    return page.limit(wanted.limit)


def query_drawings_count(drawings: DataFrame, wanted: DrawingFilter, entities: DataFrame | None = None) -> DataFrame:
    return matching(drawings, wanted, entities).agg(F.count("*").alias("drawings"))


def with_pages(drawings: DataFrame, page_size: int = 100, **options) -> DataFrame:
    """Row and page number of every drawing, newest first, without a single-task sort."""
    numbered = row_numbers(
        drawings, [], "processing_timestamp", "drawing_id", "row_no", descending=True, **options
    )
    return numbered.withColumn("page_no", (F.floor((F.col("row_no") - 1) / page_size) + 1).cast("bigint"))


def review_queue(drawings: DataFrame, limit: int = 50) -> DataFrame:
    if limit < 0:
        raise ValueError("limit must not be negative")
    return (
        drawings.where("needs_review")
        .orderBy(F.col("processing_timestamp").desc(), "drawing_id")
        .limit(limit)
    )


def usage_in_range(usage: DataFrame, start: datetime, end: datetime, drawing_id=None) -> DataFrame:
    """Usage rows of a time range, both ends included, newest first."""
    found = usage.where(F.col("timestamp").between(F.lit(start), F.lit(end)))
    if drawing_id is not None:
        found = found.where(F.col("drawing_id") == F.lit(drawing_id))
    return found.orderBy(F.col("timestamp").desc(), "usage_id")


def low_confidence_rows(text_blocks: DataFrame, entities: DataFrame, detections: DataFrame) -> DataFrame:
    """Rows under the threshold of their table."""

    def under(df: DataFrame, kind: str, key: str, threshold: float) -> DataFrame:
        return df.where(F.col("confidence") < threshold).select(
            F.lit(kind).alias("source"), "drawing_id", F.col(key).cast("string").alias("row_id"), "confidence"
        )

    return (
        under(text_blocks, "text", "text_id", ref.LOW_TEXT_CONFIDENCE)
        .unionByName(under(entities, "entity", "entity_id", ref.LOW_ENTITY_CONFIDENCE))
        .unionByName(under(detections, "shape", "detection_id", ref.LOW_SHAPE_CONFIDENCE))
    )


def ocr_fallback_candidates(text_blocks: DataFrame, primary: str = "paddleocr") -> DataFrame:
    weak = F.col("confidence") < ref.LOW_TEXT_CONFIDENCE
    return text_blocks.where(weak & (F.col("ocr_engine") == primary))


def drawings_missing_part_number(drawings: DataFrame, entities: DataFrame, above: float = 0.70) -> DataFrame:
    sure = entities.where((F.col("entity_type") == "PART_NUMBER") & (F.col("confidence") > above))
    return drawings.join(sure.select("drawing_id"), "drawing_id", "left_anti")


def ids_lookup(drawings: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows for a table of asked ids (drawing_id, position), in the asked order; unknown ids drop out."""
    return asked.join(drawings, "drawing_id").orderBy("position")


def ids_missing(drawings: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.join(drawings.select("drawing_id"), "drawing_id", "left_anti")


def fetch_by_ids(drawings: DataFrame, ids: list) -> DataFrame:
    """Rows for a short list of ids, in its order; an empty result is an error."""
    spark = drawings.sparkSession
    kind = dict(drawings.dtypes)["drawing_id"]
    asked = spark.createDataFrame(
        [(value, i) for i, value in enumerate(ids)], f"drawing_id {kind}, position int"
    )
    found = ids_lookup(drawings, asked)
    if found.isEmpty():
        raise ValueError("none of the asked drawings exists")
    return found
