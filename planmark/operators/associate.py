"""Text-to-shape association and dimension links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from planmark import reference as ref
from planmark.functions import bbox as bb, text as tx
from planmark.operators import spatial

DIMENSION_REACH = 500
LABEL_REACH = 200
MULTIPLIERS = {"dimension": 0.9, "label": 1.0, "note": 0.8}


def reach_of(kind: Column, label: int = LABEL_REACH, dimension: int = DIMENSION_REACH) -> Column:
    return F.when(kind == "dimension", F.lit(dimension)).otherwise(F.lit(label))


def confidence_of(
    kind: Column, text_box: Column, shape_box: Column, shape_class: Column, gap: Column,
    reach: Column, alignment: int = 20,
) -> Column:
    """Distance, size ratio, alignment and wording, weighted, times the multiplier of the kind."""
    by_distance = F.exp(-3 * F.least(gap / reach, F.lit(1.0)))
    small = F.least(bb.area(text_box), bb.area(shape_box))
    large = F.greatest(bb.area(text_box), bb.area(shape_box))
    by_size = F.least(F.lit(1.0), F.coalesce(F.try_divide(small, large), F.lit(0.0)) + 0.5)
    x, y = bb.center_x(text_box), bb.center_y(text_box)
    aligned = (
        (F.abs(y - bb.top(shape_box)) < alignment)
        | (F.abs(y - bb.bottom(shape_box)) < alignment)
        | (F.abs(x - bb.left(shape_box)) < alignment)
        | (F.abs(x - bb.right(shape_box)) < alignment)
    )
    by_alignment = F.when(aligned, F.lit(1.0)).otherwise(F.lit(0.5))
    labelled = F.when(F.lower(shape_class).isin(ref.LABELLED_CLASSES), F.lit(1.0)).otherwise(F.lit(0.7))
    by_wording = F.when(kind == "dimension", F.lit(1.0)).when(kind == "label", labelled).otherwise(F.lit(0.6))
    multiplier = F.lit(0.8)
    for name, value in MULTIPLIERS.items():
        multiplier = F.when(kind == name, F.lit(value)).otherwise(multiplier)
    total = 0.5 * by_distance + 0.2 * by_size + 0.15 * by_alignment + 0.15 * by_wording
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total * multiplier))


def _midpoint(text_box: Column, shape_box: Column) -> tuple[Column, Column]:
    return (
        F.floor((bb.center_x(text_box) + bb.center_x(shape_box)) / 2),
        F.floor((bb.center_y(text_box) + bb.center_y(shape_box)) / 2),
    )


def _blocked(mode: str, text_box: Column, target: Column, other: Column) -> Column:
    """Does ``other`` stand between the text and its target?"""
    x1, y1 = bb.center_x(text_box), bb.center_y(text_box)
    x2, y2 = bb.center_x(target), bb.center_y(target)
    if mode == "simple":
        return bb.point_in(*_midpoint(text_box, target), other)
    hit = bb.segment_hits(x1, y1, x2, y2, other)
    for quarter in range(5):
        t = quarter / 4.0
        x, y = (x1 + (x2 - x1) * t).cast("int"), (y1 + (y2 - y1) * t).cast("int")
        hit = hit | bb.point_in(x, y, other)
    return hit


def _sight_box(mode: str, text_box: Column, target: Column) -> Column:
    """A box around everything an obstacle of this mode could touch."""
    if mode == "simple":
        x, y = _midpoint(text_box, target)
        return bb.box(x, y, F.lit(0), F.lit(0))
    x1, y1 = bb.center_x(text_box), bb.center_y(text_box)
    x2, y2 = bb.center_x(target), bb.center_y(target)
    return bb.from_corners(
        F.floor(F.least(x1, x2)), F.floor(F.least(y1, y2)),
        F.ceil(F.greatest(x1, x2)), F.ceil(F.greatest(y1, y2)),
    )


def text_points(
    text_blocks: DataFrame, label: int = LABEL_REACH, dimension: int = DIMENSION_REACH
) -> DataFrame:
    """Slim rows for the joins: the content stays behind, only its kind travels."""
    kind = tx.text_type(F.col("content"))
    return text_blocks.select(
        "drawing_id",
        "text_id",
        kind.alias("kind"),
        F.col("bbox").alias("text_box"),
        bb.center_x(F.col("bbox")).alias("px"),
        bb.center_y(F.col("bbox")).alias("py"),
        reach_of(kind, label, dimension).alias("limit"),
    )


def association_candidates(
    text_blocks: DataFrame,
    detections: DataFrame,
    obstacles: str | None = "simple",
    k: int = 5,
    label: int = LABEL_REACH,
    dimension: int = DIMENSION_REACH,
    dense_limit: int = spatial.DENSE_LIMIT,
) -> DataFrame:
    """Best shape per text within its reach, with confidence, before the confidence cut.

    ``obstacles`` is ``simple`` (midpoint), ``advanced`` (line of sight) or None.
    """
    points = text_points(text_blocks, label, dimension)
    shapes = detections.select("drawing_id", "detection_id", "class_name", "bbox")
    dense = spatial.dense_drawings(shapes, dense_limit)

    def score(best: DataFrame) -> DataFrame:
        value = confidence_of(
            F.col("kind"), F.col("text_box"), F.col("best.bbox"), F.col("best.class_name"),
            F.col("best.edge"), F.col("limit"),
        )
        return best.select(
            "drawing_id",
            "text_id",
            F.col("best.detection_id").alias("detection_id"),
            F.col("kind").alias("relationship_type"),
            value.alias("confidence"),
            F.col("best.edge").alias("distance_pixels"),
        )

    def rated(shape: Column) -> list[Column]:
        return [
            bb.edge_distance(F.col("px"), F.col("py"), shape["bbox"]).alias("edge"),
            bb.point_distance(
                F.col("px"), F.col("py"), bb.center_x(shape["bbox"]), bb.center_y(shape["bbox"])
            ).alias("center"),
            shape["detection_id"].alias("detection_id"),
            shape["class_name"].alias("class_name"),
            shape["bbox"].alias("bbox"),
        ]

    shape = F.struct("detection_id", "class_name", "bbox")
    edge, center, ident, name, area = rated(shape)
    ranked = F.struct(edge, center, ident, name, area)
    payload = [F.first(c).alias(c) for c in ("kind", "text_box", "limit")]
    few = spatial.without_dense(shapes, dense)
    nearest = Window.partitionBy("drawing_id", "text_id").orderBy("ranked.center", "ranked.detection_id")
    sparse = (
        points.join(few, "drawing_id")
        .select(*[c for c in points.columns if c not in ("px", "py")], ranked.alias("ranked"))
        .withColumn("place", F.row_number().over(nearest))
        .where(F.col("place") <= k)
        .groupBy("drawing_id", "text_id")
        .agg(F.min("ranked").alias("best"), *payload)
        .where(F.col("best.edge") <= F.col("limit"))
    )
    if obstacles:
        other = few.select(
            F.col("drawing_id").alias("other_drawing"), F.col("detection_id").alias("other_id"), F.col("bbox").alias("other")
        )
        in_way = (F.col("other_id") != F.col("best.detection_id")) & _blocked(
            obstacles, F.col("text_box"), F.col("best.bbox"), F.col("other")
        )
        sparse = sparse.join(other, (F.col("drawing_id") == F.col("other_drawing")) & in_way, "left_anti")
    result = score(sparse)
    if dense is None:
        return result

    far = max(label, dimension)
    dense_shapes = spatial.only_dense(shapes, dense)
    neighbours = spatial.nearest_join(
        spatial.only_dense(points, dense), dense_shapes, "text_id", k, far, by_edge=True
    )
    best = (
        neighbours.withColumn("ranked", ranked)
        .groupBy("text_id")
        .agg(
            F.min("ranked").alias("best"), F.first("drawing_id").alias("drawing_id"), *payload,
        )
        .where(F.col("best.edge") <= F.col("limit"))
    )
    if obstacles:
        sight = best.select(
            "drawing_id", "text_id", "text_box", "best",
            _sight_box(obstacles, F.col("text_box"), F.col("best.bbox")).alias("sight"),
        )
        others = dense_shapes.select(
            "drawing_id", F.col("detection_id").alias("other_id"), F.col("bbox").alias("other")
        )
        hit = (
            spatial.overlap_join(sight, others, "sight", "other")
            .where(
                (F.col("other_id") != F.col("best.detection_id"))
                & _blocked(obstacles, F.col("text_box"), F.col("best.bbox"), F.col("other"))
            )
            .select("text_id")
        )
        best = best.join(hit, "text_id", "left_anti")
    return result.unionByName(score(best))


def association_id() -> Column:
    return tx.make_id("ASSOC", F.col("text_id"), F.col("detection_id"))


def associate_text_shapes(
    text_blocks: DataFrame,
    detections: DataFrame,
    min_confidence: float = 0.6,
    obstacles: str | None = "simple",
    **options,
) -> DataFrame:
    """One association per text at most: nearest outline of the five nearest centers."""
    found = association_candidates(text_blocks, detections, obstacles, **options)
    return found.where(F.col("confidence") >= min_confidence).select(association_id().alias("association_id"), "*")


def nearest_shape(
    points: DataFrame,
    detections: DataFrame,
    key: str,
    reach: float,
    dense_limit: int = spatial.DENSE_LIMIT,
) -> DataFrame:
    """Nearest center closer than ``reach``; ``points`` has drawing_id, key, px, py and payload."""
    shapes = detections.select("drawing_id", "detection_id", "class_name", "bbox")
    dense = spatial.dense_drawings(shapes, dense_limit)
    gap = bb.point_distance(
        F.col("px"), F.col("py"), bb.center_x(F.col("bbox")), bb.center_y(F.col("bbox"))
    ).alias("center_distance")
    payload = [c for c in points.columns if c not in ("drawing_id", key)]
    sparse = (
        points.join(spatial.without_dense(shapes, dense), "drawing_id")
        .select(*points.columns, F.struct(gap, "detection_id", "class_name").alias("near"))
        .where(F.col("near.center_distance") < reach)
        .groupBy("drawing_id", key)
        .agg(F.min("near").alias("near"), *[F.first(c).alias(c) for c in payload])
        .select(*points.columns, "near.*")
    )
    big = None
    if dense is not None:
        big = spatial.nearest_join(
            spatial.only_dense(points, dense), spatial.only_dense(shapes, dense), key, 1, reach
        ).select(*points.columns, "center_distance", "detection_id", "class_name")
    return spatial.union_parts(sparse, big).where(F.col("center_distance") < reach)


def link_dimensions(entities: DataFrame, detections: DataFrame, reach: float = 500.0, **options) -> DataFrame:
    """Dimension entity to the nearest shape center below ``reach``, with the feature it measures."""
    points = entities.where(F.col("entity_type") == "DIMENSION").select(
        "drawing_id", "entity_id", "value",
        bb.center_x(F.col("bbox")).alias("px"), bb.center_y(F.col("bbox")).alias("py"),
    )
    near = nearest_shape(points, detections, "entity_id", reach, **options)
    return near.select(
        "drawing_id", "entity_id", "detection_id",
        tx.feature_type(F.col("value"), F.col("class_name")).alias("feature_type"),
        F.exp(-2 * F.col("center_distance") / reach).alias("confidence"),
    )
