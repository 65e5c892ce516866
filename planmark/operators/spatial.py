"""Spatial joins inside a drawing.

Nearly every drawing holds a few dozen shapes, so a join on ``drawing_id`` pairs them and plain
columns judge each pair; what follows (best of a shape, obstacles) keeps that layout and shuffles no
more. Compiled pair rows cost a fraction of functions over arrays. A drawing with more than
``DENSE_LIMIT`` shapes is never paired whole: it takes the grid joins below, whose keys split the
drawing into cells, so one huge drawing spreads over the cluster. Both ways are exact and give the
same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from planmark.functions import bbox as bb

DENSE_LIMIT = 64
CELL = 32.0
TOP_LEVEL = 12
KNN_LEVELS = 8


def dense_drawings(shapes: DataFrame, limit: int = DENSE_LIMIT) -> DataFrame | None:
    """Ids of drawings with more than ``limit`` shapes; None where there are none."""
    found = shapes.groupBy("drawing_id").count().where(F.col("count") > limit).select("drawing_id")
    return None if found.isEmpty() else found


def only_dense(df: DataFrame, dense: DataFrame | None) -> DataFrame | None:
    return None if dense is None else df.join(dense, "drawing_id", "left_semi")


def without_dense(df: DataFrame, dense: DataFrame | None) -> DataFrame:
    return df if dense is None else df.join(dense, "drawing_id", "left_anti")


def union_parts(sparse: DataFrame, dense: DataFrame | None) -> DataFrame:
    return sparse if dense is None else sparse.unionByName(dense)


# ---- overlap join on a hierarchical grid --------------------------------------------------


def _level(box: Column) -> Column:
    """Grid level whose cells are at least as large as the box."""
    side = F.greatest(box["width"], box["height"], F.lit(1)) / F.lit(CELL)
    return F.least(F.greatest(F.ceil(F.log2(side)), F.lit(0)), F.lit(TOP_LEVEL)).cast("int")


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / (F.pow(F.lit(2.0), level) * CELL))


def _cover(box: Column, levels: Column) -> Column:
    """The (level, column, row) cells a box touches on each of ``levels``."""

    def at(level: Column) -> Column:
        columns = F.sequence(_cell(bb.left(box), level), _cell(bb.right(box), level))
        rows = F.sequence(_cell(bb.top(box), level), _cell(bb.bottom(box), level))
        return F.flatten(
            F.transform(
                columns,
                lambda gx: F.transform(
                    rows, lambda gy: F.struct(level.alias("lv"), gx.alias("gx"), gy.alias("gy"))
                ),
            )
        )

    return F.flatten(F.transform(levels, at))


def _on_own_level(df: DataFrame, box: str) -> DataFrame:
    """Cells of the box's own level, four or so."""
    return df.select("*", F.inline(_cover(F.col(box), F.array(_level(F.col(box))))))


def _on_levels_above(df: DataFrame, box: str, other: DataFrame, other_box: str, with_own: bool) -> DataFrame:
    """Cells on those coarser levels (and the own one) that boxes of ``other`` have in the drawing."""
    present = other.groupBy("drawing_id").agg(F.collect_set(_level(F.col(other_box))).alias("levels"))
    own = _level(F.col(box))
    wanted = F.filter("levels", lambda lv: (lv >= own) if with_own else (lv > own))
    return df.join(present, "drawing_id").select(*df.columns, F.inline(_cover(F.col(box), wanted)))


def overlap_join(left: DataFrame, right: DataFrame, left_box: str, right_box: str) -> DataFrame:
    """Pairs of the same drawing whose boxes touch, each once.

    Two boxes meet at the coarser of their own levels: one side lies on its own level only, the other
    goes up to it. Small boxes thus never meet in a coarse cell, and a cell holds boxes of its own
    size on one side. Two joins cover both roles. A pair counts in the cell of the upper left corner
    of its common part, so the join needs no distinct. Column names of both sides must differ, but
    for ``drawing_id``.
    """
    a, b = F.col(left_box), F.col(right_box)
    met = (
        bb.overlaps(a, b)
        & (F.col("gx") == _cell(F.greatest(bb.left(a), bb.left(b)), F.col("lv")))
        & (F.col("gy") == _cell(F.greatest(bb.top(a), bb.top(b)), F.col("lv")))
    )
    keys = ["drawing_id", "lv", "gx", "gy"]
    coarse_left = _on_own_level(left, left_box).join(_on_levels_above(right, right_box, left, left_box, True), keys)
    coarse_right = _on_levels_above(left, left_box, right, right_box, False).join(_on_own_level(right, right_box), keys)
    return coarse_left.unionByName(coarse_right).where(met).drop("lv", "gx", "gy")


# ---- nearest neighbours on a density pyramid ----------------------------------------------


def nearest_join(
    points: DataFrame, shapes: DataFrame, key: str, k: int, reach: float, by_edge: bool = False
) -> DataFrame:
    """The ``k`` shapes with the nearest centers within ``reach``, for each point row.

    ``points`` has drawing_id, ``key``, px and py; ``shapes`` has drawing_id, detection_id and
    bbox. With ``by_edge`` the reach counts from the outline, so half the largest diagonal of the
    drawing is added. Shape counts per cell of a pyramid tell, for every point, the finest level
    whose 3×3 cells hold ``k`` shapes. Those lie within 2√2 cells, hence the true neighbours lie
    in the 7×7 cells, and only these are joined. On the coarsest level a cell is as wide as the
    reach and 3×3 cells suffice.
    """
    half = F.sqrt(F.pow(F.col("bbox.width"), 2) + F.pow(F.col("bbox.height"), 2)) / 2
    extra = F.max(half) if by_edge else F.lit(0.0)
    reaches = shapes.groupBy("drawing_id").agg((F.lit(float(reach)) + extra).alias("reach"))

    def cell(value: Column, level: Column) -> Column:
        return F.floor(value / (F.col("reach") / F.pow(F.lit(2.0), F.lit(KNN_LEVELS - 1) - level)))

    def around(level: Column, radius: Column) -> Column:
        steps = F.sequence(-radius, radius)
        return F.flatten(
            F.transform(
                steps,
                lambda dx: F.transform(
                    steps,
                    lambda dy: F.struct(
                        level.alias("lv"),
                        (cell(F.col("px"), level) + dx).alias("gx"),
                        (cell(F.col("py"), level) + dy).alias("gy"),
                    ),
                ),
            )
        )

    levels = F.sequence(F.lit(0), F.lit(KNN_LEVELS - 1))
    cx, cy = bb.center_x(F.col("bbox")), bb.center_y(F.col("bbox"))
    placed = (
        shapes.join(reaches, "drawing_id")
        .select("*", F.explode(levels).alias("lv"))
        .withColumn("gx", cell(cx, F.col("lv")))
        .withColumn("gy", cell(cy, F.col("lv")))
        .drop("reach")
    )
    counts = placed.groupBy("drawing_id", "lv", "gx", "gy").agg(F.count("*").alias("n"))
    asked = points.join(reaches, "drawing_id")
    probes = (
        asked.select("drawing_id", key, "px", "py", "reach", F.explode(levels).alias("level"))
        .select("drawing_id", key, F.explode(around(F.col("level"), F.lit(1))).alias("c"))
        .select("drawing_id", key, "c.*")
    )
    chosen = (
        probes.join(counts, ["drawing_id", "lv", "gx", "gy"])
        .groupBy(key, "lv")
        .agg(F.sum("n").alias("n"))
        .groupBy(key)
        .agg(F.min(F.when(F.col("n") >= k, F.col("lv"))).alias("chosen"))
    )
    top = F.lit(KNN_LEVELS - 1)
    level = F.coalesce(F.col("chosen"), top)
    radius = F.when(level == top, F.lit(1)).otherwise(F.lit(3))
    wanted = (
        asked.join(chosen, key, "left")
        .select("*", F.explode(around(level, radius)).alias("c"))
        .select("*", "c.*")
        .drop("c", "chosen")
    )
    gap = bb.point_distance(F.col("px"), F.col("py"), cx, cy)
    best = Window.partitionBy(key).orderBy("center_distance", "detection_id")
    return (
        wanted.join(placed, ["drawing_id", "lv", "gx", "gy"])
        .withColumn("center_distance", gap)
        .where(F.col("center_distance") <= F.col("reach"))
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= k)
        .drop("lv", "gx", "gy", "reach", "place")
    )
