"""Component hierarchy: root choice, assembly edges, tree and navigation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from planmark import reference as ref
from planmark.functions import bbox as bb
from planmark.operators import spatial
from planmark.operators.aggregate import association_counts
from planmark.session import cut_lineage

FASTENER_REACH = 200.0


def root_component(detections: DataFrame, associations: DataFrame) -> DataFrame:
    """Best of size·0.5 + associations·0.3 + centrality·0.2 per drawing, ties by smaller id.

    Small per-drawing aggregates in place of windows, so a large drawing stays spread out. The slim
    shape rows with their association counts are written once and read three times.
    """
    counts = association_counts(associations).select("detection_id", "associations")
    x, y = bb.center_x(F.col("bbox")), bb.center_y(F.col("bbox"))
    sized = cut_lineage(
        detections.select(
            "drawing_id", "detection_id", "class_name", x.alias("cx"), y.alias("cy"), bb.area(F.col("bbox")).alias("area")
        )
        .join(counts, "detection_id", "left")
        .withColumn("links", F.coalesce("associations", F.lit(0)))
        .drop("associations")
    )
    middle = sized.groupBy("drawing_id").agg(
        F.avg("cx").alias("mx"), F.avg("cy").alias("my"),
        F.max("area").alias("max_area"), F.max("links").alias("max_links"),
    )
    placed = sized.join(middle, "drawing_id").withColumn(
        "off", bb.point_distance(F.col("cx"), F.col("cy"), F.col("mx"), F.col("my"))
    )
    farthest = placed.groupBy("drawing_id").agg(F.max("off").alias("max_off"))
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))
    central = F.when(F.col("max_off") > 0, 1.0 - F.col("off") / F.col("max_off")).otherwise(0.0)
    # to 12 decimals: the order in which a mean is summed decides the last bits, and so a tie
    score = F.round(share("area", "max_area") * 0.5 + share("links", "max_links") * 0.3 + central * 0.2, 12)
    return (
        placed.join(farthest, "drawing_id")
        .withColumn("score", score)
        .groupBy("drawing_id")
        .agg(F.min(F.struct((-F.col("score")).alias("low"), F.col("detection_id"), F.col("class_name"))).alias("best"))
        .select(
            "drawing_id", F.col("best.detection_id").alias("root_id"),
            F.col("best.class_name").alias("root_class"), (-F.col("best.low")).alias("score"),
        )
    )


def _shapes(detections: DataFrame) -> DataFrame:
    return detections.select("drawing_id", "detection_id", "class_name", "bbox")


def _others(shapes: DataFrame) -> DataFrame:
    return shapes.select(
        "drawing_id", F.col("detection_id").alias("other_id"), F.col("class_name").alias("other_class"),
        F.col("bbox").alias("other_box"),
    )


def containment_pairs(detections: DataFrame, dense_limit: int = spatial.DENSE_LIMIT) -> DataFrame:
    """Smallest box around each shape, in strict (area, id) order, hence without cycles."""
    shapes = _shapes(detections)
    dense = spatial.dense_drawings(shapes, dense_limit)
    rank = lambda box, ident: F.struct(bb.area(box).alias("area"), ident.alias("id"))
    own, other = rank(F.col("bbox"), F.col("detection_id")), rank(F.col("other_box"), F.col("other_id"))

    def around(pairs: DataFrame) -> DataFrame:
        return (
            pairs.where(bb.contains(F.col("other_box"), F.col("bbox")) & (other > own))
            .groupBy("drawing_id", "detection_id")
            .agg(F.min(other).alias("parent"))
            .select("drawing_id", "detection_id", F.col("parent.id").alias("parent_id"))
        )

    sparse = around(shapes.join(_others(spatial.without_dense(shapes, dense)), "drawing_id"))
    big = None
    if dense is not None:
        some = spatial.only_dense(shapes, dense)
        big = around(spatial.overlap_join(some, _others(some), "bbox", "other_box"))
    return spatial.union_parts(sparse, big)


def fastener_links(
    detections: DataFrame, reach: float = FASTENER_REACH, dense_limit: int = spatial.DENSE_LIMIT
) -> DataFrame:
    """Fastener and each other component whose center lies within ``reach``, roughly aligned."""
    shapes = _shapes(detections)
    is_fastener = F.col("class_name").isin(ref.FASTENER_CLASSES)
    fasteners = shapes.where(is_fastener)
    parts = shapes.where(~is_fastener)
    dense = spatial.dense_drawings(shapes, dense_limit)

    def linked(other_box: Column) -> Column:
        gap = bb.center_distance(F.col("bbox"), other_box)
        dx = F.abs(bb.center_x(other_box) - bb.center_x(F.col("bbox")))
        dy = F.abs(bb.center_y(other_box) - bb.center_y(F.col("bbox")))
        return (gap <= reach) & ((dx < gap * 0.8) | (dy < gap * 0.8))

    def links(pairs: DataFrame) -> DataFrame:
        return pairs.where(linked(F.col("other_box"))).select(
            "drawing_id", "detection_id", F.col("other_id").alias("component_id"),
            bb.center_distance(F.col("bbox"), F.col("other_box")).alias("distance"),
        )

    sparse = links(fasteners.join(_others(spatial.without_dense(parts, dense)), "drawing_id"))
    big = None
    if dense is not None:
        pad = int(reach) + 1
        dot = lambda box: bb.box(F.floor(bb.center_x(box)), F.floor(bb.center_y(box)), F.lit(0), F.lit(0))
        around = lambda box: bb.box(
            F.floor(bb.center_x(box)) - pad, F.floor(bb.center_y(box)) - pad, F.lit(2 * pad), F.lit(2 * pad)
        )
        some = spatial.only_dense(fasteners, dense).withColumn("near", around(F.col("bbox")))
        other = _others(spatial.only_dense(parts, dense)).withColumn("dot", dot(F.col("other_box")))
        big = links(spatial.overlap_join(some, other, "near", "dot"))
    return spatial.union_parts(sparse, big)


def assembly_edges(
    detections: DataFrame, roots: DataFrame, reach: float = FASTENER_REACH, dense_limit: int = spatial.DENSE_LIMIT
) -> DataFrame:
    """Containment first, then fastening, then what is left hangs on the root.

    A fastener that fastens something lies in no box and is no part of another, so no cycle can
    arise: a child is always smaller in (area, id), or is no fastener, or is an orphan. Each step
    decides what is left for the next one, so the pairs of a step are written once and read
    several times.
    """
    roots = cut_lineage(roots)
    root_ids = roots.select(F.col("root_id").alias("detection_id"))
    contained = cut_lineage(containment_pairs(detections, dense_limit).join(root_ids, "detection_id", "left_anti"))
    inside = contained.select(
        "drawing_id", "parent_id", F.col("detection_id").alias("child_id"),
        F.lit("contains").alias("relationship"), F.lit(0.9 * 0.95).alias("confidence"),
    )
    free = (
        _shapes(detections).join(root_ids, "detection_id", "left_anti")
        .join(contained.select("detection_id"), "detection_id", "left_anti")
        .select("drawing_id", "detection_id")
    )
    links = cut_lineage(
        fastener_links(detections, reach, dense_limit).join(free.select("detection_id"), "detection_id", "left_semi")
    )
    per_fastener = links.groupBy("detection_id").agg(F.count("*").alias("n"), F.avg("distance").alias("d"))
    base = F.when(F.col("n") >= 2, 0.8).otherwise(0.8 * 0.8)
    confidence = F.greatest(F.lit(0.3), F.least(F.lit(1.0), base * (1.0 - F.col("d") / reach * 0.2)))
    fastened = links.join(
        per_fastener.select("detection_id", confidence.alias("confidence")), "detection_id"
    ).select(
        "drawing_id", F.col("detection_id").alias("parent_id"), F.col("component_id").alias("child_id"),
        F.lit("fastens").alias("relationship"), "confidence",
    )
    orphans = (
        free.join(per_fastener.select("detection_id"), "detection_id", "left_anti")
        .join(roots.select("drawing_id", "root_id"), "drawing_id")
        .select(
            "drawing_id", F.col("root_id").alias("parent_id"), F.col("detection_id").alias("child_id"),
            F.lit("orphaned").alias("relationship"), F.lit(0.5).alias("confidence"),
        )
    )
    return reduce(DataFrame.unionByName, [inside, fastened, orphans])


def hierarchy_tree(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All nodes below each root with depth, path and relationship.

    Steps double: a round joins all nodes found so far with the steps of 1, 2, 4, ... edges, for all
    drawings at once, and joins those steps with themselves for the next one. So a tree of depth n takes
    log2(n) rounds. Each round is written to the checkpoint folder, so the plan stays flat and lost
    executors cost one round. A path never meets a node twice. With ``max_depth`` nothing below it is
    followed, and the column ``cut`` marks nodes whose children are left out.
    """
    kind = dict(roots.dtypes)["root_id"]
    found = [cut_lineage(roots.select(
        "drawing_id",
        F.col("root_id").alias("component_id"),
        F.lit(None).cast(kind).alias("parent_id"),
        F.lit(None).cast("string").alias("relationship"),
        F.lit(0).alias("depth"),
        F.array("root_id").alias("path"),
    ))]
    steps = cut_lineage(edges.where("parent_id <> child_id").select(
        F.col("parent_id").alias("s_from"), F.col("child_id").alias("s_to"), F.col("parent_id").alias("s_parent"),
        F.col("relationship").alias("s_kind"), F.array("child_id").alias("s_path"),
    ))
    length = 1
    while True:
        tree = reduce(DataFrame.unionByName, found)
        farther = cut_lineage(
            tree.join(steps, F.col("component_id") == F.col("s_from"))
            .where(~F.arrays_overlap("path", "s_path"))
            .select(
                "drawing_id",
                F.col("s_to").alias("component_id"),
                F.col("s_parent").alias("parent_id"),
                F.col("s_kind").alias("relationship"),
                (F.col("depth") + length).alias("depth"),
                F.concat("path", "s_path").alias("path"),
            )
        )
        if farther.isEmpty():
            break
        found.append(farther)
        if max_depth is not None and 2 * length > max_depth + 1:
            break
        first = steps.select(F.col("s_from").alias("f_from"), F.col("s_to").alias("f_to"), F.col("s_path").alias("f_path"))
        simple = ~F.arrays_overlap("f_path", "s_path") & ~F.array_contains("s_path", F.col("f_from"))
        steps = cut_lineage(
            first.join(steps, F.col("f_to") == F.col("s_from")).where(simple)
            .select(F.col("f_from").alias("s_from"), "s_to", "s_parent", "s_kind", F.concat("f_path", "s_path").alias("s_path"))
        )
        length *= 2
    tree = reduce(DataFrame.unionByName, found)
    if max_depth is None:
        return tree
    below = (
        tree.where(F.col("depth") == max_depth + 1).select(F.col("parent_id").alias("component_id")).distinct()
        .withColumn("cut", F.lit(True))
    )
    kept = tree.where(F.col("depth") <= max_depth).join(below, "component_id", "left")
    return kept.withColumn("cut", (F.col("depth") == max_depth) & F.coalesce("cut", F.lit(False)))


def unreachable_components(detections: DataFrame, tree: DataFrame) -> DataFrame:
    """Shapes that no path from the root reaches."""
    seen = tree.select(F.col("component_id").alias("detection_id"))
    return detections.select("drawing_id", "detection_id").join(seen, "detection_id", "left_anti")


def children_of(tree: DataFrame, components: DataFrame) -> DataFrame:
    """Direct children of the asked components (column component_id)."""
    asked = components.select(F.col("component_id").alias("parent_id"))
    return tree.join(asked, "parent_id", "left_semi")


def subtree_of(tree: DataFrame, components: DataFrame) -> DataFrame:
    """Asked components and everything below them: (subtree_root, component)."""
    asked = components.select(F.col("component_id").alias("subtree_root"))
    steps = tree.select("drawing_id", "component_id", "depth", F.explode("path").alias("subtree_root"))
    return steps.join(asked, "subtree_root", "left_semi")


def path_to_root(tree: DataFrame, components: DataFrame) -> DataFrame:
    """Path from the root to each asked component."""
    return tree.join(components.select("component_id"), "component_id", "left_semi").select(
        "drawing_id", "component_id", "path"
    )


def pairs_by_relationship(edges: DataFrame, relationship: str) -> DataFrame:
    return edges.where(F.col("relationship") == relationship).select("drawing_id", "parent_id", "child_id")
