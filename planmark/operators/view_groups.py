"""Views of one component: density clusters of like shapes, as connected components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from planmark.functions import bbox as bb
from planmark.operators import spatial
from planmark.session import cut_lineage

FEATURES = ("fx", "fy", "fs")
GROUP = ["drawing_id", "class_name"]


def standardized(detections: DataFrame) -> DataFrame:
    """Center and root of area, centered and scaled per drawing and class (population deviation)."""
    return _scaled(_centers(detections))


def _centers(detections: DataFrame) -> DataFrame:
    box = F.col("bbox")
    return detections.select(
        *GROUP, "detection_id", bb.center_x(box).alias("cx"), bb.center_y(box).alias("cy"), bb.area(box).alias("area")
    )


def _scaled(centers: DataFrame) -> DataFrame:
    raw = centers.withColumn("side", F.sqrt("area"))
    moments = raw.groupBy("drawing_id", "class_name").agg(
        F.count("*").alias("members"),
        *[f(c).alias(f"{n}_{c}") for c in ("cx", "cy", "side") for n, f in (("m", F.avg), ("s", F.stddev_pop))],
    )
    scaled = lambda c: (F.col(c) - F.col(f"m_{c}")) / (F.col(f"s_{c}") + F.lit(1e-8))
    return (
        raw.join(moments.where(F.col("members") >= 2), ["drawing_id", "class_name"])
        .select(
            "drawing_id", "class_name", "detection_id", "cx", "cy", "area", "members",
            scaled("cx").alias("fx"), scaled("cy").alias("fy"), scaled("side").alias("fs"),
        )
    )


def _points(detections: DataFrame, members: int = 2, buckets: int = 0) -> DataFrame:
    """Standardized shapes of classes with so many ``members``, written, as they are read several times. With ``buckets`` the
    plain shapes are written too, dealt by class, and what follows by class shuffles nothing."""
    centers = _centers(detections)
    if buckets:
        centers = cut_lineage(centers, GROUP, buckets)
    return cut_lineage(_scaled(centers).where(F.col("members") >= members), GROUP, buckets)


def _gap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return F.sqrt(sum(((a[f] - b[f]) * (a[f] - b[f]) for f in FEATURES[1:]), (a["fx"] - b["fx"]) * (a["fx"] - b["fx"])))


def neighbour_edges(points: DataFrame, eps: float, small: int = spatial.DENSE_LIMIT) -> DataFrame:
    """Edges (a < b) whose components are those of the graph "closer than eps".

    Small groups list their pairs. In a group of more than ``small`` shapes the space is cut into
    cubes of diagonal eps: all members of a cube are connected, so each one links to the first of
    its cube only, and two neighbouring cubes need one link if any two members are near. Pairs of
    cubes are settled by their bounding boxes where possible. Only for the rest are members
    compared, those near the other cube's box, and a semi join stops at the first hit.
    """
    group = ["drawing_id", "class_name"]
    slim = points.select(*group, "detection_id", *FEATURES, "members")
    few = slim.where(F.col("members") <= small)
    lists = few.groupBy(*group).agg(F.collect_list(F.struct("detection_id", *FEATURES)).alias("others"))
    here = {f: F.col(f) for f in FEATURES}
    near = F.filter(
        "others",
        lambda o: (F.col("detection_id") < o["detection_id"]) & (_gap(here, {f: o[f] for f in FEATURES}) <= eps),
    )
    edges = (
        few.join(lists, group)
        .select(F.col("detection_id").alias("a"), F.explode(near).alias("o"))
        .select("a", F.col("o.detection_id").alias("b"))
    )
    many = slim.where(F.col("members") > small)
    if many.isEmpty():
        return edges

    cube = eps / math.sqrt(3.0) * (1 - 1e-9)
    cells = [f"g{f[1]}" for f in FEATURES]
    placed = many.select(
        *group, "detection_id", *FEATURES, *[F.floor(F.col(f) / cube).alias(g) for f, g in zip(FEATURES, cells)]
    )
    boxes = placed.groupBy(*group, *cells).agg(
        F.min("detection_id").alias("head"),
        *[fn(f).alias(f"{n}_{f}") for f in FEATURES for n, fn in (("lo", F.min), ("hi", F.max))],
    )
    inside = placed.join(boxes.select(*group, *cells, "head"), [*group, *cells]).where(
        F.col("detection_id") != F.col("head")
    ).select(F.col("head").alias("a"), F.col("detection_id").alias("b"))

    steps = F.sequence(F.lit(-2), F.lit(2))
    around = F.flatten(F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.transform(
        steps, lambda k: F.struct(*[(F.col(g) + d).alias(g) for g, d in zip(cells, (i, j, k))]))))))
    left = boxes.select(
        *group, F.col("head").alias("a"), *[F.col(f"{n}_{f}").alias(f"a{n}_{f}") for f in FEATURES for n in ("lo", "hi")],
        F.explode(around).alias("c"),
    ).select("*", "c.*").drop("c")
    met = left.join(boxes, [*group, *cells]).where(F.col("a") < F.col("head"))
    apart = lambda f: F.greatest(F.col(f"lo_{f}") - F.col(f"ahi_{f}"), F.col(f"alo_{f}") - F.col(f"hi_{f}"), F.lit(0.0))
    span = lambda f: F.greatest(F.col(f"hi_{f}") - F.col(f"alo_{f}"), F.col(f"ahi_{f}") - F.col(f"lo_{f}"))
    length = lambda part: F.sqrt(part("fx") * part("fx") + part("fy") * part("fy") + part("fs") * part("fs"))
    pairs = met.where(length(apart) <= eps).select("*", (length(span) <= eps).alias("sure")).withColumnRenamed("head", "b")
    sure = pairs.where("sure").select("a", "b")
    open_pairs = pairs.where(~F.col("sure"))
    heads = boxes.select(*group, *cells, "head")
    members = placed.join(heads, [*group, *cells]).select("head", "detection_id", *FEATURES)

    def to_box(prefix: str) -> Column:
        off = lambda f: F.greatest(F.col(f"{prefix}lo_{f}") - F.col(f), F.col(f) - F.col(f"{prefix}hi_{f}"), F.lit(0.0))
        return length(off)

    left_members = (
        open_pairs.join(members.withColumnRenamed("head", "a"), "a").where(to_box("") <= eps)
        .select("a", "b", *[F.col(f).alias(f"p_{f}") for f in FEATURES])
    )
    right_members = (
        open_pairs.select("a", "b", *[f"a{n}_{f}" for f in FEATURES for n in ("lo", "hi")])
        .join(members.withColumnRenamed("head", "b"), "b").where(to_box("a") <= eps)
        .select(F.col("a").alias("a2"), F.col("b").alias("b2"), *FEATURES)
    )
    touching = (
        left_members.join(
            right_members,
            (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2"))
            & (_gap({f: F.col(f"p_{f}") for f in FEATURES}, here) <= eps),
            "left_semi",
        )
        .select("a", "b").distinct()
    )
    return edges.unionByName(inside).unionByName(sure).unionByName(touching)


def _cubes(points: DataFrame, eps: float) -> tuple[DataFrame, list[str]]:
    """Adds the place of every point in a grid of cubes of diagonal eps, whose members are all near each other."""
    cube = eps / math.sqrt(3.0) * (1 - 1e-9)
    cells = [f"g{f[1]}" for f in FEATURES]
    return points.withColumns({g: F.floor(F.col(f) / cube) for f, g in zip(FEATURES, cells)}), cells


def _around(points: DataFrame, cells: list[str]) -> DataFrame:
    """A row for every cube that can hold a point near the row's own."""
    for g in cells:
        points = points.withColumn(f"n{g}", F.explode(F.sequence(F.col(g) - 2, F.col(g) + 2)))
    return points


def density_members(points: DataFrame, eps: float, min_samples: int, small: int = spatial.DENSE_LIMIT) -> DataFrame:
    """(detection_id, group_id) of density clusters: a core has ``min_samples`` shapes, itself included, within eps; cores
    within eps are one cluster, named by its smallest core; another shape within eps of cores joins the
    cluster with the smallest name among them. All else is noise.

    A cube of the grid with ``min_samples`` members has cores only. So neighbours are counted only for members of thinner
    cubes, each of which has a bounded number; classes with few shapes are compared as lists.
    """
    slim = cut_lineage(points.select(*GROUP, "detection_id", *FEATURES, "members"))
    return _clustered(slim, eps, min_samples, small).select("detection_id", "group_id")


def _clustered(points: DataFrame, eps: float, min_samples: int, small: int, buckets: int = 0) -> DataFrame:
    """Rows of the written table ``points`` that are in a cluster, with its ``group_id``. Only cores are written again."""
    own = [c for c in points.columns if c not in (*GROUP, "members")]
    at = lambda prefix: {f: F.col(prefix + f) for f in FEATURES}
    close = lambda place: F.filter("others", lambda o: _gap(place, {f: o[f] for f in FEATURES}) <= eps)
    is_few = F.col("members") <= small
    few, many = points.where(is_few), points.where(~is_few)
    lists = few.groupBy(*GROUP).agg(F.first("members").alias("members"), F.collect_list(F.struct(*own)).alias("others"))
    few_cores = (
        lists.select("*", F.explode("others").alias("me")).where(F.size(close(at("me."))) >= min_samples)
        .select(*GROUP, "members", "me.*")
    )

    placed, cells = _cubes(many, eps)
    sizes = placed.groupBy(*GROUP, *cells).agg(F.count("*").alias("in_cube"))
    sized = cut_lineage(placed.join(sizes, [*GROUP, *cells]))
    dense, thin = F.col("in_cube") >= min_samples, F.col("in_cube") < min_samples
    other = sized.select(*[F.col(c).alias(f"o_{c}") for c in (*GROUP, *cells, "detection_id", *FEATURES)])

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        """Points of ``left`` with those of ``right`` (o_ columns) within eps, itself included."""
        same = [F.col(c) == F.col(f"o_{c}") for c in GROUP] + [F.col(f"n{g}") == F.col(f"o_{g}") for g in cells]
        both = _around(left, cells).join(right, same)
        return both.where(_gap(at(""), at("o_")) <= eps)

    near = met(sized.where(thin), other).groupBy("detection_id").count().where(F.col("count") >= min_samples)
    many_cores = sized.where(dense).unionByName(sized.where(thin).join(near, "detection_id", "left_semi"))
    cores = cut_lineage(few_cores.unionByName(many_cores.select(*points.columns)), GROUP, buckets)
    core_ids = cores.select("detection_id")
    linked = connected_components(neighbour_edges(cores, eps, small)).withColumnRenamed("node", "detection_id")
    named = cut_lineage(
        cores.join(linked, "detection_id", "left")
        .withColumn("group_id", F.coalesce("component", "detection_id")).drop("component"),
        GROUP, buckets,
    )
    core_lists = named.where(is_few).groupBy(*GROUP).agg(F.collect_list(F.struct("group_id", *FEATURES)).alias("others"))
    border = (
        few.join(core_lists, GROUP)
        .withColumn("group_id", F.array_min(F.transform(close(at("")), lambda o: o["group_id"])))
        .drop("others").where("group_id is not null").join(core_ids, "detection_id", "left_anti")
    )
    named_cores = other.join(named.select(F.col("detection_id").alias("o_detection_id"), "group_id"), "o_detection_id")
    thin_rest = sized.where(thin).join(core_ids, "detection_id", "left_anti")
    joins = met(thin_rest, named_cores).groupBy("detection_id").agg(F.min("group_id").alias("group_id"))
    border_many = many.join(joins, "detection_id")
    return named.unionByName(border).unionByName(border_many)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of an edge table; the component is its smallest node.

    Label propagation with pointer jumping: each round takes the least label around a node, then
    the label of that label, so the number of rounds grows with the logarithm of the diameter.
    Labels are pre-aggregated before each shuffle and every round is written to the checkpoint
    folder.
    """
    both = cut_lineage(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
    for _ in range(max_rounds):
        around = (
            both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("seen")), "b")
            .groupBy("a").agg(F.min("seen").alias("seen"))
        )
        lowered = labels.join(around, "a").select(
            "a", F.col("label").alias("old"), F.least("label", "seen").alias("label")
        )
        jump = labels.select(F.col("a").alias("label"), F.col("label").alias("beyond"))
        jumped = lowered.join(jump, "label", "left").select(
            "a", "old", F.least("label", F.coalesce("beyond", "label")).alias("label")
        )
        step = cut_lineage(jumped)
        labels = step.select("a", "label")
        if step.where(F.col("old") != F.col("label")).isEmpty():
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def multi_view_groups(
    detections: DataFrame, eps: float = 1.0, min_samples: int = 2, min_ratio: float = 0.5,
    small: int = spatial.DENSE_LIMIT, buckets: int = 0,
) -> DataFrame:
    """Groups of like shapes with view names and the largest shape.

    With two samples a density cluster is a connected component of the eps graph; with another number see
    ``density_members``. A cluster of one shape is no group, and a class with fewer shapes than a core needs has no cluster.
    With ``buckets`` shapes are dealt by class into so many.
    """
    if min_samples < 1:
        raise ValueError("a cluster has one sample at least")
    points = _points(detections, max(2, min_samples), buckets)
    if min_samples == 2:
        groups = connected_components(neighbour_edges(points, eps, small)).withColumnRenamed("node", "detection_id")
        joined = points.join(groups, "detection_id")
    else:
        joined = _clustered(points, eps, min_samples, small, buckets).withColumnRenamed("group_id", "component")
    biggest = F.struct("area", (-F.col("detection_id")).alias("first")) if dict(points.dtypes)["detection_id"] in (
        "bigint", "int") else F.struct("area", "detection_id")
    summed = joined.groupBy("drawing_id", "class_name", "component").agg(
        F.count("*").alias("shapes"),
        F.min("area").alias("min_area"), F.max("area").alias("max_area"),
        (F.max("cx") - F.min("cx")).alias("x_range"), (F.max("cy") - F.min("cy")).alias("y_range"),
        F.max_by("detection_id", biggest).alias("primary_shape_id"),
    )
    wide = F.col("x_range") > F.col("y_range")
    names = lambda *values: F.array(*map(F.lit, values))
    views = (
        F.when(wide & (F.col("shapes") == 2), names("front", "side"))
        .when(wide, names("front", "side", "top"))
        .when(F.col("shapes") == 2, names("top", "front"))
        .otherwise(names("top", "front", "side"))
    )
    alike = F.coalesce(F.try_divide("min_area", "max_area"), F.lit(0.0)) >= min_ratio
    return summed.where(alike & (F.col("shapes") > 1)).select(
        "drawing_id", "class_name", F.col("component").alias("group_id"), "shapes",
        views.alias("views"), "primary_shape_id",
    )


def group_members(
    detections: DataFrame, eps: float = 1.0, small: int = spatial.DENSE_LIMIT, buckets: int = 0
) -> DataFrame:
    """(detection_id, group_id) before the size filter."""
    found = connected_components(neighbour_edges(_points(detections, buckets=buckets), eps, small))
    return found.select(F.col("node").alias("detection_id"), F.col("component").alias("group_id"))


def primary_view_shape(members: DataFrame, detections: DataFrame) -> DataFrame:
    """Largest shape of each group, ties by smaller id."""
    area = bb.area(F.col("bbox"))
    return (
        members.join(detections.select("detection_id", area.alias("area")), "detection_id")
        .groupBy("group_id")
        .agg(F.min(F.struct((-F.col("area")).alias("low"), F.col("detection_id"))).alias("best"))
        .select("group_id", F.col("best.detection_id").alias("primary_shape_id"))
    )
