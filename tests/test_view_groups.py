import random

import pytest
from pyspark.sql import functions as F

from planmark.functions import bbox as bb
from planmark.operators import view_groups
from tests.conftest import rows


def shapes(spark, n=160):
    rng = random.Random(3)
    data = [(1, i, "gear", rng.randrange(900), rng.randrange(700), rng.choice([20, 25, 60]), 30) for i in range(n)]
    df = spark.createDataFrame(data, "drawing_id int, detection_id bigint, class_name string, x int, y int, w int, h int")
    return df.withColumn("bbox", bb.box(*(F.col(c) for c in "xywh")))


def test_cubes_give_the_same_components(spark):
    df = shapes(spark)
    for eps in (0.3, 0.5):
        short = rows(view_groups.group_members(df, eps, small=10_000), "detection_id", "group_id")
        cubes = rows(view_groups.group_members(df, eps, small=2), "detection_id", "group_id")
        assert short and short == cubes


def test_long_chain(spark):
    edges = spark.range(1, 400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = view_groups.connected_components(edges.repartition(4))
    assert found.count() == 400 and rows(found.select("component").distinct()) == [(1,)]


def test_groups_have_names_and_primary(spark):
    found = view_groups.multi_view_groups(shapes(spark, 40), eps=0.6).collect()
    assert found and all(r["shapes"] >= 2 and r["views"][0] in ("front", "top") for r in found)


def clusters(points, eps, min_samples):
    """Density clusters by comparing all pairs: {detection: group}."""
    near = {
        a: [b for b in points if sum((x - y) ** 2 for x, y in zip(points[a], points[b])) ** 0.5 <= eps] for a in points
    }
    cores = {a for a in points if len(near[a]) >= min_samples}
    name = {}
    for a in sorted(cores):
        if a not in name:
            name[a], waiting = a, [a]
            while waiting:
                for b in near[waiting.pop()]:
                    if b in cores and b not in name:
                        name[b] = a
                        waiting.append(b)
    border = {a: min(name[b] for b in near[a] if b in cores) for a in points if a not in cores and any(b in cores for b in near[a])}
    return name | border


@pytest.mark.parametrize("min_samples", [1, 2, 3, 4, 5, 6])
def test_density_clusters_against_all_pairs(spark, min_samples):
    rng = random.Random(min_samples)
    data = [(1, i, "gear", rng.randrange(900), rng.randrange(700), rng.choice([20, 25, 60]), 30) for i in range(150)]
    data += [(1, 200 + i, "gear", 400 + rng.randrange(25), 300 + rng.randrange(25), 25, 30) for i in range(40)]  # a dense spot
    data += [(d, 1000 * d + i, "bolt", rng.randrange(300), rng.randrange(300), 30, 30) for d in (2, 3) for i in range(25)]
    df = spark.createDataFrame(data, "drawing_id int, detection_id bigint, class_name string, x int, y int, w int, h int")
    points = view_groups.standardized(df.withColumn("bbox", bb.box(*(F.col(c) for c in "xywh"))))
    by = {}
    for r in points.collect():
        by.setdefault((r["drawing_id"], r["class_name"]), {})[r["detection_id"]] = (r["fx"], r["fy"], r["fs"])
    eps = 0.35
    wanted = sorted(x for mine in by.values() for x in clusters(mine, eps, min_samples).items())
    assert rows(view_groups.density_members(points, eps, min_samples, small=30), "detection_id", "group_id") == wanted
