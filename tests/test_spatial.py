"""The grid ways must give what the short-array ways give, and what brute force gives."""

import math
import random

import pytest
from pyspark.sql import functions as F

from planmark.functions import bbox as bb
from planmark.operators import associate, hierarchy, spatial, validate
from tests.conftest import rows


@pytest.fixture(scope="module")
def sheet(spark):
    """One drawing with 300 shapes and 200 texts, clustered, with boxes from tiny to huge."""
    rng = random.Random(5)
    shapes, texts = [], []
    for i in range(300):
        cx, cy = rng.choice([(200, 200), (2500, 300), (900, 2600)])
        size = rng.choice([4, 30, 90, 700])
        x, y = int(abs(rng.gauss(cx, 180))), int(abs(rng.gauss(cy, 180)))
        shapes.append((1, i, rng.choice(["bolt", "gear", "plate"]), x, y, size, size // 2 + 3))
    for i in range(200):
        x, y = rng.randrange(4000), rng.randrange(4000)
        texts.append((1, i, rng.choice(["25 mm", "BOLT", "some longer note"]), x, y, 60, 20))
    shape_df = spark.createDataFrame(shapes, "drawing_id int, detection_id int, class_name string, x int, y int, w int, h int")
    text_df = spark.createDataFrame(texts, "drawing_id int, text_id int, content string, x int, y int, w int, h int")
    boxed = lambda df: df.withColumn("bbox", bb.box(*(F.col(c) for c in "xywh"))).drop(*"xywh")
    return boxed(text_df), boxed(shape_df), texts, shapes


@pytest.mark.parametrize("mode", [None, "simple", "advanced"])
def test_association_ways_agree(sheet, mode):
    texts, shapes, *_ = sheet
    short = associate.association_candidates(texts, shapes, mode, dense_limit=10_000)
    grid = associate.association_candidates(texts, shapes, mode, dense_limit=0)
    columns = ("text_id", "detection_id", "relationship_type", "confidence", "distance_pixels")
    found = rows(short, *columns)
    assert found and found == rows(grid, *columns)


def test_association_against_brute_force(sheet):
    text_df, shape_df, texts, shapes = sheet
    found = {r["text_id"]: r["detection_id"] for r in associate.association_candidates(text_df, shape_df, None, dense_limit=0).collect()}
    for _, tid, content, tx, ty, tw, th in texts:
        px, py = tx + tw / 2, ty + th / 2
        ranked = []
        for _, sid, _, x, y, w, h in shapes:
            center = math.hypot(x + w / 2 - px, y + h / 2 - py)
            if x <= px <= x + w and y <= py <= y + h:
                edge = min(px - x, x + w - px, py - y, y + h - py)
            else:
                edge = math.hypot(max(x - px, 0, px - x - w), max(y - py, 0, py - y - h))
            ranked.append((center, sid, edge))
        edge, _, sid = min((e, c, s) for c, s, e in sorted(ranked)[:5])
        limit = 500 if content == "25 mm" else 200
        assert found.get(tid) == (sid if edge <= limit else None)


@pytest.mark.parametrize("run", [hierarchy.containment_pairs, hierarchy.fastener_links])
def test_hierarchy_ways_agree(sheet, run):
    _, shapes, *_ = sheet
    found = rows(run(shapes, dense_limit=10_000))
    assert found and found == rows(run(shapes, dense_limit=0))


def test_nearest_ways_agree(sheet):
    texts, shapes, *_ = sheet
    points = texts.select(
        "drawing_id", "text_id", bb.center_x(F.col("bbox")).alias("px"), bb.center_y(F.col("bbox")).alias("py")
    )
    ways = [rows(associate.nearest_shape(points, shapes, "text_id", 500, dense_limit=n)) for n in (10_000, 0)]
    assert ways[0] and ways[0] == ways[1]


def test_overlap_join_gives_each_pair_once(sheet):
    _, shapes, _, raw = sheet
    other = shapes.select("drawing_id", F.col("detection_id").alias("other_id"), F.col("bbox").alias("other_box"))
    found = [tuple(r) for r in spatial.overlap_join(shapes, other, "bbox", "other_box").select("detection_id", "other_id").collect()]
    wanted = {
        (a[1], b[1]) for a in raw for b in raw
        if a[3] <= b[3] + b[5] and b[3] <= a[3] + a[5] and a[4] <= b[4] + b[6] and b[4] <= a[4] + a[6]
    }
    assert len(found) == len(set(found)) and set(found) == wanted


def test_overlapping_entities_ways_agree(views):
    ways = [
        rows(validate.overlapping_entities(views.entities, views.text_blocks, dense_limit=n)) for n in (10_000, 0, 5)
    ]
    assert ways[0] and ways[0] == ways[1] == ways[2]


def test_mixed_sizes_agree(views):
    texts, shapes = views.text_blocks, views.detections
    ways = [rows(associate.associate_text_shapes(texts, shapes, dense_limit=n), "text_id", "detection_id") for n in (100, 3)]
    assert ways[0] and ways[0] == ways[1]


def test_near_far(spark):
    texts = spark.createDataFrame([(1, 1, "25 mm")], "drawing_id int, text_id int, content string").withColumn(
        "bbox", bb.box(*(F.lit(v) for v in (100, 100, 50, 20))))
    shapes = spark.createDataFrame([(1, 1, "bolt", 150, 110), (1, 2, "bolt", 400, 400)],
                                   "drawing_id int, detection_id int, class_name string, x int, y int")
    shapes = shapes.withColumn("bbox", bb.box(F.col("x"), F.col("y"), F.lit(50), F.lit(50)))
    assert rows(associate.associate_text_shapes(texts, shapes), "detection_id") == [(1,)]
