"""Finding F3 of round 4: the disk that validation rules hold."""

import random

from pyspark.sql import functions as F

from planmark.functions import bbox as bb
from planmark.operators import associate, validate
from planmark.plans import catalog, views as plan_views
from tests.conftest import rows

FOLDER = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_are_written_one_after_the_other(spark):
    """all six rules stood in one plan, so their shuffles lay on the disk together."""
    found = catalog.queries()["all_validation_issues"](spark, FOLDER)
    plan = _plan(found)
    assert "hashpartitioning" not in plan and "Join" not in plan
    assert not [f for f in found.inputFiles() if "lineitem" in f]


def test_overlaps_keep_drawings_together(spark, views):
    """pairs of blocks and entities were dealt by block twice."""
    kept = views.kept
    plan = _plan(validate.overlapping_entities(kept.entities, kept.text_blocks))
    assert "hashpartitioning" not in plan


def test_overlapping_entities_against_all_pairs(spark):
    """blocks without entity, entities without block, several of one block, one crowded drawing."""
    rng = random.Random(5)
    sizes = {1: 6, 2: 9, 3: 1, 4: 90}
    blocks = [(d, 1000 * d + i, rng.randrange(200), rng.randrange(60)) for d, n in sizes.items() for i in range(n)]
    entities, n = [], 0
    for d, t, _, _ in blocks:
        for _ in range(rng.choice([0, 1, 1, 3])):
            n += 1
            entities.append((f"E{n:05d}", d, rng.choice(["WEIGHT", "OEM"]), t))
    entities += [("E99998", 1, "OEM", None), ("E99999", 1, "OEM", 77)]
    text = spark.createDataFrame(blocks, "drawing_id long, text_id long, x int, y int").withColumn(
        "bbox", bb.box(F.col("x"), F.col("y"), F.lit(70), F.lit(20)))
    ents = spark.createDataFrame(entities, "entity_id string, drawing_id long, entity_type string, source_text_id long")
    place = {t: (d, x, y) for d, t, x, y in blocks}

    def iou(p, q):
        w, h = max(0, 70 - abs(p[1] - q[1])), max(0, 20 - abs(p[2] - q[2]))
        return w * h / (2 * 1400 - w * h)

    wanted = sorted(
        (a[1], a[0], a[2], b[0], b[2]) for a in entities for b in entities
        if a[0] < b[0] and a[2] != b[2] and a[3] in place and b[3] in place and place[a[3]][0] == place[b[3]][0]
        and iou(place[a[3]], place[b[3]]) > 0.3
    )
    found = validate.overlapping_entities(ents, text)
    assert wanted and rows(found, "drawing_id", "entity_id", "entity_type", "other_id", "other_type") == wanted


def test_only_values_that_offend_meet_the_shapes(views):
    """all entities were dealt by block to meet the few dimensions that are linked."""
    links = associate.associate_text_shapes(views.text_blocks, views.detections)
    found = validate.entity_shape_mismatch(links, views.kept.entities, views.detections)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    tests = [line for line in plan.split("\n") if "Filter" in line and "m10" in line]
    assert [line for line in tests if "class_name" not in line]


def test_entities_of_both_layers_are_not_dealt_anew(spark, monkeypatch):
    """where names are not broadcast, the union of both layers had no layout and went through a shuffle."""
    seen, real = [], plan_views.cut_lineage
    monkeypatch.setattr(plan_views, "cut_lineage", lambda df, by, n: seen.append((df, by, n)) or real(df, by, n))
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan_views.Views(spark, FOLDER).kept.entities.count()
        df, by, n = next(x for x in seen if "extraction_method" in x[0].columns)
        plan = _plan(df.repartition(n, *by))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert "Union" in plan and "Exchange" not in plan.split("Union")[0]
