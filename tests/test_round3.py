"""Cases of the third review: what the derived tables do not hold, and plans that must not change."""

import random

import pytest
from pyspark.sql import functions as F

from planmark.functions import text as tx
from planmark.operators import associate, fingerprint, hierarchy, validate
from planmark.plans import catalog


@pytest.mark.parametrize("text, wanted", [
    ("4703 Achverber", False), ('{"a":1} x', False), ("[1]]", False), ("1] x [2", False), ("1,2", False),
    ('1, "a": 2', False), ("'a'", False), ('{"a":"it\'s","b":[\'q\']}', False), ('"a\nb"', False), ("", False),
    ('{"a":1,"a":2}', True), ('["a\\"b\'c"]', True), (" 12 \n", True), ("null", True), (None, None),
])
def test_json_is_one_whole_value(spark, text, wanted):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.json_ok(F.col("t"))).first()[0] is wanted


def test_keys_of_hashes_are_not_gathered_on_the_driver(spark):
    draw = random.Random(1)
    df = spark.createDataFrame([(i, draw.getrandbits(63)) for i in range(3000)], "vec_id long, hash long")
    found = fingerprint.similar_hashes(df)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan
    assert not [line for line in plan.splitlines() if "BroadcastExchange" in line and "piece" in line]


@pytest.mark.parametrize("key", ["children_of", "issue_references", "drawing_confidence", "export_summary"])
def test_lines_are_aggregated_once(spark, key):
    found = catalog.queries()[key](spark, "/root/testdata/sf0.001")
    assert not [file for file in found.inputFiles() if "lineitem" in file]


def test_small_drawings_are_paired_without_arrays(views):
    for found in (
        associate.associate_text_shapes(views.text_blocks, views.detections),
        hierarchy.containment_pairs(views.detections), validate.overlapping_blocks(views.text_blocks),
    ):
        assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
