from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from planmark.operators import export, integrity, query, scoring
from planmark.plans.helpers import scratch
from planmark.sources import store
from tests.conftest import rows

Filter = query.DrawingFilter


@pytest.mark.parametrize(
    "bad",
    [
        {"status": "nope"}, {"min_confidence": 1.5}, {"min_confidence": 0.9, "max_confidence": 0.1},
        {"date_from": datetime(2024, 2, 1), "date_to": datetime(2024, 1, 1)},
        {"date_from": datetime(2024, 1, 1), "date_to": datetime(2024, 2, 1, tzinfo=timezone.utc)},
        {"limit": -1}, {"limit": 1001}, {"offset": -1}, {"limit": 0, "offset": 5},
        {"sort_by": "color"}, {"sort_by": "drawing_id", "sort_order": "up"}, {"sort_order": "asc"},
    ],
)
def test_bad_filters(bad):
    with pytest.raises(ValueError):
        Filter(**bad)


def test_paging():
    page = Filter(limit=50)
    assert page.next_page().page_number == 2 and page.next_page().previous_page() == page
    assert page.previous_page().offset == 0 and page.is_empty() and not Filter(status="REVIEW").is_empty()
    assert Filter(status="review", limit=7).merge(Filter(needs_review=True)).active() == {
        "status": "review", "needs_review": True, "limit": 100, "offset": 0,
    }


def test_fetch_by_ids(views):
    found = query.fetch_by_ids(views.drawings, [5, 99_999_999, 2])
    assert [r["drawing_id"] for r in found.collect()] == [5, 2]
    with pytest.raises(ValueError):
        query.fetch_by_ids(views.drawings, [99_999_999])


def test_delete_empties_optional_references(spark):
    drawings = spark.createDataFrame([(1, "a"), (2, "b")], "drawing_id int, source_file string")
    texts = spark.createDataFrame([(10, 1), (20, 2)], "text_id int, drawing_id int")
    issues = spark.createDataFrame([(1, 2, 10), (2, 2, 20), (3, 1, 10)], "issue_id int, drawing_id int, text_id int")
    tables = {"drawings": drawings, "text_extractions": texts, "validation_issues": issues}
    kept = integrity.delete_cascade(tables, drawings.where("drawing_id = 1"))
    left = sorted(tuple(r) for r in kept["validation_issues"].select("issue_id", "text_id").fillna(-1).collect())
    assert left == [(1, -1), (2, 20)] and kept["text_extractions"].count() == 1


def test_large_documents_are_split_without_loss(views):
    children = {"text_blocks": (views.text_blocks, "text_id")}
    whole = export.nested_documents(views.drawings, children)
    split = export.nested_documents(views.drawings, children, elements=2)
    listed = lambda df: rows(df.select("drawing_id", F.explode("text_blocks.text_id").alias("t")))
    assert listed(split) == listed(whole) and split.count() > whole.count()
    assert split.select(F.max("parts")).first()[0] >= 3


def test_delimiters(views):
    assert store.check_delimiter("\t") == "\t"
    for bad, strict in (("", False), (";;", False), ("\n", False), ("\t", True), ('"', True)):
        with pytest.raises(ValueError):
            store.check_delimiter(bad, strict)


def test_formula_guard(spark):
    df = spark.createDataFrame([("=1+1",), ("plain",), (None,)], "v string").select(export.guarded(F.col("v")).alias("g"))
    assert [r["g"] for r in df.collect()] == ["'=1+1", "plain", ""]


def test_fixed_rounds_exact_halves_to_even(spark):
    df = spark.createDataFrame([(0.03125,), (1234.5,), (None,)], "v double").select(export.fixed(F.col("v")).alias("g"))
    assert [r["g"] for r in df.collect()] == ["0.0312", "1234.5000", ""]


def test_snapshot_and_append(spark, views):
    root = scratch(spark, "test-store")
    store.append_table(views.drawings, root, "drawings")
    store.append_table(views.drawings, root, "drawings")
    assert spark.read.parquet(f"{root}/drawings").count() == 2 * views.drawings.count()
    counts = store.table_snapshot({"drawings": views.drawings}, root + "/snap", "7").collect()
    assert counts[0]["rows"] == views.drawings.count()


def test_routes_without_budget(views):
    profiles = scoring.profile(views.drawings, views.text_blocks, views.detections, views.entities)
    routes = scoring.route_drawings(scoring.routing_scores(profiles), budget_left=False)
    assert routes.where("estimated_cost > 0 OR pipeline <> 'BASELINE_ONLY'").isEmpty()


def test_scores_stay_in_range(views):
    profiles = scoring.profile(views.drawings, views.text_blocks, views.detections, views.entities)
    scores = scoring.routing_scores(profiles)
    for column in ("ocr_quality", "entity_completeness", "shape_detection_quality", "overall"):
        assert scores.where(~F.col(column).between(0.0, 1.0)).isEmpty()
