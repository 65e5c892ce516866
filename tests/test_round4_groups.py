"""Finding F2 of round 4: the disk that density groups hold."""

import random

import pytest
from pyspark.sql import functions as F

from planmark.functions import bbox as bb
from planmark.operators import view_groups
from planmark.plans import catalog
from tests.conftest import rows

FOLDER = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("min_samples, small", [(1, 64), (2, 64), (3, 64), (4, 3)])
def test_groups_of_dealt_shapes(spark, min_samples, small):
    """a class with fewer shapes than a core needs is left out early, and dealing changes no group."""
    rng = random.Random(min_samples)
    data = [
        (d, 100 * d + i, rng.choice(["gear", "bolt", "pin"]), rng.randrange(300), rng.randrange(300), 30, 30)
        for d, n in enumerate([1, 2, 3, 7, 25, 60]) for i in range(n)
    ]
    df = spark.createDataFrame(data, "drawing_id long, detection_id bigint, class_name string, x int, y int, w int, h int")
    df = df.withColumn("bbox", bb.box(*(F.col(c) for c in "xywh")))
    plain = rows(view_groups.multi_view_groups(df, 1.0, min_samples, small=small).withColumn("views", F.array_join("views", ",")))
    dealt = view_groups.multi_view_groups(df, 1.0, min_samples, small=small, buckets=3)
    assert plain and plain == rows(dealt.withColumn("views", F.array_join("views", ",")))
    points = view_groups.standardized(df)
    named = view_groups.density_members(points, 1.0, min_samples, small) if min_samples != 2 else view_groups.group_members(
        df, 1.0, small)
    sizes = named.groupBy("group_id").count().where("count > 1").agg(F.sum("count")).first()[0]
    every = view_groups.multi_view_groups(df, 1.0, min_samples, min_ratio=0.0, small=small).agg(F.sum("shapes")).first()[0]
    assert every == sizes


def test_dense_groups_read_written_shapes(spark, monkeypatch):
    """shapes were derived from the lines a second time, with five shuffles, to describe the groups."""
    written, real = [], view_groups.cut_lineage
    monkeypatch.setattr(view_groups, "cut_lineage", lambda *a: written.append(real(*a)) or written[-1])
    found = catalog.queries()["multi_view_groups_dense"](spark, FOLDER)
    assert not [f for f in found.inputFiles() if "lineitem" in f or "orders" in f]
    points = written[1]
    assert {"fx", "members", "area"} <= set(points.columns) and points.agg(F.min("members")).first()[0] >= 3
    lists = points.groupBy(*view_groups.GROUP).agg(F.collect_list("detection_id").alias("ids"))
    assert "Exchange" not in _plan(points.hint("merge").join(lists, view_groups.GROUP))
