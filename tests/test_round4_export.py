"""Findings of round 4 on the disk a query holds: steps, tables dealt by drawing, nested documents."""

from pyspark.sql import functions as F

from planmark.plans import catalog
from planmark.session import SHUFFLES_GO, cut_lineage
from tests.conftest import rows

FOLDER = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_written_step_leaves_no_shuffle_on_disk(spark):
    """shuffles of all steps stayed until the driver collected garbage."""
    before, setting = _shuffle_files(spark), spark.conf.get(SHUFFLES_GO, None)
    counted = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    kept = cut_lineage(counted)
    dealt = cut_lineage(counted, ["k"], 4)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(SHUFFLES_GO, None) == setting
    assert rows(kept) == rows(dealt) == rows(counted)


def test_tables_dealt_alike_are_joined_and_grouped_without_a_shuffle(spark, views):
    """each join and group by drawing dealt lines, shapes and entities anew."""
    kept = views.kept
    met = kept.text_blocks.hint("merge").join(kept.entities.select("drawing_id", "entity_id"), "drawing_id").groupBy("drawing_id").count()
    assert "Exchange" not in _plan(met)
    for name in ("lines", "shaped_lines", "text_blocks", "detections", "entities", "drawings"):
        mine, plain = getattr(kept, name), getattr(views, name)
        assert mine.columns == plain.columns
        assert mine.exceptAll(plain).isEmpty() and plain.exceptAll(mine).isEmpty()


def test_ids_made_of_other_columns_are_not_stored(spark, views):
    """the digests made more than half of the entities on disk."""
    files = views.kept.entities.inputFiles()
    assert files and "entity_id" not in spark.read.parquet(*files).columns


def test_documents_are_gathered_without_a_shuffle(spark):
    """rows of all lists, each with all its columns, went through one shuffle, and once more to be counted."""
    found = catalog.queries()["nested_json_export"](spark, FOLDER)
    plan = _plan(found)
    assert "collect_list" in plan and "hashpartitioning" not in plan
    assert not [f for f in found.inputFiles() if "lineitem" in f or "orders" in f]
