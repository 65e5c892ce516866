"""Findings of round 3 on growth with the input: what is read, cut and dealt more often than it need be."""

import random
import re

from pyspark.sql import functions as F

from planmark import reference as ref
from planmark.functions import text as tx
from planmark.operators import extract, search_index
from planmark.plans import catalog
from planmark.plans.helpers import scratch
from planmark.sources import publish
from planmark.streaming import jobs

FOLDER = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_dealt_without_a_sample(spark, views, monkeypatch):
    """a shuffle by ranges cuts every entity twice, once for its sample."""
    given, real = [], publish.publish_tables
    monkeypatch.setattr(publish, "publish_tables", lambda tables, *rest: given.append(tables) or real(tables, *rest))
    found = catalog.queries()["entity_search_index"](spark, FOLDER)
    assert found.count() and len(given) == 2
    for tables in given:
        plan = _plan(tables[search_index.POSTINGS])
        assert "rangepartitioning" not in plan and "REBALANCE_PARTITIONS_BY_COL" in plan
        assert not [file for file in tables[search_index.POSTINGS].inputFiles() if "lineitem" in file]


def test_a_crowded_bucket_has_many_files_in_token_order(spark):
    """one token in all entities still does not make one task."""
    kinds = "drawing_id long, entity_id string, entity_type string, value string, original_text string"
    draw = F.concat(F.lit("e"), F.sha2(F.col("id").cast("string"), 256))
    many = spark.range(20_000).select(
        F.col("id").alias("drawing_id"), draw.alias("entity_id"), F.lit("OEM").alias("entity_type"), F.lit("SKF").alias("value"),
        F.lit(" SKF").alias("original_text"),
    ).unionByName(spark.createDataFrame([(-1, "one", "OEM", "Timken", "Timken (x)")], kinds))
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        root = scratch(spark, "test-crowd")
        search_index.add_entities(many, root, "a", buckets=2)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    stored = spark.read.parquet(*publish.published_folders(spark, root)[search_index.POSTINGS])
    held = stored.where("token = 'skf'").groupBy(F.input_file_name().alias("file")).count().collect()
    assert len(held) > 2 and sum(r["count"] for r in held) == 20_000
    for r in held:
        tokens = [x[0] for x in spark.read.parquet(r["file"]).select("token").collect()]
        assert tokens == sorted(tokens)
    assert search_index.search(spark, root, "skf oem", buckets=2).count() == 20_000
    assert [r["entity_id"] for r in search_index.search(spark, root, "timken X", buckets=2).collect()] == ["one"]


def test_tokens_of_value_and_original_text(spark):
    kinds = "drawing_id long, entity_id string, entity_type string, value string, original_text string"
    texts = [("Steel 304", " Steel 304 "), ("5 mm", "Ø5 MM"), (None, "only"), ("value", None), (None, None), ("", "--"), ("A\tb", "\tA\tb")]
    df = spark.createDataFrame([(i, str(i), "PART_NUMBER", a, b) for i, (a, b) in enumerate(texts)], kinds)
    found = {}
    for r in extract.entity_tokens(df).collect():
        assert r["token"] not in found.setdefault(r["drawing_id"], set())  # each once
        found[r["drawing_id"]].add(r["token"])
    for i, pair in enumerate(texts):
        whole = " ".join(["PART_NUMBER", *filter(None, pair)]).lower()
        assert found[i] == {t for t in re.split(r"[\W_]+", whole) if t}


def test_cheap_tests_drop_no_match_and_spare_the_patterns(spark):
    """a block without a unit meets no pattern of dimensions; what is found stays the same."""
    draw = random.Random(3)
    pieces = [
        "5", "12.", ".5", "±", "Ø", "ø", "⌀", " ", "\t", " ", "\n", "mm", "cm", "m", "in", "inch", '"', "x", "X", "M", "M8", "kg", "G", "LBS",
        "oz", "Kg", "#", "-", "/", "_", "UNC", "UNF", "AB", "ABC", "PART", "NO:", "1000", "٣", "é", "N7", "Ra", "Steel", "a", ",",
    ]
    texts = ["".join(draw.choices(pieces, k=draw.randint(1, 9))) for _ in range(20_000)]
    blocks = spark.createDataFrame(list(enumerate(texts)), "text_id long, content string")
    plain = lambda kind: F.regexp_extract_all("content", F.lit(tx.UNICODE + ref.REGEX_LAYERS[kind][0]), F.lit(0))
    kept = lambda kind: extract._matches(F.col("content"), kind)["found"]
    wrong = {k: F.count_if(plain(k) != kept(k)).alias(k) for k in ref.REGEX_LAYERS}
    hits = {k: F.count_if(F.size(plain(k)) > 0).alias("n" + k) for k in ref.REGEX_LAYERS}
    row = blocks.agg(*wrong.values(), *hits.values()).first()
    assert all(row[k] == 0 and row["n" + k] > 30 for k in ref.REGEX_LAYERS), row
    spared = {"DIMENSION": "M4x1.25 WEIGHT: 3", "WEIGHT": "Ø12.5 ± 0.1 mm", "THREAD_SPEC": "WEIGHT: 3.25 kg", "PART_NUMBER": "BOLT NO 5"}
    for kind, text in spared.items():
        one = spark.createDataFrame([(text,)], "t string")
        assert not one.select(F.col("t").rlike(tx.UNICODE + extract._PREFILTER[kind])).first()[0]


def test_patterns_run_in_compiled_code(views):
    """functions over the items of an array made half the cost of the patterns."""
    plan = extract.regex_entities(views.text_blocks)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "transform(" not in plan


def test_second_reading_takes_written_entities(spark):
    """lines were aggregated and entities extracted once for each side of the join."""
    found = catalog.queries()["dedup_entities"](spark, FOLDER)
    assert found.inputFiles() and not [file for file in found.inputFiles() if "lineitem" in file]
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_written_entities_are_the_same(views):
    assert views.kept.entities.exceptAll(views.entities).isEmpty() and views.entities.exceptAll(views.kept.entities).isEmpty()


def test_micro_batches_have_files_for_all_cores(spark, monkeypatch):
    """batches of four files kept four cores busy, and their number grew with the input."""
    asked, real = [], jobs.read_folder
    monkeypatch.setattr(jobs, "read_folder", lambda *a, **b: asked.append(b["files_per_batch"]) or real(*a, **b))
    assert catalog.queries()["stream_entity_extraction"](spark, FOLDER).count()
    assert asked and asked[0] >= spark.sparkContext.defaultParallelism
