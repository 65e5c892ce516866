"""Cases that the derived tables do not hold: foreign digits, deep trees, silent blocks, crowded sheets."""

import difflib
import random

from pyspark.sql import functions as F

from planmark.functions import bbox as bb, checks
from planmark.operators import extract, hierarchy, ordered, spatial
from tests.conftest import rows


def blocks(spark, *texts):
    df = spark.createDataFrame([(1, i, i, t) for i, t in enumerate(texts)], "drawing_id int, text_id int, block_no int, content string")
    return df.withColumn("bbox", bb.box(*(F.lit(v) for v in (0, 0, 10, 10)))).withColumn("region_type", F.lit("title_block"))


def test_foreign_digits_and_blanks(spark):
    found = extract.regex_entities(blocks(spark, "Ra 3.2", "٣ kg", "٣ mm"))
    kinds = {(r["entity_type"], r["source_text_id"]) for r in found.collect()}
    assert {("SURFACE_FINISH", 0), ("WEIGHT", 1), ("DIMENSION", 2)} <= kinds


def test_title_text_over_silent_blocks(spark):
    one = extract.title_block_fields(blocks(spark, "SCALE", ":", " : ", "1:2", "REV", ":", "B")).first()
    assert one["scale"] == "1:2" and one["revision"] == "B"
    assert extract.title_block_fields(blocks(spark, ":", " ")).collect()[0]["scale"] is None


def test_fuzzy_match_against_brute_force(spark):
    draw = random.Random(8)
    word = lambda n: "".join(draw.choice("abcx") for _ in range(n))
    contents = [word(draw.randint(1, 12)) for _ in range(25)] + ["BOLT", "abcdef"]
    texts = [word(draw.randint(1, 12)) for _ in range(25)] + ["B", "axbxcx"]
    df = blocks(spark, *contents)
    wanted = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "drawing_id int, wanted_id int, text string")
    for threshold in (0.3, 0.5, 0.85, 1.0):
        got = {r["wanted_id"]: r for r in extract.fuzzy_block_match(wanted, df, threshold).collect()}
        for i, text in enumerate(texts):
            holding = [j for j, c in enumerate(contents) if text in c]
            best = max(difflib.SequenceMatcher(None, text, c).ratio() for c in contents)
            if holding:
                assert got[i]["exact"] and contents[got[i]["text_id"]] == contents[holding[0]]
            elif best >= threshold:
                assert abs(got[i]["ratio"] - best) < 1e-9
            else:
                assert i not in got


def test_tree_has_no_depth_limit(spark):
    edges = spark.createDataFrame([(i, i + 1, "contains") for i in range(70)], "parent_id int, child_id int, relationship string")
    roots = spark.createDataFrame([(1, 0)], "drawing_id int, root_id int")
    short = hierarchy.hierarchy_tree(edges.where("child_id <= 4"), roots, max_depth=2)
    assert rows(short, "component_id", "cut") == [(0, False), (1, False), (2, True)]
    deep = hierarchy.hierarchy_tree(edges.where("child_id <= 55"), roots)
    assert deep.agg(F.max("depth")).first()[0] == 55


def test_tree_of_depth_1000_takes_few_rounds(spark, monkeypatch):
    """A chain, with a side branch and a way back to the root that no path may take."""
    written = []
    real = hierarchy.cut_lineage
    monkeypatch.setattr(hierarchy, "cut_lineage", lambda df: written.append(1) or real(df))
    data = [(i, i + 1, "contains") for i in range(1000)] + [(500, 5000, "fastens"), (1000, 0, "contains"), (5000, 700, "fastens")]
    edges = spark.createDataFrame(data, "parent_id int, child_id int, relationship string")
    tree = hierarchy.hierarchy_tree(edges, spark.createDataFrame([(1, 0)], "drawing_id int, root_id int"))
    got = sorted((r["component_id"], r["depth"], r["parent_id"], len(r["path"])) for r in tree.collect())
    wanted = [(i, i, i - 1 if i else None, i + 1) for i in range(1001)] + [(5000, 501, 500, 502)]
    wanted += [(i, i - 198, 5000 if i == 700 else i - 1, i - 197) for i in range(700, 1001)]
    assert got == sorted(wanted) and len(written) <= 24


def test_small_boxes_never_meet_in_coarse_cells(spark):
    n = 3_000
    grid = spark.range(n).select(
        F.lit(1).alias("drawing_id"), F.col("id").alias("a_id"),
        bb.box((F.col("id") % 60 * 40).cast("int"), F.floor(F.col("id") / 60).cast("int") * 40, F.lit(10), F.lit(10)).alias("a"),
    )
    other = grid.select("drawing_id", F.col("a_id").alias("b_id"), F.col("a").alias("b"))
    up = spatial._on_levels_above(other, "b", grid, "a", True)
    assert up.groupBy("lv", "gx", "gy").count().agg(F.max("count")).first()[0] <= 4
    assert spatial.overlap_join(grid, other, "a", "b").where("a_id <> b_id").count() == 0


def test_an_outlier_does_not_fill_one_range(spark):
    df = spark.range(20_000).select(
        F.lit(1).alias("k"), F.col("id"), F.when(F.col("id") == 0, 10**12).otherwise(F.col("id")).alias("o")
    )
    ranged = ordered.with_ranges(df, ["k"], "o", rows_per_range=1_000)
    sizes = [r["count"] for r in ranged.groupBy("range_no").count().collect()]
    assert max(sizes) <= 2_000 and len(sizes) >= 10


def test_value_checks(spark):
    df = spark.createDataFrame([(0.5, "WEIGHT"), (None, None), (1.5, "nonsense")], "v double, k string")
    found = df.select(checks.in_unit_range(F.col("v")), checks.in_percent(F.col("v")), checks.known_type(F.col("k"))).collect()
    assert [tuple(r) for r in found] == [(True, True, True), (False, False, False), (False, True, False)]
    near = spark.createDataFrame([(" Bolt M8", "bolt m8 "), ("bolt", "gear")], "a string, b string")
    assert [r[0] for r in near.select(checks.fuzzy_match(F.col("a"), F.col("b"))).collect()] == [True, False]
