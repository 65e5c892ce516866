from pyspark.sql import Window, functions as F

from planmark.operators import ordered
from tests.conftest import rows


def test_ranges_give_plain_window_results(views):
    usage = views.usage.withColumn("day", F.to_date("timestamp"))
    plain = Window.partitionBy("day").orderBy("timestamp", "usage_id")
    wanted = usage.select(
        "usage_id",
        F.row_number().over(plain).alias("n"),
        F.round(F.sum("cost_usd").over(plain.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("s"),
        F.lag("use_case").over(plain).alias("before"),
        F.lead("use_case").over(plain).alias("after"),
    )
    split = ordered.row_numbers(usage, ["day"], "timestamp", "usage_id", "n", rows_per_range=4)
    split = ordered.running_sum(split, ["day"], "timestamp", "usage_id", F.col("cost_usd"), "s", rows_per_range=3)
    split = ordered.preceding(split, ["day"], "timestamp", "usage_id", "use_case", "before", rows_per_range=5)
    split = ordered.following(split, ["day"], "timestamp", "usage_id", "use_case", "after", rows_per_range=5)
    text = lambda df: sorted(map(str, df.select("usage_id", "n", F.round("s", 6).alias("s"), "before", "after").collect()))
    assert text(split) == text(wanted)


def test_global_descending_numbers(views):
    drawings = views.drawings
    plain = Window.orderBy(F.col("processing_timestamp").desc(), "drawing_id")
    wanted = drawings.select("drawing_id", F.row_number().over(plain).alias("n"))
    split = ordered.row_numbers(drawings, [], "processing_timestamp", "drawing_id", "n", True, rows_per_range=50)
    assert rows(split, "drawing_id", "n") == rows(wanted, "drawing_id", "n")
