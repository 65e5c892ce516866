"""Order-dependent results without one window task per key.

A plain window keyed by drawing or day sorts all rows of that key in one task. Here a key with
many rows is first cut into ranges of its order column: the bounds are quantiles of the order among
the key's own rows, so neither outliers nor crowded stretches make a range long. The window runs
inside a range, and one small row per range carries the totals or the border row over to the next.
A key with few rows is one range. Rows of one order value stay in one range, however many they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_RANGE = 1_000_000
#: Ranges that quantiles cut a key into at most; a longer key has longer ranges.
MOST_RANGES = 256


def _number(order: str, df: DataFrame) -> Column:
    kind = dict(df.dtypes)[order]
    return F.unix_micros(order) if kind == "timestamp" else F.col(order).cast("bigint")


def with_ranges(df: DataFrame, keys: list[str], order: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds ``range_no``, which grows with ``order`` inside each key: how many of the key's quantiles
    lie below the value, -1 for null. Equal values share a range."""
    value = _number(order, df)
    every = [i / MOST_RANGES for i in range(1, MOST_RANGES)]
    step = F.greatest(F.floor(F.lit(MOST_RANGES) * rows_per_range / F.col("rows_of_key")), F.lit(1))
    used = F.array_distinct(F.filter("quantiles", lambda q, i: (i + 1) % F.col("step") == 0))
    long = df
    if keys:  # quantiles for long keys only
        sizes = df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > rows_per_range)
        long = df.join(sizes.select(*keys), keys, "left_semi")
    cuts = (
        long.groupBy(*keys).agg(
            F.count("*").alias("rows_of_key"),
            F.percentile_approx(value, every, F.lit(4 * MOST_RANGES)).alias("quantiles"),
        )
        .where(F.col("rows_of_key") > rows_per_range)
        .withColumn("step", step).select(*keys, used.alias("bounds"))
    )
    if keys:
        joined = df.join(cuts, keys, "left")
    else:  # one row of bounds at most
        one = cuts.first()
        bounds = F.array(*[F.lit(b) for b in one["bounds"]]) if one else F.lit(None)
        joined = df.withColumn("bounds", bounds.cast("array<bigint>"))
    below = F.size(F.filter(F.coalesce("bounds", F.array().cast("array<bigint>")), lambda b: b < value))
    return joined.withColumn("range_no", F.when(value.isNull(), F.lit(-1)).otherwise(below).cast("int")).drop("bounds")


def _ranges_window(keys: list[str], descending: bool = False):
    order = F.col("range_no").desc() if descending else F.col("range_no").asc()
    return Window.partitionBy(*keys).orderBy(order)


def _totals(ranged: DataFrame, keys: list[str], value: Column, descending: bool) -> DataFrame:
    """Sum of all earlier ranges, one row per key and range."""
    per_range = ranged.groupBy(*keys, "range_no").agg(F.sum(value).alias("own"))
    before = _ranges_window(keys, descending).rowsBetween(Window.unboundedPreceding, -1)
    return per_range.withColumn("carried", F.coalesce(F.sum("own").over(before), F.lit(0))).drop("own")


def running_sum(
    df: DataFrame, keys: list[str], order: str, tie: str, value: Column, name: str, **options
) -> DataFrame:
    """Cumulative ``value`` per key in (order, tie) sequence."""
    ranged = with_ranges(df, keys, order, **options)
    inside = (
        Window.partitionBy(*keys, "range_no").orderBy(order, tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    carried = _totals(ranged, keys, value, False)
    return (
        ranged.join(carried, [*keys, "range_no"])
        .withColumn(name, F.sum(value).over(inside) + F.col("carried"))
        .drop("carried", "range_no")
    )


def row_numbers(
    df: DataFrame, keys: list[str], order: str, tie: str, name: str, descending: bool = False, **options
) -> DataFrame:
    """Exact row number per key in (order, tie) sequence; ``keys`` may be empty."""
    ranged = with_ranges(df, keys, order, **options)
    first = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*keys, "range_no").orderBy(first, F.col(tie))
    carried = _totals(ranged, keys, F.lit(1), descending)
    return (
        ranged.join(carried, [*keys, "range_no"])
        .withColumn(name, F.row_number().over(inside) + F.col("carried"))
        .drop("carried", "range_no")
    )


def _neighbour(df, keys, order, tie, value, name, forward, **options) -> DataFrame:
    ranged = with_ranges(df, keys, order, **options)
    inside = Window.partitionBy(*keys, "range_no").orderBy(order, tie)
    near = F.lead if forward else F.lag
    edge = F.min_by if forward else F.max_by
    border = ranged.groupBy(*keys, "range_no").agg(
        edge(F.struct(F.col(value)), F.struct(order, tie)).alias("border")
    )
    across = near("border").over(_ranges_window(keys))
    borders = border.withColumn("beyond", across).drop("border")
    found = F.coalesce(near(F.struct(F.col(value))).over(inside), F.col("beyond"))
    return (
        ranged.join(borders, [*keys, "range_no"])
        .withColumn(name, found[value])
        .drop("beyond", "range_no")
    )


def following(df: DataFrame, keys: list[str], order: str, tie: str, value: str, name: str, **options) -> DataFrame:
    """``value`` of the next row of the key."""
    return _neighbour(df, keys, order, tie, value, name, True, **options)


def preceding(df: DataFrame, keys: list[str], order: str, tie: str, value: str, name: str, **options) -> DataFrame:
    """``value`` of the previous row of the key."""
    return _neighbour(df, keys, order, tie, value, name, False, **options)
