"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, scaled down by its quality weight, so that sorting by key
is a weighted sample without replacement whose every prefix is one too. A source takes its whole
documents as often as its target holds all of them (complete epochs), then the documents with the
smallest keys as far as the rest of the target goes (prefix sums of sizes), and last the one
document left whose size fits the remainder best, if it brings the source nearer to its target.

Sorting a source never meets in one task: its key axis is cut into ranges of about
``ROWS_PER_RANGE`` rows, prefix sums run inside a range, and one row per range carries over.

Behaviour at the edges: a null text has size 0; documents without words are taken 0 times; the null
source is a source of its own and comes last; null ids are ids like others; repeated rows (same id,
source and text) count each and share one decision, by the largest weight among them; an empty table
gives an empty result; keys are derived from id, source, text and seed, hence reruns agree, and ties go
by id and text digest; very long texts travel as a digest and a size only; columns named as the four
results are replaced, other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from planmark.llm.common import WORD, text_of
from planmark.session import cut_lineage

WEIGHTS = (5, 2, 1)
#: No source is repeated more often.
MOST_EPOCHS = 3
ROWS_PER_RANGE = 4_096
SEED = "mix"
#: A document of no known worth is still taken, last.
LEAST_WEIGHT = 1e-3
#: What junk is full of; documents with many of these weigh less.
JUNK = "[#*$%&|<>!]"
_KEYS = ("m_id", "m_source", "m_text")


def text_quality(text: Column, size: Column) -> Column:
    """Weight of a document in the sample: 1, less the more junk characters come on a word."""
    junk = F.regexp_count(text, F.lit(JUNK)).cast("double")
    return F.lit(1.0) / (F.lit(1.0) + F.lit(4.0) * junk / F.greatest(size, F.lit(1)).cast("double"))


def measure(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None
) -> DataFrame:
    """One narrow row per document: identity, source, size, quality weight.

    ``weight`` names a column of quality scores; without, the text's own junk decides. Scores that are
    null, not finite or below ``LEAST_WEIGHT`` count as that.
    """
    words = F.regexp_count(text_of(text), F.lit(WORD)).cast("long")
    sized = df.select(
        F.col(f"`{doc_id}`").alias("m_id"),
        F.col(f"`{source}`").cast("string").alias("m_source"),
        F.md5(text_of(text)).alias("m_text"),
        words.alias("m_size"),
        text_of(text).alias("m_raw"),
        (F.col(f"`{weight}`").cast("double") if weight else F.lit(None).cast("double")).alias("m_given"),
    )
    usable = ~F.isnan("m_given") & (F.col("m_given") >= LEAST_WEIGHT) & (F.col("m_given") < float("inf"))
    given = F.when(usable, F.col("m_given")).otherwise(F.lit(LEAST_WEIGHT))
    own = text_quality(F.col("m_raw"), F.col("m_size"))
    return sized.withColumn("m_weight", given if weight else own).drop("m_raw", "m_given")


def targets(measured: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per source: its size and its target.

    Shares follow the weights; a share above ``most`` times the source's size is cut there and the
    excess shared anew. That ends with one factor for all uncut sources, found by one pass over the
    sources in the order in which a growing factor would cut them. The windows hold a row per source.
    """
    sizes = measured.groupBy("m_source").agg(
        F.sum("m_size").alias("source_size"), F.count("*").alias("m_rows"), F.avg("m_weight").alias("m_mean")
    )
    place = F.row_number().over(Window.orderBy(F.col("m_source").asc_nulls_last())) - 1
    share = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(place, F.lit(len(weights)))).cast("long")
    cap = F.col("source_size") * most
    every = Window.partitionBy()
    by_cap = Window.orderBy("m_full", "m_place")
    return (
        sizes.withColumn("m_place", place)
        .withColumn("m_share", share)
        .withColumn("m_full", cap / F.col("m_share"))
        .withColumn("m_cut", F.coalesce(F.sum(cap).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("m_open", F.sum("m_share").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn(
            "m_factor",
            (F.sum("source_size").over(every) - F.col("m_cut")).cast("double") / F.col("m_open").cast("double"),
        )
        .withColumn("m_free", F.col("m_factor") <= F.col("m_full"))
        .withColumn("m_factor", F.max(F.when(F.col("m_free"), F.col("m_factor"))).over(every))
        .withColumn(
            "target",
            F.when(F.col("m_free"), F.least(F.col("m_factor") * F.col("m_share"), cap.cast("double")))
            .otherwise(cap.cast("double")),
        )
        .select("m_source", "source_size", "target", "m_rows", "m_mean")
    )


def sample_key(doc_id: Column, source: Column, text_digest: Column, weight: Column, seed: str = SEED) -> Column:
    """An exponential variate with rate ``weight``, drawn from a digest of id, source and text, so that
    documents that share an id, or have none, spread over the ranges too."""
    known = [F.coalesce(c.cast("string"), F.lit("")) for c in (doc_id, source, text_digest)]
    digest = F.md5(F.concat_ws(":", F.lit(seed), *known))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    return -F.log(uniform) / weight


def plan_mix(
    measured: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_EPOCHS,
    seed: str = SEED,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """One row per distinct document: size, source_size, target and taken (words, repeats counted)."""
    documents = (
        measured.groupBy(*_KEYS, "m_size").agg(F.count("*").alias("m_copies"), F.max("m_weight").alias("m_weight"))
        .withColumn("m_key", sample_key(*map(F.col, _KEYS), F.col("m_weight"), seed))
        .withColumn("m_total", F.col("m_size") * F.col("m_copies"))
    )
    per_source = targets(measured, weights, most).withColumnRenamed("m_source", "m_of")
    # the key's distribution function at the source's mean weight: grows with the key, near uniform
    level = F.lit(1.0) - F.exp(-F.col("m_key") * F.col("m_mean"))
    ranges = F.ceil(F.col("m_rows") / rows_per_range)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    placed = (
        documents.join(per_source, F.col("m_source").eqNullSafe(F.col("m_of"))).drop("m_of")
        .withColumn("m_range", F.floor(level * ranges).cast("long"))
        .withColumn("m_epochs", full.cast("long"))
        .withColumn("m_rest", F.col("target") - F.col("m_epochs") * F.col("source_size"))
    )
    inside = (
        Window.partitionBy("m_source", "m_range").orderBy("m_key", "m_id", "m_text")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = cut_lineage(placed.withColumn("m_prefix", F.sum("m_total").over(inside)))
    earlier = Window.partitionBy("m_source").orderBy("m_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        summed.groupBy("m_source", "m_range").agg(F.sum("m_total").alias("m_own"))
        .select(
            F.col("m_source").alias("c_source"), F.col("m_range").alias("c_range"),
            F.coalesce(F.sum("m_own").over(earlier), F.lit(0)).alias("m_before"),
        )
    )
    chosen = (
        summed.join(
            carried, F.col("m_source").eqNullSafe(F.col("c_source")) & (F.col("m_range") == F.col("c_range"))
        )
        .withColumn("m_extra", F.col("m_prefix") + F.col("m_before") <= F.col("m_rest"))
    )
    left = chosen.groupBy("m_source").agg(
        (F.max("m_rest") - F.coalesce(F.sum(F.when(F.col("m_extra"), F.col("m_total"))), F.lit(0))).alias("m_left")
    ).withColumnRenamed("m_source", "l_source")
    open_rows = chosen.filter(~F.col("m_extra") & (F.col("m_total") > 0)).join(
        left, F.col("m_source").eqNullSafe(F.col("l_source"))
    )
    off = F.abs(F.col("m_total") - F.col("m_left"))
    closing = (
        open_rows.filter(off < F.col("m_left")).groupBy("m_source")
        .agg(F.min(F.struct(off.alias("off"), "m_key", "m_id", "m_text")).alias("best"))
        .select(
            F.col("m_source").alias("b_source"), F.col("best.m_id").alias("b_id"), F.col("best.m_text").alias("b_text")
        )
    )
    is_last = (
        F.col("m_source").eqNullSafe(F.col("b_source"))
        & F.col("m_id").eqNullSafe(F.col("b_id")) & (F.col("m_text") == F.col("b_text"))
    )
    marked = chosen.join(closing, is_last, "left")
    times = F.col("m_epochs") + F.when(F.col("m_extra") | F.col("b_text").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    return marked.select(
        *_KEYS, F.col("m_size").alias("size"), "source_size", "target", (F.col("m_size") * times).alias("taken")
    )


def _same(left: str, right: str):
    return F.col(left).eqNullSafe(F.col(right))


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with the identity columns of ``measure``) and their decisions."""
    plan = plan.select(*[F.col(k).alias(f"p_{k}") for k in _KEYS], "size", "source_size", "target", "taken")
    on = _same("m_id", "p_m_id") & _same("m_source", "p_m_source") & _same("m_text", "p_m_text")
    return rows.join(plan, on).drop(*[f"p_{k}" for k in _KEYS])


def mix(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None,
    **options,
) -> DataFrame:
    """Adds size, source_size, target and taken to every row of ``df``."""
    plan = plan_mix(cut_lineage(measure(df, doc_id, text, source, weight)), **options)
    rows = df.drop("size", "source_size", "target", "taken").withColumns({
        "m_id": F.col(f"`{doc_id}`"), "m_source": F.col(f"`{source}`").cast("string"), "m_text": F.md5(text_of(text)),
    })
    return with_plan(rows, plan).drop(*_KEYS)


def apply_mix(df: DataFrame, **options) -> DataFrame:
    """The mixed rows themselves: each as often as the mix takes it, with the columns of ``df``."""
    plain = [f"u{i}" for i in range(len(df.columns))]  # whatever the user's columns are called
    named = dict(zip(df.columns, plain))
    keys = {k: named[options.pop(k, k)] for k in ("doc_id", "text", "source")}
    if options.get("weight"):
        options["weight"] = named[options["weight"]]
    mixed = mix(df.toDF(*plain), **keys, **options)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0)).cast("int")
    repeated = mixed.withColumn("m_repeat", F.explode(F.array_repeat(F.lit(0), times)))
    return repeated.select(*[F.col(p).alias(c) for c, p in named.items()])
