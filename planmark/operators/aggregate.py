"""Summaries of drawings, entities, shapes and batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from planmark import reference as ref


def processing_statistics(drawings: DataFrame) -> DataFrame:
    """One row per day."""
    return drawings.groupBy(F.to_date("processing_timestamp").alias("date")).agg(
        F.count("*").alias("total_drawings"),
        F.count_if(F.col("status") == "complete").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("needs_review")).alias("needing_review"),
        F.avg("overall_confidence").alias("avg_confidence"),
        F.count_if(F.col("pipeline_used") == "LLM_ENHANCED").alias("llm_enhanced_count"),
    )


def severity_rank(severity: Column) -> Column:
    pairs = [F.lit(part) for pair in ref.SEVERITY_RANK.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), severity)


def drawings_needing_review(drawings: DataFrame, issues: DataFrame) -> DataFrame:
    """Flagged drawings with the number of issues and the highest severity by rank."""
    worst = issues.groupBy("drawing_id").agg(
        F.count("*").alias("issue_count"),
        F.max(F.struct(severity_rank(F.col("severity")).alias("rank"), F.col("severity"))).alias("worst"),
    )
    return (
        drawings.where("needs_review")
        .join(worst, "drawing_id", "left")
        .select(
            "drawing_id", "source_file", "overall_confidence", "pipeline_used",
            F.coalesce("issue_count", F.lit(0)).alias("issue_count"),
            F.col("worst.severity").alias("highest_severity"),
            F.coalesce(F.col("worst.rank"), F.lit(0)).alias("severity_rank"),
            "processing_timestamp",
        )
    )


def most_severe_first(review: DataFrame) -> DataFrame:
    return review.orderBy(F.col("severity_rank").desc(), F.col("processing_timestamp").desc(), "drawing_id")


def review_top_issues(review: DataFrame, limit: int = 10) -> DataFrame:
    return most_severe_first(review.where(F.col("highest_severity").isin("HIGH", "CRITICAL"))).limit(limit)


def database_stats(
    drawings: DataFrame, text_blocks: DataFrame, entities: DataFrame, detections: DataFrame,
    associations: DataFrame, usage: DataFrame,
) -> DataFrame:
    """Totals in long form: (name, value); each table is counted once, in its own aggregate."""

    def total(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").cast("string").alias("value")).select(F.lit(name).alias("name"), "value")

    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    by_drawing = drawings.agg(
        F.count("*").alias("n"), F.min("processing_timestamp").alias("old"), F.max("processing_timestamp").alias("new")
    ).select(
        F.explode(
            F.array(
                F.struct(F.lit("total_drawings").alias("name"), F.col("n").cast("string").alias("value")),
                F.struct(F.lit("oldest_drawing").alias("name"), stamp("old").alias("value")),
                F.struct(F.lit("newest_drawing").alias("name"), stamp("new").alias("value")),
            )
        ).alias("r")
    ).select("r.*")
    spend = usage.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("c")).select(
        F.lit("total_llm_cost").alias("name"), F.format_string("%.4f", F.col("c")).alias("value")
    )
    return reduce(
        DataFrame.unionByName,
        [
            by_drawing,
            total("total_text_blocks", text_blocks),
            total("total_entities", entities),
            total("total_detections", detections),
            total("total_associations", associations),
            spend,
        ],
    )


def extraction_statistics(drawings: DataFrame, entities: DataFrame) -> DataFrame:
    """Per drawing: entities by type and by method, mean confidence (0 if none)."""
    by = lambda column, name: F.count_if(F.col(column) == name).alias(f"n_{name.lower()}")
    counts = entities.groupBy("drawing_id").agg(
        F.count("*").alias("total_entities"),
        F.avg("confidence").alias("average_confidence"),
        *[by("entity_type", t) for t in ref.ROUTING_ENTITY_WEIGHTS],
        *[by("extraction_method", m) for m in ("regex", "spacy", "llm")],
    )
    return drawings.select("drawing_id").join(counts, "drawing_id", "left").na.fill(0).na.fill(0.0)


def detection_summary(detections: DataFrame, high: float = 0.7, medium: float = 0.5) -> DataFrame:
    """Per drawing: total, mean and shares of high, medium and low confidence."""
    c = F.col("confidence")
    share = lambda condition: F.avg(F.when(condition, 1.0).otherwise(0.0))
    return detections.groupBy("drawing_id").agg(
        F.count("*").alias("total_detections"),
        F.avg(c).alias("average_confidence"),
        share(c >= high).alias("high"),
        share((c >= medium) & (c < high)).alias("medium"),
        share(c < medium).alias("low"),
    )


def detections_by_class(detections: DataFrame) -> DataFrame:
    return detections.groupBy("drawing_id", "class_name").agg(F.count("*").alias("detections"))


def drawing_report_counts(entities: DataFrame, detections: DataFrame) -> DataFrame:
    """Counts per entity type and shape class of every drawing, long form."""

    def counted(df: DataFrame, section: str, key: str) -> DataFrame:
        return df.groupBy("drawing_id", F.col(key).alias("name")).agg(F.count("*").alias("n")).select(
            "drawing_id", F.lit(section).alias("section"), "name", "n"
        )

    return counted(entities, "entity", "entity_type").unionByName(counted(detections, "shape", "class_name"))


def ocr_average_confidence(drawings: DataFrame, text_blocks: DataFrame) -> DataFrame:
    means = text_blocks.groupBy("drawing_id").agg(F.avg("confidence").alias("m"), F.count("*").alias("n"))
    return drawings.select("drawing_id").join(means, "drawing_id", "left").select(
        "drawing_id",
        F.coalesce("m", F.lit(0.0)).alias("average_confidence"),
        F.coalesce("n", F.lit(0)).alias("text_blocks"),
    )


def association_counts(associations: DataFrame) -> DataFrame:
    return associations.groupBy("drawing_id", "detection_id").agg(F.count("*").alias("associations"))


def batch_result(drawings: DataFrame, usage: DataFrame, audit: DataFrame) -> DataFrame:
    """Totals of a batch of drawings; mean time over drawings with a time above 0."""
    cost = usage.groupBy("drawing_id").agg(F.sum("cost_usd").alias("cost"))
    time = audit.groupBy("drawing_id").agg(F.sum("duration_seconds").alias("seconds"))
    joined = drawings.select("drawing_id", "status", "needs_review").join(cost, "drawing_id", "left").join(
        time, "drawing_id", "left"
    )
    n = F.count("*")
    good, bad = F.count_if(F.col("status") == "complete"), F.count_if(F.col("status") == "failed")
    flagged = F.count_if(F.col("needs_review"))
    return joined.agg(
        n.alias("total_drawings"),
        good.alias("successful"),
        bad.alias("failed"),
        flagged.alias("needs_review"),
        F.coalesce(F.try_divide(good, n), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.try_divide(flagged, n), F.lit(0.0)).alias("review_rate"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_llm_cost"),
        F.coalesce(F.avg(F.when(F.col("seconds") > 0, F.col("seconds"))), F.lit(0.0)).alias("average_processing_time"),
    )


def confidence_histogram(drawings: DataFrame, bins: int = 20) -> DataFrame:
    """Equal bins from minimum to maximum; the maximum belongs to the last bin; empty bins count 0."""
    c = F.col("overall_confidence")
    # values first: few distinct scores are left to place, and one pass gives counts and limits
    values = drawings.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count("*").alias("n"))
    limits = values.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    edges = limits.where(F.col("low").isNotNull()).select(
        F.when(F.col("low") == F.col("high"), F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(F.col("low") == F.col("high"), F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
        F.lit(1).alias("one"),
    )
    placed = (
        values.withColumn("one", F.lit(1))
        .join(F.broadcast(edges), "one")  # one row
        .groupBy(F.least(F.expr(f"width_bucket(v, low, high, {bins})"), F.lit(bins)).alias("bin"))
        .agg(F.sum("n").alias("n"))
    )
    return (
        edges.select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint"))).alias("bin"), "low", "high")
        .join(placed, "bin", "left")
        .select(
            "bin",
            (F.col("low") + (F.col("bin") - 1) * (F.col("high") - F.col("low")) / bins).alias("bin_start"),
            F.coalesce("n", F.lit(0)).alias("drawings"),
        )
    )


def status_breakdown(drawings: DataFrame) -> DataFrame:
    """Successful, review and failed counts with their share of the three."""
    totals = drawings.agg(
        F.count_if(F.col("status") == "complete").alias("a"),
        F.count_if(F.col("needs_review")).alias("b"),
        F.count_if(F.col("status") == "failed").alias("c"),
    )
    row = lambda name, column: F.struct(
        F.lit(name).alias("label"),
        F.col(column).alias("drawings"),
        F.coalesce(F.try_divide(F.col(column), F.expr("a + b + c")), F.lit(0.0)).alias("share"),
    )
    return totals.select(
        F.explode(F.array(row("Successful", "a"), row("Needs Review", "b"), row("Failed", "c"))).alias("r")
    ).select("r.*")


def error_triage(audit: DataFrame) -> DataFrame:
    """Failed steps by stage and verdict, from the wording of the message."""
    from planmark.functions import text as tx

    message = F.lower("error_message")
    verdict = (
        F.when(tx.contains_any(message, ref.TRANSIENT_DB_WORDS), "retriable")
        .when(tx.contains_any(message, ref.PERMANENT_DB_WORDS), "permanent")
        .when(tx.contains_any(message, ref.TRANSIENT_API_WORDS), "retriable")
        .when(tx.contains_any(message, ref.PERMANENT_CALL_WORDS), "permanent")
        .when(tx.contains_any(message, ref.TRANSIENT_CALL_WORDS), "retriable")
        .otherwise("permanent")
    )
    return (
        audit.where(F.col("error_message").isNotNull())
        .groupBy("stage", verdict.alias("verdict"))
        .agg(F.count("*").alias("errors"))
    )


def image_quality_verdict(
    metrics: DataFrame, blur: float = 100.0, contrast: float = 20.0, dark: float = 30.0, bright: float = 225.0
) -> DataFrame:
    """First failing measure wins; metrics arrive as columns blur, contrast and brightness."""
    reason = (
        F.when(F.col("blur") < blur, "blurry")
        .when(F.col("contrast") < contrast, "low_contrast")
        .when(~F.col("brightness").between(dark, bright), "poor_brightness")
    )
    return metrics.withColumn("rejection_reason", reason).withColumn("is_acceptable", reason.isNull())
