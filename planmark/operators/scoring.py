"""Confidence, completeness, review flags and routing per drawing.

Every score starts from one row of counts per drawing (``profile``), built with partial
aggregation on each child table, so a drawing's rows are never gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from planmark import reference as ref


def best_part_number(drawings: DataFrame, entities: DataFrame) -> DataFrame:
    """Highest (confidence, value) part number; exists=false and 0.0 without one."""
    best = (
        entities.where(F.col("entity_type") == "PART_NUMBER")
        .groupBy("drawing_id")
        .agg(F.max(F.struct("confidence", "value")).alias("best"))
    )
    return drawings.select("drawing_id").join(best, "drawing_id", "left").select(
        "drawing_id",
        F.col("best").isNotNull().alias("has_part_number"),
        F.coalesce("best.confidence", F.lit(0.0)).alias("confidence"),
        F.col("best.value").alias("value"),
    )


def profile(drawings: DataFrame, text_blocks: DataFrame, detections: DataFrame, entities: DataFrame) -> DataFrame:
    """Counts, means and type means per drawing; zeros where a child table has no rows."""
    kinds = list(ref.ROUTING_ENTITY_WEIGHTS)
    text = text_blocks.groupBy("drawing_id").agg(F.count("*").alias("n_text"), F.avg("confidence").alias("ocr"))
    shape = detections.groupBy("drawing_id").agg(F.count("*").alias("n_shape"), F.avg("confidence").alias("shape"))
    of = lambda kind: F.when(F.col("entity_type") == kind, F.col("confidence"))
    found = entities.groupBy("drawing_id").agg(
        F.count("*").alias("n_entity"),
        F.avg("confidence").alias("entity"),
        *[F.avg(of(k)).alias(f"mean_{k}") for k in kinds],
        F.max(F.when(F.col("entity_type") == "PART_NUMBER", F.struct("confidence", "value"))).alias("part"),
    )
    joined = reduce(lambda a, b: a.join(b, "drawing_id", "left"), [text, shape, found], drawings)
    zeros = {c: 0 for c in ("n_text", "n_shape", "n_entity")} | {c: 0.0 for c in ("ocr", "shape", "entity")}
    return joined.na.fill(zeros)


def drawing_confidence(profiles: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """0.3·text + 0.4·shapes + 0.3·entities, times the validation adjustment."""
    score = 0.30 * F.col("ocr") + 0.40 * F.col("shape") + 0.30 * F.col("entity")
    if report is None:
        return profiles.withColumn("confidence", score)
    return (
        profiles.join(report.select("drawing_id", "confidence_adjustment"), "drawing_id", "left")
        .withColumn("confidence", score * F.coalesce("confidence_adjustment", F.lit(1.0)))
        .drop("confidence_adjustment")
    )


def completeness_score(profiles: DataFrame, associations: DataFrame, title_blocks: DataFrame) -> DataFrame:
    """Weighted coverage of entity types, shapes, associations and the title block."""
    weights = ref.COMPLETENESS_ENTITY_WEIGHTS
    total = sum(weights.values())
    got = reduce(
        lambda s, p: s + F.when(F.col(f"mean_{p[0]}").isNotNull(), p[1]).otherwise(0.0), weights.items(), F.lit(0.0)
    )
    linked = associations.groupBy("drawing_id").agg(F.count("*").alias("n_link"))
    titled = title_blocks.select("drawing_id", F.lit(True).alias("titled")).distinct()
    joined = (
        profiles.join(linked, "drawing_id", "left").join(titled, "drawing_id", "left")
        .withColumn("n_link", F.coalesce("n_link", F.lit(0)))
        .withColumn("titled", F.coalesce("titled", F.lit(False)))
    )
    rate = F.coalesce(F.try_divide(F.col("n_link"), F.col("n_text")), F.lit(0.0))
    has = lambda kind: F.col(f"mean_{kind}").isNotNull()
    parts = joined.select(
        "drawing_id",
        (got / total).alias("entity_completeness"),
        F.when(F.col("n_shape") > 0, 1.0).otherwise(0.0).alias("shape_completeness"),
        (F.least(rate, F.lit(0.7)) / 0.7).alias("association_completeness"),
        F.when(F.col("titled"), 1.0).otherwise(0.5).alias("title_block_completeness"),
        F.array_compact(
            F.array(
                F.when(~has("PART_NUMBER"), F.lit("PART_NUMBER")),
                F.when(~has("DIMENSION"), F.lit("DIMENSION")),
                F.when(F.col("n_shape") == 0, F.lit("SHAPES")),
            )
        ).alias("missing_critical_fields"),
    )
    overall = (
        0.40 * F.col("entity_completeness") + 0.30 * F.col("shape_completeness")
        + 0.20 * F.col("association_completeness") + 0.10 * F.col("title_block_completeness")
    )
    return parts.withColumn("overall_score", overall)


def review_flags(profiles: DataFrame, issues: DataFrame, threshold: float = 0.75) -> DataFrame:
    """One row per flag; ``profiles`` carries the score in ``confidence`` and the status."""
    c = F.col("confidence")
    severity = F.when(c < 0.5, "CRITICAL").when(c < 0.65, "HIGH").when(c < 0.75, "MEDIUM").otherwise("LOW")

    def flag(condition: Column, kind: str, level: Column | str, reason: Column | str) -> Column:
        level = F.lit(level) if isinstance(level, str) else level
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.when(
            condition,
            F.struct(F.lit(kind).alias("flag_type"), level.alias("severity"), reason.alias("reason")),
        )

    low = F.format_string("Overall confidence %.3f below threshold %.3f", c, F.lit(threshold))
    flags = F.array_compact(
        F.array(
            flag(c < threshold, "LOW_CONFIDENCE", severity, low),
            flag(F.col("n_entity") == 0, "MISSING_DATA", "HIGH", "No entities extracted from drawing"),
            flag(F.col("n_shape") == 0, "MISSING_DATA", "HIGH", "No shapes detected in drawing"),
            flag(
                F.col("part").isNull(), "CRITICAL_FIELD_MISSING", "CRITICAL",
                "Missing critical entities: PART_NUMBER",
            ),
            flag(F.col("status") == "failed", "ERROR", "CRITICAL", "Processing failed or encountered errors"),
        )
    )
    own = profiles.select("drawing_id", F.explode(flags).alias("f")).select("drawing_id", "f.*")
    from_rules = issues.where(F.col("severity").isin("HIGH", "CRITICAL")).select(
        "drawing_id", F.lit("INCONSISTENCY").alias("flag_type"), "severity", F.col("message").alias("reason")
    )
    return own.unionByName(from_rules)


def routing_scores(profiles: DataFrame, partial_credit: float = 0.3, weights: dict[str, float] | None = None) -> DataFrame:
    """Five scores and their weighted sum."""
    weights = weights or ref.ROUTING_SCORE_WEIGHTS
    if abs(sum(weights.values()) - 1.0) >= 1e-6:
        raise ValueError("score weights must sum to 1")
    entity = F.lit(0.0)
    for kind, weight in ref.ROUTING_ENTITY_WEIGHTS.items():
        missing = 0.0 if kind == "PART_NUMBER" else weight * partial_credit
        entity = entity + F.coalesce(F.col(f"mean_{kind}") * weight, F.lit(missing))
    capped = lambda count, norm: F.least(F.col(count) / norm, F.lit(1.0))
    text, shape, ent = (F.col(c) > 0 for c in ("n_text", "n_shape", "n_entity"))
    scores = {
        "ocr_quality": F.when(text, 0.7 * F.col("ocr") + (1 - 0.7) * capped("n_text", 20)).otherwise(0.0),
        "entity_completeness": F.least(entity, F.lit(1.0)),
        "shape_detection_quality": F.when(
            shape, 0.8 * F.col("shape") + (1 - 0.8) * capped("n_shape", 5)
        ).otherwise(0.0),
        "critical_field_presence": F.coalesce(F.col("part.confidence"), F.lit(0.0)),
        "data_consistency": F.when(text & shape & ent, 0.9).when(text & ent, 0.7).otherwise(0.5),
    }
    scored = profiles.select(
        "drawing_id",
        *(["priority"] if "priority" in profiles.columns else []),
        F.col("part").isNotNull().alias("has_part_number"),
        *[column.alias(name) for name, column in scores.items()],
    )
    overall = reduce(lambda s, p: s + F.col(p[0]) * p[1], weights.items(), F.lit(0.0))
    return scored.withColumn("overall", overall)


def weakest_dimension(scores: DataFrame) -> DataFrame:
    """Lowest of the five scores, ties by name, and the stage that would improve it.

    Scores are compared to 12 decimals, since the order of a sum decides the last bits.
    """
    score = lambda name: F.round(F.col(name), 12).alias("score")
    pairs = F.array(*[F.struct(score(n), F.lit(n).alias("name")) for n in ref.DIMENSION_TO_STAGE])
    mapping = F.create_map(*[F.lit(part) for pair in ref.DIMENSION_TO_STAGE.items() for part in pair])
    return (
        scores.withColumn("w", F.array_min(pairs))
        .withColumn("weakest", F.col("w.name"))
        .withColumn("weakest_score", F.col("w.score"))
        .withColumn("stage", mapping[F.col("weakest")])
        .drop("w")
    )


def sampled(rate: float = 0.08) -> Column:
    """Deterministic share of drawings, from a digest of the id, in place of a random draw."""
    limit = min(int(rate * 65536), 65535)
    return F.substring(F.md5(F.col("drawing_id").cast("string")), 1, 4) < F.lit(f"{limit:04x}")


def route_drawings(
    scores: DataFrame, budget_left: bool = True, sample: Column | None = None,
    high: float = 0.85, medium: float = 0.70,
) -> DataFrame:
    """Ordered rules to pipeline, stages, reason and cost; the first rule that holds decides."""
    sample = sampled() if sample is None else sample
    money = F.lit(budget_left)
    weak = weakest_dimension(scores)
    stages = lambda *names: F.array(*[F.lit(n) for n in names])
    none = F.array().cast("array<string>")

    def route(pipeline: str, reason: str, what: Column, forced: bool = False) -> Column:
        return F.struct(
            F.lit(pipeline).alias("pipeline"), F.lit(reason).alias("reason"),
            what.alias("stages"), F.lit(forced).alias("forced_by_critical_field"),
        )

    overall, entity = F.col("overall"), F.col("entity_completeness")
    one = stages("entity_extraction")
    decision = (
        F.when(
            ~F.col("has_part_number") & money & (F.col("priority") != "LOW"),
            route("LLM_ENHANCED", "MISSING_PART_NUMBER", one, True),
        )
        .when(~F.col("has_part_number"), route("BASELINE_ONLY", "MISSING_PART_NUMBER_NO_BUDGET", none, True))
        .when(
            (F.col("critical_field_presence") < 0.70) & money,
            route("HYBRID", "LOW_PART_NUMBER_CONFIDENCE", one, True),
        )
        .when(
            (overall >= high) & (F.col("critical_field_presence") >= 0.9),
            route("BASELINE_ONLY", "HIGH_CONFIDENCE", none),
        )
        .when((entity < 0.75) & money & sample, route("HYBRID", "LOW_ENTITY_COMPLETENESS", one))
        .when(
            (F.col("ocr_quality") < 0.85) & (entity < 0.80) & money,
            route("HYBRID", "POOR_OCR_AND_ENTITIES", stages("ocr_verification", "entity_extraction")),
        )
        .when(
            (overall >= medium) & (overall < high) & money & sample,
            route("HYBRID", "MEDIUM_CONFIDENCE_WEAK_DIMENSION", F.array(F.col("stage"))),
        )
        .otherwise(route("BASELINE_ONLY", "BASELINE_FALLBACK", none))
    )
    prices = F.create_map(*[F.lit(part) for pair in ref.STAGE_COSTS.items() for part in pair])
    cost = F.aggregate("stages", F.lit(0.0), lambda total, s: total + F.coalesce(prices[s], F.lit(0.05)))
    return (
        weak.withColumn("route", decision)
        .select("drawing_id", "overall", "route.*")
        .withColumn("estimated_cost", cost)
    )


def unexpected_types(entities: DataFrame) -> DataFrame:
    """Types seen but not weighted by the router."""
    seen = entities.select("entity_type").distinct()
    return seen.where(~F.col("entity_type").isin(list(ref.ROUTING_ENTITY_WEIGHTS)))

