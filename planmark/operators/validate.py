"""Consistency rules. Each rule gives rows of one issue schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from planmark import reference as ref
from planmark.functions import bbox as bb, text as tx
from planmark.operators import spatial
from planmark.operators.associate import nearest_shape

ISSUE_COLUMNS = ["drawing_id", "severity", "issue_type", "message", "entity_id", "detection_id", "text_id"]


def _issues(df: DataFrame, severity: str, issue_type: Column | str, message: Column, **ids: str) -> DataFrame:
    kind = F.lit(issue_type) if isinstance(issue_type, str) else issue_type
    return df.select(
        "drawing_id", F.lit(severity).alias("severity"), kind.alias("issue_type"),
        message.alias("message"), *[F.col(column).alias(name) for name, column in ids.items()],
    )


def orphaned_entities(entities: DataFrame, text_blocks: DataFrame) -> DataFrame:
    known = text_blocks.select(F.col("text_id").alias("source_text_id"))
    lost = entities.join(known, "source_text_id", "left_anti")
    message = F.format_string("Entity %s '%s' has no source text block", F.col("entity_type"), F.col("value"))
    return _issues(lost, "HIGH", "orphaned_entity", message, entity_id="entity_id")


def unassociated_dimensions(
    text_blocks: DataFrame, detections: DataFrame, associations: DataFrame, reach: float = 500.0, **options
) -> DataFrame:
    """Dimension-like text without association although a shape is near."""
    loose = (
        text_blocks.where(tx.looks_like_dimension(F.col("content")))
        .join(associations.select("text_id"), "text_id", "left_anti")
        .select(
            "drawing_id", "text_id", "content",
            bb.center_x(F.col("bbox")).alias("px"), bb.center_y(F.col("bbox")).alias("py"),
        )
    )
    near = nearest_shape(loose, detections, "text_id", reach, **options)
    message = F.format_string(
        "Dimension '%s' is %.1fpx from %s but not associated",
        F.col("content"), F.col("center_distance"), F.col("class_name"),
    )
    return _issues(
        near, "MEDIUM", "missing_association", message, detection_id="detection_id", text_id="text_id"
    )


def entity_shape_mismatch(associations: DataFrame, entities: DataFrame, detections: DataFrame) -> DataFrame:
    """Diameter on a shape that is no cylinder, thread on a shape that is no fastener;
    the first offending entity of each association counts."""
    value, shape = F.lower("value"), F.lower("class_name")
    round_value, thread_value = value.contains("ø") | value.contains("diameter"), tx.contains_any(value, ref.THREAD_HINTS)
    diameter = round_value & ~tx.contains_any(shape, ref.CYLINDER_CLASSES)
    thread = thread_value & ~tx.contains_any(shape, ref.THREADED_CLASSES)
    kind = F.when(diameter, F.lit("diameter_on_non_cylinder")).when(thread, F.lit("thread_on_non_fastener"))
    linked = (
        associations.where(F.col("relationship_type") == "dimension")
        .select("association_id", "text_id", "detection_id")
        .join(
            entities.where(round_value | thread_value).select(  # no other value offends
                "drawing_id", "entity_id", "entity_type", "value", "occurrence",
                F.col("source_text_id").alias("text_id"),
            ),
            "text_id",
        )
        .join(detections.select("detection_id", "class_name"), "detection_id")
        .withColumn("issue_type", kind)
        .where(F.col("issue_type").isNotNull())
    )
    layer = reduce(
        lambda done, pair: F.when(F.col("entity_type") == pair[1], F.lit(pair[0])).otherwise(done),
        enumerate([*ref.REGEX_LAYERS, "OEM"]),
        F.lit(99),
    )
    first = (
        linked.groupBy("association_id")
        .agg(
            F.min_by(
                F.struct("drawing_id", "entity_id", "detection_id", "text_id", "issue_type", "value", "class_name"),
                F.struct(layer.alias("layer"), F.col("occurrence")),
            ).alias("i")
        )
        .select("i.*")
    )
    wording = F.when(
        F.col("issue_type") == "diameter_on_non_cylinder",
        F.format_string(
            "Diameter dimension '%s' associated with non-cylindrical shape '%s'", F.col("value"), F.col("class_name")
        ),
    )
    message = wording.otherwise(
        F.format_string(
            "Thread specification '%s' associated with non-fastener shape '%s'", F.col("value"), F.col("class_name")
        )
    )
    return _issues(
        first, "LOW", F.col("issue_type"), message,
        entity_id="entity_id", detection_id="detection_id", text_id="text_id",
    )


def critical_field_issues(drawings: DataFrame, entities: DataFrame, enforce_material: bool = False) -> DataFrame:
    """CRITICAL without part number, HIGH without material where enforced, LOW without OEM."""
    rules = [("PART_NUMBER", "CRITICAL", "missing_critical_field", "No PART_NUMBER found in drawing")]
    if enforce_material:
        rules.append(("MATERIAL", "HIGH", "missing_field", "No material specification found in drawing"))
    rules.append(("OEM", "LOW", "missing_field", "No OEM/manufacturer found in drawing"))
    rows = F.array(*[
        F.struct(
            F.lit(t).alias("entity_type"), F.lit(s).alias("severity"),
            F.lit(k).alias("issue_type"), F.lit(m).alias("message"),
        )
        for t, s, k, m in rules
    ])
    have = entities.where(F.col("entity_type").isin([r[0] for r in rules])).select("drawing_id", "entity_type")
    return (
        drawings.select("drawing_id", F.explode(rows).alias("r"))
        .select("drawing_id", "r.*")
        .join(have, ["drawing_id", "entity_type"], "left_anti")
        .drop("entity_type")
    )


def _boxes(text_blocks: DataFrame) -> DataFrame:
    return text_blocks.select("drawing_id", "text_id", F.col("bbox").alias("box"))


def _over(pairs: DataFrame, min_iou: float) -> DataFrame:
    """Blocks that overlap by more than ``min_iou``, each pair once, and each block with itself."""
    overlap = bb.iou(F.col("box"), F.col("other_box"))
    return pairs.where((F.col("text_id") <= F.col("other_text")) & (overlap > min_iou)).withColumn("overlap", overlap)


def _others(blocks: DataFrame, *more: str) -> DataFrame:
    return blocks.select(
        "drawing_id", F.col("text_id").alias("other_text"), F.col("box").alias("other_box"),
        *[F.col(c).alias(f"other_{c}") for c in more],
    )


def overlapping_blocks(
    text_blocks: DataFrame, min_iou: float = 0.3, dense_limit: int = spatial.DENSE_LIMIT
) -> DataFrame:
    """Text blocks of a drawing that overlap by more than ``min_iou``, each pair once,
    and each block with itself."""
    blocks = _boxes(text_blocks)
    dense = spatial.dense_drawings(blocks, dense_limit)
    pairs = blocks.join(_others(spatial.without_dense(blocks, dense)), "drawing_id")
    if dense is not None:
        some = spatial.only_dense(blocks, dense)
        big = spatial.overlap_join(some, _others(some), "box", "other_box")
        pairs = pairs.unionByName(big)
    return _over(pairs, min_iou).select("drawing_id", "text_id", "other_text", "overlap")


def overlapping_entities(
    entities: DataFrame, text_blocks: DataFrame, min_iou: float = 0.3, dense_limit: int = spatial.DENSE_LIMIT
) -> DataFrame:
    """Entities of different type whose source boxes overlap by more than ``min_iou``, each pair once.

    Boxes are compared per text block, since the entities of one block share its box. In a small drawing a block holds its
    entities as a list, so all steps keep the rows of a drawing together.
    """
    blocks = _boxes(text_blocks)
    slim = entities.select("drawing_id", F.col("source_text_id").alias("text_id"), F.struct("entity_id", "entity_type").alias("e"))
    dense = spatial.dense_drawings(blocks, dense_limit)
    holding = (
        spatial.without_dense(blocks, dense).unionByName(spatial.without_dense(slim, dense), allowMissingColumns=True)
        .groupBy("drawing_id", "text_id")
        .agg(F.first("box", ignorenulls=True).alias("box"), F.collect_list("e").alias("held"))
        .where(F.col("box").isNotNull() & (F.size("held") > 0))
    )
    pairs = (
        _over(holding.join(_others(holding, "held"), "drawing_id"), min_iou)
        .select("drawing_id", "text_id", "other_text", "overlap", F.explode("held").alias("a"), "other_held")
        .withColumn("b", F.explode("other_held")).drop("other_held")
    )
    if dense is not None:
        crowded = overlapping_blocks(spatial.only_dense(text_blocks, dense), min_iou, dense_limit)
        one = slim.select("text_id", F.col("e").alias("a"))
        two = slim.select(F.col("text_id").alias("other_text"), F.col("e").alias("b"))
        pairs = pairs.unionByName(crowded.join(one, "text_id").join(two, "other_text"))
    once = (F.col("text_id") != F.col("other_text")) | (F.col("a.entity_id") < F.col("b.entity_id"))
    return (
        pairs.where((F.col("a.entity_type") != F.col("b.entity_type")) & once)
        .withColumn("first", F.least("a", "b"))
        .withColumn("second", F.greatest("a", "b"))
        .select(
            "drawing_id",
            F.col("first.entity_id").alias("entity_id"), F.col("first.entity_type").alias("entity_type"),
            F.col("second.entity_id").alias("other_id"), F.col("second.entity_type").alias("other_type"),
            "overlap",
        )
    )


def overlap_issues(pairs: DataFrame) -> DataFrame:
    message = F.format_string(
        "Entities %s and %s have %.1f%% overlapping bounding boxes",
        F.col("entity_type"), F.col("other_type"), F.col("overlap") * 100,
    )
    return _issues(pairs, "MEDIUM", "overlapping_entities", message, entity_id="entity_id")


def conflicting_associations(associations: DataFrame) -> DataFrame:
    """Texts linked to more than one shape."""
    return (
        associations.groupBy("drawing_id", "text_id")
        .agg(F.count("*").alias("shapes"))
        .where(F.col("shapes") > 1)
    )


def conflict_issues(conflicts: DataFrame) -> DataFrame:
    message = F.format_string(
        "Text block %s associated with %d different shapes", F.col("text_id").cast("string"), F.col("shapes")
    )
    return _issues(conflicts, "LOW", "conflicting_association", message, text_id="text_id")


def validation_rules(
    drawings: DataFrame, text_blocks: DataFrame, detections: DataFrame, entities: DataFrame,
    associations: DataFrame, enforce_material: bool = False, dense_limit: int = spatial.DENSE_LIMIT,
) -> list[DataFrame]:
    """The issues of each of the six rules, without the ids that a rule does not know."""
    return [
        orphaned_entities(entities, text_blocks),
        unassociated_dimensions(text_blocks, detections, associations, dense_limit=dense_limit),
        entity_shape_mismatch(associations, entities, detections),
        critical_field_issues(drawings, entities, enforce_material),
        overlap_issues(overlapping_entities(entities, text_blocks, dense_limit=dense_limit)),
        conflict_issues(conflicting_associations(associations)),
    ]


def all_validation_issues(
    drawings: DataFrame, text_blocks: DataFrame, detections: DataFrame, entities: DataFrame,
    associations: DataFrame, enforce_material: bool = False, dense_limit: int = spatial.DENSE_LIMIT,
) -> DataFrame:
    """All six rules in one schema."""
    parts = validation_rules(drawings, text_blocks, detections, entities, associations, enforce_material, dense_limit)
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return joined.select(*ISSUE_COLUMNS)


def issues_by_severity(drawings: DataFrame, issues: DataFrame) -> DataFrame:
    """Counts per severity, all four present, for every drawing."""
    counts = issues.groupBy("drawing_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ref.SEVERITY_RANK]
    )
    return drawings.select("drawing_id").join(counts, "drawing_id", "left").na.fill(0)


def validation_report(drawings: DataFrame, issues: DataFrame) -> DataFrame:
    """Verdict and confidence adjustment per drawing."""
    counted = issues_by_severity(drawings, issues)
    penalty = reduce(
        lambda total, pair: total + F.col(pair[0].lower()) * pair[1], ref.SEVERITY_PENALTY.items(), F.lit(0.0)
    )
    return counted.select(
        "drawing_id",
        (F.col("critical") + F.col("high") + F.col("medium") + F.col("low")).alias("issues"),
        (F.col("critical") == 0).alias("is_valid"),
        ((F.col("high") > 0) | (F.col("critical") > 0)).alias("requires_review"),
        (1 - F.least(penalty, F.lit(ref.MAX_PENALTY))).alias("confidence_adjustment"),
    )


def issue_references(
    issues: DataFrame, entities: DataFrame, detections: DataFrame, text_blocks: DataFrame
) -> DataFrame:
    """Issues with what they point at; references may be empty."""
    return (
        issues.join(entities.select("entity_id", "entity_type", "value"), "entity_id", "left")
        .join(detections.select("detection_id", "class_name"), "detection_id", "left")
        .join(text_blocks.select("text_id", "content"), "text_id", "left")
    )
