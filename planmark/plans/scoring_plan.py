"""Registered queries: validation reports, scores, flags and routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from planmark.operators import extract, scoring, validate
from planmark.operators.associate import associate_text_shapes
from planmark.plans.helpers import tidy
from planmark.plans.registry import registry
from planmark.plans.spatial_plan import IOU
from planmark.plans.views import PAGE_HEIGHT, PAGE_WIDTH, Views, with_views

Q, SQL, register = registry()

# every rule in one table: drawing, severity, kind
ALL_ISSUES = f"""SELECT drawing_id, 'CRITICAL' AS severity, 'missing_critical_field' AS issue_type FROM drw WHERE drawing_id NOT IN (SELECT drawing_id FROM ent WHERE entity_type='PART_NUMBER')
    UNION ALL SELECT drawing_id, 'LOW', 'missing_field' FROM drw WHERE drawing_id NOT IN (SELECT drawing_id FROM ent WHERE entity_type='OEM')
    UNION ALL SELECT drawing_id, 'MEDIUM', 'missing_association' FROM (SELECT t.drawing_id, t.text_id, min(p.center) AS c FROM txt t JOIN prs p USING (text_id)
      WHERE t.ln = 2 AND t.text_id NOT IN (SELECT text_id FROM asc_) GROUP BY 1, 2) WHERE c < 500
    UNION ALL SELECT a.drawing_id, 'LOW', 'diameter_on_non_cylinder' FROM asc_ a JOIN det d USING (detection_id) WHERE relationship_type = 'dimension'
      AND NOT regexp_matches(class_name, 'shaft|hole|pin|cylinder|bearing|bushing') AND EXISTS (SELECT 1 FROM ent e WHERE e.text_id = a.text_id AND contains(lower(e.value), 'ø'))
    UNION ALL SELECT a.drawing_id, 'MEDIUM', 'overlapping_entities' FROM (SELECT *, 'ENT-'||substr(sha256(entity_key),1,16) AS eid FROM ent) a
      JOIN (SELECT *, 'ENT-'||substr(sha256(entity_key),1,16) AS eid FROM ent) b ON a.drawing_id = b.drawing_id AND a.eid < b.eid AND a.entity_type <> b.entity_type AND {IOU} > 0.3"""

REPORT = """SELECT d.drawing_id, coalesce(n, 0) AS issues, coalesce(nc, 0) = 0 AS is_valid, coalesce(nh, 0) + coalesce(nc, 0) > 0 AS requires_review,
    1 - least(0.5, 0.3*coalesce(nc,0) + 0.15*coalesce(nh,0) + 0.05*coalesce(nm,0) + 0.02*coalesce(nl,0))::DOUBLE AS confidence_adjustment, nc, nh, nm, nl
    FROM drw d LEFT JOIN (SELECT drawing_id, count(*) AS n, count(*) FILTER (severity='CRITICAL') AS nc, count(*) FILTER (severity='HIGH') AS nh,
      count(*) FILTER (severity='MEDIUM') AS nm, count(*) FILTER (severity='LOW') AS nl FROM iss GROUP BY 1) i USING (drawing_id)"""

PROFILE = """SELECT d.drawing_id, d.priority, d.status, d.overall_confidence, coalesce(nt,0) AS nt, coalesce(ocr,0) AS ocr, coalesce(ns,0) AS ns, coalesce(shp,0) AS shp,
    coalesce(ne,0) AS ne, coalesce(en,0) AS en, m1, m2, m3, m4, m5, m6, m7, m8, pc, pv
    FROM drw d LEFT JOIN (SELECT drawing_id, count(*) AS nt, avg(confidence) AS ocr FROM txt GROUP BY 1) t USING (drawing_id)
    LEFT JOIN (SELECT drawing_id, count(*) AS ns, avg(confidence) AS shp FROM det GROUP BY 1) s USING (drawing_id)
    LEFT JOIN (SELECT drawing_id, count(*) AS ne, avg(confidence) AS en, avg(confidence) FILTER (entity_type='PART_NUMBER') AS m1, avg(confidence) FILTER (entity_type='OEM') AS m2,
      avg(confidence) FILTER (entity_type='MATERIAL') AS m3, avg(confidence) FILTER (entity_type='DIMENSION') AS m4, avg(confidence) FILTER (entity_type='WEIGHT') AS m5,
      avg(confidence) FILTER (entity_type='THREAD_SPEC') AS m6, avg(confidence) FILTER (entity_type='TOLERANCE') AS m7, avg(confidence) FILTER (entity_type='SURFACE_FINISH') AS m8,
      max(confidence) FILTER (entity_type='PART_NUMBER') AS pc, max(value) FILTER (entity_type='PART_NUMBER') AS pv FROM ent GROUP BY 1) e USING (drawing_id)"""

SCORES = """SELECT *, 0.2*ocr_quality + 0.35*entity_completeness + 0.25*shape_detection_quality + 0.15*critical_field_presence + 0.05*data_consistency AS overall FROM (
    SELECT drawing_id, priority, m1 IS NOT NULL AS has_part_number, CASE WHEN nt > 0 THEN 0.7*ocr + 0.3*least(nt/20, 1) ELSE 0 END::DOUBLE AS ocr_quality,
    least(1, coalesce(m1*0.4, 0) + coalesce(m2*0.15, 0.045) + coalesce(m3*0.1, 0.03) + coalesce(m4*0.15, 0.045) + coalesce(m5*0.05, 0.015) + coalesce(m6*0.05, 0.015)
      + coalesce(m7*0.05, 0.015) + coalesce(m8*0.05, 0.015))::DOUBLE AS entity_completeness,
    CASE WHEN ns > 0 THEN 0.8*shp + 0.2*least(ns/5, 1) ELSE 0 END::DOUBLE AS shape_detection_quality, coalesce(pc, 0) AS critical_field_presence,
    CASE WHEN nt > 0 AND ns > 0 AND ne > 0 THEN 0.9 WHEN nt > 0 AND ne > 0 THEN 0.7 ELSE 0.5 END::DOUBLE AS data_consistency FROM prof)"""

WEAK = """SELECT *, (list_sort([(round(critical_field_presence, 12), 'critical_field_presence'), (round(data_consistency, 12), 'data_consistency'), (round(entity_completeness, 12), 'entity_completeness'),
    (round(ocr_quality, 12), 'ocr_quality'), (round(shape_detection_quality, 12), 'shape_detection_quality')])[1])[2] AS weakest, least(critical_field_presence, data_consistency, entity_completeness, ocr_quality, shape_detection_quality) AS weakest_score FROM scr"""


def _associations(v: Views) -> DataFrame:
    return associate_text_shapes(v.text_blocks, v.detections)


def _issues(v: Views) -> DataFrame:
    """Three rules read the associations and five the entities, so both are written once. Rules are settled one after the
    other, and what one has shuffled is gone before the next; only what the reports count is written."""
    v = v.kept
    rules = validate.validation_rules(v.drawings, v.text_blocks, v.detections, v.entities, v.keep(_associations(v)))
    return reduce(DataFrame.unionByName, [v.keep(rule.select("drawing_id", "severity", "issue_type")) for rule in rules])


def _profile(v: Views) -> DataFrame:
    return scoring.profile(v.drawings, v.text_blocks, v.detections, v.entities)


@register(
    "all_validation_issues",
    with_views("SELECT drawing_id, severity, issue_type, count(*) AS n FROM iss GROUP BY ALL", iss=ALL_ISSUES),
)
def _(v: Views) -> DataFrame:
    return _issues(v).groupBy("drawing_id", "severity", "issue_type").agg(F.count("*").alias("n"))


@register(
    "critical_field_issues",
    with_views(
        """SELECT drawing_id, 'CRITICAL' AS severity, 'missing_critical_field' AS issue_type FROM drw WHERE drawing_id NOT IN (SELECT drawing_id FROM ent WHERE entity_type='PART_NUMBER')
        UNION ALL SELECT drawing_id, 'HIGH', 'missing_field' FROM drw WHERE drawing_id NOT IN (SELECT drawing_id FROM ent WHERE entity_type='MATERIAL')
        UNION ALL SELECT drawing_id, 'LOW', 'missing_field' FROM drw WHERE drawing_id NOT IN (SELECT drawing_id FROM ent WHERE entity_type='OEM')"""
    ),
)
def _(v: Views) -> DataFrame:
    return validate.critical_field_issues(v.drawings, v.entities, True).select("drawing_id", "severity", "issue_type")


@register(
    "issues_by_severity",
    with_views(
        "SELECT drawing_id, coalesce(nl,0) AS low, coalesce(nm,0) AS medium, coalesce(nh,0) AS high, coalesce(nc,0) AS critical FROM rep",
        iss=ALL_ISSUES, rep=REPORT,
    ),
)
def _(v: Views) -> DataFrame:
    return validate.issues_by_severity(v.drawings, _issues(v))


@register(
    "validation_report",
    with_views(
        "SELECT drawing_id, issues, is_valid, requires_review, round(confidence_adjustment, 6) AS confidence_adjustment FROM rep",
        iss=ALL_ISSUES, rep=REPORT,
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(validate.validation_report(v.drawings, _issues(v)))


@register(
    "drawing_confidence",
    with_views(
        "SELECT drawing_id, round((0.3*ocr + 0.4*shp + 0.3*en) * confidence_adjustment, 9) AS confidence FROM prof JOIN rep USING (drawing_id)",
        iss=ALL_ISSUES, rep=REPORT, prof=PROFILE,
    ),
)
def _(v: Views) -> DataFrame:
    report = validate.validation_report(v.drawings, _issues(v))
    return tidy(scoring.drawing_confidence(_profile(v.kept), report).select("drawing_id", "confidence"), 9)


@register(
    "completeness_score",
    with_views(
        """SELECT *, round(0.4*e + 0.3*shape_completeness + 0.2*a + 0.1*title_block_completeness, 9) AS overall_score, round(e, 9) AS entity_completeness, round(a, 9) AS association_completeness
        FROM (SELECT p.drawing_id, ((m1 IS NOT NULL)::INT*1.0 + (m4 IS NOT NULL)::INT*0.8 + (m2 IS NOT NULL)::INT*0.5 + (m3 IS NOT NULL)::INT*0.3 + (m5 IS NOT NULL)::INT*0.2)::DOUBLE/2.8 AS e,
        (ns > 0)::INT::DOUBLE AS shape_completeness, least(coalesce(na/nullif(nt,0), 0), 0.7)/0.7::DOUBLE AS a, CASE WHEN tb.drawing_id IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS title_block_completeness,
        concat_ws(',', CASE WHEN m1 IS NULL THEN 'PART_NUMBER' END, CASE WHEN m4 IS NULL THEN 'DIMENSION' END, CASE WHEN ns = 0 THEN 'SHAPES' END) AS missing_critical_fields
        FROM prof p LEFT JOIN (SELECT drawing_id, count(*) AS na FROM asc_ GROUP BY 1) x USING (drawing_id)
        LEFT JOIN (SELECT DISTINCT drawing_id FROM txt WHERE x > 600 AND y > 560) tb ON tb.drawing_id = p.drawing_id)""",
        prof=PROFILE,
    ).replace("SELECT *, round(0.4*e", "SELECT drawing_id, shape_completeness, title_block_completeness, missing_critical_fields, round(0.4*e"),
)
def _(v: Views) -> DataFrame:
    v = v.kept
    region = extract.title_block_region(extract.mark_title_blocks(v.text_blocks, PAGE_WIDTH, PAGE_HEIGHT))
    return tidy(scoring.completeness_score(_profile(v), _associations(v), region), 9)


FLAGS = """SELECT drawing_id, 'LOW_CONFIDENCE' AS flag_type, CASE WHEN overall_confidence < 0.5 THEN 'CRITICAL' WHEN overall_confidence < 0.65 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM prof WHERE overall_confidence < 0.75
        UNION ALL SELECT drawing_id, 'MISSING_DATA', 'HIGH' FROM prof WHERE ne = 0 UNION ALL SELECT drawing_id, 'MISSING_DATA', 'HIGH' FROM prof WHERE ns = 0
        UNION ALL SELECT drawing_id, 'CRITICAL_FIELD_MISSING', 'CRITICAL' FROM prof WHERE m1 IS NULL UNION ALL SELECT drawing_id, 'ERROR', 'CRITICAL' FROM prof WHERE status = 'failed'
        UNION ALL SELECT drawing_id, 'INCONSISTENCY', 'CRITICAL' FROM prof WHERE m1 IS NULL"""


@register(
    "review_flags",
    with_views(
        "SELECT * FROM flg",
        prof=PROFILE, flg=FLAGS,
    ),
)
def _(v: Views) -> DataFrame:
    v = v.kept
    scored = _profile(v).withColumn("confidence", F.col("overall_confidence"))
    flags = scoring.review_flags(scored, validate.critical_field_issues(v.drawings, v.entities))
    return flags.select("drawing_id", "flag_type", "severity")


@register(
    "best_part_number",
    with_views(
        "SELECT drawing_id, m1 IS NOT NULL AS has_part_number, coalesce(pc, 0) AS confidence, pv AS value FROM prof",
        prof=PROFILE,
    ),
)
def _(v: Views) -> DataFrame:
    return scoring.best_part_number(v.drawings, v.entities)


@register(
    "routing_scores",
    with_views(
        """SELECT drawing_id, round(ocr_quality, 9) AS ocr_quality, round(entity_completeness, 9) AS entity_completeness, round(shape_detection_quality, 9) AS shape_detection_quality,
        critical_field_presence, data_consistency, round(overall, 9) AS overall FROM scr""",
        prof=PROFILE, scr=SCORES,
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(scoring.routing_scores(_profile(v)).drop("priority", "has_part_number"), 9)


@register(
    "weakest_dimension",
    with_views(
        """SELECT drawing_id, weakest, round(weakest_score, 9) AS weakest_score, CASE weakest WHEN 'ocr_quality' THEN 'ocr_verification'
        WHEN 'data_consistency' THEN 'shape_validation' WHEN 'shape_detection_quality' THEN 'shape_validation' ELSE 'entity_extraction' END AS stage FROM weak""",
        prof=PROFILE, scr=SCORES, weak=WEAK,
    ),
)
def _(v: Views) -> DataFrame:
    weak = scoring.weakest_dimension(scoring.routing_scores(_profile(v)))
    return tidy(weak.select("drawing_id", "weakest", "weakest_score", "stage"), 9)


@register(
    "route_drawings",
    with_views(
        """SELECT drawing_id, reason, CASE reason WHEN 'MISSING_PART_NUMBER' THEN 'LLM_ENHANCED' WHEN 'LOW_ENTITY_COMPLETENESS' THEN 'HYBRID' WHEN 'POOR_OCR_AND_ENTITIES' THEN 'HYBRID'
        WHEN 'MEDIUM_CONFIDENCE_WEAK_DIMENSION' THEN 'HYBRID' WHEN 'LOW_PART_NUMBER_CONFIDENCE' THEN 'HYBRID' ELSE 'BASELINE_ONLY' END AS pipeline,
        round(CASE reason WHEN 'MISSING_PART_NUMBER' THEN 0.08 WHEN 'LOW_ENTITY_COMPLETENESS' THEN 0.08 WHEN 'LOW_PART_NUMBER_CONFIDENCE' THEN 0.08 WHEN 'POOR_OCR_AND_ENTITIES' THEN 0.1
          WHEN 'MEDIUM_CONFIDENCE_WEAK_DIMENSION' THEN CASE WHEN weakest = 'ocr_quality' THEN 0.02 WHEN weakest IN ('data_consistency','shape_detection_quality') THEN 0.04 ELSE 0.08 END ELSE 0 END::DOUBLE, 6) AS estimated_cost
        FROM (SELECT *, substr(md5(drawing_id::VARCHAR), 1, 4) < '147a' AS smp, CASE WHEN NOT has_part_number AND priority <> 'LOW' THEN 'MISSING_PART_NUMBER' WHEN NOT has_part_number THEN 'MISSING_PART_NUMBER_NO_BUDGET'
          WHEN critical_field_presence < 0.7 THEN 'LOW_PART_NUMBER_CONFIDENCE' WHEN overall >= 0.85 AND critical_field_presence >= 0.9 THEN 'HIGH_CONFIDENCE'
          WHEN entity_completeness < 0.75 AND smp THEN 'LOW_ENTITY_COMPLETENESS' WHEN ocr_quality < 0.85 AND entity_completeness < 0.8 THEN 'POOR_OCR_AND_ENTITIES'
          WHEN overall >= 0.7 AND overall < 0.85 AND smp THEN 'MEDIUM_CONFIDENCE_WEAK_DIMENSION' ELSE 'BASELINE_FALLBACK' END AS reason FROM weak)""",
        prof=PROFILE, scr=SCORES, weak=WEAK,
    ),
)
def _(v: Views) -> DataFrame:
    routes = scoring.route_drawings(scoring.routing_scores(_profile(v)))
    return tidy(routes.select("drawing_id", "reason", "pipeline", "estimated_cost"))


@register(
    "unexpected_types",
    """SELECT entity_type FROM (SELECT CASE event_type WHEN 'view' THEN 'SCALE' WHEN 'click' THEN 'OEM' WHEN 'error' THEN 'REVISION' ELSE 'WEIGHT' END AS entity_type FROM events)
    EXCEPT SELECT unnest(['PART_NUMBER','OEM','MATERIAL','DIMENSION','WEIGHT','THREAD_SPEC','TOLERANCE','SURFACE_FINISH'])""",
)
def _(v: Views) -> DataFrame:
    kinds = F.expr("CASE event_type WHEN 'view' THEN 'SCALE' WHEN 'click' THEN 'OEM' WHEN 'error' THEN 'REVISION' ELSE 'WEIGHT' END")
    return scoring.unexpected_types(v.table("events").select(kinds.alias("entity_type")))
