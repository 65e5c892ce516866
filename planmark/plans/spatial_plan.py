"""Registered queries: spatial joins and validation rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from planmark.operators import associate, fingerprint, hierarchy, validate
from planmark.plans.helpers import tidy
from planmark.plans.registry import registry
from planmark.plans.views import Views, with_views

Q, SQL, register = registry()

CANDIDATE = "text_id, detection_id, kind AS relationship_type, round(confidence, 6) AS confidence, round(edge, 6) AS distance_pixels"
COLUMNS = ("text_id", "detection_id", "relationship_type", "confidence", "distance_pixels")


def _candidates(v: Views, obstacles: str | None) -> DataFrame:
    return tidy(associate.association_candidates(v.text_blocks, v.detections, obstacles).select(*COLUMNS))


def _associations(v: Views) -> DataFrame:
    return associate.associate_text_shapes(v.text_blocks, v.detections)


@register(
    "associate_text_shapes",
    with_views(
        """SELECT text_id, drawing_id, detection_id, relationship_type, round(confidence, 6) AS confidence,
        round(distance_pixels, 6) AS distance_pixels FROM asc_"""
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(_associations(v).drop("association_id"))


@register("association_confidence", with_views(f"SELECT {CANDIDATE} FROM cnd"))
def _(v: Views) -> DataFrame:
    return _candidates(v, None)


@register("obstacle_filter_simple", with_views(f"SELECT {CANDIDATE} FROM clear"))
def _(v: Views) -> DataFrame:
    return _candidates(v, "simple")


# a segment meets a box if both ends are not beyond one side and the corners are not all on one side of its line
SIGHT = """SELECT * FROM cnd c WHERE NOT EXISTS (SELECT 1 FROM det o, (SELECT c.x+c.w/2.0::DOUBLE AS sx, c.y+c.h/2.0::DOUBLE AS sy) s
    WHERE o.drawing_id = c.drawing_id AND o.detection_id <> c.detection_id AND (
    (least(px,sx) <= o.x+o.w AND greatest(px,sx) >= o.x AND least(py,sy) <= o.y+o.h AND greatest(py,sy) >= o.y
      AND least((sx-px)*(o.y-py)-(sy-py)*(o.x-px), (sx-px)*(o.y-py)-(sy-py)*(o.x+o.w-px), (sx-px)*(o.y+o.h-py)-(sy-py)*(o.x-px), (sx-px)*(o.y+o.h-py)-(sy-py)*(o.x+o.w-px)) <= 0
      AND greatest((sx-px)*(o.y-py)-(sy-py)*(o.x-px), (sx-px)*(o.y-py)-(sy-py)*(o.x+o.w-px), (sx-px)*(o.y+o.h-py)-(sy-py)*(o.x-px), (sx-px)*(o.y+o.h-py)-(sy-py)*(o.x+o.w-px)) >= 0)
    OR EXISTS (SELECT 1 FROM (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS t) u
      WHERE trunc(px+t*(sx-px)) BETWEEN o.x AND o.x+o.w AND trunc(py+t*(sy-py)) BETWEEN o.y AND o.y+o.h)))"""


@register("obstacle_filter_advanced", with_views(f"SELECT {CANDIDATE} FROM sight", sight=SIGHT))
def _(v: Views) -> DataFrame:
    return _candidates(v, "advanced")


@register(
    "link_dimensions",
    with_views(
        """SELECT source AS source_text_id, detection_id, round(exp(-2*dist/500), 6) AS confidence,
        CASE WHEN regexp_matches(lower(value), '(ø|diameter|dia\\.?)\\s*\\d+\\.?\\d*') THEN 'diameter' WHEN class_name = 'plate' THEN 'dimension'
          WHEN class_name IN ('bolt') THEN 'thread_size' ELSE 'dimension' END AS feature_type FROM (
        SELECT e.text_id AS source, e.value, d.detection_id, d.class_name, sqrt(power(d.x+d.w/2.0::DOUBLE-e.x-e.w/2.0,2)+power(d.y+d.h/2.0::DOUBLE-e.y-e.h/2.0,2)) AS dist
        FROM ent e JOIN det d USING (drawing_id) WHERE e.entity_type = 'DIMENSION'
        QUALIFY row_number() OVER (PARTITION BY e.text_id ORDER BY dist, d.detection_id) = 1) WHERE dist < 500"""
    ),
)
def _(v: Views) -> DataFrame:
    links = associate.link_dimensions(v.entities, v.detections)
    source = v.entities.select("entity_id", "source_text_id")
    return tidy(links.join(source, "entity_id").select("source_text_id", "detection_id", "confidence", "feature_type"))


@register(
    "containment_pairs",
    with_views(
        """SELECT c.drawing_id, c.detection_id, arg_min(p.detection_id, (p.w*p.h, p.detection_id)) AS parent_id FROM det c JOIN det p ON p.drawing_id = c.drawing_id
        AND c.x >= p.x AND c.y >= p.y AND c.x+c.w <= p.x+p.w AND c.y+c.h <= p.y+p.h AND (p.w*p.h, p.detection_id) > (c.w*c.h, c.detection_id) GROUP BY 1, 2"""
    ),
)
def _(v: Views) -> DataFrame:
    return hierarchy.containment_pairs(v.detections)


@register(
    "fastener_links",
    with_views(
        """SELECT drawing_id, detection_id, component_id, round(dist, 6) AS distance FROM (
        SELECT f.drawing_id, f.detection_id, c.detection_id AS component_id, sqrt(power(f.x+f.w/2.0::DOUBLE-c.x-c.w/2.0,2)+power(f.y+f.h/2.0::DOUBLE-c.y-c.h/2.0,2)) AS dist
        FROM det f JOIN det c ON c.drawing_id = f.drawing_id AND f.class_name IN ('bolt','screw','nut','washer','pin','fastener')
        AND c.class_name NOT IN ('bolt','screw','nut','washer','pin','fastener')) WHERE dist <= 200 AND dist > 0"""
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(hierarchy.fastener_links(v.detections))


IOU = """greatest(0, least(a.x+a.w,b.x+b.w)-greatest(a.x,b.x))*greatest(0, least(a.y+a.h,b.y+b.h)-greatest(a.y,b.y))::DOUBLE
    / (a.w*a.h+b.w*b.h-greatest(0, least(a.x+a.w,b.x+b.w)-greatest(a.x,b.x))*greatest(0, least(a.y+a.h,b.y+b.h)-greatest(a.y,b.y)))"""


# boxes belong to blocks, so the oracle compares blocks first and opens the pairs that remain
@register(
    "overlapping_entities",
    with_views(
        f"""SELECT p.drawing_id, least(a.eid, b.eid) AS entity_id, CASE WHEN a.eid < b.eid THEN a.entity_type ELSE b.entity_type END AS entity_type,
        greatest(a.eid, b.eid) AS other_id, CASE WHEN a.eid < b.eid THEN b.entity_type ELSE a.entity_type END AS other_type, round(p.iou, 6) AS overlap
        FROM near_blocks p JOIN named a ON a.text_id = p.one JOIN named b ON b.text_id = p.two
        WHERE a.entity_type <> b.entity_type AND (p.one <> p.two OR a.eid < b.eid)""",
        named="SELECT text_id, entity_type, 'ENT-'||substr(sha256(entity_key),1,16) AS eid FROM ent",
        near_blocks=f"""SELECT a.drawing_id, a.text_id AS one, b.text_id AS two, {IOU} AS iou
        FROM txt a JOIN txt b ON a.drawing_id = b.drawing_id AND a.text_id <= b.text_id WHERE {IOU} > 0.3""",
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(validate.overlapping_entities(v.entities, v.text_blocks))


@register(
    "unassociated_dimensions",
    with_views(
        """SELECT drawing_id, text_id, detection_id, 'MEDIUM' AS severity FROM (SELECT t.drawing_id, t.text_id, p.detection_id, p.center FROM txt t JOIN prs p USING (text_id)
        WHERE t.ln = 2 AND t.text_id NOT IN (SELECT text_id FROM asc_) QUALIFY row_number() OVER (PARTITION BY t.text_id ORDER BY p.center, p.detection_id) = 1) WHERE center < 500"""
    ),
)
def _(v: Views) -> DataFrame:
    found = validate.unassociated_dimensions(v.text_blocks, v.detections, _associations(v))
    return found.select("drawing_id", "text_id", "detection_id", "severity")


# some entities point at a text that only exists on paper
@register(
    "orphaned_entities",
    with_views(
        """SELECT e.drawing_id, 'ENT-'||substr(sha256(entity_key),1,16) AS entity_id, 'HIGH' AS severity
        FROM ent e JOIN txt t USING (text_id) WHERE t.confidence < 0.7"""
    ),
)
def _(v: Views) -> DataFrame:
    kept = v.text_blocks.where(F.col("confidence") >= 0.7)
    return validate.orphaned_entities(v.entities, kept).select("drawing_id", "entity_id", "severity")


@register(
    "entity_shape_mismatch",
    with_views(
        """SELECT a.drawing_id, a.text_id, a.detection_id, 'diameter_on_non_cylinder' AS issue_type FROM asc_ a JOIN det d USING (detection_id)
        WHERE relationship_type = 'dimension' AND NOT regexp_matches(class_name, 'shaft|hole|pin|cylinder|bearing|bushing')
        AND EXISTS (SELECT 1 FROM ent e WHERE e.text_id = a.text_id AND contains(lower(e.value), 'ø'))"""
    ),
)
def _(v: Views) -> DataFrame:
    found = validate.entity_shape_mismatch(_associations(v), v.entities, v.detections)
    return found.select("drawing_id", "text_id", "detection_id", "issue_type")


@register(
    "issue_references",
    with_views(
        """SELECT a.drawing_id, a.detection_id, d.class_name, a.text_id, t.content FROM asc_ a JOIN det d USING (detection_id) JOIN txt t ON t.text_id = a.text_id
        WHERE relationship_type = 'dimension' AND EXISTS (SELECT 1 FROM ent e WHERE e.text_id = a.text_id AND contains(lower(e.value), 'ø'))
        AND NOT regexp_matches(class_name, 'shaft|hole|pin|cylinder|bearing|bushing')"""
    ),
)
def _(v: Views) -> DataFrame:
    v = v.kept
    issues = validate.entity_shape_mismatch(_associations(v), v.entities, v.detections)
    found = validate.issue_references(issues, v.entities, v.detections, v.text_blocks)
    return found.select("drawing_id", "detection_id", "class_name", "text_id", "content")


@register(
    "conflicting_associations",
    with_views(
        """SELECT drawing_id, text_id, count(*) AS shapes FROM (SELECT drawing_id, text_id, detection_id FROM cnd UNION ALL SELECT drawing_id, text_id, detection_id FROM asc_) GROUP BY 1, 2 HAVING count(*) > 1"""
    ),
)
def _(v: Views) -> DataFrame:
    keys = ("drawing_id", "text_id", "detection_id")
    twice = associate.association_candidates(v.text_blocks, v.detections, None).select(*keys).unionByName(
        _associations(v).select(*keys)
    )
    return validate.conflicting_associations(twice)


@register(
    "similar_hashes",
    """WITH src AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings UNION ALL SELECT vec_id + 1000000, list_concat([-embedding[1]::DOUBLE], embedding[2:]::DOUBLE[]) FROM embeddings),
    m AS (SELECT vec_id, e, list_sum(e) / 64 AS mean FROM src), bits AS (SELECT vec_id, array_to_string(list_transform(e, lambda x: CASE WHEN x > mean THEN '1' ELSE '0' END), '') AS b FROM m),
    grp AS (SELECT b, min(vec_id) AS head FROM bits GROUP BY 1)
    SELECT head AS a, vec_id AS b, 1.0::DOUBLE AS similarity FROM bits JOIN grp USING (b) WHERE vec_id <> head
    UNION ALL SELECT g.head, k.head, 1 - hamming(g.b, k.b) / 64.0::DOUBLE FROM grp g JOIN grp k ON g.head < k.head AND hamming(g.b, k.b) <= 6""",
)
def _(v: Views) -> DataFrame:
    vectors = v.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    copies = vectors.select(
        (F.col("vec_id") + 1000000).alias("vec_id"),
        F.concat(F.array(-F.col("e")[0]), F.slice("e", 2, 63)).alias("e"),
    )
    hashed = vectors.unionByName(copies).select("vec_id", fingerprint.average_hash(F.col("e")).alias("hash"))
    return tidy(fingerprint.similar_hashes(hashed))
