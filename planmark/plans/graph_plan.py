"""Registered queries: hierarchy and view groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from planmark.operators import hierarchy, view_groups
from planmark.operators.associate import associate_text_shapes
from planmark.plans.helpers import tidy
from planmark.plans.registry import registry
from planmark.plans.views import Views, with_views
from planmark.session import cut_lineage

Q, SQL, register = registry()

ROOTS = """SELECT drawing_id, detection_id AS root_id, class_name AS root_class, score FROM (
    SELECT *, 0.5*area/max(area) OVER p + 0.3*links/greatest(1, max(links) OVER p) + 0.2*CASE WHEN max(off) OVER p > 0 THEN 1 - off/max(off) OVER p ELSE 0 END AS score FROM (
      SELECT *, sqrt(power(cx-avg(cx) OVER (PARTITION BY drawing_id),2)+power(cy-avg(cy) OVER (PARTITION BY drawing_id),2)) AS off FROM (
        SELECT d.drawing_id, d.detection_id, d.class_name, d.x+d.w/2.0::DOUBLE AS cx, d.y+d.h/2.0::DOUBLE AS cy, d.w*d.h AS area, coalesce(n, 0) AS links
        FROM det d LEFT JOIN (SELECT detection_id, count(*) AS n FROM asc_ GROUP BY 1) a USING (detection_id)))
    WINDOW p AS (PARTITION BY drawing_id)) QUALIFY row_number() OVER (PARTITION BY drawing_id ORDER BY round(score, 12) DESC, detection_id) = 1"""
INSIDE = """SELECT c.drawing_id, c.detection_id, arg_min(p.detection_id, (p.w*p.h, p.detection_id)) AS parent_id FROM det c JOIN det p ON p.drawing_id = c.drawing_id
    AND c.x >= p.x AND c.y >= p.y AND c.x+c.w <= p.x+p.w AND c.y+c.h <= p.y+p.h AND (p.w*p.h, p.detection_id) > (c.w*c.h, c.detection_id)
    WHERE c.detection_id NOT IN (SELECT root_id FROM rts) GROUP BY 1, 2"""
FREE = "SELECT * FROM det WHERE detection_id NOT IN (SELECT root_id FROM rts) AND detection_id NOT IN (SELECT detection_id FROM ins)"
LINKS = """SELECT f.drawing_id, f.detection_id, c.detection_id AS component_id, sqrt(power(f.x+f.w/2.0::DOUBLE-c.x-c.w/2.0,2)+power(f.y+f.h/2.0::DOUBLE-c.y-c.h/2.0,2)) AS dist
    FROM free f JOIN det c ON c.drawing_id = f.drawing_id AND f.class_name = 'bolt' AND c.class_name <> 'bolt' WHERE dist <= 200 AND dist > 0"""
EDGES = """SELECT drawing_id, parent_id, detection_id AS child_id, 'contains' AS relationship, 0.855::DOUBLE AS confidence FROM ins
    UNION ALL SELECT drawing_id, detection_id, component_id, 'fastens', greatest(0.3, least(1, (CASE WHEN count(*) OVER f >= 2 THEN 0.8 ELSE 0.64 END) * (1 - avg(dist) OVER f / 200 * 0.2))) FROM lnk WINDOW f AS (PARTITION BY detection_id)
    UNION ALL SELECT f.drawing_id, root_id, f.detection_id, 'orphaned', 0.5 FROM free f JOIN rts USING (drawing_id) WHERE f.detection_id NOT IN (SELECT detection_id FROM lnk)"""
TREE = """SELECT drawing_id, root_id AS component_id, NULL::BIGINT AS parent_id, NULL::VARCHAR AS relationship, 0::BIGINT AS depth, [root_id] AS path FROM rts
    UNION ALL SELECT t.drawing_id, e.child_id, e.parent_id, e.relationship, t.depth + 1, list_append(t.path, e.child_id) FROM tree t JOIN edg e ON e.parent_id = t.component_id
    WHERE NOT list_contains(t.path, e.child_id)"""
PARTS = {"rts": ROOTS, "ins": INSIDE, "free": FREE, "lnk": LINKS, "edg": EDGES, "tree": TREE}


def _roots(v: Views) -> DataFrame:
    v = v.kept
    return hierarchy.root_component(v.detections, associate_text_shapes(v.text_blocks, v.detections))


def _edges(v: Views) -> DataFrame:
    return hierarchy.assembly_edges(v.kept.detections, _roots(v))


def _tree(v: Views) -> DataFrame:
    roots = cut_lineage(_roots(v))
    return hierarchy.hierarchy_tree(hierarchy.assembly_edges(v.kept.detections, roots), roots)


@register(
    "root_component",
    with_views("SELECT drawing_id, root_id, root_class, round(score, 6) AS score FROM rts", rts=ROOTS),
)
def _(v: Views) -> DataFrame:
    return tidy(_roots(v))


@register("assembly_edges", with_views("SELECT drawing_id, parent_id, child_id, relationship FROM edg", **PARTS))
def _(v: Views) -> DataFrame:
    return _edges(v).select("drawing_id", "parent_id", "child_id", "relationship")


@register("edge_confidence", with_views("SELECT parent_id, child_id, round(confidence, 6) AS confidence FROM edg", **PARTS))
def _(v: Views) -> DataFrame:
    return tidy(_edges(v).select("parent_id", "child_id", "confidence"))


@register(
    "hierarchy_tree",
    with_views(
        "SELECT drawing_id, component_id, parent_id, relationship, depth, array_to_string(path, ',') AS path FROM tree", **PARTS
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(_tree(v))


@register(
    "unreachable_components",
    with_views("SELECT drawing_id, detection_id FROM det WHERE detection_id NOT IN (SELECT component_id FROM tree)", **PARTS),
)
def _(v: Views) -> DataFrame:
    return hierarchy.unreachable_components(v.kept.detections, _tree(v))


def _large(v: Views) -> DataFrame:
    """Asked components: all shapes of class plate or gear."""
    return v.kept.detections.where(F.col("class_name").isin("plate", "gear")).select(F.col("detection_id").alias("component_id"))


ASKED = "(SELECT detection_id FROM det WHERE class_name IN ('plate','gear'))"


@register(
    "children_of",
    with_views(f"SELECT parent_id, component_id, relationship FROM tree WHERE parent_id IN {ASKED}", **PARTS),
)
def _(v: Views) -> DataFrame:
    return hierarchy.children_of(_tree(v), _large(v)).select("parent_id", "component_id", "relationship")


@register(
    "subtree_of",
    with_views(
        f"SELECT subtree_root, component_id, depth FROM (SELECT *, unnest(path) AS subtree_root FROM tree) WHERE subtree_root IN {ASKED}", **PARTS
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(hierarchy.subtree_of(_tree(v), _large(v)).select("subtree_root", "component_id", "depth"))


@register(
    "path_to_root",
    with_views(f"SELECT drawing_id, component_id, array_to_string(path, ',') AS path FROM tree WHERE component_id IN {ASKED}", **PARTS),
)
def _(v: Views) -> DataFrame:
    return tidy(hierarchy.path_to_root(_tree(v), _large(v)))


@register(
    "pairs_by_relationship",
    with_views("SELECT drawing_id, parent_id, child_id FROM edg WHERE relationship = 'fastens'", **PARTS),
)
def _(v: Views) -> DataFrame:
    return hierarchy.pairs_by_relationship(_edges(v), "fastens")


# wider groups than a drawing gives: all shapes of one customer lie on one sheet
SHEETS = """SELECT o_custkey AS sheet, detection_id, class_name, x, y, w, h FROM det JOIN orders ON o_orderkey = drawing_id"""
POINTS = """SELECT *, (x+w/2.0::DOUBLE - avg(x+w/2.0::DOUBLE) OVER p)/(stddev_pop(x+w/2.0::DOUBLE) OVER p + 1e-8) AS fx, (y+h/2.0::DOUBLE - avg(y+h/2.0::DOUBLE) OVER p)/(stddev_pop(y+h/2.0::DOUBLE) OVER p + 1e-8) AS fy,
    (sqrt(w*h) - avg(sqrt(w*h)) OVER p)/(stddev_pop(sqrt(w*h)) OVER p + 1e-8) AS fs FROM sht WINDOW p AS (PARTITION BY sheet, class_name)"""
NEAR = """SELECT a.detection_id AS a, b.detection_id AS b FROM pts a JOIN pts b ON a.sheet = b.sheet AND a.class_name = b.class_name AND a.detection_id <> b.detection_id
    AND sqrt(power(a.fx-b.fx,2)+power(a.fy-b.fy,2)+power(a.fs-b.fs,2)) <= 0.5"""
REACH = "SELECT a AS node, b AS other FROM near UNION SELECT r.node, n.b FROM reach r JOIN near n ON n.a = r.other"
COMPONENTS = "SELECT node, least(node, min(other)) AS component FROM reach GROUP BY 1"
VIEWS = {"sht": SHEETS, "pts": POINTS, "near": NEAR, "reach": REACH, "comp": COMPONENTS}


def _sheets(v: Views) -> DataFrame:
    orders = v.table("orders").select(F.col("o_orderkey").alias("drawing_id"), "o_custkey")
    return v.kept.detections.join(orders, "drawing_id").withColumn("drawing_id", F.col("o_custkey"))


GROUPS = """SELECT sheet AS drawing_id, class_name, component AS group_id, count(*) AS shapes,
        CASE WHEN max(x+w/2.0)-min(x+w/2.0) > max(y+h/2.0)-min(y+h/2.0) THEN CASE WHEN count(*) = 2 THEN 'front,side' ELSE 'front,side,top' END
          ELSE CASE WHEN count(*) = 2 THEN 'top,front' ELSE 'top,front,side' END END AS views,
        arg_min(detection_id, (-w*h, detection_id)) AS primary_shape_id
        FROM pts JOIN comp ON node = detection_id GROUP BY 1, 2, 3 HAVING min(w*h)/max(w*h) >= 0.5"""


@register("multi_view_groups", with_views(GROUPS, **VIEWS))
def _(v: Views) -> DataFrame:
    return tidy(view_groups.multi_view_groups(_sheets(v), eps=0.5, buckets=v.kept.buckets))


DENSE_VIEWS = {
    "sht": SHEETS, "pts": POINTS, "near": NEAR,
    "core": "SELECT a AS id FROM near GROUP BY a HAVING count(*) + 1 >= 3",
    "linked": "SELECT n.a, n.b FROM near n JOIN core x ON x.id = n.a JOIN core y ON y.id = n.b",
    "reach": "SELECT a AS node, b AS other FROM linked UNION SELECT r.node, n.b FROM reach r JOIN linked n ON n.a = r.other",
    "cores": "SELECT id AS node, least(id, coalesce(min(other), id)) AS component FROM core LEFT JOIN reach ON node = id GROUP BY id",
    "comp": """SELECT node, component FROM cores UNION ALL
      SELECT n.a, min(c.component) FROM near n JOIN cores c ON c.node = n.b WHERE n.a NOT IN (SELECT id FROM core) GROUP BY n.a""",
}


@register("multi_view_groups_dense", with_views(GROUPS, **DENSE_VIEWS))
def _(v: Views) -> DataFrame:
    return tidy(view_groups.multi_view_groups(_sheets(v), eps=0.5, min_samples=3, buckets=v.kept.buckets))


@register(
    "primary_view_shape",
    with_views(
        "SELECT component AS group_id, arg_min(detection_id, (-w*h, detection_id)) AS primary_shape_id FROM pts JOIN comp ON node = detection_id GROUP BY 1",
        **VIEWS,
    ),
)
def _(v: Views) -> DataFrame:
    sheets = _sheets(v)
    return view_groups.primary_view_shape(view_groups.group_members(sheets, eps=0.5, buckets=v.kept.buckets), sheets)
