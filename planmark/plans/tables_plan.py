"""Registered queries: sources, sinks, table rules, listings."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from planmark.operators import (
    associate, export, extract, fingerprint, hierarchy, history, integrity, query, scoring, search_index, validate,
)
from planmark.operators.associate import associate_text_shapes
from planmark.plans.graph_plan import PARTS
from planmark.plans.helpers import scratch, tidy
from planmark.plans.registry import registry
from planmark.plans.scoring_plan import FLAGS, PROFILE
from planmark.plans.views import PAGE_HEIGHT, PAGE_WIDTH, Views, with_views
from planmark.sources import files, publish, store

Q, SQL, register = registry()


# ---- sources and sinks ----------------------------------------------------------------------


@register("file_manifest")
def _(v: Views) -> DataFrame:
    found = files.file_manifest(v.spark, v.folder, "*.parquet", header="PAR1", max_size_mb=1.0)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return tidy(found.select(name.alias("file"), "length", "size_mb", "header_ok", "size_ok", "digest"))


@register(
    "duplicate_files",
    "SELECT sha256(text) AS digest, count(*) AS files, min(doc_id) AS first_file FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def _(v: Views) -> DataFrame:
    return fingerprint.duplicate_files(v.table("documents"), "doc_id", "text")


def _table_set(v: Views) -> dict[str, DataFrame]:
    return {
        "drawings": v.drawings,
        "text_extractions": v.text_blocks,
        "shape_detections": v.detections,
        "entities": v.entities,
        "llm_usage": v.usage,
        "processing_audit": v.audit,
    }


COUNTS_SQL = """SELECT 'drawings' AS "table", count(*) AS "rows" FROM drw UNION ALL SELECT 'text_extractions', count(*) FROM txt
    UNION ALL SELECT 'shape_detections', count(*) FROM det UNION ALL SELECT 'entities', count(*) FROM ent
    UNION ALL SELECT 'llm_usage', count(*) FROM usg UNION ALL SELECT 'processing_audit', count(*) FROM aud"""


# rows and contents: a sum of digests of the columns that identify a row and what it says
CONTENT = {
    "drawings": ("drw", ("drawing_id", "source_file", "status")),
    "text_extractions": ("txt", ("text_id", "drawing_id", "content")),
    "shape_detections": ("det", ("detection_id", "drawing_id", "class_name")),
    "entities": ("ent", ("drawing_id", "entity_type", "value", "original_text")),
    "llm_usage": ("usg", ("usage_id", "drawing_id", "model", "tokens_input")),
    "processing_audit": ("aud", ("audit_id", "drawing_id", "stage", "error_message")),
}
INGEST_SQL = " UNION ALL ".join(
    f"""SELECT '{name}' AS "table", count(*) AS "rows", sum(('0x'||substr(md5(concat_ws('|', {", ".join(columns)})), 1, 8))::BIGINT)::BIGINT AS content
    FROM {view}"""
    for name, (view, columns) in CONTENT.items()
)


@register("ingest_tables", with_views(INGEST_SQL))
def _(v: Views) -> DataFrame:
    tables, root = _table_set(v), scratch(v.spark, "ingest")
    store.ingest_tables(tables, root, "first")
    store.ingest_tables(tables, root, "first")  # a delivery that comes twice counts once
    back = publish.read_published(v.spark, root)
    parts = []
    for name, (_, columns) in CONTENT.items():
        digest = F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8), 16, 10).cast("bigint")
        parts.append(back[name].agg(F.count("*").alias("rows"), F.sum(digest).alias("content")).select(F.lit(name).alias("table"), "rows", "content"))
    return reduce(DataFrame.unionByName, parts)


@register("table_snapshot", with_views(COUNTS_SQL))
def _(v: Views) -> DataFrame:
    return store.table_snapshot(_table_set(v), scratch(v.spark, "snapshot"), "1").select("table", "rows")


LINE_RULES = integrity.TableRules(
    required=("l_orderkey", "l_partkey"),
    unit_range=("l_discount",),
    positive=("l_quantity", "l_tax"),
    allowed={"l_returnflag": ["A", "N"]},
    unique=(("l_orderkey", "l_linenumber"),),
    parents={"l_partkey": ("part", "p_partkey")},
)


@register(
    "constraint_check",
    with_views(
        """SELECT source, reason, count(*) AS "rows" FROM (
        SELECT 'lineitem' AS source, 'l_tax not positive' AS reason FROM lineitem WHERE l_tax <= 0
        UNION ALL SELECT 'lineitem', 'l_quantity not positive' FROM lineitem WHERE l_quantity <= 0
        UNION ALL SELECT 'lineitem', 'l_discount not in 0..1' FROM lineitem WHERE l_discount NOT BETWEEN 0 AND 1
        UNION ALL SELECT 'lineitem', 'l_returnflag not allowed' FROM lineitem WHERE l_returnflag NOT IN ('A','N')
        UNION ALL SELECT 'lineitem', 'l_orderkey+l_linenumber repeated' FROM
          (SELECT count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1
        UNION ALL SELECT 'lineitem', 'l_partkey without part' FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
        UNION ALL SELECT 'audit', 'stage not allowed' FROM aud WHERE stage IN ('validation','complete')
        UNION ALL SELECT 'audit', 'duration_seconds negative' FROM aud WHERE duration_seconds < 0
        UNION ALL SELECT 'audit', 'drawing_id without drawings' FROM aud WHERE drawing_id NOT IN (SELECT drawing_id FROM drw)
        ) GROUP BY ALL"""
    ),
)
def _(v: Views) -> DataFrame:
    lines = integrity.check_table(v.table("lineitem"), LINE_RULES, {"part": v.table("part")})
    audit = integrity.check_table(v.audit, integrity.RULES["processing_audit"], {"drawings": v.drawings})
    named = lambda df, source: df.select(F.lit(source).alias("source"), F.explode("reasons").alias("reason"))
    return (
        named(lines, "lineitem").unionByName(named(audit, "audit"))
        .groupBy("source", "reason").agg(F.count("*").alias("rows"))
    )


@register(
    "merge_status",
    with_views(
        """SELECT d.drawing_id, coalesce(c.new_status, d.status) AS status FROM drw d LEFT JOIN (
        SELECT drawing_id, max_by(new_status, (ts, change_id)) AS new_status FROM (
          SELECT user_id AS drawing_id, ts, event_id AS change_id, CASE event_type WHEN 'view' THEN 'review' WHEN 'click' THEN 'processing'
            WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'complete' ELSE 'unknown' END AS new_status FROM events)
        WHERE new_status <> 'unknown' GROUP BY 1) c USING (drawing_id)"""
    ),
)
def _(v: Views) -> DataFrame:
    changes = v.table("events").select(
        F.col("user_id").alias("drawing_id"),
        F.col("ts").alias("changed_at"),
        F.col("event_id").alias("change_id"),
        F.expr(
            "CASE event_type WHEN 'view' THEN 'review' WHEN 'click' THEN 'processing' "
            "WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'complete' ELSE 'unknown' END"
        ).alias("new_status"),
    )
    return integrity.merge_status(v.drawings, changes).select("drawing_id", "status")


@register(
    "delete_cascade",
    with_views(
        """SELECT 'drawings' AS "table", count(*) AS "rows" FROM drw WHERE status <> 'failed'
        UNION ALL SELECT 'text_extractions', count(*) FROM txt WHERE drawing_id NOT IN (SELECT drawing_id FROM drw WHERE status = 'failed')
        UNION ALL SELECT 'entities', count(*) FROM ent WHERE drawing_id NOT IN (SELECT drawing_id FROM drw WHERE status = 'failed')
        UNION ALL SELECT 'shape_detections', count(*) FROM det WHERE drawing_id NOT IN (SELECT drawing_id FROM drw WHERE status = 'failed')"""
    ),
)
def _(v: Views) -> DataFrame:
    tables = {
        "drawings": v.drawings, "text_extractions": v.text_blocks,
        "entities": v.entities, "shape_detections": v.detections,
    }
    return integrity.row_counts(integrity.delete_cascade(tables, v.drawings.where("status = 'failed'")))


SUMMARY_SQL = """SELECT d.drawing_id, source_file, strftime(processing_timestamp, '%Y-%m-%d %H:%M:%S') AS processing_timestamp,
    printf('%.4f', overall_confidence) AS overall_confidence, needs_review, status,
    coalesce(e.n, 0) AS entity_count, coalesce(s.n, 0) AS detection_count, coalesce(a.n, 0) AS association_count,
    coalesce(e.pn, false) AS has_part_number, tb.drawing_id IS NOT NULL AS has_title_block,
    CAST((overall_confidence < 0.75)::INT + (coalesce(e.n,0)=0)::INT + (coalesce(s.n,0)=0)::INT
      + (NOT coalesce(e.pn,false))::INT + (status='failed')::INT + (NOT coalesce(e.pn,false))::INT AS BIGINT) AS review_flag_count
    FROM drw d LEFT JOIN (SELECT drawing_id, count(*) AS n, bool_or(entity_type='PART_NUMBER') AS pn FROM ent GROUP BY 1) e USING (drawing_id)
    LEFT JOIN (SELECT drawing_id, count(*) AS n FROM det GROUP BY 1) s USING (drawing_id)
    LEFT JOIN (SELECT drawing_id, count(*) AS n FROM asc_ GROUP BY 1) a USING (drawing_id)
    LEFT JOIN (SELECT DISTINCT drawing_id FROM txt WHERE x > 600 AND y > 560) tb ON tb.drawing_id = d.drawing_id"""


def _flags(v: Views) -> DataFrame:
    profiles = scoring.profile(v.drawings, v.text_blocks, v.detections, v.entities)
    scored = profiles.withColumn("confidence", F.col("overall_confidence"))
    return scoring.review_flags(scored, validate.critical_field_issues(v.drawings, v.entities))


@register("export_summary", with_views(SUMMARY_SQL))
def _(v: Views) -> DataFrame:
    v = v.kept
    marked = extract.mark_title_blocks(v.text_blocks, PAGE_WIDTH, PAGE_HEIGHT)
    return export.export_summary(
        v.drawings, v.entities, v.detections, associate_text_shapes(v.text_blocks, v.detections),
        extract.title_block_region(marked), _flags(v),
    )


@register(
    "export_entities",
    with_views(
        """SELECT e.drawing_id, source_file, 'ENT-'||substr(sha256(entity_key),1,16) AS entity_id, entity_type,
        CASE WHEN substr(value,1,1) IN ('=','+','-','@',chr(9),chr(13)) THEN ''''||value ELSE value END AS value,
        CASE WHEN substr(original_text,1,1) IN ('=','+','-','@',chr(9),chr(13)) THEN ''''||original_text ELSE original_text END AS original_text,
        printf('%.4f', confidence) AS confidence, method AS extraction_method,
        x AS bbox_x, y AS bbox_y, w AS bbox_width, h AS bbox_height FROM ent e JOIN drw USING (drawing_id)"""
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(export.export_entities(v.entities, v.drawings))


@register(
    "export_detections",
    with_views(
        """SELECT t.drawing_id, source_file, detection_id, class_name, printf('%.4f', confidence) AS confidence,
        x AS bbox_x, y AS bbox_y, w AS bbox_width, h AS bbox_height,
        printf('%.4f', least(1.0, (x+w/2.0)/1000.0)::DOUBLE) AS bbox_norm_x_center, printf('%.4f', least(1.0, (y+h/2.0)/800.0)::DOUBLE) AS bbox_norm_y_center,
        printf('%.4f', (w/1000.0)::DOUBLE) AS bbox_norm_width, printf('%.4f', (h/800.0)::DOUBLE) AS bbox_norm_height
        FROM det t JOIN drw USING (drawing_id)"""
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(export.export_detections(v.detections, v.drawings))


@register(
    "export_associations",
    with_views(
        """SELECT a.drawing_id, source_file, 'ASSOC-'||substr(sha256(text_id||'|'||detection_id),1,16) AS association_id,
        text_id, detection_id AS shape_id, relationship_type, printf('%.4f', confidence) AS confidence,
        printf('%.4f', distance_pixels) AS distance_pixels FROM asc_ a JOIN drw USING (drawing_id)"""
    ),
)
def _(v: Views) -> DataFrame:
    return export.export_associations(associate_text_shapes(v.text_blocks, v.detections), v.drawings)


@register(
    "csv_sink",
    with_views("SELECT relationship_type, count(*) AS \"rows\" FROM asc_ GROUP BY 1"),
)
def _(v: Views) -> DataFrame:
    path = scratch(v.spark, "csv")
    store.csv_sink(
        export.export_associations(associate_text_shapes(v.text_blocks, v.detections), v.drawings), path, ";"
    )
    back = v.spark.read.option("sep", ";").option("header", "true").csv(path)
    return back.groupBy("relationship_type").agg(F.count("*").alias("rows"))


@register(
    "nested_json_export",
    with_views(
        """SELECT d.drawing_id, 0::BIGINT AS part, d.status, coalesce(t.l,'') AS text_blocks, coalesce(e.l,'') AS entities, coalesce(s.l,'') AS detections,
          coalesce(a.l,'') AS associations, r.root_id::VARCHAR AS root_component, coalesce(h.l,'') AS assemblies, coalesce(f.l,'') AS review_flags
        FROM drw d LEFT JOIN (SELECT drawing_id, string_agg(text_id::VARCHAR||':'||content, ';' ORDER BY text_id) AS l FROM txt GROUP BY 1) t USING (drawing_id)
        LEFT JOIN (SELECT drawing_id, string_agg(id||':'||entity_type||':'||value, ';' ORDER BY id) AS l
          FROM (SELECT *, 'ENT-'||substr(sha256(entity_key),1,16) AS id FROM ent) GROUP BY 1) e USING (drawing_id)
        LEFT JOIN (SELECT drawing_id, string_agg(detection_id::VARCHAR||':'||class_name, ';' ORDER BY detection_id) AS l FROM det GROUP BY 1) s USING (drawing_id)
        LEFT JOIN (SELECT drawing_id, string_agg(id||':'||relationship_type, ';' ORDER BY id) AS l
          FROM (SELECT *, 'ASSOC-'||substr(sha256(text_id||'|'||detection_id),1,16) AS id FROM asc_) GROUP BY 1) a USING (drawing_id)
        LEFT JOIN (SELECT drawing_id, root_id FROM rts) r USING (drawing_id)
        LEFT JOIN (SELECT drawing_id, string_agg(parent_id::VARCHAR||':'||child_id::VARCHAR||':'||relationship, ';' ORDER BY parent_id, child_id, relationship) AS l
          FROM edg GROUP BY 1) h USING (drawing_id)
        LEFT JOIN (SELECT drawing_id, string_agg(flag_type||':'||severity, ';' ORDER BY flag_type, severity) AS l FROM flg GROUP BY 1) f USING (drawing_id)""",
        **PARTS, prof=PROFILE, flg=FLAGS,
    ),
)
def _(v: Views) -> DataFrame:
    v = v.kept
    links = v.keep(associate_text_shapes(v.text_blocks, v.detections).drop("association_id"))
    roots = v.keep(hierarchy.root_component(v.detections, links))
    edges = v.keep(hierarchy.assembly_edges(v.detections, roots))
    named = links.withColumn("association_id", associate.association_id())
    documents = export.nested_json_export(
        v.drawings,
        {
            "text_blocks": (v.text_blocks, "text_id"),
            "entities": (v.entities, "entity_id"),
            "detections": (v.detections, "detection_id"),
            "associations": (named, "association_id"),
            "review_flags": (v.keep(_flags(v)), "flag_type"),
        },
        roots=roots, edges=edges,
    )
    fields = {
        "text_blocks": ("text_id", "content"), "entities": ("entity_id", "entity_type", "value"),
        "detections": ("detection_id", "class_name"), "associations": ("association_id", "relationship_type"),
        "review_flags": ("flag_type", "severity"),
    }
    edge = ("parent_id", "child_id", "relationship")
    items = lambda names: f"array<struct<{','.join(f'{n}:string' for n in names)}>>"
    schema = ", ".join(f"{name} {items(names)}" for name, names in fields.items())
    parsed = documents.withColumn("d", F.from_json(
        "document", f"status string, {schema}, hierarchy struct<root_component_id:string,assemblies:{items(edge)}>"
    ))
    line = lambda path, names: F.array_join(
        F.transform(F.coalesce(path, F.array().cast(items(names))), lambda x: F.concat_ws(":", *[x[n] for n in names])), ";"
    )
    return tidy(parsed.select(
        "drawing_id", "part", "d.status", *[line(F.col(f"d.{name}"), names).alias(name) for name, names in fields.items()],
        F.col("d.hierarchy.root_component_id").alias("root_component"),
        line(F.col("d.hierarchy.assemblies"), edge).alias("assemblies"),
    ))


# documents with one kind of fault each, by order priority and status
FAULTY = """CASE o_orderpriority
    WHEN '1-URGENT' THEN '{"drawing_id":"' || o_orderkey || '","source_file":"f","processing_timestamp":"t","overall_confidence":' || (o_orderkey % 30) / 20.0 || ',"entities":[{"entity_type":"OEM","value":"x"},{"value":"y"},7]}'
    WHEN '2-HIGH' THEN '{"drawing_id":"' || o_orderkey || '","overall_confidence":"high","entities":"none","detections":[{"class_name":"bolt"}]}'
    WHEN '3-MEDIUM' THEN '{"source_file":"f","detections":[{"class_name":"bolt","bbox":[1,2]},{"bbox":[]}]}'
    WHEN '5-LOW' THEN '{"drawing_id":"' || o_orderkey
    ELSE '{"drawing_id":"' || o_orderkey || '","source_file":"f","processing_timestamp":"t","overall_confidence":1}' END"""


@register(
    "json_schema_check",
    f"""WITH doc AS (SELECT o_orderkey AS doc_id, {FAULTY.replace("(o_orderkey % 30) / 20.0", "CAST((o_orderkey % 30) / 20.0 AS DOUBLE)")} AS document FROM orders),
    j AS (SELECT doc_id, document, json_valid(document) AS ok, CASE WHEN json_valid(document) THEN document::JSON END AS j FROM doc)
    SELECT doc_id, CASE WHEN NOT ok THEN 'Not a JSON document' ELSE concat_ws(',',
      CASE WHEN (j->'drawing_id') IS NULL THEN 'Missing required field: drawing_id' END,
      CASE WHEN (j->'source_file') IS NULL THEN 'Missing required field: source_file' END,
      CASE WHEN (j->'processing_timestamp') IS NULL THEN 'Missing required field: processing_timestamp' END,
      CASE WHEN (j->'overall_confidence') IS NULL THEN NULL WHEN json_type((j->'overall_confidence')) = 'VARCHAR' THEN 'Invalid confidence type'
        WHEN CAST((j->>'overall_confidence') AS DOUBLE) > 1 THEN 'Confidence out of range [0.0, 1.0]' END,
      CASE WHEN json_type((j->'entities')) = 'VARCHAR' THEN 'Entities must be a list'
        WHEN json_type((j->'entities')) = 'ARRAY' THEN 'Entity 1 missing entity_type,Entity 2 must be a dictionary' END,
      CASE WHEN json_array_length((j->'detections')) = 1 THEN 'Detection 0 missing bbox'
        WHEN json_array_length((j->'detections')) = 2 THEN 'Detection 1 missing class_name' END) END AS errors FROM j""",
)
def _(v: Views) -> DataFrame:
    documents = v.table("orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.expr(FAULTY.replace("(o_orderkey % 30) / 20.0", "CAST((o_orderkey % 30) / 20.0D AS DOUBLE)")).alias("document"),
    )
    return tidy(export.json_schema_check(documents))


@register(
    "ids_lookup",
    with_views(
        "SELECT event_id AS position, drawing_id, status FROM events JOIN drw ON drawing_id = user_id"
    ),
)
def _(v: Views) -> DataFrame:
    asked = v.table("events").select(F.col("event_id").alias("position"), F.col("user_id").alias("drawing_id"))
    return query.ids_lookup(v.drawings, asked).select("position", "drawing_id", "status")


@register(
    "cost_export",
    with_views(
        """SELECT use_case, count(*) AS "rows" FROM usg WHERE "timestamp" >= TIMESTAMP '2024-01-05' AND "timestamp" < TIMESTAMP '2024-01-20' GROUP BY 1"""
    ),
)
def _(v: Views) -> DataFrame:
    path = scratch(v.spark, "cost")
    store.cost_export(v.usage, datetime(2024, 1, 5), datetime(2024, 1, 20), path)
    return v.spark.read.option("header", "true").csv(path).groupBy("use_case").agg(F.count("*").alias("rows"))


@register(
    "pending_files",
    with_views("SELECT source_file FROM drw WHERE drawing_id NOT IN (SELECT user_id FROM events)"),
)
def _(v: Views) -> DataFrame:
    done = v.drawings.join(v.table("events").select(F.col("user_id").alias("drawing_id")), "drawing_id", "left_semi")
    return files.pending_files(v.drawings.select("source_file"), done)


# ---- listings ---------------------------------------------------------------------------------

SPAN = {"date_from": datetime(1996, 1, 1), "date_to": datetime(1998, 12, 31)}


@register(
    "query_drawings",
    with_views(
        """SELECT drawing_id, source_file, overall_confidence, status FROM drw WHERE status = 'complete' AND needs_review
        AND overall_confidence BETWEEN 0.2 AND 0.7 AND processing_timestamp BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'
        ORDER BY processing_timestamp DESC, drawing_id LIMIT 100 OFFSET 50"""
    ),
)
def _(v: Views) -> DataFrame:
    wanted = query.DrawingFilter(
        status="complete", needs_review=True, min_confidence=0.2, max_confidence=0.7, offset=50, **SPAN
    )
    return query.query_drawings(v.drawings, wanted).select("drawing_id", "source_file", "overall_confidence", "status")


@register(
    "query_drawings_sorted",
    with_views("SELECT drawing_id, overall_confidence FROM drw WHERE status = 'review' ORDER BY overall_confidence DESC, drawing_id LIMIT 200"),
)
def _(v: Views) -> DataFrame:
    wanted = query.DrawingFilter(status="review", sort_by="overall_confidence", sort_order="desc", limit=200)
    return query.query_drawings(v.drawings, wanted).select("drawing_id", "overall_confidence")


@register(
    "has_part_number_filter",
    with_views(
        """SELECT drawing_id, EXISTS (SELECT 1 FROM ent e WHERE e.drawing_id = d.drawing_id AND entity_type = 'PART_NUMBER') AS has_part_number FROM drw d"""
    ),
)
def _(v: Views) -> DataFrame:
    side = lambda flag: query.matching(
        v.drawings, query.DrawingFilter(has_part_number=flag), v.entities
    ).select("drawing_id", F.lit(flag).alias("has_part_number"))
    return side(True).unionByName(side(False))


@register(
    "query_drawings_count",
    with_views(
        """SELECT count(*) AS drawings FROM drw WHERE needs_review AND overall_confidence >= 0.3
        AND processing_timestamp BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'"""
    ),
)
def _(v: Views) -> DataFrame:
    return query.query_drawings_count(
        v.drawings, query.DrawingFilter(needs_review=True, min_confidence=0.3, **SPAN)
    )


@register(
    "page_stats",
    with_views(
        """SELECT drawing_id, row_no, (row_no - 1) // 100 + 1 AS page_no FROM
        (SELECT drawing_id, row_number() OVER (ORDER BY processing_timestamp DESC, drawing_id) AS row_no FROM drw)"""
    ),
)
def _(v: Views) -> DataFrame:
    return query.with_pages(v.drawings, 100).select(
        "drawing_id", F.col("row_no").cast("bigint").alias("row_no"), "page_no"
    )


@register(
    "review_queue",
    with_views("SELECT drawing_id, overall_confidence FROM drw WHERE needs_review ORDER BY processing_timestamp DESC, drawing_id LIMIT 50"),
)
def _(v: Views) -> DataFrame:
    return query.review_queue(v.drawings).select("drawing_id", "overall_confidence")


@register(
    "usage_in_range",
    with_views(
        """SELECT usage_id, drawing_id, use_case, round(cost_usd, 6) AS cost_usd FROM usg
        WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-18'"""
    ),
)
def _(v: Views) -> DataFrame:
    found = query.usage_in_range(v.usage, datetime(2024, 1, 3), datetime(2024, 1, 18))
    return tidy(found.select("usage_id", "drawing_id", "use_case", "cost_usd"))


@register(
    "low_confidence_rows",
    with_views(
        """SELECT 'text' AS source, drawing_id, text_id::VARCHAR AS row_id, confidence FROM txt WHERE confidence < 0.85
        UNION ALL SELECT 'entity', drawing_id, 'ENT-'||substr(sha256(entity_key),1,16), confidence FROM ent WHERE confidence < 0.80
        UNION ALL SELECT 'shape', drawing_id, detection_id::VARCHAR, confidence FROM det WHERE confidence < 0.45"""
    ),
)
def _(v: Views) -> DataFrame:
    return query.low_confidence_rows(v.text_blocks, v.entities, v.detections)


@register(
    "ocr_fallback_candidates",
    with_views("SELECT text_id, drawing_id, confidence FROM txt WHERE confidence < 0.85 AND ocr_engine = 'paddleocr'"),
)
def _(v: Views) -> DataFrame:
    return query.ocr_fallback_candidates(v.text_blocks).select("text_id", "drawing_id", "confidence")


SEARCH_SQL = with_views(
    r"""SELECT drawing_id, 'ENT-'||substr(sha256(entity_key),1,16) AS entity_id, entity_type FROM ent
    WHERE list_has_all(regexp_extract_all(lower(entity_type||' '||value||' '||original_text), '[\p{L}\p{N}]+'), ['steel','304'])"""
)


@register("entity_search", SEARCH_SQL)
def _(v: Views) -> DataFrame:
    return extract.entity_search(v.entities, "Steel 304")


@register("entity_search_index", SEARCH_SQL)
def _(v: Views) -> DataFrame:
    root, entities = scratch(v.spark, "search"), v.kept.entities
    odd = F.col("drawing_id") % 2 == 1
    search_index.add_entities(entities.where(odd), root, "odd")
    search_index.add_entities(entities.where(~odd), root, "even")
    return search_index.search(v.spark, root, "Steel 304")


@register(
    "type_filter",
    with_views("SELECT drawing_id, entity_type, value FROM ent WHERE entity_type IN ('OEM','THREAD_SPEC')"),
)
def _(v: Views) -> DataFrame:
    return extract.type_filter(v.entities, ["OEM", "THREAD_SPEC"]).select("drawing_id", "entity_type", "value")


@register(
    "drawings_missing_part_number",
    with_views(
        """SELECT drawing_id, source_file FROM drw WHERE drawing_id NOT IN
        (SELECT drawing_id FROM ent WHERE entity_type = 'PART_NUMBER' AND confidence > 0.70)"""
    ),
)
def _(v: Views) -> DataFrame:
    return query.drawings_missing_part_number(v.drawings, v.entities).select("drawing_id", "source_file")


# ---- audit trail and snapshots -------------------------------------------------------------------


@register(
    "audit_stage_durations",
    with_views(
        """SELECT drawing_id, audit_id, stage, row_number() OVER (PARTITION BY drawing_id ORDER BY "timestamp", audit_id) AS step_no,
        duration_seconds, round(sum(duration_seconds) OVER (PARTITION BY drawing_id), 6) AS total_seconds,
        round(coalesce(duration_seconds / nullif(sum(duration_seconds) OVER (PARTITION BY drawing_id), 0), 0), 9) AS share,
        min_by(stage, ("timestamp", audit_id)) FILTER (status = 'failed') OVER (PARTITION BY drawing_id) AS failed_stage FROM aud"""
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(history.audit_stage_durations(v.audit), share=9)


@register(
    "invalid_stage_transitions",
    with_views(
        """SELECT drawing_id, audit_id, previous_stage, stage FROM
        (SELECT *, lag(stage) OVER (PARTITION BY drawing_id ORDER BY "timestamp", audit_id) AS previous_stage FROM aud)
        WHERE previous_stage IS NOT NULL AND previous_stage <> 'complete' AND (previous_stage, stage) NOT IN (
        ('pdf_processing','image_preprocessing'), ('image_preprocessing','ocr_extraction'), ('ocr_extraction','shape_detection'),
        ('shape_detection','entity_extraction'), ('entity_extraction','data_association'), ('entity_extraction','llm_enhancement'),
        ('data_association','validation'), ('data_association','llm_enhancement'), ('llm_enhancement','validation'), ('validation','complete'))"""
    ),
)
def _(v: Views) -> DataFrame:
    return history.invalid_stage_transitions(v.audit)


def _snapshots(v: Views) -> DataFrame:
    return v.table("events").select(
        F.col("user_id").alias("snapshot_id"), F.col("event_id").alias("version"),
        F.col("ts").cast("timestamp").alias("created"),
    )


@register(
    "latest_snapshot",
    "SELECT user_id AS snapshot_id, max_by(event_id, (ts, event_id)) AS version FROM events GROUP BY 1",
)
def _(v: Views) -> DataFrame:
    return history.latest_snapshot(_snapshots(v)).select("snapshot_id", "version")


@register(
    "snapshot_retention",
    """SELECT snapshot_id, version, place FROM (SELECT user_id AS snapshot_id, event_id AS version,
       row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events
       WHERE ts >= TIMESTAMP '2024-01-24') WHERE place <= 10""",
)
def _(v: Views) -> DataFrame:
    kept = history.snapshot_retention(_snapshots(v), datetime(2024, 1, 31))
    return tidy(kept.select("snapshot_id", "version", "place"))


@register(
    "llm_label_candidates",
    with_views(
        """SELECT drawing_id, detection_id, class_name, place FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY detection_id) AS place
        FROM det WHERE confidence < 0.7) WHERE place <= 5"""
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(history.label_candidates(v.detections).select("drawing_id", "detection_id", "class_name", "place"))
