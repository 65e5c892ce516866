"""Registered queries: text to entities, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from planmark.functions import checks, bbox as bb, text as tx, units
from planmark.operators import extract, near_text
from planmark.plans.helpers import tidy
from planmark.plans.registry import registry
from planmark.plans.views import PAGE_HEIGHT, PAGE_WIDTH, Views, with_views

Q, SQL, register = registry()

ENTITY_ROWS = "SELECT drawing_id, text_id AS source_text_id, value, original_text, confidence, x AS bbox_x FROM ent WHERE entity_type = '{}'"


def _layer(kind: str):
    def run(v: Views) -> DataFrame:
        found = extract.extract_entities(v.text_blocks, [kind])
        return tidy(
            found.select(
                "drawing_id", "source_text_id", "value", "original_text", "confidence",
                F.col("bbox.x").alias("bbox_x"),
            )
        )

    return run


for _key, _kind in {
    "part_number": "PART_NUMBER", "dimension": "DIMENSION", "weight": "WEIGHT", "thread": "THREAD_SPEC",
    "material": "MATERIAL", "finish": "SURFACE_FINISH", "tolerance": "TOLERANCE", "oem": "OEM",
}.items():
    register(f"entities_{_key}", with_views(ENTITY_ROWS.format(_kind)))(_layer(_kind))


@register(
    "extract_entities",
    with_views(
        """SELECT 'ENT-'||substr(sha256(entity_key),1,16) AS entity_id, drawing_id, entity_type, value, confidence,
        method AS extraction_method, text_id AS source_text_id FROM ent"""
    ),
)
def _(v: Views) -> DataFrame:
    return v.entities.select(
        "entity_id", "drawing_id", "entity_type", "value", "confidence", "extraction_method", "source_text_id"
    )


@register(
    "title_block_fields",
    with_views(
        r"""SELECT drawing_id, nullif(regexp_extract(t, '(?:^|[^\p{L}\p{N}_])([A-Z]{2,10}[-_]?[A-Z0-9]{4,20}(?:[-_][A-Z0-9]+)?)\b', 1), '') AS part_number,
        CASE WHEN contains(lower(t), 'skf') THEN 'SKF' END AS oem, nullif(regexp_extract(t, '(?:SCALE|Scale)[:\s]*(\d+:\d+|1:\d+)', 1), '') AS scale,
        nullif(regexp_extract(t, '\d{1,2}[/-]\d{1,2}[/-]\d{2,4}', 0), '') AS date, nullif(regexp_extract(t, '(?:REV|Rev|Revision)[:\s]*([A-Z0-9]+)', 1), '') AS revision
        FROM (SELECT drawing_id, string_agg(content, ' ' ORDER BY block_no) AS t FROM txt WHERE x > 600 AND y > 560 GROUP BY 1)"""
    ),
)
def _(v: Views) -> DataFrame:
    return extract.title_block_fields(extract.mark_title_blocks(v.text_blocks, PAGE_WIDTH, PAGE_HEIGHT))


@register(
    "title_block_region",
    with_views(
        """SELECT drawing_id, min(x) AS x, min(y) AS y, max(x+w)-min(x) AS width, max(y+h)-min(y) AS height, 0.8::DOUBLE AS confidence, count(*) AS blocks
        FROM txt WHERE x > 600 AND y > 560 GROUP BY 1"""
    ),
)
def _(v: Views) -> DataFrame:
    region = extract.title_block_region(extract.mark_title_blocks(v.text_blocks, PAGE_WIDTH, PAGE_HEIGHT))
    return tidy(region.select("drawing_id", "bbox.*", "confidence", "blocks"))


@register(
    "normalize_dimension",
    with_views(
        r"""SELECT text_id, value AS raw, CAST(regexp_extract(value, '([Øø⌀])?\s*(\d+\.?\d*)', 2) AS DOUBLE) AS value,
        try_cast(trim(replace(regexp_extract(value, '([Øø⌀])?\s*(\d+\.?\d*)\s*(±?\s*\d+\.?\d*)?', 3), '±', '')) AS DOUBLE) AS tolerance,
        'mm' AS unit, starts_with(value, 'Ø') AS is_diameter, CAST(regexp_extract(value, '([Øø⌀])?\s*(\d+\.?\d*)', 2) AS DOUBLE) AS value_mm
        FROM ent WHERE entity_type = 'DIMENSION'"""
    ),
)
def _(v: Views) -> DataFrame:
    found = extract.with_normalized(extract.extract_entities(v.text_blocks, ["DIMENSION"]))
    n = F.col("normalized_value")
    return tidy(
        found.select(
            F.col("source_text_id").alias("text_id"),
            *[n[c].alias(c) for c in ("raw", "value", "tolerance", "unit", "is_diameter", "value_mm")],
        )
    )


@register(
    "normalize_weight",
    with_views(
        r"""SELECT text_id, CAST(regexp_extract(value, '^(\d+\.?\d*)', 1) AS DOUBLE) AS value, 'kg' AS unit,
        CAST(regexp_extract(value, '^(\d+\.?\d*)', 1) AS DOUBLE) AS value_kg FROM ent WHERE entity_type = 'WEIGHT'"""
    ),
)
def _(v: Views) -> DataFrame:
    found = extract.with_normalized(extract.extract_entities(v.text_blocks, ["WEIGHT"]))
    n = F.col("normalized_value")
    return tidy(found.select(F.col("source_text_id").alias("text_id"), *[n[c].alias(c) for c in ("value", "unit", "value_kg")]))


@register(
    "missing_critical",
    with_views(
        """SELECT drawing_id, entity_type FROM drw CROSS JOIN (VALUES ('PART_NUMBER'), ('OEM')) t(entity_type)
        WHERE (drawing_id, entity_type) NOT IN (SELECT DISTINCT drawing_id, entity_type FROM ent)"""
    ),
)
def _(v: Views) -> DataFrame:
    return extract.missing_critical(v.drawings, v.entities)


# a second reading of part of the blocks, with boxes moved by a few pixels
SHIFT = "(drawing_id * 7 + block_no * 13) % 61"


@register(
    "dedup_entities",
    with_views(
        f"""SELECT n.drawing_id, n.entity_type, n.value, n.nx AS bbox_x FROM
        (SELECT e.drawing_id, e.entity_type, lower(e.value) AS value, e.x + ((e.drawing_id*7 + t.block_no*13) % 61) AS nx, e.y, e.w, e.h FROM ent e JOIN txt t USING (text_id)) n
        WHERE NOT EXISTS (SELECT 1 FROM ent o WHERE o.drawing_id = n.drawing_id AND o.entity_type = n.entity_type AND lower(o.value) = lower(n.value)
          AND greatest(0, least(o.x+o.w, n.nx+n.w)-greatest(o.x, n.nx)) * greatest(0, least(o.y+o.h, n.y+n.h)-greatest(o.y, n.y))
          >= 0.3 * (o.w*o.h + n.w*n.h - greatest(0, least(o.x+o.w, n.nx+n.w)-greatest(o.x, n.nx)) * greatest(0, least(o.y+o.h, n.y+n.h)-greatest(o.y, n.y))))"""
    ),
)
def _(v: Views) -> DataFrame:
    moved = F.col("bbox").withField("x", (F.col("bbox.x") + F.expr(SHIFT)).cast("int"))
    entities, blocks = v.kept.entities, v.kept.text_blocks.select(F.col("text_id").alias("source_text_id"), "block_no")
    again = (
        entities.join(blocks, "source_text_id")
        .withColumn("bbox", moved)
        .withColumn("value", F.lower("value"))
    )
    return tidy(
        extract.dedup_entities(again, entities).select(
            "drawing_id", "entity_type", "value", F.col("bbox.x").alias("bbox_x")
        )
    )


# ---- model replies --------------------------------------------------------------------------

REPLY = """CASE WHEN event_type = 'error' THEN '{"entities":[{"type":"PART_NU'
    WHEN event_type = 'view' THEN '{"entities":[{"type":"PART_NUMBER","value":"AB-' || event_id || '","confidence":0.95},{"type":"OEM","value":"SKF"}]}'
    WHEN event_type = 'click' THEN '{"entities":[{"type":"MATERIAL","value":"Steel"},{"type":"NONSENSE","value":"x"},{"type":"OEM","value":"NSK"}]}'
    WHEN event_type = 'signup' THEN '{"note":"none"}' ELSE '{"entities":[]}' END"""


@register(
    "llm_entities",
    """SELECT user_id AS drawing_id, event_id AS reply_id, 'PART_NUMBER' AS entity_type, 'AB-'||event_id AS value, 0.95::DOUBLE AS confidence FROM events WHERE event_type = 'view'
    UNION ALL SELECT user_id, event_id, 'OEM', 'SKF', 0.9 FROM events WHERE event_type = 'view'
    UNION ALL SELECT user_id, event_id, 'MATERIAL', 'Steel', 0.9 FROM events WHERE event_type = 'click'""",
)
def _(v: Views) -> DataFrame:
    replies = v.table("events").select(
        F.col("user_id").alias("drawing_id"), F.col("event_id").alias("reply_id"), F.expr(REPLY).alias("reply")
    )
    found = extract.reply_entities(replies).alias("e")
    numbered = replies.select("reply_id", tx.make_id("ENT", F.col("reply_id"), F.lit(0), F.lit("llm")).alias("first"),
                              tx.make_id("ENT", F.col("reply_id"), F.lit(1), F.lit("llm")).alias("second"))
    keys = numbered.select("reply_id", F.explode(F.array("first", "second")).alias("entity_id"))
    return tidy(found.join(keys, "entity_id").select("drawing_id", "reply_id", "entity_type", "value", "confidence"))


@register(
    "apply_ocr_corrections",
    with_views(
        """SELECT text_id, CASE WHEN confidence < 0.85 AND q % 3 = 0 THEN content||' X' ELSE content END AS content,
        CASE WHEN confidence >= 0.85 THEN confidence WHEN q % 3 = 0 THEN 0.95 WHEN q % 3 = 1 THEN 0.85 ELSE confidence END AS confidence FROM txt"""
    ),
)
def _(v: Views) -> DataFrame:
    size = F.col("bbox.width") - 60
    replies = v.text_blocks.where(size % 3 < 2).select(
        "text_id",
        F.when(size % 3 == 0, F.to_json(F.struct(F.concat("content", F.lit(" X")).alias("corrected_text"))))
        .otherwise(F.lit("cannot read")).alias("reply"),
    )
    return extract.apply_ocr_corrections(v.text_blocks, replies).select("text_id", "content", "confidence")


@register(
    "assessment_scores",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 0.5 ELSE round(value % 10 / 10, 6) END AS overall_quality,
    CASE event_type WHEN 'click' THEN 0.7 ELSE 0.5 END::DOUBLE AS complexity_score,
    CASE event_type WHEN 'click' THEN 'enhanced' ELSE 'baseline' END AS recommended_pipeline FROM events""",
)
def _(v: Views) -> DataFrame:
    reply = F.expr(
        "CASE event_type WHEN 'error' THEN 'I cannot tell' "
        "WHEN 'click' THEN concat('{\"overall_quality\":', value % 10, ',\"complexity\":7,\"recommended_pipeline\":\"enhanced\"}') "
        "ELSE concat('{\"overall_quality\":', value % 10, '}') END"
    )
    scored = extract.assessment_scores(v.table("events").select(F.col("event_id").alias("drawing_id"), reply.alias("reply")))
    return tidy(
        scored.select(F.col("drawing_id").alias("event_id"), "overall_quality", "complexity_score", "recommended_pipeline")
    )


@register(
    "merge_ocr_engines",
    with_views(
        """SELECT text_id, CASE WHEN b THEN upper(content) ELSE content END AS content, CASE WHEN b THEN 'easyocr' ELSE ocr_engine END AS ocr_engine,
        CASE WHEN b THEN (50+pk%50)/100.0::DOUBLE ELSE confidence END AS confidence
        FROM (SELECT *, confidence < 0.85 AND (50+pk%50)/100.0::DOUBLE > confidence AS b FROM txt JOIN part ON p_partkey = pk)
        UNION ALL SELECT text_id, content, ocr_engine, confidence FROM txt WHERE pk NOT IN (SELECT p_partkey FROM part)"""
    ),
)
def _(v: Views) -> DataFrame:
    texts = v.text_blocks.select("text_id", F.upper("content").alias("content"))
    fallback = texts.join(
        v.detections.select(F.col("detection_id").alias("text_id"), "confidence"), "text_id"
    )
    return extract.merge_ocr_engines(v.text_blocks, fallback).select("text_id", "content", "ocr_engine", "confidence")


@register(
    "token_estimate",
    r"""SELECT conv_id, turn, CAST(trunc(n * 1.33::DOUBLE) AS BIGINT) AS gateway_tokens, greatest(1, n * 4 // 3) AS provider_tokens FROM
    (SELECT conv_id, turn, len(list_filter(string_split_regex(text, '\s+'), lambda t: t <> '')) AS n FROM conversations)""",
)
def _(v: Views) -> DataFrame:
    return v.table("conversations").select(
        "conv_id", "turn",
        tx.token_estimate(F.col("text")).alias("gateway_tokens"),
        tx.token_estimate(F.col("text"), "provider").alias("provider_tokens"),
    )


@register("fuzzy_block_match")
def _(v: Views) -> DataFrame:
    damaged = F.translate("content", "0O1", "OQl")
    blocks = v.kept.text_blocks
    wanted = blocks.select("drawing_id", F.col("text_id").alias("wanted_id"), damaged.alias("text"))
    return tidy(extract.fuzzy_block_match(wanted, blocks))


@register(
    "near_duplicate_text",
    r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(trim(coalesce(text, ''))), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] ELSE list_sort(list_distinct(list_transform(
      range(greatest(1, len(ws) - 4)), lambda i: array_to_string(ws[i + 1:i + 5], ' ')))) END AS sh FROM w),
    class AS (SELECT sh, min(doc_id) AS text_id, len(sh) AS n FROM s GROUP BY sh),
    e AS (SELECT text_id, n, unnest(sh) AS x FROM class),
    shared AS (SELECT a.text_id AS a, b.text_id AS b, a.n + b.n AS both_n, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.text_id < b.text_id GROUP BY 1, 2, 3),
    links AS (SELECT a, b FROM shared WHERE 5 * c >= 4 * (both_n - c) UNION SELECT b, a FROM shared WHERE 5 * c >= 4 * (both_n - c)),
    reach AS (SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
    grp AS (SELECT node, least(node, min(other)) AS group_id FROM reach GROUP BY 1)
    SELECT doc_id, text_id, coalesce(group_id, text_id) AS group_id FROM s JOIN class USING (sh) LEFT JOIN grp ON node = text_id""",
)
def _(v: Views) -> DataFrame:
    return near_text.near_duplicate_text(v.table("documents"))


# ---- scalar functions ------------------------------------------------------------------------


@register(
    "text_functions",
    r"""SELECT doc_id,
    md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS whitespace,
    md5(trim(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9\s.]', '', 'g'), '\s+', ' ', 'g'))) AS plain,
    len(list_filter(list_transform(regexp_extract_all(text, '-?\d+(?:[.,]\d+)*'), lambda x: try_cast(replace(x, ',', '.') AS DOUBLE)), lambda x: x IS NOT NULL)) AS numbers,
    round(coalesce(list_sum(list_filter(list_transform(regexp_extract_all(text, '-?\d+(?:[.,]\d+)*'), lambda x: try_cast(replace(x, ',', '.') AS DOUBLE)), lambda x: x IS NOT NULL AND abs(x) < 1e9)), 0), 3) AS number_sum,
    nullif(regexp_extract(text, '\d{4}', 0), '') AS first_year,
    md5(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g')) AS camel,
    CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 77)||'...' END AS short,
    length(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10))) AS unix_length,
    md5(trim(regexp_replace(regexp_replace(regexp_replace(translate(text, '|Ol', 'I01'), '[.,;:!?]{2,}', '.', 'g'), '\s([.,;:!?])', '\1', 'g'), '\s+', ' ', 'g'))) AS ocr_clean,
    len(regexp_extract_all(text, '[0-9]+')) > 0 AS has_number, json_valid(text) AND text <> '' AS is_json
    FROM documents""",
)
def _(v: Views) -> DataFrame:
    text = F.col("text")
    numbers = tx.extract_numbers(text)
    small = F.filter(numbers, lambda n: F.abs(n) < 1e9)
    return tidy(
        v.table("documents").select(
            "doc_id",
            F.md5(tx.normalize_whitespace(text)).alias("whitespace"),
            F.md5(tx.remove_special_characters(text, ".")).alias("plain"),
            F.size(numbers).alias("numbers"),
            F.aggregate(small, F.lit(0.0), lambda s, n: s + n).alias("number_sum"),
            tx.extract_pattern(text, r"\d{4}").alias("first_year"),
            F.md5(tx.split_camel_case(text)).alias("camel"),
            tx.truncate_text(text, 80).alias("short"),
            F.length(tx.normalize_line_endings(text)).alias("unix_length"),
            F.md5(tx.clean_ocr_text(text)).alias("ocr_clean"),
            text.rlike("[0-9]").alias("has_number"),
            tx.json_ok(text).alias("is_json"),
        ),
        number_sum=3,
    )


@register(
    "block_text_functions",
    with_views(
        r"""SELECT text_id,
        replace(replace(replace(content, 'Ø', 'diameter'), '±', 'plus_minus'), '°', 'degrees') AS symbols,
        upper(substr(content,1,1))||substr(content,2) AS capital,
        array_to_string(list_filter(regexp_extract_all(content, '(?:^|[^\p{L}\p{N}_])([a-zA-Z0-9]+)', 1), lambda t: length(t) >= 2), ',') AS words,
        coalesce(length(regexp_replace(translate(content, ' ,.', ''), '[^0-9]', '', 'g'))::DOUBLE / nullif(length(translate(content, ' ,.', '')), 0) > 0.7, false) AS numeric_text,
        ln = 2 AS dimension_like,
        CASE WHEN regexp_matches(content, '\d+\.?\d*\s*(mm|cm|in|inch|")') THEN 'dimension' WHEN length(content) <= 10 AND regexp_full_match(replace(content, ' ', ''), '\p{L}+') THEN 'label' ELSE 'note' END AS kind,
        1 - levenshtein(lower(content), lower(replace(content, '0', 'O')))::DOUBLE / length(content) >= 0.9 AS fuzzy_same FROM txt"""
    ),
)
def _(v: Views) -> DataFrame:
    content = F.col("content")
    damaged = F.replace(content, F.lit("0"), F.lit("O"))
    return tidy(
        v.text_blocks.select(
            "text_id",
            tx.normalize_symbols(content).alias("symbols"),
            tx.capitalize_first(content).alias("capital"),
            tx.extract_words(content).alias("words"),
            tx.is_numeric_text(content).alias("numeric_text"),
            tx.looks_like_dimension(content).alias("dimension_like"),
            tx.text_type(content).alias("kind"),
            (tx.levenshtein_similarity(content, damaged) >= 0.9).alias("fuzzy_same"),
        )
    )


UNIT_CASE = "CASE l_linenumber % 7 WHEN 0 THEN '{}' WHEN 1 THEN '{}' WHEN 2 THEN '{}' WHEN 3 THEN '{}' WHEN 4 THEN '{}' WHEN 5 THEN '{}' ELSE '{}' END"


@register(
    "unit_functions",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
    CASE l_linenumber % 7 WHEN 0 THEN 'mm' WHEN 1 THEN 'cm' WHEN 2 THEN 'inch' WHEN 3 THEN 'kg' WHEN 4 THEN 'lbs' WHEN 5 THEN 'mg' END AS unit,
    round(l_quantity * CASE l_linenumber % 7 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 10.0 WHEN 2 THEN 25.4 END, 6) AS in_mm,
    round(l_quantity * CASE l_linenumber % 7 WHEN 3 THEN 1.0::DOUBLE WHEN 4 THEN 0.453592 WHEN 5 THEN 0.000001 END, 6) AS in_kg
    FROM lineitem""",
)
def _(v: Views) -> DataFrame:
    written = F.concat(
        F.col("l_quantity").cast("string"), F.lit(" "),
        F.expr(UNIT_CASE.format("mm", "cm", "inch", "kg", "lbs", "mg", "furlong")),
    )
    unit = units.detect_unit(written)
    return tidy(
        v.table("lineitem").select(
            "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
            "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
            F.when(F.expr("l_linenumber % 7 < 6"), F.expr(UNIT_CASE.format("mm", "cm", "inch", "kg", "lbs", "mg", ""))).alias("unit"),
            units.convert_unit(F.col("l_quantity"), unit, F.lit("mm")).alias("in_mm"),
            units.convert_unit(F.col("l_quantity"), F.expr(UNIT_CASE.format("mm", "cm", "inch", "kg", "lbs", "mg", "furlong")), F.lit("kg")).alias("in_kg"),
        )
    )


@register(
    "bbox_functions",
    with_views(
        """SELECT t.text_id, t.w*t.h AS area, t.x+t.w/2.0::DOUBLE AS cx, t.y+t.h/2.0::DOUBLE AS cy,
        round(greatest(0, least(t.x+t.w,d.x+d.w)-greatest(t.x,d.x))*greatest(0, least(t.y+t.h,d.y+d.h)-greatest(t.y,d.y))::DOUBLE
          / (t.w*t.h+d.w*d.h-greatest(0, least(t.x+t.w,d.x+d.w)-greatest(t.x,d.x))*greatest(0, least(t.y+t.h,d.y+d.h)-greatest(t.y,d.y))), 6) AS iou,
        round(sqrt(power(greatest(0, d.x-t.x-t.w, t.x-d.x-d.w),2)+power(greatest(0, d.y-t.y-t.h, t.y-d.y-d.h),2)), 6) AS gap,
        t.x >= d.x AND t.y >= d.y AND t.x+t.w <= d.x+d.w AND t.y+t.h <= d.y+d.h AS inside,
        least(t.x+t.w,d.x+d.w) >= greatest(t.x,d.x) AND least(t.y+t.h,d.y+d.h) >= greatest(t.y,d.y) AS touching,
        least(t.x+t.w+15, 1000) - greatest(t.x-15, 0) AS expanded_width, least(t.x+t.w,1000)-least(t.x,1000) AS clipped_width,
        CAST(round_even(t.w*1.5::DOUBLE, 0) AS BIGINT) AS scaled_width,
        CAST(greatest(0, round_even(t.x+t.w/2.0::DOUBLE-round_even(t.w*1.5::DOUBLE,0)/2.0, 0)) AS BIGINT) AS scaled_x,
        round(t.w::DOUBLE/t.h, 6) AS ratio, CAST(trunc(t.x*150/72.0::DOUBLE) AS BIGINT) AS pixels,
        t.x >= 0 AND t.x+t.w <= 1000 AND t.y+t.h <= 800 AS valid_box
        FROM txt t JOIN det d ON d.detection_id = t.text_id"""
    ),
)
def _(v: Views) -> DataFrame:
    t, d = F.col("bbox"), F.col("other")
    both = v.text_blocks.join(
        v.detections.select(F.col("detection_id").alias("text_id"), F.col("bbox").alias("other")), "text_id"
    )
    return tidy(
        both.select(
            "text_id", bb.area(t).alias("area"), bb.center_x(t).alias("cx"), bb.center_y(t).alias("cy"),
            bb.iou(t, d).alias("iou"), bb.distance(t, d).alias("gap"), bb.contains(d, t).alias("inside"),
            bb.overlaps(t, d).alias("touching"), bb.expand(t, 15, PAGE_WIDTH, PAGE_HEIGHT)["width"].alias("expanded_width"),
            bb.clip(t, PAGE_WIDTH, PAGE_HEIGHT)["width"].alias("clipped_width"),
            bb.scale(t, 1.5)["width"].alias("scaled_width"), bb.scale(t, 1.5)["x"].alias("scaled_x"),
            bb.aspect_ratio(t).alias("ratio"), bb.points_to_pixels(t["x"], 150).alias("pixels"),
            bb.valid(t, PAGE_WIDTH, PAGE_HEIGHT).alias("valid_box"),
        )
    )


@register(
    "rule_predicates",
    r"""SELECT page_id, regexp_matches(url, '^https?://[^\s/$.?#].[^\s]*$') AS url_ok,
    regexp_matches(replace(url, '://', '@'), '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') AS email_like,
    regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[<>:"\\|?*]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS file_name,
    nullif(regexp_extract(url, '^(.*?)/+[^/]*$', 1), '') AS directory,
    'PAGE-'||substr(sha256(page_id||'|'||url), 1, 16) AS stable_id, page_id BETWEEN 0 AND 100 AS in_percent FROM pages""",
)
def _(v: Views) -> DataFrame:
    url = F.col("url")
    name = tx.safe_filename(url)
    return v.table("pages").select(
        "page_id",
        tx.is_url(url).alias("url_ok"),
        tx.is_email(F.replace(url, F.lit("://"), F.lit("@"))).alias("email_like"),
        F.when(name == "unnamed", F.lit("")).otherwise(name).alias("file_name"),
        F.nullif(tx.split_path(url)["directory"], F.lit("")).alias("directory"),
        tx.make_id("PAGE", F.col("page_id"), url).alias("stable_id"),
        checks.in_percent(F.col("page_id").cast("double")).alias("in_percent"),
    )


@register(
    "value_checks",
    r"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_discount * 12 BETWEEN 0 AND 1 AS unit_range, l_quantity * 3 BETWEEN 0 AND 100 AS percent,
    l_shipmode IN ('WEIGHT') OR l_returnflag = 'A' AS known, 2 AS words, l_comment_name AS extended,
    l_linenumber % 2 = 1 AS drawing_id_ok, lower(trim(l_returnflag)) = 'n' AS same_text
    FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 'sheet.PDF' ELSE 'sheet.pdf.txt.pdf' END AS l_comment_name,
          'X' AS l_shipmode FROM lineitem)""",
)
def _(v: Views) -> DataFrame:
    odd = F.col("l_linenumber") % 2 == 1
    kind = F.when(F.col("l_returnflag") == "A", F.lit("WEIGHT")).when(F.col("l_returnflag") == "N", F.lit("weight"))
    name = F.when(odd, F.lit("sheet.pdf.txt")).otherwise(F.lit("sheet.PDF"))
    ident = F.when(odd, F.lit("DWG-20240101-120000-0123abcd")).otherwise(F.lit("DWG-20240101-1200-0123abcd"))
    return tidy(
        v.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
            checks.in_unit_range(F.col("l_discount") * 12).alias("unit_range"),
            checks.in_percent(F.col("l_quantity") * 3).alias("percent"),
            checks.known_type(kind).alias("known"),
            tx.count_words(F.concat(F.lit(" two  "), F.col("l_returnflag"))).cast("bigint").alias("words"),
            tx.ensure_extension(name, "pdf").alias("extended"),
            tx.is_drawing_id(ident).alias("drawing_id_ok"),
            checks.fuzzy_match(F.concat(F.lit(" "), F.col("l_returnflag")), F.lit("N ")).alias("same_text"),
        )
    )


@register(
    "box_checks",
    with_views(
        """SELECT t.text_id,
        CASE WHEN hit THEN greatest(t.x, t.dx) ELSE 0 END AS common_x,
        CASE WHEN hit THEN least(t.x+t.w, t.dx+t.dw) - greatest(t.x, t.dx) ELSE 0 END AS common_width,
        t.x >= 0 AND t.x < 1000 AND t.y >= 0 AND t.y < 800 AS corner_on_page,
        least(t.x, t.dx) AS hull_x, greatest(t.x, t.dx) - least(t.x, t.dx) AS hull_width, t.x AS again_x, t.w AS again_width
        FROM (SELECT t.text_id, t.x, t.y, t.w, t.h, d.x AS dx, d.y AS dy, d.w AS dw, d.h AS dh,
              least(t.x+t.w,d.x+d.w) >= greatest(t.x,d.x) AND least(t.y+t.h,d.y+d.h) >= greatest(t.y,d.y) AS hit
              FROM txt t JOIN det d ON d.detection_id = t.text_id) t
        WHERE t.x >= 0 AND t.y >= 0 AND t.x + t.w <= 1000 AND t.y + t.h <= 800"""
    ),
)
def _(v: Views) -> DataFrame:
    t, d = F.col("bbox"), F.col("other")
    both = v.text_blocks.join(
        v.detections.select(F.col("detection_id").alias("text_id"), F.col("bbox").alias("other")), "text_id"
    ).where(bb.valid(t, PAGE_WIDTH, PAGE_HEIGHT))
    point = lambda b: F.struct(b["x"].cast("double").alias("x"), b["y"].cast("double").alias("y"))
    common, hull = bb.intersection(t, d), bb.points_to_bbox(F.array(point(t), point(d)))
    again = bb.denormalize(bb.normalize(t, PAGE_WIDTH, PAGE_HEIGHT), PAGE_WIDTH, PAGE_HEIGHT)
    return tidy(
        both.select(
            "text_id", common["x"].alias("common_x"), common["width"].alias("common_width"),
            bb.in_bounds(t["x"], t["y"], PAGE_WIDTH, PAGE_HEIGHT).alias("corner_on_page"),
            hull["x"].alias("hull_x"), hull["width"].alias("hull_width"),
            again["x"].cast("bigint").alias("again_x"), again["width"].cast("bigint").alias("again_width"),
        )
    )


@register(
    "entity_layers_union",
    with_views(
        """SELECT extraction_method, entity_type, count(*) AS n FROM (
        SELECT method AS extraction_method, entity_type FROM ent
        UNION ALL SELECT 'llm', 'PART_NUMBER' FROM events WHERE event_type = 'view' UNION ALL SELECT 'llm', 'OEM' FROM events WHERE event_type = 'view'
        UNION ALL SELECT 'llm', 'MATERIAL' FROM events WHERE event_type = 'click') GROUP BY ALL"""
    ),
)
def _(v: Views) -> DataFrame:
    regex = extract.regex_entities(v.text_blocks)
    words = extract.dedup_entities(extract.dictionary_entities(v.text_blocks), regex)
    replies = v.table("events").select(
        F.col("user_id").alias("drawing_id"), F.col("event_id").alias("reply_id"), F.expr(REPLY).alias("reply")
    )
    layers = regex.unionByName(words).unionByName(extract.reply_entities(replies))
    return layers.groupBy("extraction_method", "entity_type").agg(F.count("*").alias("n"))
