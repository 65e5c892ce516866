"""Document tables derived from the given star-schema tables, and the same in SQL.

The given tables hold no drawings. Each order becomes a drawing, each (order, line) a text block
and a shape, each event a usage row and an audit row. Only integer arithmetic is used, so that
every engine derives the same rows. All of a table is used, whatever its size.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from planmark.functions import bbox as bb
from planmark.operators import extract
from planmark.session import cut_lineage

PAGE_WIDTH, PAGE_HEIGHT = 1000, 800
LINES_PER_BUCKET = 200_000


class Views:
    """The derived tables for one folder of parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        return self.grouped(self.table("lineitem"))

    def grouped(self, lineitem: DataFrame) -> DataFrame:
        return (
            lineitem.groupBy(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").cast("bigint").alias("ln"))
            .agg(
                F.min("l_partkey").alias("pk"),
                F.min("l_suppkey").alias("sk"),
                F.min("l_quantity").cast("bigint").alias("q"),
            )
        )

    @cached_property
    def text_blocks(self) -> DataFrame:
        cast = lambda column: F.col(column).cast("string")
        content = F.expr(
            """CASE ln
            WHEN 1 THEN concat('PART NO: ABC-', 10000 + pk)
            WHEN 2 THEN concat('Ø', q, '.5 ± 0.1 mm')
            WHEN 3 THEN concat('MATERIAL: Steel ', 300 + pk % 30)
            WHEN 4 THEN concat('WEIGHT: ', q, '.25 kg')
            WHEN 5 THEN concat('M', 4 + 2 * (q % 8), 'x1.25')
            WHEN 6 THEN CASE q % 5
                WHEN 0 THEN 'BOLT'
                WHEN 1 THEN concat('SCALE 1:', 2 + pk % 5)
                WHEN 2 THEN concat('REV ', chr(65 + pk % 26))
                WHEN 3 THEN concat(1 + pk % 28, '/03/2024')
                ELSE 'SCALE:' END
            WHEN 7 THEN CASE WHEN q % 4 = 0 THEN concat('1:', 2 + pk % 9) ELSE 'SKF Ra 1.6' END
            END"""
        )
        return self.lines.select(
            (F.col("ok") * 10 + F.col("ln")).alias("text_id"),
            F.col("ok").alias("drawing_id"),
            F.col("ln").alias("block_no"),
            content.alias("content"),
            bb.box(
                (F.col("pk") * 41 + F.col("sk") * 7) % 1000,
                (F.col("pk") * 59 + F.col("ln") * 89) % 800,
                60 + F.col("q"),
                F.lit(20),
            ).alias("bbox"),
            ((60 + F.col("sk") % 40) / 100).alias("confidence"),
            F.when(F.col("pk") % 2 == 0, "paddleocr").otherwise("easyocr").alias("ocr_engine"),
            F.lit("text").alias("region_type"),
        )

    @cached_property
    def shaped_lines(self) -> DataFrame:
        part = self.table("part").select(
            F.col("p_partkey").alias("pk"), F.split("p_name", " ")[1].alias("class_name")
        )
        return self.lines.join(part, "pk")

    @cached_property
    def detections(self) -> DataFrame:
        box = bb.box(
            (F.col("pk") * 37 + F.col("sk") * 11) % 1000,
            (F.col("pk") * 53 + F.col("ln") * 97) % 800,
            40 + (F.col("q") * 7) % 200,
            40 + (F.col("sk") * 13) % 200,
        )
        return self.shaped_lines.select(
            (F.col("ok") * 10 + F.col("ln")).alias("detection_id"),
            F.col("ok").alias("drawing_id"),
            "class_name",
            ((50 + F.col("pk") % 50) / 100).alias("confidence"),
            box.alias("bbox"),
            bb.normalize(box, PAGE_WIDTH, PAGE_HEIGHT).alias("bbox_normalized"),
            F.lit("v1").alias("model_version"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        return self.table("orders")

    @cached_property
    def drawings(self) -> DataFrame:
        score = ((F.col("o_orderkey") * 7919) % 1001) / F.lit(1000.0)
        return self.orders.select(
            F.col("o_orderkey").alias("drawing_id"),
            F.concat(F.lit("order_"), F.col("o_orderkey"), F.lit(".pdf")).alias("source_file"),
            F.col("o_orderdate").cast("timestamp").alias("processing_timestamp"),
            F.lit("1.0").alias("pipeline_version"),
            score.alias("overall_confidence"),
            F.expr(
                "CASE o_orderpriority WHEN '1-URGENT' THEN 'LLM_ENHANCED' WHEN '2-HIGH' THEN 'HYBRID' "
                "ELSE 'BASELINE' END"
            ).alias("pipeline_used"),
            (score < 0.75).alias("needs_review"),
            F.expr(
                "CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'failed' "
                "WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'O' THEN 'processing' "
                "ELSE 'review' END"
            ).alias("status"),
            F.expr("CASE WHEN o_orderpriority = '5-LOW' THEN 'LOW' ELSE 'NORMAL' END").alias("priority"),
        )

    @cached_property
    def entities(self) -> DataFrame:
        return extract.extract_entities(self.text_blocks)

    @cached_property
    def usage(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.table("events").withColumn("k", k).select(
            F.col("event_id").alias("usage_id"),
            F.col("user_id").alias("drawing_id"),
            F.expr(
                "CASE event_type WHEN 'view' THEN 'drawing_assessment' "
                "WHEN 'click' THEN 'ocr_verification' WHEN 'signup' THEN 'entity_extraction' "
                "WHEN 'error' THEN 'shape_validation' ELSE 'complex_reasoning' END"
            ).alias("use_case"),
            F.expr("CASE k % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'google' END").alias("provider"),
            F.expr(
                "CASE k % 5 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4-turbo' WHEN 2 THEN 'gpt-4o-mini' "
                "WHEN 3 THEN 'gemini-1.5-pro' ELSE 'local-model' END"
            ).alias("model"),
            (F.col("k") % 3).cast("int").alias("model_tier"),
            (100 + F.col("k") * 10).alias("tokens_input"),
            (50 + F.col("k") * 3).alias("tokens_output"),
            (F.col("k") % 2).alias("image_count"),
            (F.col("value") / 1000).alias("cost_usd"),
            F.col("ts").cast("timestamp").alias("timestamp"),
            (F.col("k") % 7 == 0).alias("tier_stepped_down"),
        )

    @cached_property
    def audit(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.table("events").withColumn("k", k).select(
            F.col("event_id").alias("audit_id"),
            F.col("user_id").alias("drawing_id"),
            F.expr(
                "CASE k % 9 WHEN 0 THEN 'pdf_processing' WHEN 1 THEN 'image_preprocessing' "
                "WHEN 2 THEN 'ocr_extraction' WHEN 3 THEN 'shape_detection' WHEN 4 THEN 'entity_extraction' "
                "WHEN 5 THEN 'data_association' WHEN 6 THEN 'llm_enhancement' WHEN 7 THEN 'validation' "
                "ELSE 'complete' END"
            ).alias("stage"),
            F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
            F.col("value").alias("duration_seconds"),
            F.expr(
                "CASE WHEN event_type <> 'error' THEN NULL ELSE CASE k % 6 WHEN 0 THEN 'database is locked' "
                "WHEN 1 THEN 'UNIQUE constraint failed' WHEN 2 THEN 'Rate limit reached' "
                "WHEN 3 THEN 'Invalid API key' WHEN 4 THEN 'Connection reset' ELSE 'bad page tree' END END"
            ).alias("error_message"),
            F.col("ts").cast("timestamp").alias("timestamp"),
        )

    @cached_property
    def kept(self) -> Views:
        """The same views for queries that read blocks, shapes or entities many times: lines
        are aggregated and joined once, entities extracted once, and written."""
        return Kept(self.spark, self.folder)


class Kept(Views):
    """All tables are dealt by drawing into as many buckets, so what joins or groups them by drawing shuffles nothing."""

    @cached_property
    def buckets(self) -> int:
        rows = self.table("lineitem").count()
        return max(self.spark.sparkContext.defaultParallelism, rows // LINES_PER_BUCKET + 1)

    def keep(self, df: DataFrame, key: str = "drawing_id") -> DataFrame:
        return cut_lineage(df, [key], self.buckets)

    @cached_property
    def lines(self) -> DataFrame:
        return self.keep(self.grouped(self.table("lineitem").repartition(self.buckets, "l_orderkey")), "ok")

    @cached_property
    def shaped_lines(self) -> DataFrame:
        return self.keep(super().shaped_lines, "ok")

    @cached_property
    def orders(self) -> DataFrame:
        return self.keep(super().orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"), "o_orderkey")

    @cached_property
    def entities(self) -> DataFrame:
        # the dictionary layer reads its blocks three times, and few blocks name anybody
        words = extract.dictionary_entities(self.keep(extract.naming_blocks(self.text_blocks)))
        # the few are dealt like the many, else the union would be dealt anew
        rows = extract.regex_entities(self.text_blocks).unionByName(words.repartition(self.buckets, "drawing_id"))
        kept = self.keep(rows.drop("entity_id"))  # a digest of other columns, more than half of a row on disk
        return kept.withColumn("entity_id", extract.entity_id()).select(rows.columns)


# The same tables for the oracle. Written on their own, from the formulas, not from the code above.
SQL = {
    "g": """SELECT l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln, min(l_partkey) AS pk,
        min(l_suppkey) AS sk, CAST(min(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2""",
    "txt": """SELECT ok*10+ln AS text_id, ok AS drawing_id, ln AS block_no, ok, ln, pk, sk, q,
        CASE ln WHEN 1 THEN 'PART NO: ABC-'||(10000+pk) WHEN 2 THEN 'Ø'||q||'.5 ± 0.1 mm'
          WHEN 3 THEN 'MATERIAL: Steel '||(300+pk%30) WHEN 4 THEN 'WEIGHT: '||q||'.25 kg'
          WHEN 5 THEN 'M'||(4+2*(q%8))||'x1.25'
          WHEN 6 THEN CASE q%5 WHEN 0 THEN 'BOLT' WHEN 1 THEN 'SCALE 1:'||(2+pk%5)
            WHEN 2 THEN 'REV '||chr(CAST(65+pk%26 AS INTEGER)) WHEN 3 THEN (1+pk%28)||'/03/2024' ELSE 'SCALE:' END
          WHEN 7 THEN CASE WHEN q%4=0 THEN '1:'||(2+pk%9) ELSE 'SKF Ra 1.6' END END AS content,
        (pk*41+sk*7)%1000 AS x, (pk*59+ln*89)%800 AS y, 60+q AS w, 20::BIGINT AS h,
        (60+sk%40)/100.0::DOUBLE AS confidence,
        CASE WHEN pk%2=0 THEN 'paddleocr' ELSE 'easyocr' END AS ocr_engine FROM g""",
    "det": """SELECT ok*10+ln AS detection_id, ok AS drawing_id, split_part(p_name,' ',2) AS class_name,
        (50+pk%50)/100.0::DOUBLE AS confidence, (pk*37+sk*11)%1000 AS x, (pk*53+ln*97)%800 AS y,
        40+(q*7)%200 AS w, 40+(sk*13)%200 AS h FROM g JOIN part ON p_partkey=pk""",
    "drw": """SELECT o_orderkey AS drawing_id, 'order_'||o_orderkey||'.pdf' AS source_file,
        o_orderdate AS processing_timestamp, ((o_orderkey*7919)%1001)/1000.0::DOUBLE AS overall_confidence,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'LLM_ENHANCED' WHEN '2-HIGH' THEN 'HYBRID' ELSE 'BASELINE' END AS pipeline_used,
        ((o_orderkey*7919)%1001)/1000.0::DOUBLE < 0.75 AS needs_review,
        CASE WHEN o_orderpriority='5-LOW' AND o_orderstatus='P' THEN 'failed' WHEN o_orderstatus='F' THEN 'complete'
          WHEN o_orderstatus='O' THEN 'processing' ELSE 'review' END AS status,
        CASE WHEN o_orderpriority='5-LOW' THEN 'LOW' ELSE 'NORMAL' END AS priority FROM orders""",
    "ev": "SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events",
    "usg": """SELECT event_id AS usage_id, user_id AS drawing_id,
        CASE event_type WHEN 'view' THEN 'drawing_assessment' WHEN 'click' THEN 'ocr_verification'
          WHEN 'signup' THEN 'entity_extraction' WHEN 'error' THEN 'shape_validation' ELSE 'complex_reasoning' END AS use_case,
        CASE k%3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'google' END AS provider,
        CASE k%5 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4-turbo' WHEN 2 THEN 'gpt-4o-mini' WHEN 3 THEN 'gemini-1.5-pro' ELSE 'local-model' END AS model,
        100+k*10 AS tokens_input, 50+k*3 AS tokens_output, k%2 AS image_count, value/1000 AS cost_usd,
        ts AS "timestamp", k%7=0 AS tier_stepped_down FROM ev""",
    "aud": """SELECT event_id AS audit_id, user_id AS drawing_id,
        CASE k%9 WHEN 0 THEN 'pdf_processing' WHEN 1 THEN 'image_preprocessing' WHEN 2 THEN 'ocr_extraction'
          WHEN 3 THEN 'shape_detection' WHEN 4 THEN 'entity_extraction' WHEN 5 THEN 'data_association'
          WHEN 6 THEN 'llm_enhancement' WHEN 7 THEN 'validation' ELSE 'complete' END AS stage,
        CASE WHEN event_type='error' THEN 'failed' ELSE 'completed' END AS status, value AS duration_seconds,
        CASE WHEN event_type<>'error' THEN NULL ELSE CASE k%6 WHEN 0 THEN 'database is locked'
          WHEN 1 THEN 'UNIQUE constraint failed' WHEN 2 THEN 'Rate limit reached' WHEN 3 THEN 'Invalid API key'
          WHEN 4 THEN 'Connection reset' ELSE 'bad page tree' END END AS error_message, ts AS "timestamp" FROM ev""",
    # entities: RE2 has an ASCII word boundary, so the left edge is a guarded group
    "ent_raw": r"""
        SELECT *, 'PART_NUMBER' AS entity_type, 0.90 AS conf, regexp_extract_all(content, '(?:^|[^\p{L}\p{N}_])([A-Z]{2,10}[-_]?[A-Z0-9]{4,20}(?:[-_][A-Z0-9]+)?)\b', 1) AS vals FROM txt
        UNION ALL SELECT *, 'DIMENSION', 0.85, regexp_extract_all(content, '(?:^|[^\p{L}\p{N}_])([Øø⌀]?\s*\d+\.?\d*\s*(?:±?\s*\d*\.?\d*)?\s*(?:mm|cm|m|in|inch|"))\b', 1) FROM txt
        UNION ALL SELECT *, 'WEIGHT', 0.85, regexp_extract_all(content, '(?i)\b(\d+\.?\d*\s*(?:kg|g|lbs|oz))\b', 1) FROM txt
        UNION ALL SELECT *, 'THREAD_SPEC', 0.90, regexp_extract_all(content, '(?:^|[^\p{L}\p{N}_])(M\d+[xX]?\d*\.?\d*|#?\d+[-/]\d+\s*(?:UNC|UNF))\b', 1) FROM txt
        UNION ALL SELECT *, 'MATERIAL', 0.75, regexp_extract_all(content, '(?i)(?:^|[^\p{L}\p{N}_])((?:steel|aluminum|brass|stainless|titanium|plastic)\s+[A-Z0-9\-]+)\b', 1) FROM txt
        UNION ALL SELECT *, 'SURFACE_FINISH', 0.80, regexp_extract_all(content, '(?:^|[^\p{L}\p{N}_])(Ra\s*\d+\.?\d*|N\d+)\b', 1) FROM txt
        UNION ALL SELECT *, 'TOLERANCE', 0.85, regexp_extract_all(content, '(±\s*\d+\.?\d*\s*(?:mm|cm|m|in)?)\b', 1) FROM txt""",
    "ent_rx": """SELECT text_id, drawing_id, entity_type, conf::DOUBLE AS confidence, 'regex' AS method, x, y, w, h,
        unnest(vals) AS original_text, unnest(range(1, len(vals)+1)) AS occurrence FROM ent_raw""",
    "oem": """SELECT unnest(['SKF','Timken','NSK','NTN','FAG','INA','Schaeffler','KOYO','NACHI','THK','IKO']) AS name""",
    "ent_tok": """SELECT * FROM (SELECT text_id, drawing_id, block_no, unnest(toks) AS tok, unnest(range(len(toks))) AS pos
        FROM (SELECT *, string_split_regex(content, '[^A-Za-z0-9]+') AS toks FROM txt)) JOIN oem ON lower(tok)=lower(name)""",
    "ent_at": """SELECT drawing_id, tok, arg_min(text_id, (block_no, text_id)) AS at_text FROM (SELECT DISTINCT drawing_id, tok FROM ent_tok)
        JOIN txt USING (drawing_id) WHERE contains(content, tok) GROUP BY 1, 2""",
    "ent_oem": """SELECT b.text_id, b.drawing_id, 'OEM' AS entity_type, 0.85::DOUBLE AS confidence, 'spacy' AS method, b.x, b.y, b.w, b.h,
        m.tok AS original_text, row_number() OVER (PARTITION BY b.text_id ORDER BY m.block_no, m.text_id, m.pos) AS occurrence
        FROM ent_tok m JOIN ent_at a ON a.drawing_id = m.drawing_id AND a.tok = m.tok JOIN txt b ON b.text_id = a.at_text""",
    "ent": """SELECT *, trim(original_text) AS value,
        text_id||'|'||entity_type||'|'||occurrence||'|'||method AS entity_key FROM
        (SELECT * FROM ent_rx UNION ALL SELECT text_id, drawing_id, entity_type, confidence, method, x, y, w, h, original_text, occurrence FROM ent_oem)""",
}


def with_views(body: str, **extra: str) -> str:
    """Oracle text: the derived tables as leading CTEs, then further CTEs, then the body."""
    ctes = {**SQL, **extra}
    listed = ",\n".join(f"{name} AS ({text})" for name, text in ctes.items())
    return f"WITH RECURSIVE {listed}\n{body}"


# Associations in SQL, shared by many oracles. ``cnd`` has no obstacle test and no confidence cut.
SQL |= {
    "tk": r"""SELECT *, x+w/2.0::DOUBLE AS px, y+h/2.0::DOUBLE AS py, CASE WHEN kind = 'dimension' THEN 500 ELSE 200 END AS lim FROM (
        SELECT *, CASE WHEN regexp_matches(content, '\d+\.?\d*\s*(mm|cm|in|inch|")') THEN 'dimension'
          WHEN length(content) <= 10 AND regexp_full_match(replace(content,' ',''), '\p{L}+') THEN 'label' ELSE 'note' END AS kind FROM txt)""",
    "prs": """SELECT t.text_id, t.drawing_id, t.kind, t.lim, t.px, t.py, t.w AS tw, t.h AS th, d.detection_id, d.class_name, d.x, d.y, d.w, d.h,
        sqrt(power(d.x+d.w/2.0::DOUBLE-px,2)+power(d.y+d.h/2.0::DOUBLE-py,2)) AS center,
        CASE WHEN px BETWEEN d.x AND d.x+d.w AND py BETWEEN d.y AND d.y+d.h THEN least(px-d.x, d.x+d.w-px, py-d.y, d.y+d.h-py)
          ELSE sqrt(power(greatest(d.x-px,0,px-d.x-d.w),2)+power(greatest(d.y-py,0,py-d.y-d.h),2)) END AS edge
        FROM tk t JOIN det d USING (drawing_id)""",
    "cnd": """SELECT *, greatest(0, least(1, (0.5*exp(-3*least(edge/lim,1)) + 0.2*least(1, least(tw*th,w*h)/greatest(tw*th,w*h)::DOUBLE+0.5)
          + 0.15*CASE WHEN abs(py-y)<20 OR abs(py-y-h)<20 OR abs(px-x)<20 OR abs(px-x-w)<20 THEN 1 ELSE 0.5 END
          + 0.15*CASE kind WHEN 'dimension' THEN 1 WHEN 'label' THEN CASE WHEN class_name IN ('bolt','nut','screw','gear','bearing') THEN 1 ELSE 0.7 END ELSE 0.6 END)
          * CASE kind WHEN 'dimension' THEN 0.9 WHEN 'label' THEN 1.0 ELSE 0.8 END))::DOUBLE AS confidence
        FROM (SELECT * FROM (SELECT * FROM prs QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY center, detection_id) <= 5)
          QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY edge, center, detection_id) = 1) WHERE edge <= lim""",
    "clear": """SELECT * FROM cnd c WHERE NOT EXISTS (SELECT 1 FROM det o WHERE o.drawing_id = c.drawing_id AND o.detection_id <> c.detection_id
        AND floor((c.px + c.x + c.w/2.0::DOUBLE)/2) BETWEEN o.x AND o.x+o.w AND floor((c.py + c.y + c.h/2.0::DOUBLE)/2) BETWEEN o.y AND o.y+o.h)""",
    "asc_": """SELECT text_id, drawing_id, detection_id, kind AS relationship_type, confidence, edge AS distance_pixels FROM clear WHERE confidence >= 0.6""",
}
