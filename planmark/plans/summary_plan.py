"""Registered queries: summaries, costs, budgets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from planmark import reference as ref
from planmark.operators import aggregate, cost, validate
from planmark.operators.associate import associate_text_shapes
from planmark.plans.helpers import tidy
from planmark.plans.registry import registry
from planmark.plans.views import Views, with_views

Q, SQL, register = registry()

START, END = datetime(2024, 1, 5), datetime(2024, 1, 25)
RANGE = """"timestamp" >= TIMESTAMP '2024-01-05' AND "timestamp" < TIMESTAMP '2024-01-25'"""


def _associations(v: Views) -> DataFrame:
    return associate_text_shapes(v.text_blocks, v.detections)


@register(
    "llm_daily_costs",
    with_views(
        """SELECT strftime("timestamp", '%Y-%m-%d') AS date, use_case, model, count(*) AS call_count,
        CAST(sum(tokens_input) AS BIGINT) AS total_input_tokens, CAST(sum(tokens_output) AS BIGINT) AS total_output_tokens,
        CAST(sum(image_count) AS BIGINT) AS total_images, round(sum(cost_usd), 6) AS total_cost, round(avg(cost_usd), 12) AS avg_cost_per_call,
        count(*) FILTER (tier_stepped_down) AS stepped_down_count FROM usg GROUP BY 1, 2, 3"""
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(cost.llm_daily_costs(v.usage), avg_cost_per_call=12)


@register(
    "processing_statistics",
    with_views(
        """SELECT strftime(processing_timestamp, '%Y-%m-%d') AS date, count(*) AS total_drawings, count(*) FILTER (status='complete') AS completed,
        count(*) FILTER (status='failed') AS failed, count(*) FILTER (needs_review) AS needing_review, round(avg(overall_confidence), 12) AS avg_confidence,
        count(*) FILTER (pipeline_used='LLM_ENHANCED') AS llm_enhanced_count FROM drw GROUP BY 1"""
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(aggregate.processing_statistics(v.drawings), avg_confidence=12)


ISSUES_SQL = """SELECT drawing_id, 'CRITICAL' AS severity, 4 AS rank FROM drw WHERE drawing_id NOT IN (SELECT drawing_id FROM ent WHERE entity_type='PART_NUMBER')
    UNION ALL SELECT drawing_id, 'LOW', 1 FROM drw WHERE drawing_id NOT IN (SELECT drawing_id FROM ent WHERE entity_type='OEM')"""
REVIEW_SQL = """SELECT d.drawing_id, source_file, overall_confidence, pipeline_used, coalesce(n, 0) AS issue_count,
    CASE coalesce(r, 0) WHEN 4 THEN 'CRITICAL' WHEN 1 THEN 'LOW' END AS highest_severity, coalesce(r, 0) AS severity_rank, processing_timestamp
    FROM drw d LEFT JOIN (SELECT drawing_id, count(*) AS n, max(rank) AS r FROM iss GROUP BY 1) i USING (drawing_id) WHERE needs_review"""


def _review(v: Views) -> DataFrame:
    return aggregate.drawings_needing_review(v.drawings, validate.critical_field_issues(v.drawings, v.entities))


@register(
    "drawings_needing_review",
    with_views(
        "SELECT drawing_id, source_file, overall_confidence, pipeline_used, issue_count, highest_severity, severity_rank FROM rev",
        iss=ISSUES_SQL, rev=REVIEW_SQL,
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(aggregate.most_severe_first(_review(v)).drop("processing_timestamp"))


@register(
    "review_top_issues",
    with_views(
        """SELECT drawing_id, highest_severity, issue_count FROM rev WHERE severity_rank >= 3
        ORDER BY severity_rank DESC, processing_timestamp DESC, drawing_id LIMIT 10""",
        iss=ISSUES_SQL, rev=REVIEW_SQL,
    ),
)
def _(v: Views) -> DataFrame:
    return aggregate.review_top_issues(_review(v)).select("drawing_id", "highest_severity", "issue_count")


@register(
    "database_stats",
    with_views(
        """SELECT 'total_drawings' AS name, count(*)::VARCHAR AS value FROM drw UNION ALL SELECT 'oldest_drawing', strftime(min(processing_timestamp), '%Y-%m-%d %H:%M:%S') FROM drw
        UNION ALL SELECT 'newest_drawing', strftime(max(processing_timestamp), '%Y-%m-%d %H:%M:%S') FROM drw UNION ALL SELECT 'total_text_blocks', count(*)::VARCHAR FROM txt
        UNION ALL SELECT 'total_entities', count(*)::VARCHAR FROM ent UNION ALL SELECT 'total_detections', count(*)::VARCHAR FROM det
        UNION ALL SELECT 'total_associations', count(*)::VARCHAR FROM asc_ UNION ALL SELECT 'total_llm_cost', printf('%.4f', sum(cost_usd)) FROM usg"""
    ),
)
def _(v: Views) -> DataFrame:
    return aggregate.database_stats(v.drawings, v.text_blocks, v.entities, v.detections, _associations(v), v.usage)


@register(
    "daily_cost",
    """SELECT round(coalesce(sum(value/1000), 0), 6) AS cost_usd FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'""",
)
def _(v: Views) -> DataFrame:
    return tidy(cost.daily_cost(v.usage, datetime(2024, 1, 10)))


def _by(field: str):
    @register(
        f"cost_by_{field}",
        with_views(f"SELECT {field}, round(sum(cost_usd), 6) AS cost_usd FROM usg WHERE {RANGE} GROUP BY 1"),
    )
    def run(v: Views) -> DataFrame:
        return tidy(cost.cost_by(cost.within(v.usage, START, END), field))


for _field in ("use_case", "provider", "model"):
    _by(_field)


@register(
    "cost_by_drawing",
    with_views("SELECT drawing_id, round(sum(cost_usd), 6) AS cost_usd FROM usg GROUP BY 1"),
)
def _(v: Views) -> DataFrame:
    return tidy(cost.cost_by_drawing(v.usage))


@register(
    "top_drawings_by_cost",
    with_views("SELECT drawing_id, round(sum(cost_usd), 6) AS cost_usd FROM usg GROUP BY 1 ORDER BY sum(cost_usd) DESC, 1 LIMIT 10"),
)
def _(v: Views) -> DataFrame:
    return tidy(cost.top_drawings_by_cost(v.usage))


@register(
    "cost_report",
    with_views(
        f"""SELECT section, name, round(value, 6) AS value FROM (
        SELECT 'use_case' AS section, use_case AS name, sum(cost_usd) AS value FROM u GROUP BY 2
        UNION ALL SELECT 'provider', provider, sum(cost_usd) FROM u GROUP BY 2 UNION ALL SELECT 'model', model, sum(cost_usd) FROM u GROUP BY 2
        UNION ALL SELECT 'day_cost', strftime("timestamp", '%Y-%m-%d'), sum(cost_usd) FROM u GROUP BY 2
        UNION ALL SELECT 'day_calls', strftime("timestamp", '%Y-%m-%d'), count(*) FROM u GROUP BY 2
        UNION ALL SELECT 'total', 'cost', sum(cost_usd) FROM u UNION ALL SELECT 'total', 'calls', count(*) FROM u
        UNION ALL SELECT 'tokens', 'input', sum(tokens_input) FROM u UNION ALL SELECT 'tokens', 'output', sum(tokens_output) FROM u
        UNION ALL SELECT 'tokens', 'images', sum(image_count) FROM u UNION ALL SELECT 'tokens', 'mean_input', avg(tokens_input) FROM u
        UNION ALL SELECT 'tokens', 'mean_output', avg(tokens_output) FROM u
        UNION ALL SELECT 'total', 'mean_per_drawing', sum(cost_usd)/count(DISTINCT drawing_id) FROM u
        UNION ALL (SELECT 'top_drawing', drawing_id::VARCHAR, sum(cost_usd) FROM u GROUP BY drawing_id ORDER BY 3 DESC, drawing_id LIMIT 10))""",
        u=f"SELECT * FROM usg WHERE {RANGE}",
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(cost.cost_report(v.usage, START, END))


@register(
    "cost_cube",
    with_views(
        """SELECT use_case, provider, model, day, CAST(grouping(use_case, provider, model, day) AS BIGINT) AS level, count(*) AS calls, round(sum(cost_usd), 6) AS cost_usd
        FROM (SELECT *, strftime("timestamp", '%Y-%m-%d') AS day FROM usg) GROUP BY CUBE (use_case, provider, model, day)"""
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(cost.cost_cube(v.usage))


@register(
    "price_calls",
    with_views(
        """SELECT usage_id, round(coalesce(tokens_input/1e6*CASE model WHEN 'gpt-4o' THEN 2.5 WHEN 'gpt-4-turbo' THEN 10 WHEN 'gpt-4o-mini' THEN 0.15 WHEN 'gemini-1.5-pro' THEN 1.25 END
        + tokens_output/1e6*CASE model WHEN 'gpt-4o' THEN 10 WHEN 'gpt-4-turbo' THEN 30 WHEN 'gpt-4o-mini' THEN 0.6 WHEN 'gemini-1.5-pro' THEN 5 END, 0), 9) AS estimated_cost FROM usg"""
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(cost.price_calls(v.usage).select("usage_id", "estimated_cost"), 9)


@register(
    "budget_summary",
    with_views(
        """SELECT strftime("timestamp", '%Y-%m-%d') AS date, round(sum(cost_usd), 6) AS daily_spend, round(20 - sum(cost_usd), 6) AS remaining_budget,
        round(sum(cost_usd)/20*100, 6) AS budget_used_pct, sum(cost_usd) >= 16 AS alert_triggered FROM usg GROUP BY 1"""
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(cost.budget_summary(v.usage, daily_budget=20.0))


@register(
    "running_spend",
    with_views(
        """SELECT usage_id, round(sum(cost_usd) OVER (PARTITION BY CAST("timestamp" AS DATE) ORDER BY "timestamp", usage_id ROWS UNBOUNDED PRECEDING), 6) AS day_spend,
        round(sum(cost_usd) OVER (PARTITION BY drawing_id ORDER BY "timestamp", usage_id ROWS UNBOUNDED PRECEDING), 6) AS drawing_spend FROM usg"""
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(cost.running_spend(v.usage).select("usage_id", "day_spend", "drawing_spend"))


PLAN_PRICES = {
    "claude-3-haiku": (0.25, 1.25), "claude-3-sonnet": (3.0, 15.0),
    "claude-3.5-sonnet": (3.0, 15.0), "claude-3-opus": (15.0, 75.0),
}


def _plan_prices_sql() -> str:
    """Model and prices of each use case by tier, cheap first, as a table."""
    table = {**ref.MODEL_PRICES, **PLAN_PRICES}
    rows = []
    for name, models in ref.USE_CASE_MODELS.items():
        cells = [f"'{name}'"]
        for model in reversed(models):
            price_in, price_out = table.get(model, (0.0, 0.0))
            cells += [f"'{model}'", f"{float(price_in)}::DOUBLE", f"{float(price_out)}::DOUBLE"]
        rows.append(f"({', '.join(cells)})")
    names = ", ".join(f"m{t}, i{t}, o{t}" for t in (0, 1, 2))
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(use_case, {names})"


def _by_tier(tier: str, what: str) -> str:
    return f"CASE {tier} WHEN 0 THEN c.{what}0 WHEN 1 THEN c.{what}1 ELSE c.{what}2 END"


# one call of each day in every step; the day's spend, tier and drawing totals travel in the row
PLAN_SQL = with_views(
    """SELECT strftime(day, '%Y-%m-%d') AS day, usage_id, drawing_id, allowed, reason, tier, model,
    round(estimated_cost, 9) AS estimated_cost, round(spend_before, 9) AS spend_before FROM run WHERE n > 0""",
    prices=_plan_prices_sql(),
    calls="SELECT CAST(\"timestamp\" AS DATE) AS day, usage_id, drawing_id, m0, m1, m2, "
    + ", ".join(f"tokens_input/1e6*i{t} + tokens_output/1e6*o{t} AS c{t}" for t in (0, 1, 2))
    + ", row_number() OVER (PARTITION BY CAST(\"timestamp\" AS DATE) ORDER BY \"timestamp\", usage_id) AS n"
    " FROM usg JOIN prices USING (use_case)",
    run=f"""SELECT day, 0::BIGINT AS n, NULL::BIGINT AS usage_id, NULL::BIGINT AS drawing_id, false AS allowed, '' AS reason,
    2::BIGINT AS tier, NULL::VARCHAR AS model, 0::DOUBLE AS estimated_cost, 0::DOUBLE AS spend_before, 0::DOUBLE AS spend,
    MAP([-1::BIGINT], [0::DOUBLE]) AS drawings FROM calls GROUP BY day
    UNION ALL
    SELECT day, n, usage_id, drawing_id, NOT over_drawing AND NOT over_day,
    CASE WHEN over_drawing THEN 'DRAWING_LIMIT' WHEN over_day THEN 'DAILY_BUDGET' WHEN now = 0 THEN 'TIER_0' WHEN now = 1 THEN 'TIER_1' ELSE 'PREFERRED' END,
    now, CASE WHEN NOT over_drawing AND NOT over_day THEN model END, cost, spend,
    CASE WHEN NOT over_drawing AND NOT over_day THEN spend + cost ELSE spend END,
    CASE WHEN NOT over_drawing AND NOT over_day THEN map_concat(drawings, MAP([drawing_id], [already + cost])) ELSE drawings END
    FROM (SELECT *, NOT over_drawing AND spend + cost > 1.0 AS over_day FROM (
      SELECT c.*, r.spend, r.drawings, q.already, q.over_drawing, q.now, {_by_tier("q.now", "c")} AS cost, {_by_tier("q.now", "m")} AS model
      FROM run r JOIN calls c ON c.day = r.day AND c.n = r.n + 1,
      LATERAL (SELECT already, over_drawing, CASE WHEN NOT over_drawing AND r.spend >= 0.8::DOUBLE AND r.tier > 0 THEN r.tier - 1 ELSE r.tier END AS now
        FROM (SELECT already, already + {_by_tier("r.tier", "c")} > 0.05::DOUBLE AS over_drawing
          FROM (SELECT coalesce(r.drawings[c.drawing_id], 0) AS already))) q))""",
)


@register("budget_plan", PLAN_SQL)
def _(v: Views) -> DataFrame:
    calls = cost.planned_calls(v.usage, PLAN_PRICES)
    return tidy(cost.budget_plan(calls, daily_budget=1.0, per_drawing=0.05), 9)


@register(
    "extraction_statistics",
    with_views(
        """SELECT d.drawing_id, count(e.entity_key) AS total_entities, round(coalesce(avg(confidence), 0), 12) AS average_confidence,
        count(*) FILTER (entity_type='PART_NUMBER') AS n_part_number, count(*) FILTER (entity_type='OEM') AS n_oem, count(*) FILTER (entity_type='MATERIAL') AS n_material,
        count(*) FILTER (entity_type='DIMENSION') AS n_dimension, count(*) FILTER (entity_type='WEIGHT') AS n_weight, count(*) FILTER (entity_type='THREAD_SPEC') AS n_thread_spec,
        count(*) FILTER (entity_type='TOLERANCE') AS n_tolerance, count(*) FILTER (entity_type='SURFACE_FINISH') AS n_surface_finish,
        count(*) FILTER (method='regex') AS n_regex, count(*) FILTER (method='spacy') AS n_spacy, 0::BIGINT AS n_llm
        FROM drw d LEFT JOIN ent e USING (drawing_id) GROUP BY 1"""
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(aggregate.extraction_statistics(v.drawings, v.entities), average_confidence=12)


@register(
    "detection_summary",
    with_views(
        """SELECT drawing_id, count(*) AS total_detections, round(avg(confidence), 9) AS average_confidence, round(avg((confidence>=0.7)::INT), 9) AS high,
        round(avg((confidence>=0.5 AND confidence<0.7)::INT), 9) AS medium, round(avg((confidence<0.5)::INT), 9) AS low FROM det GROUP BY 1"""
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(aggregate.detection_summary(v.detections), 9)


@register(
    "detections_by_class",
    with_views("SELECT drawing_id, class_name, count(*) AS detections FROM det GROUP BY 1, 2"),
)
def _(v: Views) -> DataFrame:
    return aggregate.detections_by_class(v.detections)


@register(
    "drawing_report_counts",
    with_views(
        """SELECT drawing_id, 'entity' AS section, entity_type AS name, count(*) AS n FROM ent GROUP BY 1, 3
        UNION ALL SELECT drawing_id, 'shape', class_name, count(*) FROM det GROUP BY 1, 3"""
    ),
)
def _(v: Views) -> DataFrame:
    return aggregate.drawing_report_counts(v.entities, v.detections)


@register(
    "ocr_average_confidence",
    with_views(
        """SELECT d.drawing_id, round(coalesce(avg(confidence), 0), 9) AS average_confidence, count(t.text_id) AS text_blocks
        FROM drw d LEFT JOIN txt t USING (drawing_id) GROUP BY 1"""
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(aggregate.ocr_average_confidence(v.drawings, v.text_blocks), 9)


@register(
    "association_counts",
    with_views("SELECT drawing_id, detection_id, count(*) AS associations FROM asc_ GROUP BY 1, 2"),
)
def _(v: Views) -> DataFrame:
    return aggregate.association_counts(_associations(v))


@register(
    "batch_result",
    with_views(
        """SELECT count(*) AS total_drawings, count(*) FILTER (status='complete') AS successful, count(*) FILTER (status='failed') AS failed,
        count(*) FILTER (needs_review) AS needs_review, round(avg((status='complete')::INT), 9) AS success_rate, round(avg(needs_review::INT), 9) AS review_rate,
        round(sum(c), 6) AS total_llm_cost, round(avg(s) FILTER (s > 0), 6) AS average_processing_time
        FROM drw LEFT JOIN (SELECT drawing_id, sum(cost_usd) AS c FROM usg GROUP BY 1) USING (drawing_id)
        LEFT JOIN (SELECT drawing_id, sum(duration_seconds) AS s FROM aud GROUP BY 1) USING (drawing_id)"""
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(aggregate.batch_result(v.drawings, v.usage, v.audit), success_rate=9, review_rate=9)


@register(
    "confidence_histogram",
    with_views(
        """SELECT bin, round(low + (bin-1)*(high-low)/20, 9) AS bin_start, count(overall_confidence) AS drawings FROM
        (SELECT unnest(range(1, 21)) AS bin) b CROSS JOIN (SELECT min(overall_confidence) AS low, max(overall_confidence) AS high FROM drw) l
        LEFT JOIN drw ON least(20, 1 + floor((overall_confidence-low)*20/(high-low))) = bin GROUP BY 1, 2"""
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(aggregate.confidence_histogram(v.drawings), 9)


@register(
    "status_breakdown",
    with_views(
        """SELECT label, drawings, round(drawings / sum(drawings) OVER (), 9) AS share FROM (SELECT 'Successful' AS label, count(*) FILTER (status='complete') AS drawings FROM drw
        UNION ALL SELECT 'Needs Review', count(*) FILTER (needs_review) FROM drw UNION ALL SELECT 'Failed', count(*) FILTER (status='failed') FROM drw)"""
    ),
)
def _(v: Views) -> DataFrame:
    return tidy(aggregate.status_breakdown(v.drawings), 9)


@register(
    "error_triage",
    with_views(
        """SELECT stage, CASE WHEN error_message IN ('UNIQUE constraint failed', 'Invalid API key', 'bad page tree') THEN 'permanent' ELSE 'retriable' END AS verdict, count(*) AS errors
        FROM aud WHERE error_message IS NOT NULL GROUP BY 1, 2"""
    ),
)
def _(v: Views) -> DataFrame:
    return aggregate.error_triage(v.audit)


@register(
    "image_quality_verdict",
    """SELECT reason AS rejection_reason, reason IS NULL AS is_acceptable, count(*) AS images FROM (SELECT CASE WHEN l_extendedprice/300 < 100 THEN 'blurry' WHEN l_quantity < 20 THEN 'low_contrast'
    WHEN (l_partkey*37+l_suppkey*11)%256 < 30 OR (l_partkey*37+l_suppkey*11)%256 > 225 THEN 'poor_brightness' END AS reason FROM lineitem) GROUP BY 1, 2""",
)
def _(v: Views) -> DataFrame:
    metrics = v.table("lineitem").select(
        (F.col("l_extendedprice") / 300).alias("blur"), F.col("l_quantity").alias("contrast"),
        ((F.col("l_partkey") * 37 + F.col("l_suppkey") * 11) % 256).alias("brightness"),
    )
    return (
        aggregate.image_quality_verdict(metrics)
        .groupBy("rejection_reason", "is_acceptable").agg(F.count("*").alias("images"))
    )
