"""Registered queries: streaming jobs over the given tables, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from planmark.operators import cost
from planmark.plans.helpers import scratch, tidy
from planmark.plans.registry import registry
from planmark.plans.summary_plan import PLAN_PRICES, PLAN_SQL
from planmark.plans.views import Views, with_views
from planmark.streaming import jobs

Q, SQL, register = registry()


def _stage(v: Views, df: DataFrame, name: str) -> tuple[str, str]:
    """Write the derived table as the folder a stream reads; a second path for its state."""
    source = scratch(v.spark, name)
    df.write.parquet(f"{source}/in")
    return f"{source}/in", source


@register(
    "stream_entity_extraction",
    with_views("SELECT entity_type, method AS extraction_method, count(*) AS n FROM ent WHERE method = 'regex' GROUP BY 1, 2"),
)
def _(v: Views) -> DataFrame:
    folder, root = _stage(v, v.text_blocks, "stream-text")
    # a batch of fewer files than cores leaves cores idle, whatever the number of batches
    files = max(4, 2 * v.spark.sparkContext.defaultParallelism)
    stream = jobs.entity_stream(jobs.read_folder(v.spark, folder, v.text_blocks.schema, files_per_batch=files))
    jobs.write_folder(stream, f"{root}/out", f"{root}/state").start().awaitTermination()
    written = v.spark.read.schema(stream.schema).parquet(f"{root}/out")
    return written.groupBy("entity_type", "extraction_method").agg(F.count("*").alias("n"))


@register(
    "stream_daily_spend",
    with_views(
        """SELECT strftime("timestamp", '%Y-%m-%d') AS date, use_case, count(*) AS calls, round(sum(cost_usd), 6) AS cost_usd FROM usg GROUP BY 1, 2"""
    ),
)
def _(v: Views) -> DataFrame:
    folder, root = _stage(v, v.usage, "stream-usage")
    stream = jobs.daily_spend_stream(jobs.read_folder(v.spark, folder, v.usage.schema))
    jobs.write_latest(stream, f"{root}/out", f"{root}/state").start().awaitTermination()
    return tidy(jobs.read_latest(v.spark, f"{root}/out", stream.schema, ["date", "use_case"]))


@register("stream_budget_state", PLAN_SQL)
def _(v: Views) -> DataFrame:
    calls = cost.planned_calls(v.usage, PLAN_PRICES)
    folder, root = _stage(v, calls, "stream-calls")
    stream = jobs.read_folder(v.spark, folder, calls.schema)
    jobs.budget_stream(stream, f"{root}/out", f"{root}/state", daily_budget=1.0, per_drawing=0.05).start().awaitTermination()
    return tidy(jobs.read_decisions(v.spark, f"{root}/out", cost.DECISION), 9)


@register("stream_review_alerts", with_views("SELECT drawing_id, overall_confidence FROM drw WHERE needs_review"))
def _(v: Views) -> DataFrame:
    folder, root = _stage(v, v.drawings.unionByName(v.drawings), "stream-drawings")
    alerts = jobs.review_alert_stream(jobs.read_folder(v.spark, folder, v.drawings.schema))
    jobs.collect_alerts(alerts, f"{root}/out", f"{root}/state").start().awaitTermination()
    return v.spark.read.parquet(f"{root}/out").select("drawing_id", "overall_confidence")
