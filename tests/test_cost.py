import pytest
from pyspark.sql import functions as F

from planmark.operators import cost
from planmark.plans.helpers import scratch
from planmark.plans.summary_plan import PLAN_PRICES
from planmark.streaming import jobs
from tests.conftest import rows


def replay(calls, daily, per_drawing, alert=0.8):
    """The rules, one call after the other."""
    found, day = [], None
    for r in sorted(calls, key=lambda r: (r["day"], r["timestamp"], r["usage_id"])):
        if r["day"] != day:
            day, spend, tier, drawings = r["day"], 0.0, 2, {}
        costs = [r["cost_0"], r["cost_1"], r["cost_2"]]
        price = costs[tier]
        if drawings.get(r["drawing_id"], 0.0) + price > per_drawing:
            found.append((r["usage_id"], False, "DRAWING_LIMIT", tier, price, spend))
            continue
        if spend >= daily * alert and tier > 0:
            tier -= 1
            price = costs[tier]
        if spend + price > daily:
            found.append((r["usage_id"], False, "DAILY_BUDGET", tier, price, spend))
            continue
        before, spend = spend, spend + price
        drawings[r["drawing_id"]] = drawings.get(r["drawing_id"], 0.0) + price
        found.append((r["usage_id"], True, ["TIER_0", "TIER_1", "PREFERRED"][tier], tier, price, before))
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in f) for f in found)


ALL = ("usage_id", "allowed", "reason", "tier", "estimated_cost", "spend_before")


@pytest.mark.parametrize("daily, per_drawing", [(0.2, 0.05), (1.0, 0.012), (0.05, 10.0)])
def test_budget_plan(views, daily, per_drawing):
    calls = cost.planned_calls(views.usage, PLAN_PRICES)
    found = rows(cost.budget_plan(calls, daily, per_drawing), *ALL)
    wanted = replay(calls.collect(), daily, per_drawing)
    assert found == wanted and len({r[2] for r in found}) >= 2


@pytest.mark.parametrize("daily, per_drawing", [(0.2, 0.05), (1.0, 0.012), (0.05, 10.0), (30.0, 0.02)])
def test_ranges_of_a_day_side_by_side(views, daily, per_drawing):
    calls = cost.planned_calls(views.usage, PLAN_PRICES)
    one_day = calls.withColumn("day", F.when(F.col("drawing_id") % 3 == 0, F.col("day")).otherwise(F.lit("2020-01-01").cast("date")))
    found = rows(cost.budget_plan(one_day, daily, per_drawing, calls_per_range=60), *ALL)
    assert found == replay(one_day.collect(), daily, per_drawing)


def _in_order(calls, root, parts):
    """The calls as files of one part of time each, in order of arrival."""
    import time

    cuts = F.percentile_approx(F.unix_micros("timestamp"), [i / parts for i in range(1, parts)])
    bounds = calls.select(cuts).first()[0] if parts > 1 else []
    at = sum((F.unix_micros("timestamp") > b).cast("int") for b in bounds) if bounds else F.lit(0)
    for i in range(parts):
        calls.filter(at == i).coalesce(1).write.mode("append").parquet(f"{root}/in")
        time.sleep(0.05)


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_equals_plan(spark, views, parts):
    calls = cost.planned_calls(views.usage, PLAN_PRICES)
    root = scratch(spark, "test-calls")
    _in_order(calls, root, parts)
    stream = jobs.read_folder(spark, f"{root}/in", calls.schema, files_per_batch=1)
    jobs.budget_stream(stream, f"{root}/out", f"{root}/state", 0.2, 0.05).start().awaitTermination(300)
    plan = rows(cost.budget_plan(calls, 0.2, 0.05), *ALL)
    assert rows(jobs.read_decisions(spark, f"{root}/out", cost.DECISION), *ALL) == plan


def test_stream_goes_on_after_a_failure(spark, views, monkeypatch):
    calls = cost.planned_calls(views.usage, PLAN_PRICES)
    root = scratch(spark, "test-calls")
    _in_order(calls, root, 3)

    def start():
        stream = jobs.read_folder(spark, f"{root}/in", calls.schema, files_per_batch=1)
        return jobs.budget_stream(stream, f"{root}/out", f"{root}/state", 0.2, 0.05).start()

    whole, seen = cost.state_after, []

    def broken(replayed, state):  # decisions are written, the state is not
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("lost")
        return whole(replayed, state)

    monkeypatch.setattr(cost, "state_after", broken)
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination(300)
    monkeypatch.setattr(cost, "state_after", whole)
    start().awaitTermination(300)
    plan = rows(cost.budget_plan(calls, 0.2, 0.05), *ALL)
    assert rows(jobs.read_decisions(spark, f"{root}/out", cost.DECISION), *ALL) == plan


def test_daily_spend_shows_open_days(spark, views):
    root = scratch(spark, "test-usage")
    _in_order(views.usage, root, 3)
    stream = jobs.daily_spend_stream(jobs.read_folder(spark, f"{root}/in", views.usage.schema, files_per_batch=1))
    jobs.write_latest(stream, f"{root}/out", f"{root}/state").start().awaitTermination(300)
    found = jobs.read_latest(spark, f"{root}/out", stream.schema, ["date", "use_case"])
    wanted = views.usage.groupBy(F.to_date("timestamp").alias("date"), "use_case").agg(
        F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd")
    )
    columns = ("date", "use_case", "calls", "cost_usd")
    assert rows(found, *columns) == rows(wanted, *columns)


def test_empty_report_is_zero(views):
    report = cost.cost_report(views.usage.where(F.lit(False)))
    found = {(r["section"], r["name"]): r["value"] for r in report.collect()}
    assert found[("total", "cost")] == 0.0 and found[("total", "mean_per_drawing")] == 0.0


def test_prices():
    with pytest.raises(ValueError):
        cost.top_drawings_by_cost(None, 0)
