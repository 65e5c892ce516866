"""Usage costs, prices and budgets."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from planmark import reference as ref
from planmark.operators.ordered import running_sum, with_ranges
from planmark.session import cut_lineage


def within(usage: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Half-open range, so that a midnight row belongs to one day only."""
    if start is not None:
        usage = usage.where(F.col("timestamp") >= F.lit(start))
    if end is not None:
        usage = usage.where(F.col("timestamp") < F.lit(end))
    return usage


def llm_daily_costs(usage: DataFrame) -> DataFrame:
    return usage.groupBy(F.to_date("timestamp").alias("date"), "use_case", "model").agg(
        F.count("*").alias("call_count"),
        F.sum("tokens_input").alias("total_input_tokens"),
        F.sum("tokens_output").alias("total_output_tokens"),
        F.sum("image_count").alias("total_images"),
        F.sum("cost_usd").alias("total_cost"),
        F.avg("cost_usd").alias("avg_cost_per_call"),
        F.count_if(F.col("tier_stepped_down")).alias("stepped_down_count"),
    )


def daily_cost(usage: DataFrame, day: datetime) -> DataFrame:
    """Spend of one day; 0 where there is none."""
    start = day.replace(hour=0, minute=0, second=0, microsecond=0)
    return within(usage, start, start + timedelta(days=1)).agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd")
    )


def cost_by(usage: DataFrame, field: str) -> DataFrame:
    return usage.groupBy(field).agg(F.sum("cost_usd").alias("cost_usd"))


def cost_by_drawing(
    usage: DataFrame, drawing_id=None, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    found = within(usage, start, end)
    if drawing_id is not None:
        found = found.where(F.col("drawing_id") == F.lit(drawing_id))
    return cost_by(found, "drawing_id")


def top_drawings_by_cost(usage: DataFrame, top_n: int = 10) -> DataFrame:
    if top_n < 1:
        raise ValueError("top_n must be at least 1")
    return cost_by(usage, "drawing_id").orderBy(F.col("cost_usd").desc(), "drawing_id").limit(top_n)


def cost_cube(usage: DataFrame) -> DataFrame:
    """All breakdowns over use case, provider, model and day."""
    day = F.date_format("timestamp", "yyyy-MM-dd")
    return (
        usage.withColumn("day", day)
        .cube("use_case", "provider", "model", "day")
        .agg(
            F.grouping_id().alias("level"),
            F.count("*").alias("calls"),
            F.sum("cost_usd").alias("cost_usd"),
        )
    )


def cost_report(
    usage: DataFrame, start: datetime | None = None, end: datetime | None = None, top_n: int = 10
) -> DataFrame:
    """Long report (section, name, value).

    One aggregate per (drawing, day, use case, provider, model) feeds every section, so the usage
    rows are shuffled once; the sections are grouping sets over the small result.
    """
    fine = (
        within(usage, start, end)
        .withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
        .groupBy("drawing_id", "day", "use_case", "provider", "model")
        .agg(
            F.count("*").alias("calls"), F.sum("cost_usd").alias("cost"),
            F.sum("tokens_input").alias("tin"), F.sum("tokens_output").alias("tout"),
            F.sum("image_count").alias("images"),
        )
    )
    sets = fine.groupingSets(
        [["use_case"], ["provider"], ["model"], ["day"]], "use_case", "provider", "model", "day"
    ).agg(F.grouping_id().alias("g"), F.sum("cost").alias("cost"), F.sum("calls").alias("calls"))
    # an aggregate without keys gives its row of zeros for an empty range too
    totals = fine.agg(*[F.sum(c).alias(c) for c in ("cost", "calls", "tin", "tout", "images")])
    pair = lambda section, name, value: F.struct(
        F.lit(section).alias("section"), name.alias("name"), value.cast("double").alias("value")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rate = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("calls")), F.lit(0.0))
    whole = F.array(
        pair("total", F.lit("cost"), zero("cost")),
        pair("total", F.lit("calls"), zero("calls")),
        pair("tokens", F.lit("input"), zero("tin")),
        pair("tokens", F.lit("output"), zero("tout")),
        pair("tokens", F.lit("images"), zero("images")),
        pair("tokens", F.lit("mean_input"), rate("tin")),
        pair("tokens", F.lit("mean_output"), rate("tout")),
    )
    # grouping_id: one bit per column, 1 where the column is summed over
    rows = (
        F.when(F.col("g") == 0b0111, F.array(pair("use_case", F.col("use_case"), F.col("cost"))))
        .when(F.col("g") == 0b1011, F.array(pair("provider", F.col("provider"), F.col("cost"))))
        .when(F.col("g") == 0b1101, F.array(pair("model", F.col("model"), F.col("cost"))))
        .otherwise(
            F.array(pair("day_cost", F.col("day"), F.col("cost")), pair("day_calls", F.col("day"), F.col("calls")))
        )
    )
    parts = sets.select(F.explode(rows).alias("r")).select("r.*")
    whole_rows = totals.select(F.explode(whole).alias("r")).select("r.*")
    per_drawing = fine.groupBy("drawing_id").agg(F.sum("cost").alias("cost"))
    top = (
        per_drawing.orderBy(F.col("cost").desc(), "drawing_id").limit(top_n)
        .select(F.lit("top_drawing").alias("section"), F.col("drawing_id").cast("string").alias("name"),
                F.col("cost").alias("value"))
    )
    mean = per_drawing.agg(F.coalesce(F.avg("cost"), F.lit(0.0)).alias("value")).select(
        F.lit("total").alias("section"), F.lit("mean_per_drawing").alias("name"), "value"
    )
    return reduce(DataFrame.unionByName, [whole_rows, parts, top, mean])


# ---- prices and budgets --------------------------------------------------------------------


def _price(model: Column, position: int) -> Column:
    pairs = [F.lit(part) for name, prices in ref.MODEL_PRICES.items() for part in (name, float(prices[position]))]
    return F.try_element_at(F.create_map(*pairs), model)


def call_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """USD from tokens and the price per million; an unknown model costs 0."""
    cost = tokens_in / 1_000_000 * _price(model, 0) + tokens_out / 1_000_000 * _price(model, 1)
    return F.coalesce(cost, F.lit(0.0))


def price_calls(usage: DataFrame) -> DataFrame:
    return usage.withColumn(
        "estimated_cost", call_cost(F.col("model"), F.col("tokens_input"), F.col("tokens_output"))
    )


def budget_summary(usage: DataFrame, daily_budget: float = 50.0, alert_share: float = 0.8) -> DataFrame:
    spend = F.col("daily_spend")
    used = F.lit(0.0) if daily_budget == 0 else spend / daily_budget * 100
    return (
        usage.groupBy(F.to_date("timestamp").alias("date"))
        .agg(F.sum("cost_usd").alias("daily_spend"))
        .select(
            "date", "daily_spend",
            (F.lit(daily_budget) - spend).alias("remaining_budget"),
            used.alias("budget_used_pct"),
            (spend >= daily_budget * alert_share).alias("alert_triggered"),
        )
    )


def running_spend(usage: DataFrame, **options) -> DataFrame:
    """Cumulative spend in call order, per day and per drawing."""
    dated = usage.withColumn("day", F.to_date("timestamp"))
    by_day = running_sum(dated, ["day"], "timestamp", "usage_id", F.col("cost_usd"), "day_spend", **options)
    return running_sum(
        by_day, ["drawing_id"], "timestamp", "usage_id", F.col("cost_usd"), "drawing_spend", **options
    )


DECISION = (
    "day date, usage_id bigint, drawing_id bigint, allowed boolean, reason string, tier int, "
    "model string, estimated_cost double, spend_before double"
)


class BudgetState:
    """Spend and tier of one day. Refused calls cost nothing, so each decision needs all earlier ones."""

    def __init__(self, daily: float, per_drawing: float, alert_share: float, tier: int = 2):
        self.daily, self.per_drawing, self.alert = daily, per_drawing, daily * alert_share
        self.spend, self.tier, self.by_drawing = 0.0, tier, {}

    def decide(self, drawing, costs: tuple[float, float, float], models: tuple[str, str, str]):
        """``costs`` and ``models`` by tier: cheap, balanced, premium."""
        before, cost = self.spend, costs[self.tier]
        already = self.by_drawing.get(drawing, 0.0)
        if already + cost > self.per_drawing:
            return False, "DRAWING_LIMIT", self.tier, None, cost, before
        if before >= self.alert and self.tier > 0:
            self.tier -= 1
            cost = costs[self.tier]
        if before + cost > self.daily:
            return False, "DAILY_BUDGET", self.tier, None, cost, before
        self.spend = before + cost
        self.by_drawing[drawing] = already + cost
        reason = ("TIER_0", "TIER_1", "PREFERRED")[self.tier]
        return True, reason, self.tier, models[self.tier], cost, before


def tier_model(use_case: Column, tier: int) -> Column:
    """Model of a tier: 2 premium, 1 balanced, 0 cheap."""
    pairs = [F.lit(part) for name, models in ref.USE_CASE_MODELS.items() for part in (name, models[2 - tier])]
    return F.try_element_at(F.create_map(*pairs), use_case)


def planned_calls(usage: DataFrame, prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Cost and model of every tier for each planned call."""
    table = {**ref.MODEL_PRICES, **(prices or {})}

    def price(model: Column, position: int) -> Column:
        pairs = [F.lit(part) for name, p in table.items() for part in (name, float(p[position]))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), model), F.lit(0.0))

    columns = []
    for tier in (0, 1, 2):
        model = tier_model(F.col("use_case"), tier)
        cost = F.col("tokens_input") / 1e6 * price(model, 0) + F.col("tokens_output") / 1e6 * price(model, 1)
        columns += [model.alias(f"model_{tier}"), cost.alias(f"cost_{tier}")]
    return usage.select(
        F.to_date("timestamp").alias("day"), "timestamp", "usage_id", "drawing_id", *columns
    )


#: Calls of a day that one range replays; a longer day is cut into ranges of its order.
CALLS_PER_RANGE = 1_000_000
#: Rows of a replay: what a range starts from (day's total, then drawings), and its calls.
_TOTAL, _DRAWING, _CALL = 0, 1, 2


def _replay(rows: DataFrame, limits: tuple[float, float, float], decisions: bool) -> DataFrame:
    """One ordered pass over every range: its starting state, then its calls, read as a sorted stream.

    Gives the decisions and, for each range, what it adds: (kind, day, range_no, drawing_id, spent, tier). Memory
    holds the drawings that the budget has admitted, not the calls that ask.
    """
    kinds = dict(rows.dtypes)
    schema = _parse_datatype_string(
        f"kind int, range_no int, spent double, {DECISION}"
        .replace("usage_id bigint", f"usage_id {kinds['usage_id']}").replace("drawing_id bigint", f"drawing_id {kinds['drawing_id']}")
    )
    arrow = to_arrow_schema(schema)
    names = ("day", "range_no", "kind", "usage_id", "drawing_id", "spent", "tier", "cost_0", "cost_1", "cost_2", "model_0", "model_1", "model_2")

    def table(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def ended(day, number, state: BudgetState, start: float, known: dict) -> Iterator[tuple]:
        yield (_TOTAL, number, state.spend - start, day, None, None, None, None, state.tier, None, None, None)
        for drawing, spent in state.by_drawing.items():
            if more := spent - known.get(drawing, 0.0):
                yield (_DRAWING, number, more, day, None, drawing, None, None, None, None, None, None)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, start, known = None, None, 0.0, {}
        for batch in batches:
            out = []
            for day, number, kind, usage, drawing, spent, tier, c0, c1, c2, m0, m1, m2 in zip(*(batch.column(n).to_pylist() for n in names)):
                if (day, number) != at:
                    if at is not None:
                        out.extend(ended(*at, state, start, known))
                    at, state, start, known = (day, number), BudgetState(*limits), 0.0, {}
                if kind == _TOTAL:
                    start = state.spend = spent
                    state.tier = tier
                elif kind == _DRAWING:
                    known[drawing] = state.by_drawing[drawing] = spent
                else:
                    decided = state.decide(drawing, (c0, c1, c2), (m0, m1, m2))
                    if decisions:
                        out.append((_CALL, number, None, day, usage, drawing, *decided))
            yield table(out)
        if at is not None:
            yield table(list(ended(*at, state, start, known)))

    ordered = rows.repartition("day", "range_no").sortWithinPartitions("day", "range_no", "kind", "timestamp", "usage_id")
    return ordered.select(*names).mapInArrow(replay, schema)


def _with_states(ranged: DataFrame, states: DataFrame) -> DataFrame:
    """Calls of all ranges and what each range starts from (kind, day, range_no, drawing_id, spent, tier)."""
    return ranged.withColumn("kind", F.lit(_CALL)).unionByName(states, allowMissingColumns=True)


def _first_states(ranges: DataFrame, state: DataFrame | None) -> DataFrame:
    """``state`` (day, drawing_id, spent, tier; a null drawing for the day itself) at the first range of each day."""
    first = ranges.groupBy("day").agg(F.min("range_no").alias("range_no"))
    kind = F.when(F.col("drawing_id").isNull(), _TOTAL).otherwise(_DRAWING).alias("kind")
    return state.join(first, "day").select(kind, "day", "range_no", "drawing_id", "spent", "tier")


def _sums_before(keys: list[str]) -> Column:
    before = Window.partitionBy(*keys).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("spent").over(before), F.lit(0.0))


def _settled(ranged: DataFrame, ranges: DataFrame, first: DataFrame, limits: tuple[float, float, float]) -> DataFrame:
    """What every range starts from, for days of several ranges.

    A range changes spend, tier and drawings by amounts that hardly depend on where it starts, so all ranges are
    replayed at once from a guess, what they add is summed up over the ranges before (the tier is the
    lowest before), and this is repeated until the sums stand still. The first n ranges of a day are right after n rounds at
    the latest; away from the limits two or three rounds do for all.
    """
    keys = ["day", "range_no"]
    asked = cut_lineage(ranged.select(*keys, "drawing_id").distinct())
    states, mark = first, None
    while True:
        added = cut_lineage(_replay(_with_states(ranged, states), limits, False))
        start = F.lit(-(2**31)).alias("range_no")  # what the day had before its first range
        day_rows = added.filter(F.col("kind") == _TOTAL).select("day", "range_no", "spent", "tier").unionByName(
            first.filter(F.col("kind") == _TOTAL).select("day", start, "spent", "tier")
        )
        before = Window.partitionBy("day").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
        totals = day_rows.select(
            F.lit(_TOTAL).alias("kind"), "day", "range_no", _sums_before(["day"]).alias("spent"),
            F.coalesce(F.min("tier").over(before), F.lit(2)).alias("tier"),
        ).filter(F.col("range_no") > -(2**31))
        by_drawing = added.filter(F.col("kind") == _DRAWING).select("day", "range_no", "drawing_id", "spent").unionByName(
            first.filter(F.col("kind") == _DRAWING).select("day", start, "drawing_id", "spent")
        )
        # a drawing's spend reaches the later ranges that ask for it
        both = by_drawing.unionByName(asked.withColumn("spent", F.lit(0.0))).groupBy("day", "drawing_id", "range_no").agg(F.sum("spent").alias("spent"))
        drawings = both.select(
            F.lit(_DRAWING).alias("kind"), "day", "range_no", "drawing_id", _sums_before(["day", "drawing_id"]).alias("spent")
        ).filter((F.col("range_no") > -(2**31)) & (F.col("spent") > 0))
        states = cut_lineage(totals.unionByName(drawings, allowMissingColumns=True))
        found = states.agg(
            F.count("*"), F.sum(F.xxhash64("kind", "day", "range_no", "drawing_id", "spent", "tier").cast("decimal(38,0)"))
        ).first()
        if found == mark:
            return states
        mark = found


def replay_budget(
    calls: DataFrame, daily_budget: float = 50.0, per_drawing: float = 0.30, alert_share: float = 0.8,
    state: DataFrame | None = None, calls_per_range: int = CALLS_PER_RANGE,
) -> DataFrame:
    """Decisions on planned calls, and what every range of a day adds (see ``_replay``).

    ``state`` (day, drawing_id, spent, tier) is what earlier calls have left; a null drawing is the day itself.
    """
    limits = (daily_budget, per_drawing, alert_share)
    ranged = with_ranges(calls, ["day"], "timestamp", calls_per_range)
    ranges = cut_lineage(ranged.select("day", "range_no").distinct())
    if state is None:
        kind = calls.schema["drawing_id"].dataType
        state = calls.select(F.lit(None).cast("date").alias("day"), F.lit(None).cast(kind).alias("drawing_id"), F.lit(0.0).alias("spent"), F.lit(2).alias("tier")).limit(0)
    first = cut_lineage(_first_states(ranges, state))
    several = ranges.groupBy("day").count().filter("count > 1").select("day")
    if several.isEmpty():
        return _replay(_with_states(ranged, first), limits, True)
    ranged = cut_lineage(ranged)
    long = ranged.join(several, "day", "left_semi")
    settled = _settled(long, ranges.join(several, "day", "left_semi"), first.join(several, "day", "left_semi"), limits)
    states = first.join(several, "day", "left_anti").unionByName(settled)
    return _replay(_with_states(ranged, states), limits, True)


def decisions(replayed: DataFrame) -> DataFrame:
    return replayed.filter(F.col("kind") == _CALL).select(*[part.split()[0] for part in DECISION.split(", ")])


def state_after(replayed: DataFrame, state: DataFrame | None) -> DataFrame:
    """``state`` with what ``replayed`` adds: (day, drawing_id, spent, tier)."""
    added = replayed.filter(F.col("kind") != _CALL).select("day", "drawing_id", "spent", "tier")
    if state is not None:
        added = added.unionByName(state.select("day", "drawing_id", "spent", "tier"))
    return added.groupBy("day", "drawing_id").agg(F.sum("spent").alias("spent"), F.min("tier").alias("tier"))


def budget_plan(calls: DataFrame, daily_budget: float = 50.0, per_drawing: float = 0.30, alert_share: float = 0.8, **options) -> DataFrame:
    """Replay of planned calls in order, per day: allowed or not, tier, model, reason.

    Each decision depends on all earlier ones of its day, because refused calls cost nothing. A day with many calls
    is replayed in ranges side by side (see ``_settled``); spends then are sums of ranges. Every call,
    admitted or not, gets its tier, price and the spend before it.
    """
    return decisions(replay_budget(calls, daily_budget, per_drawing, alert_share, **options))
