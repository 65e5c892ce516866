"""The same operators over growing folders, as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import LongType, StructField, StructType

from planmark.operators import cost, extract
from planmark.session import cut_lineage


def read_folder(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """New parquet files of a folder; the schema is given, never inferred."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def entity_stream(text_blocks: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Pattern entities of arriving blocks; stateless, so exactly once with a file sink."""
    return extract.regex_entities(text_blocks, types)


def write_folder(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append to a parquet folder, take what is there and stop; a rerun goes on from the checkpoint."""
    return (
        df.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )


def daily_spend_stream(usage: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Spend per day and use case. Written in update mode, so that open days show too; a day leaves the state when
    the watermark passes its end."""
    return (
        usage.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", "1 day").alias("day"), "use_case")
        .agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd"))
        .select(F.to_date("day.start").alias("date"), "use_case", "calls", "cost_usd")
    )


def review_alert_stream(drawings: DataFrame, lateness: str = "1 day") -> DataFrame:
    """A drawing that enters review, once."""
    return (
        drawings.where("needs_review")
        .withWatermark("processing_timestamp", lateness)
        .dropDuplicatesWithinWatermark(["drawing_id"])
        .select("drawing_id", "processing_timestamp", "overall_confidence")
    )


def _batches_before(spark: SparkSession, path: str, number: int, schema: str) -> DataFrame | None:
    """The newest version below ``number`` of a table that every micro-batch writes anew."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return None
    found = [s.getPath().getName() for s in system.listStatus(folder)]
    numbers = [int(n.split("=")[1]) for n in found if n.startswith("batch=")]
    # a version is complete when its marker stands in it
    complete = [n for n in numbers if n < number and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={n}/_SUCCESS"))]
    return spark.read.schema(schema).parquet(f"{path}/batch={max(complete)}") if complete else None


def budget_stream(
    calls: DataFrame, path: str, checkpoint: str, daily_budget: float = 50.0, per_drawing: float = 0.30, alert_share: float = 0.8,
    keep_days: int = 2, **options,
) -> DataStreamWriter:
    """Decisions for arriving calls (``planned_calls`` of a usage stream), in ``path``/decisions.

    The state is a table of keyed rows, one for each day and one for each drawing of a day, in a version for each
    micro-batch. A batch takes the version before its own, is decided like ``budget_plan``, and overwrites its own
    decisions and version, so that a batch that is run again after a failure gives the same tables. Days that
    lie more than ``keep_days`` behind the newest one leave the state. Calls of a day must arrive in the order of time.
    """
    kind = calls.schema["drawing_id"].dataType.simpleString()
    schema = f"day date, drawing_id {kind}, spent double, tier int"

    def decide(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = _batches_before(spark, f"{path}/state", number, schema)
        replayed = cut_lineage(cost.replay_budget(cut_lineage(batch), daily_budget, per_drawing, alert_share, state=known, **options))
        cost.decisions(replayed).write.mode("overwrite").parquet(f"{path}/decisions/batch={number}")
        state = cut_lineage(cost.state_after(replayed, known))
        newest = state.agg(F.max("day")).first()[0]
        if newest is not None:
            state = state.filter(F.col("day") >= F.date_sub(F.lit(newest), keep_days))
        state.write.mode("overwrite").parquet(f"{path}/state/batch={number}")

    return calls.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def read_decisions(spark: SparkSession, path: str, schema) -> DataFrame:
    """All decisions that a budget stream has written."""
    return spark.read.schema(schema).parquet(f"{path}/decisions").drop("batch")


def write_latest(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Changed rows of an aggregate, a folder for each micro-batch; a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )


def read_latest(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """The table that ``write_latest`` keeps: of each key the row of the newest batch, open days included."""
    rest = [f.name for f in schema if f.name not in keys]
    written = spark.read.schema(StructType([*schema, StructField("batch", LongType())])).parquet(path)
    newest = F.max_by(F.struct(*rest), "batch").alias("newest")
    return written.groupBy(*keys).agg(newest).select(*keys, "newest.*")


def collect_alerts(alerts: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Micro-batches to a folder per batch number, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
