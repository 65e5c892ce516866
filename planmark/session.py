"""Session and checkpoint helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from planmark.shipping import ship_package


def build_session(app: str = "planmark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster; a private one only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not configured:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = os.path.join(tempfile.mkdtemp(prefix="spark-"), "checkpoints")
    target = configured
    context.setCheckpointDir(target)
    return target


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile are removed with its end, not when the driver collects garbage."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


def cut_lineage(df: DataFrame, by: Sequence[str] = (), buckets: int = 0) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it from there.

    Lost executors then cost no recomputation, the plan starts anew, later reads take only the
    columns they need, and the planner knows the real size. The shuffles of the step leave the disk.

    With ``buckets`` the table is dealt by the columns ``by``, so that tables of as many buckets are joined
    and grouped on them without a shuffle.
    """
    spark = df.sparkSession
    name = f"planmark_cut_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/{name}"
    with _shuffles_go(spark):
        if not buckets:
            df.write.parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        dealt = df.repartition(buckets, *by)
        dealt.write.bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(name)
    return spark.table(name)
