"""Several tables that appear together or not at all.

A batch writes its files into folders of its own, one per table, which no reader looks at. One small
log entry then names all of them. The entry is written under a hidden name and renamed to the name of
the batch, the only step that readers can see, so they find every table of a batch or none. A batch
that is run again after it was published changes nothing; one that was killed before leaves folders
without an entry, and its second run writes new ones.

Readers list the log once and read the folders it names. Two writers of different batches never touch
the same path; two of the same batch race for one rename, which only the first wins.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

LOG = "_published"
_ENTRY = "batch string, folders map<string,string>"


def _files(spark: SparkSession, path: str):
    """Spark's own view of the file system that holds ``path``, and the path there."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf), target


def is_published(spark: SparkSession, root: str, batch: str) -> bool:
    files, entry = _files(spark, f"{root}/{LOG}/{batch}.json")
    return files.util().exists(entry)


def _announce(spark: SparkSession, root: str, batch: str, folders: dict[str, str]) -> bool:
    """Put the log entry in place by one rename; False where another run of the batch came first."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    files, entry = _files(spark, f"{root}/{LOG}/{batch}.json")
    hidden = jvm.org.apache.hadoop.fs.Path(f"{root}/{LOG}/.{batch}-{uuid.uuid4().hex}")
    create = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    parents = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$CreateOpts"), 1)
    parents[0] = getattr(jvm.org.apache.hadoop.fs, "Options$CreateOpts").createParent()
    out = files.create(hidden, create, parents)
    try:
        out.write(bytearray(json.dumps({"batch": batch, "folders": folders}).encode()))
    finally:
        out.close()
    try:
        files.rename(hidden, entry, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Exception as error:
        if "FileAlreadyExistsException" not in str(error):
            raise
        files.delete(hidden, False)
        return False
    return True


def publish_tables(
    tables: dict[str, DataFrame], root: str, batch: str, partition_by: dict[str, list[str]] | None = None
) -> bool:
    """Add one batch of rows to several tables at once; False if the batch was there already.

    ``batch`` names the delivery (letters, digits, ``-`` and ``_``) and makes a repeated run harmless.
    """
    if not batch or not batch.replace("-", "").replace("_", "").isalnum() or not batch.isascii():
        raise ValueError(f"batch name {batch!r} must consist of letters, digits, - and _")
    spark = next(iter(tables.values())).sparkSession
    if is_published(spark, root, batch):
        return False
    folders = {}
    for name, df in tables.items():
        folders[name] = f"batch={batch}-{uuid.uuid4().hex}"
        df.write.mode("errorifexists").partitionBy(*(partition_by or {}).get(name, [])).parquet(
            f"{root}/{name}/{folders[name]}"
        )
    return _announce(spark, root, batch, folders)


def published_folders(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Folders of every table as of now: one row of the log a batch, so what comes here is small."""
    files, log = _files(spark, f"{root}/{LOG}")
    found: dict[str, list[str]] = {}
    if files.util().exists(log):
        for row in spark.read.schema(_ENTRY).json(f"{root}/{LOG}").orderBy("batch").collect():
            for name, folder in row["folders"].items():
                found.setdefault(name, []).append(f"{root}/{name}/{folder}")
    return found


def read_published(spark: SparkSession, root: str, *names: str) -> dict[str, DataFrame]:
    """The named tables (all, if none is named) as one state: later batches stay out of sight."""
    folders = published_folders(spark, root)
    return {
        name: spark.read.option("basePath", f"{root}/{name}").parquet(*folders[name]).drop("batch")
        for name in names or folders
    }
