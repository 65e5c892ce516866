"""A stored inverted index of entities.

Every token of an entity is a posting. Postings lie in folders by a hash bucket of their token and in
token order inside each file, so a search opens the buckets of its own tokens only, and within them
the row groups that can hold these tokens. A batch of entities adds files and rewrites none; batches
appear as a whole (``sources.publish``).

Entities are cut into tokens once a batch: postings are dealt by bucket, without a sample that fixes ranges first. A bucket
with a token that a third of all entities hold is cut into many tasks and files by its size.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from planmark.operators.extract import entity_tokens
from planmark.sources import publish

POSTINGS = "postings"
BUCKETS = 64
_KEY = ("drawing_id", "entity_id", "entity_type")


def _bucket(token, buckets: int):
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def add_entities(entities: DataFrame, root: str, batch: str, buckets: int = BUCKETS) -> bool:
    """Post one batch of entities; False if the batch is in the index already."""
    postings = (
        entity_tokens(entities).withColumn("bucket", _bucket(F.col("token"), buckets))
        .hint("rebalance", "bucket").sortWithinPartitions("bucket", "token")
    )
    return publish.publish_tables({POSTINGS: postings}, root, batch, {POSTINGS: ["bucket"]})


def search(spark: SparkSession, root: str, query: str, buckets: int = BUCKETS) -> DataFrame:
    """Entities that hold every token of the query, each once, also when two batches hold it.

    ``buckets`` must be what the index was built with. A query without tokens finds nothing.
    """
    wanted = sorted({t for t in re.split(r"[\W_]+", query.lower()) if t})
    folders = publish.published_folders(spark, root).get(POSTINGS)
    if not folders or not wanted:
        return spark.createDataFrame([], "drawing_id long, entity_id string, entity_type string")
    spots = spark.createDataFrame([(t,) for t in wanted], "t string").select(_bucket(F.col("t"), buckets)).collect()
    postings = spark.read.option("basePath", f"{root}/{POSTINGS}").parquet(*folders)
    return (
        postings.where(F.col("bucket").isin(sorted({r[0] for r in spots})) & F.col("token").isin(wanted))
        .groupBy(*_KEY)
        .agg(F.collect_set("token").alias("held"))  # no more than the query's own tokens
        .where(F.size("held") == len(wanted))
        .drop("held")
    )
