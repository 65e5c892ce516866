"""From raw documents to tokens: quality, line dedup, near duplicates, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, which the one before has
written. A stage that edits texts also corrects ``n_chars`` where the documents have that column.
SQL cannot express the stages; tests compare each with a brute-force version.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from planmark.llm import bpe, jaccard, line_chunks, mixing, quality
from planmark.llm.queries import VOCABULARY, remainder, table
from planmark.session import ensure_checkpoint_dir
from planmark.shipping import ship_package

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones."""
    net = quality.train(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    return quality.score(docs, net, out="quality_score").filter("quality_score >= 0.5").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of several lines that occur earlier; every document stays."""
    out = line_chunks.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles with a Jaccard similarity of 0.8 or more."""
    return jaccard.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.apply_mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digest of the bytes they decode to."""
    path = public_tokenizers.path(VOCABULARY)
    done = bpe.round_trip(docs, path, public_tokenizers.PATTERN).select("doc_id", "lang", "source", "tokens")
    return done.select(
        "doc_id", "lang", "source", F.size("tokens.ids").cast("long").alias("n_tokens"), "tokens.ids", "tokens.decoded_sha256"
    )


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written to the shared folder and read by the next."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{ensure_checkpoint_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
