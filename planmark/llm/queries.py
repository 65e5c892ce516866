"""Registered queries of the operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from planmark.llm import (
    alignment, bpe, decision_list, langid, line_chunks, merkle, mixing, permutation_index, quality, simhash, style_tree,
    suffix_index, warc,
)
from planmark.llm.merkle_sql import MERKLE_SQL
from planmark.session import cut_lineage, ensure_checkpoint_dir
from planmark.plans.registry import registry

Q, SQL, query = registry()

VOCABULARY = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    texts = table(spark, folder, "documents").select("doc_id", "text")
    done = bpe.round_trip(texts, path, public_tokenizers.PATTERN).select("doc_id", "tokens")
    return done.select("doc_id", F.size("tokens.ids").cast("long").alias("n_tokens"), "tokens.ids_sha256", "tokens.decoded_sha256")


@query("op2_permutation_neighbours")
def op2_permutation_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return permutation_index.neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op4_line_chunks")
def op4_line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return line_chunks.dedup_lines(documents, count="removed_passages")


@query(
    "op5_mix_sources",
    r"""
    WITH rows_ AS (
      SELECT doc_id, source, md5(coalesce(text, '')) AS tid, coalesce(text, '') AS t,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
      FROM documents
    ),
    weighed AS (
      SELECT doc_id, source, tid, size,
             1.0::DOUBLE / (1.0::DOUBLE + 4.0::DOUBLE * len(regexp_extract_all(t, '[#*$%&|<>!]'))::DOUBLE
                            / greatest(size, 1)::DOUBLE) AS w
      FROM rows_
    ),
    sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM weighed GROUP BY source),
    shares AS (
      SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place,
             [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS share
      FROM sizes
    ),
    factors AS (
      SELECT *, (source_size * 3)::DOUBLE / share::DOUBLE AS full_at,
             (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (
                ORDER BY (source_size * 3)::DOUBLE / share::DOUBLE, place
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / (sum(share) OVER (ORDER BY (source_size * 3)::DOUBLE / share::DOUBLE, place
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS factor
      FROM shares
    ),
    goals AS (
      SELECT source, source_size,
             CASE WHEN factor <= full_at
                  THEN least(max(CASE WHEN factor <= full_at THEN factor END) OVER () * share, (source_size * 3)::DOUBLE)
                  ELSE (source_size * 3)::DOUBLE END AS target
      FROM factors
    ),
    docs AS (
      SELECT doc_id, source, tid, size, w, count(*) AS copies, size * count(*) AS total,
             -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(source, '') || ':' || tid), 1, 13))::BIGINT::DOUBLE + 0.5)
                 / 4503599627370496.0::DOUBLE) / w AS k
      FROM weighed GROUP BY doc_id, source, tid, size, w
    ),
    summed AS (
      SELECT d.*, g.source_size, g.target,
             CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS epochs,
             sum(d.total) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, tid ROWS UNBOUNDED PRECEDING) AS prefix
      FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
    ),
    chosen AS (SELECT *, target - epochs * source_size AS rest, prefix <= target - epochs * source_size AS extra FROM summed),
    remains AS (
      SELECT *, rest - coalesce(sum(CASE WHEN extra THEN total END) OVER (PARTITION BY source), 0) AS remain FROM chosen
    ),
    last_ AS (
      SELECT *, NOT extra AND total > 0 AND abs(total - remain) < remain AND row_number() OVER (
               PARTITION BY source, (NOT extra AND total > 0 AND abs(total - remain) < remain)
               ORDER BY abs(total - remain), k, doc_id NULLS FIRST, tid) = 1 AS closing
      FROM remains
    )
    SELECT r.doc_id, l.size, l.source_size, l.target,
           l.size * (l.epochs + CASE WHEN l.extra OR l.closing THEN 1 ELSE 0 END)::BIGINT AS taken
    FROM rows_ r JOIN last_ l ON r.doc_id IS NOT DISTINCT FROM l.doc_id
      AND r.source IS NOT DISTINCT FROM l.source AND r.tid = l.tid
    """,
)
def op5_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    measured = cut_lineage(mixing.measure(table(spark, folder, "documents")))
    decided = mixing.with_plan(measured, mixing.plan_mix(measured))
    return decided.select(F.col("m_id").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op8_simhash_groups")
def op8_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def remainder(divisor: int, doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % divisor


@query("op3_language_id")
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = langid.train(documents, remainder(5) != 0)
    found = langid.predict(documents.select("doc_id", "text"), model, reject=False)
    held_out = F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "accepted")


@query(
    "op6_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    d AS (
      SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS x, body,
             min(page_id) OVER (PARTITION BY body) AS first_id
      FROM p
    ),
    bits AS (
      SELECT *, list_transform(range(32), lambda i: (
               (('0x' || substr(x, (i // 8 * 10 + 1)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)) AS fives
      FROM d
    )
    SELECT page_id, payload_bytes,
           list_aggregate(list_transform(fives, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v + 1)::INT, 1)),
                          'string_agg', '') AS payload_digest,
           CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN first_id <> page_id THEN first_id END AS refers_to
    FROM bits
    """,
)
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, folder, "pages"), path)
    return warc.resolve(warc.read_archives(spark, path))


@query("op7_quality")
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    net = quality.train(documents, table(spark, folder, "labels"), remainder(3) != 1)
    found = quality.score(documents.select("doc_id", "text"), net)
    held_out = F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    rules = decision_list.train(documents, table(spark, folder, "labels"))
    found = decision_list.judge(documents.select("doc_id", "text"), rules)
    return found.select("doc_id", *decision_list.STATISTICS, "base_failed", "kept")


@query("op10_main_text")
def op10_main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = style_tree.extract(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars")


@query("op11_merkle_manifest", MERKLE_SQL)
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    tampered = F.when(remainder(2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.prove(documents, {"text": tampered})


@query("op12_suffix_index")
def op12_suffix_index(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_index.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path
    return alignment.align(
        table(spark, folder, "documents"), path("byte_bpe_50k.json"), public_tokenizers.PATTERN, path("piece_bpe_32k.model")
    )


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
