"""The pipeline against its operators' plain versions, and the registered queries against their oracles."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from planmark.llm import bpe, mixing, quality
from planmark.llm.queries import Q, SQL, remainder
from tests.llm.test_jaccard import groups
from tests.llm.test_line_chunks import expected as expected_lines
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        seen[name] = (docs.collect(), after.collect())
        if i < 4:
            assert after.columns == columns
        docs = after
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "mixing", "tokens"]

    before, after = seen["quality"]
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after}
    assert sum(truth.get(r["doc_id"]) == 1 and r["doc_id"] not in kept for r in before) <= 1

    before, after = seen["line_dedup"]
    assert sorted(r["doc_id"] for r in before) == sorted(r["doc_id"] for r in after)
    cleaned = expected_lines([(r["doc_id"], r["text"]) for r in before])
    wanted = {doc_id: text for (doc_id, _), (text, _) in cleaned.items()}
    assert {r["doc_id"]: r["text"] for r in after} == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = seen["near_duplicates"]
    ordered = sorted(before, key=lambda r: r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted({ordered[i]["doc_id"] for i in groups([r["text"] for r in ordered])})

    before, after = seen["mixing"]
    sizes = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert abs(sizes(before) - sizes(after)) < 0.05 * sizes(before)
    assert max(sum(r["doc_id"] == d["doc_id"] for r in after) for d in before) <= 3

    before, after = seen["tokens"]
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in before}
    assert len(after) == len(before)
    for r in after:
        assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_odd_rows(spark, tmp_path, documents):
    rows = [(None, None), (None, "x y z " * 30), (1, ""), (1, ""), (2, "a b c " * 3000), (2, "a b c " * 3000), (3, None), (4, "line one\nline two\n" * 40)]
    docs = documents(*rows, c_id=1, ids=2, root=3, size=4, m_repeat=5, lang_pred="x")
    docs = docs.withColumn("source", F.when(F.col("doc_id") == 4, F.lit(None)).otherwise(F.col("source")))
    spark.createDataFrame([(2, 1, 0), (4, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert name == "tokens" or docs.columns == columns


@pytest.mark.parametrize("key", sorted(SQL))
def test_oracles(spark, key):
    same, note = compare(spark, connect(FOLDER), FOLDER, Q[key], SQL[key])
    assert same, note


@pytest.mark.parametrize("key", sorted(set(Q) - set(SQL)))
def test_queries_run(spark, key):
    assert Q[key](spark, FOLDER).count() > 0


def test_main_text_is_the_article(spark):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in Q["op10_main_text"](spark, FOLDER).collect():
        article = pages[r["page_id"]].split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:h1|p)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


def test_labels_outside_the_fold_teach_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(remainder(3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train(docs, x, remainder(3) != 1) for x in (labels, flipped))
    assert (a.second == b.second).all() and a.temperature == b.temperature
    assert mixing.WEIGHTS == (5, 2, 1)
