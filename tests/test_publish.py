"""Publication in one step, the stored search index, manifests of large files, crowded hashes."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from planmark.operators import extract, fingerprint, search_index
from planmark.plans.helpers import scratch
from planmark.sources import files, publish, store
from tests.conftest import rows


def test_tables_appear_together(spark):
    root = scratch(spark, "test-publish")
    one = spark.createDataFrame([(1, "a"), (2, None)], "drawing_id long, v string")
    two = spark.createDataFrame([(1,)], "drawing_id long")
    assert publish.read_published(spark, root) == {}
    assert store.ingest_tables({"one": one, "two": two}, root, "b1")
    # the second table of this batch fails after the first was written
    broken = two.select(F.raise_error(F.lit("lost")).cast("long").alias("drawing_id"))
    with pytest.raises(Exception, match="lost"):
        store.ingest_tables({"one": one, "two": broken}, root, "b2")
    before = publish.read_published(spark, root)
    assert (before["one"].count(), before["two"].count()) == (2, 1)
    # its second run counts once, a third run not at all
    assert store.ingest_tables({"one": one, "two": two}, root, "b2")
    assert not store.ingest_tables({"one": one, "two": two}, root, "b2")
    after = publish.read_published(spark, root)
    assert after["one"].count() == 4 and after["two"].count() == 2 and after["one"].columns == ["drawing_id", "v"]
    # a state that was read before stays what it was
    assert (before["one"].count(), before["two"].count()) == (2, 1)


def test_only_one_of_two_writers_wins(spark):
    root = scratch(spark, "test-race")
    assert publish._announce(spark, root, "b", {"t": "x"})
    assert not publish._announce(spark, root, "b", {"t": "y"})
    assert publish.published_folders(spark, root) == {"t": [f"{root}/t/x"]}
    with pytest.raises(ValueError):
        publish.publish_tables({"t": spark.range(1)}, root, "../b")


def test_usage_is_laid_out_by_day(spark):
    root = scratch(spark, "test-days")
    usage = spark.sql("SELECT id AS usage_id, timestamp'2024-01-01 23:00:00' + make_interval(0,0,0,0,id) AS timestamp FROM range(5)")
    store.ingest_tables({"llm_usage": usage}, root)
    back = publish.read_published(spark, root, "llm_usage")["llm_usage"]
    assert set(back.columns) == {"usage_id", "timestamp", "day"} and back.count() == 5
    assert back.where("day = '2024-01-02'").count() == 4


def test_search_reads_its_buckets_only(spark, views):
    root, some = scratch(spark, "test-search"), views.entities.where("drawing_id % 3 = 0")
    assert search_index.search(spark, root, "steel").isEmpty()
    assert search_index.add_entities(some, root, "a")
    assert not search_index.add_entities(some, root, "a")
    search_index.add_entities(views.entities, root, "b")  # holds the first batch once more
    for query in ("Steel 304", "steel", "STEEL, steel!", "no such words", "skf"):
        found = search_index.search(spark, root, query)
        assert rows(found, "entity_id") == rows(extract.entity_search(views.entities, query), "entity_id")
    assert search_index.search(spark, root, " ,").isEmpty()
    plan = search_index.search(spark, root, "Steel 304")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(token, [304,steel])" in plan


def test_manifest_of_small_and_large_files(spark, tmp_path):
    bodies = {"a.pdf": b"%PDF-1.7 body", "b c%20d.pdf": b"%PDF-" + b"x" * 5000, "e.pdf": b"%", "f.pdf": b"no" * 3000}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    for row_bytes in (0, 100, 1 << 20):
        found = {r["path"].rsplit("/", 1)[1]: r for r in files.file_manifest(spark, str(tmp_path), row_bytes=row_bytes).collect()}
        assert set(found) == set(bodies)
        for name, body in bodies.items():
            r = found[name]
            assert r["digest"] == hashlib.sha256(body).hexdigest() and r["length"] == len(body)
            assert r["header_ok"] == body.startswith(b"%PDF-") and r["size_ok"]


def test_manifest_of_a_file_beyond_a_row(spark, tmp_path):
    with open(tmp_path / "huge.pdf", "wb") as out:
        out.write(b"%PDF-")
        out.truncate(2_300_000_000)  # sparse, more than one row can hold
    found = files.file_manifest(spark, str(tmp_path)).first()
    assert found["header_ok"] and not found["size_ok"] and found["length"] == 2_300_000_000 and len(found["digest"]) == 64


@pytest.mark.parametrize("crowd", [1, 20, 10_000])
def test_crowded_hashes_against_all_pairs(spark, crowd):
    draw = random.Random(4)
    base = draw.getrandbits(64)
    near = [base ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 7))) for _ in range(150)]
    shared = [(0xABCD << 48) | draw.getrandbits(48) for _ in range(80)]  # one common key of two bands
    hashes = near + shared + near[:5]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    df = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(hashes)], "vec_id long, hash long")
    got = rows(fingerprint.similar_hashes(df, crowd=crowd), "a", "b", "similarity")
    head = {}
    for i, h in enumerate(hashes):
        head.setdefault(h, i)
    wanted = [(head[h], i, 1.0) for i, h in enumerate(hashes) if head[h] != i]
    some = sorted((i, h) for h, i in head.items())
    wanted += [
        (i, j, round(1 - (g ^ h).bit_count() / 64, 9))
        for i, g in some for j, h in some if i < j and (g ^ h).bit_count() <= 6
    ]
    assert got == sorted(wanted)
