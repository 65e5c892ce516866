import pytest
from pyspark.sql import functions as F

from planmark.llm import mixing
from planmark.session import cut_lineage


def shares(sizes):
    """Targets by resharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return {**fixed, **share}
        fixed |= {s: 3.0 * sizes[s] for s in over}


ROWS = [(i, "w " * (1 + i * 7 % 23), "en", s) for i, s in enumerate(["a"] * 5 + ["b"] * 400 + ["ü"] * 60 + [None] * 30 + ["Z"] * 9)]


@pytest.mark.parametrize("per_range", [4, 4096])
def test_targets_and_taken(documents, per_range):
    df = documents(*ROWS, (None, None, "en", "b"), (7, ROWS[7][1], "en", "b"), (7, ROWS[7][1], "en", "b"), size="x", m_id=4, target=1)
    rows = mixing.mix(df, rows_per_range=per_range).collect()
    assert len(rows) == len(ROWS) + 3
    sizes, taken = {}, {}
    for r in rows:
        assert r["size"] == len((r["text"] or "").split())
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    wanted = shares(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - wanted[r["source"]]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= 12, s
    assert abs(sum(taken.values()) - sum(sizes.values())) <= 30


def test_ranges_and_partitions_change_nothing(documents):
    df = documents(*ROWS)
    runs = [
        {(r["doc_id"], r["taken"]) for r in mixing.mix(d, rows_per_range=n).collect()}
        for d, n in ((df, 3), (df.repartition(7), 4096), (df.coalesce(1), 50))
    ]
    assert runs[0] == runs[1] == runs[2]


def test_better_documents_are_taken_more(documents):
    junk = "### $$$ *** |||"
    df = documents(*[(i, (junk if i % 2 else "good old plain words") + " x" * 6, "en", "b" if i % 5 else "a") for i in range(600)])
    rows = mixing.mix(df.filter("source = 'b'").union(df.filter("source = 'a'"))).collect()
    share = lambda odd: sum(r["taken"] for r in rows if r["source"] == "b" and r["doc_id"] % 2 == odd)
    assert share(0) > 1.2 * share(1)


def test_apply_repeats_rows(documents):
    df = documents(*ROWS, m_repeat="clash", size=-5, m_id="mine", taken=None, u0=7)
    mixed = mixing.mix(documents(*ROWS)).agg(F.sum("taken")).first()[0]
    out = cut_lineage(mixing.apply_mix(df))
    assert out.columns == df.columns
    assert [tuple(r) for r in out.select("m_repeat", "size", "m_id", "taken", "u0").distinct().collect()] == [
        ("clash", -5, "mine", None, 7)
    ]
    assert out.agg(F.sum(F.regexp_count("text", F.lit("w")))).first()[0] == mixed


def test_edges(documents):
    assert mixing.mix(documents((1, "x")).filter("doc_id > 1")).count() == 0
    blank = mixing.mix(documents((1, None), (2, " \n"), (None, ""))).collect()
    assert {(r["size"], r["taken"], r["target"]) for r in blank} == {(0, 0, 0.0)}
    alone = mixing.mix(documents((1, "one two three"))).collect()[0]
    assert (alone["target"], alone["taken"]) == (3.0, 3)


def test_documents_without_ids_draw_each_for_themselves(documents):
    df = documents(*[(None, f"words of document {i}", "en", "b") for i in range(400)], (1, "a b c", "en", "a"))
    measured = mixing.measure(df)
    key = mixing.sample_key(F.col("m_id"), F.col("m_source"), F.col("m_text"), F.col("m_weight"))
    assert measured.select(key).distinct().count() == 401


def test_a_given_weight_decides(documents):
    texts = [(i, f"word{i} " * 8, "en", "b" if i % 5 else "a") for i in range(600)]
    df = documents(*texts).withColumn("w", F.when(F.col("doc_id") % 2 == 0, 1.0).when(F.col("doc_id") % 3 == 0, float("nan")))
    taken = lambda rows, odd: sum(r["taken"] for r in rows if r["source"] == "b" and r["doc_id"] % 2 == odd)
    rows = mixing.mix(df, weight="w").collect()
    assert taken(rows, 0) > 20 * max(1, taken(rows, 1)) or taken(rows, 1) == 0
    assert mixing.apply_mix(df, weight="w").columns == df.columns
    twice = df.unionByName(df.withColumn("w", F.lit(0.5)))  # one document, two weights: one decision, the higher weight
    assert mixing.mix(twice, weight="w").count() == 1200
