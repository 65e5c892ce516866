import numpy as np
import pytest
from pyspark.sql import functions as F

from planmark.llm import permutation_index as pi

QUERY = "vec_id % 20 = 0"


def exact(rows, k):
    rows = sorted({(i, tuple(v)) for i, v in rows})
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            s = x @ np.array(v)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df, **options):
    out = {}
    for r in pi.neighbours(df, F.expr(QUERY), **options).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for rows in out.values():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, len(rows) + 1))
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(rows, rows[1:]))
    return {q: [(v, s) for _, v, s in rows] for q, rows in out.items()}


@pytest.mark.parametrize("scale", [False, True])
def test_recall_against_brute_force(spark, scale):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scale:  # norms that differ
        x *= draw.uniform(0.5, 1.5, (3000, 1))
    rows = [(i, [float(np.float32(v)) for v in x[i]]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = found(df, pivots=128, prefix=48, shard=700, query_block=60, least=100)
    wanted = exact(rows, 20)
    assert set(got) == set(wanted) and all(len(v) == 20 for v in got.values())
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in wanted[q]}) for q in wanted)
    assert hits / (20 * len(wanted)) >= 0.9
    of = dict(rows)
    for q, near in got.items():
        assert all(abs(s - np.dot(of[q], of[v])) < 1e-9 for v, s in near)


def test_recall_on_the_given_vectors(spark):
    """The query's own settings, in shards so large that the measured share decides and not the floor."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    wanted, got = exact(rows, 20), found(df, shard=1000)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in wanted[q]}) for q in wanted)
    assert hits / (20 * len(wanted)) >= 0.93


def test_ties_copies_and_bad_rows(spark):
    one, two = [1.0, 0.0], [0.6, 0.8]
    nan, inf = float("nan"), float("inf")
    rows = [(i, one) for i in range(0, 90)] + [(i, two) for i in range(90, 110)]
    bad = [(200, None), (220, [0.0, 0.0]), (240, [nan, 1.0]), (260, [None, 1.0]), (280, [inf, 1.0]), (300, [1.0, 2.0, 3.0]), (None, one)]
    df = spark.createDataFrame(rows + [(20, one)] + bad, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    got = found(df)
    assert {q: [v for v, _ in near] for q, near in got.items()} == {q: [v for v, _ in near] for q, near in exact(rows, 20).items()}
    assert found(df.filter("vec_id < 3")) == {0: [(1, 1.0), (2, 1.0)]}
    assert found(df.filter("vec_id = 0")) == {}
    assert found(df.filter("vec_id < 0")) == {}


def test_pivots_leave_out_crowds():
    draw = np.random.default_rng(1)
    crowd = np.tile([1.0, 0, 0, 0], (50, 1)) + draw.normal(0, 1e-3, (50, 4))
    rest = draw.normal(size=(50, 4))
    chosen = pi.choose_pivots(np.vstack([crowd, rest]), 10)
    assert len(chosen) == 10 and (chosen[:, 0] > 0.99).sum() <= 2
    assert len(pi.choose_pivots(crowd, 10)) == 10
