"""Repeated strings against a plain dictionary of all strings of 50 bytes."""

import hashlib
import random

import numpy as np
import pytest

from planmark.llm import suffix_index
from planmark.llm.queries import Q


def expected(rows):
    last = 2**63 - 1
    texts = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    lowest = {}
    for i, t in texts:
        for a in range(len(t) - 49):
            s = t[a : a + 50]
            if lowest.get(s, last + 1) > i:
                lowest[s] = i
    out = []
    for (doc, _), (i, t) in zip(rows, texts):
        gone = np.zeros(len(t) + 1, dtype=bool)
        for a in range(len(t) - 49):
            if lowest[t[a : a + 50]] < i:
                gone[a : a + 50] = True
        gone = gone[: len(t)]
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int(np.sum(gone & ~np.concatenate(([False], gone[:-1])))) if len(t) else 0
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    found = suffix_index.remove_repeats(df, with_text=True).collect()
    for r in found:
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found), key=repr)


def texts(n, seed=4):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh é") for _ in range(draw.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(draw.choice([6, 12, 15, 40]))) for _ in range(8)]
    passages += ["x" * 70, "ab" * 60, "\0" * 80, passages[0][:49], passages[0][:50], passages[1][10:65]]
    out = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(draw.randrange(1, 30))) for _ in range(draw.randrange(1, 5))]
        for _ in range(draw.randrange(3)):
            parts.insert(draw.randrange(len(parts) + 1), draw.choice(passages))
        out.append((i * 3, " ".join(parts)))
    return out


EDGES = [(None, None), (None, "n" * 60), (None, "n" * 60), (1, ""), (2, "short"), (3, "short"), (7, "same words " * 20), (7, "same words " * 20), (8, "same words " * 20), (9, "q" * 50), (10, "q" * 49)]


def test_against_all_strings(documents):
    rows = texts(150) + EDGES + [(1000, "lead " + texts(150)[3][1]), (1001, texts(150)[3][1]), (0, texts(150)[5][1])]
    assert result(documents(*rows, digest=1, place="x", batch=2, shard=3, spans=4)) == expected(rows)


@pytest.mark.parametrize("strings", [1, 400])
def test_many_levels_as_one(monkeypatch, strings):
    monkeypatch.setattr(suffix_index, "STRINGS", strings)
    rows = texts(80, 9)
    rows = [(i, t.encode()) for i, t in rows if len(t.encode()) >= 50]
    body, ids = b"".join(t for _, t in rows), np.array([i for i, _ in rows])
    sizes = np.array([len(t) for _, t in rows])
    which, a, b = suffix_index.repeated(ids, sizes, np.frombuffer(body, np.uint8))
    gone = [np.zeros(n, dtype=bool) for n in sizes]
    for w, x, y in zip(which, a, b):
        gone[w][x:y] = True
    want = {i: n for i, _, n, _, _ in expected([(i, t.decode()) for i, t in rows])}
    assert {i: int(g.sum()) for i, g in zip(ids.tolist(), gone)} == want


def test_levels_grow_geometrically():
    family = suffix_index.Family()
    for i in range(13):
        keys = np.array([b"%050d" % (i * 10 + k) for k in range(10)], dtype="S50")
        assert not family.add(keys, np.full(10, i)).any()
        assert family.add(keys[:0], np.zeros(0, int)).size == 0
    assert [n for n, _ in family.levels] == [8, 4, 1]
    assert family.add(np.array([b"%050d" % 5, b"%050d" % 999], dtype="S50"), np.array([99, 99])).tolist() == [True, False]


def test_stretches_cover_every_string():
    rows = [t.encode() for _, t in texts(40, 2)]
    doc, first, count, _ = suffix_index.stretches(rows, step=300)
    seen = [(d, p) for d, f, n in zip(doc.tolist(), first.tolist(), count.tolist()) for p in range(f, f + n)]
    assert seen == [(d, p) for d, t in enumerate(rows) for p in range(max(len(t) - 49, 0))]
    again = suffix_index.stretches(rows)
    assert (again[1] == first).all() and (again[2] == count).all()


def test_empty_table(documents):
    assert result(documents((1, "x")).limit(0)) == []


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in Q["op12_suffix_index"](spark, folder).collect()), key=repr)
    assert got == expected(rows)
