import hashlib
import random
from collections.abc import Iterator

import pyarrow as pa
import pytest

from planmark.llm import line_chunks as lc


def expected(rows):
    """Brute force over all passages of two lines and all long lines, without chunks."""
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest())
    seen, out = set(), {}
    for doc_id, text in sorted({r for r in rows if r[1] is not None}, key=order):
        lines = text.split("\n")
        filled = [i for i, x in enumerate(lines) if x.strip()]
        passages = [(a, b) for a, b in zip(filled, filled[1:])]
        passages += [(a, a) for a in filled if len(lines[a].split()) >= 50]
        gone = set()
        for a, b in sorted(passages):
            body = "\n".join(lines[a : b + 1])
            if body in seen:
                gone.update(range(a, b + 1))
            seen.add(body)
        runs = sum(1 for i in gone if i - 1 not in gone)
        out[(doc_id, text)] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), runs)
    out.update({r: (None, 0) for r in rows if r[1] is None})
    return out


def corpus(draw, n):
    pool = [[f"line {draw.random()}" for _ in range(draw.randint(1, 12))] for _ in range(8)]
    pool += [[f"top {i}", "", f"below {i}"] for i in range(3)] + [[" ".join(f"w{i}x{j}" for j in range(60))] for i in range(3)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(draw.randint(0, 5)):
            lines += draw.choice(pool) if draw.random() < 0.5 else [f"own {draw.random()}"] * draw.randint(1, 3)
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("copies", [1, 1000])
def test_against_brute_force(documents, monkeypatch, copies):
    monkeypatch.setattr(lc, "COPIES", copies)
    rows = corpus(random.Random(4), 120)
    rows += [(500, rows[7][1]), (501, rows[7][1]), (None, rows[9][1]), (3, rows[3][1]), (502, None), (503, ""), (504, "\n\n\n\n\n")]
    rows += [(505, "a\nb\na\nb\nc"), (506, "a\na\na\na"), (507, " \na\n\nb\n\nc")]
    df = documents(*rows, chunk_id="clash", chunk_clean="kept", first=1)
    out = lc.dedup_lines(df, out="clean", count="removed").collect()
    assert len(out) == len(rows)
    wanted = expected(rows)
    for r in out:
        assert (r["clean"], r["removed"]) == wanted[(r["doc_id"], r["text"])], r["doc_id"]
        assert (r["chunk_id"], r["chunk_clean"], r["first"]) == ("clash", "kept", 1)
    assert sum(r["removed"] for r in out) > 20


def test_every_repeated_passage_goes(documents):
    """Passages of 1 to 6 lines and over 50 words, and pairs of short lines, between foreign lines."""
    draw, rows, passages = random.Random(8), [], {}
    own = lambda: f"own {draw.random()}"
    for size in range(1, 7):
        for k in range(10):
            words = 60 // size + 1
            passages[size, k] = [" ".join(f"p{size}x{k}x{i}x{j}" for j in range(words)) for i in range(size)]
    passages |= {(0, k): [f"short {k}", f"shorter {k}"] for k in range(10)}
    for turn in range(3):
        for lines in passages.values():
            rows.append((len(rows), "\n".join([own(), own(), *lines, own(), own()])))
    out = {r["doc_id"]: r["text"].split("\n") for r in lc.dedup_lines(documents(*rows)).collect()}
    for doc_id, text in rows:
        lines = text.split("\n")
        assert out[doc_id] == (lines if doc_id < len(passages) else lines[:2] + lines[-2:])


def test_boundaries_resist_shifts():
    draw = random.Random(1)
    passage = [f"shared {draw.random()}" for _ in range(60)]
    whole = {passage[i] for i in lc.chunk_ends(passage)[:-1]}
    found = {["x", "y", *passage, "z"][i] for i in lc.chunk_ends(["x", "y", *passage, "z"])}
    assert len(whole - found) <= 1 and 10 < len(whole) < 35


def test_every_pair_lies_in_one_chunk():
    for lines in (["a"] * 500, ["a", "", "b", " ", "c"], [f"l{i}" for i in range(300)]):
        filled = [i for i, x in enumerate(lines) if x.strip()]
        pairs = [p for _, _, inside in lc.chunks(lines) for p in inside]
        assert pairs == [(a, b + 1) for a, b in zip(filled, filled[1:])]
        for first, after, inside in lc.chunks(lines):
            assert all(first <= a and b <= after for a, b in inside)
    assert list(lc.chunks([""])) == [] and list(lc.chunks(["one short line"])) == []


def test_unequal_bytes_stay(documents, monkeypatch):
    """Equal digests of different bytes: the bytes decide, through the whole operator."""
    rows = [(1, "a\nb\nc"), (2, "d\ne\nf"), (3, "a\nb\nc"), (4, "d\ne\nf")]
    assert sorted(r["c_id"] for r in lc.removals(documents(*rows)).collect()) == [3, 4]
    real = lc._digests

    def colliding(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for found in real(batches):
            chunks = found.flatten()
            same = [pa.array([7] * len(chunks), pa.int64())] * 2
            fields = [chunks.field("first"), chunks.field("after"), *same, chunks.field("inside")]
            chunks = pa.StructArray.from_arrays(fields, ["first", "after", "h1", "h2", "inside"])
            yield pa.ListArray.from_arrays(found.offsets, chunks)

    monkeypatch.setattr(lc, "_digests", colliding)
    out = {r["doc_id"]: r["text"] for r in lc.dedup_lines(documents(*rows)).collect()}
    assert out[1] == "a\nb\nc" and out[2] == out[4] == "d\ne\nf" and out[3] == ""


def test_empty_table(documents):
    none = documents((1, "x")).filter("doc_id > 1")
    assert lc.dedup_lines(none).count() == 0
