"""Alignment against the two libraries and a plain count over all links."""

import hashlib
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from planmark.llm import alignment
from planmark.llm.alignment import byte_level

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
OF = byte_level()
PATHS = (A_PATH, public_tokenizers.PATTERN, B_PATH)


def plain(text):
    """Groups of a text as lists of ids, by the libraries alone."""
    if not text:
        return []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    a_bytes = [bytes(OF[c] for c in A.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [B.id_to_piece(i)]]
    raw = (" " + text).encode()
    if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return []
    ends_a, ends_b = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end), ends_b.index(end)
        out.append((a[i : x + 1], b[j : y + 1]))
        i, j = x + 1, y + 1
    return out


def expected(rows):
    groups = {k: plain(t) for k, (_, t) in enumerate(rows)}
    links = Counter((g[0][-1], g[1][-1]) for found in groups.values() for g in found)
    most = Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    out = []
    for k, (doc, _) in enumerate(rows):
        found = groups[k]
        pairs = [(g[0][-1], g[1][-1]) for g in found]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in found)
        out.append((
            doc, sum(len(x) for x, _ in found), sum(len(y) for _, y in found), len(found), len(found),
            sum(links[p] == most[p[1]] for p in pairs), sum(links[p] for p in pairs),
            hashlib.sha256(text.encode()).hexdigest() if found else "",
        ))
    return sorted(out, key=repr)


ALIGNER = alignment.Aligner(*PATHS)


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'sa.1\xa0　é▁<0x>"), st.characters(exclude_categories=["Cs"])), max_size=50))
def test_any_text_as_the_libraries(text):
    codes = ALIGNER.codes(text)
    want = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in plain(text))
    assert ";".join(ALIGNER.groups[c] for c in codes or []) == want


@pytest.mark.parametrize("text", ["a \xa0 \xa0b", " lead", "trail ", "two  blanks", "x\n\ny z", "<|endoftext|> <s> </s>", "ﬁ ① ½", "日本語 テキスト", "a" * 3000])
def test_cases_as_the_libraries(text):
    codes = ALIGNER.codes(text)
    want = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in plain(text))
    assert ";".join(ALIGNER.groups[c] for c in codes or []) == want


@pytest.mark.parametrize("dense", [3, alignment.DENSE])
def test_planes_round_trip(monkeypatch, dense):
    monkeypatch.setattr(alignment, "DENSE", dense)
    draw = random.Random(5)
    rows = {(draw.choice([3, 9, 2**40, 77]), draw.randrange(alignment.DOCUMENTS)): draw.choice([1, 2, 3, 8, 70_000]) for _ in range(2000)}
    rows |= {(5, d): 1 + d % 5 for d in range(alignment.DOCUMENTS)}
    keys = sorted(rows)
    pairs, docs, links, bitmaps = alignment.planes(*(np.array(x) for x in ([p for p, _ in keys], [d for _, d in keys], [rows[k] for k in keys])))
    assert pairs.tolist() == sorted({p for p, _ in keys})
    assert docs.tolist() == [sum(q == p for q, _ in keys) for p in pairs.tolist()]
    assert links.tolist() == [sum(rows[k] for k in keys if k[0] == p) for p in pairs.tolist()]
    got = Counter()
    for at, found, k in alignment.read_planes(bitmaps):
        for i, d in zip(at.tolist(), found.tolist()):
            got[pairs.tolist()[i], d] += 1 << k
    assert got == rows


TEXTS = [None, "", " ", "plain words here", "plain words here", "plain plain plain words", "a \xa0b", "ﬁ", "x" * 4000, "line\nline\tline  two", "Ünï çödé 日本"]


def result(df):
    return sorted((tuple(r) for r in alignment.align(df, *PATHS).collect()), key=repr)


def test_forgetting_changes_nothing():
    aligner = alignment.Aligner(*PATHS)
    before = [aligner.groups[c] for c in aligner.codes("some words and some words")]
    aligner.forget()
    aligner.codes("other text")
    assert [aligner.groups[c] for c in aligner.codes("some words and some words")] == before


def test_operator_against_plain_counts(documents):
    draw = random.Random(8)
    words = "the quick brown fox jumps over lazy dogs naïve résumé 42 x9".split()
    rows = [(i if i else None, t) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, " ".join(draw.choice(words) for _ in range(draw.randrange(60)))) for i in range(60)] + [(3, TEXTS[3])]
    df = documents(*rows, pair=1, chunk=2, n_a="clash", kind=None)
    assert result(df) == expected(rows)


def test_empty_table(documents):
    assert result(documents((1, "x")).limit(0)) == []


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(df) == expected([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


SCHEMA = pa.schema([
    ("kind", pa.string()), ("chunk", pa.int64()), ("idx", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("pair", pa.int64()), ("docs", pa.int64()), ("links", pa.int64()), ("planes", pa.binary()),
])


def task(monkeypatch, rows, aligner):
    """Batches that one task writes for ``rows``."""
    monkeypatch.setattr(alignment, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    chunk = alignment._Chunk(SCHEMA, aligner)
    for row in rows:
        chunk.add(*row)
        if chunk.full:
            yield from chunk.rows()
    if chunk.ids:
        yield from chunk.rows()


def gathered(batches):
    """The operator's rows from what tasks write, added up link by link."""
    docs, held, links = {}, [], Counter()
    for r in (r for batch in batches for r in batch.to_pylist()):
        if r["kind"] == "docs":
            docs[r["chunk"], r["idx"]] = r
        else:
            links[r["pair"]] += r["links"]
            held += [(r["chunk"], d, r["pair"], 1 << k) for _, found, k in alignment.read_planes([r["planes"]]) for d in found.tolist()]
    most = Counter()
    for pair, n in links.items():
        most[pair % 2**24] = max(most[pair % 2**24], n)
    best, total = Counter(), Counter()
    for chunk, d, pair, times in held:
        total[chunk, d] += times * links[pair]
        best[chunk, d] += times * (links[pair] == most[pair % 2**24])
    return sorted(
        ((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_groups"], best[k], total[k], r["groups_sha256"]) for k, r in docs.items()), key=repr
    )


@pytest.mark.parametrize("block, postings, slice_, remembered", [(1, 1, 1, 1), (40, 60, 7, 5000), (300, 10**6, 10**6, 10**8)])
def test_bounds_change_nothing(monkeypatch, block, postings, slice_, remembered):
    for name, value in {"BLOCK": block, "POSTINGS": postings, "SLICE": slice_, "REMEMBERED": remembered}.items():
        monkeypatch.setattr(alignment, name, value)
    draw = random.Random(3)
    words = ["the", "quick", "naïve", "résumé", "42", "x9", "a\n", "\nb", "", "\xa0", "日本語", "brown"]
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(draw.choice(words) for _ in range(draw.randrange(200)))) for i in range(30)]
    rows += [(200, "plain words " * 100 + "▁" + " more words" * 100), (201, "plain words " * 100)]  # the first has no tokens
    batches = list(task(monkeypatch, rows, alignment.Aligner(*PATHS)))
    assert gathered(batches) == expected(rows)
    assert not plain(rows[-2][1]) and plain(rows[-1][1])
    if block < 300:
        assert len({b["chunk"][0].as_py() for b in batches}) > 5


def test_memory_of_a_task_does_not_grow_with_its_texts(monkeypatch):
    """Two workers of an executor once took 950 MB each, for texts of 26 MB."""
    aligner = alignment.Aligner(*PATHS)
    text = "plain words here and there " * 10_000
    aligner.codes(text)
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in task(monkeypatch, ((i, text if i < 38 else text * 8) for i in range(40)), aligner))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows > 40 and peak < 60_000_000


def test_units_of_long_ago_are_forgotten(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 1_000_000)
    monkeypatch.setattr(alignment, "BLOCK", 10_000)
    draw = random.Random(4)
    aligner, most = alignment.Aligner(*PATHS), 0
    monkeypatch.setattr(alignment, "DOCUMENTS", 1)  # so that every document is looked at
    ends = ["", " ▁"]  # half of the texts have no tokens
    rows = ((i, "often " + " ".join("".join(draw.choices("abcdefgh", k=9)) for _ in range(100)) + ends[i % 2]) for i in range(200))
    for _ in task(monkeypatch, rows, aligner):
        most = max(most, len(aligner.known) + len(aligner.older[0]))
    assert 0 < most < 6_000  # of 20,000
    assert "often" in aligner.known or "often" in aligner.older[0]


SCHEMA = pa.schema([
    ("kind", pa.string()), ("chunk", pa.int64()), ("idx", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("pair", pa.int64()), ("docs", pa.int64()), ("links", pa.int64()), ("planes", pa.binary()),
])


def task(monkeypatch, rows, aligner):
    """Batches that one task writes for ``rows``."""
    monkeypatch.setattr(alignment, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    chunk = alignment._Chunk(SCHEMA, aligner)
    for row in rows:
        chunk.add(*row)
        if chunk.full:
            yield from chunk.rows()
    if chunk.ids:
        yield from chunk.rows()


def gathered(batches):
    """The operator's rows from what tasks write, added up link by link."""
    docs, held, links = {}, [], Counter()
    for r in (r for batch in batches for r in batch.to_pylist()):
        if r["kind"] == "docs":
            docs[r["chunk"], r["idx"]] = r
        else:
            links[r["pair"]] += r["links"]
            held += [(r["chunk"], d, r["pair"], 1 << k) for _, found, k in alignment.read_planes([r["planes"]]) for d in found.tolist()]
    most = Counter()
    for pair, n in links.items():
        most[pair % 2**24] = max(most[pair % 2**24], n)
    best, total = Counter(), Counter()
    for chunk, d, pair, times in held:
        total[chunk, d] += times * links[pair]
        best[chunk, d] += times * (links[pair] == most[pair % 2**24])
    return sorted(
        ((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_groups"], best[k], total[k], r["groups_sha256"]) for k, r in docs.items()), key=repr
    )


@pytest.mark.parametrize("block, postings, slice_, remembered", [(1, 1, 1, 1), (40, 60, 7, 5000), (300, 10**6, 10**6, 10**8)])
def test_bounds_change_nothing(monkeypatch, block, postings, slice_, remembered):
    for name, value in {"BLOCK": block, "POSTINGS": postings, "SLICE": slice_, "REMEMBERED": remembered}.items():
        monkeypatch.setattr(alignment, name, value)
    draw = random.Random(3)
    words = ["the", "quick", "naïve", "résumé", "42", "x9", "a\n", "\nb", "", "\xa0", "日本語", "brown"]
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(draw.choice(words) for _ in range(draw.randrange(200)))) for i in range(30)]
    rows += [(200, "plain words " * 100 + "▁" + " more words" * 100), (201, "plain words " * 100)]  # the first has no tokens
    batches = list(task(monkeypatch, rows, alignment.Aligner(*PATHS)))
    assert gathered(batches) == expected(rows)
    assert not plain(rows[-2][1]) and plain(rows[-1][1])
    if block < 300:
        assert len({b["chunk"][0].as_py() for b in batches}) > 5


def test_memory_of_a_task_does_not_grow_with_its_texts(monkeypatch):
    """Two workers of an executor once took 950 MB each, for texts of 26 MB."""
    aligner = alignment.Aligner(*PATHS)
    text = "plain words here and there " * 10_000
    aligner.codes(text)
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in task(monkeypatch, ((i, text if i < 38 else text * 8) for i in range(40)), aligner))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows > 40 and peak < 60_000_000


def test_units_of_long_ago_are_forgotten(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 1_000_000)
    monkeypatch.setattr(alignment, "BLOCK", 10_000)
    draw = random.Random(4)
    aligner, most = alignment.Aligner(*PATHS), 0
    monkeypatch.setattr(alignment, "DOCUMENTS", 1)  # so that every document is looked at
    ends = ["", " ▁"]  # half of the texts have no tokens
    rows = ((i, "often " + " ".join("".join(draw.choices("abcdefgh", k=9)) for _ in range(100)) + ends[i % 2]) for i in range(200))
    for _ in task(monkeypatch, rows, aligner):
        most = max(most, len(aligner.known) + len(aligner.older[0]))
    assert 0 < most < 6_000  # of 20,000
    assert "often" in aligner.known or "often" in aligner.older[0]
