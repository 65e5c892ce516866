import random
import re
from itertools import combinations

import numpy as np

import corpus_pipeline
from planmark.llm import jaccard


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def groups(texts):
    """Brute force: the lowest member of each text's component under Jaccard >= 0.8 of all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(texts)), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] == sets[b] or 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared) > 0:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def corpus(draw):
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(draw.choices(words, k=30))
    texts = []
    for size in (1, 4, 5, 6, 9, 14, 40, 90, 200, 400) * 3:
        base = draw.choices(words, k=size)
        texts.append(" ".join(base))
        for _ in range(5):  # edits at all shares around the limit
            edited = list(base)
            for i in draw.sample(range(size), min(size, draw.randint(0, 1 + size // 40))):
                edited[i] = draw.choice(words)
            texts.append(" ".join(edited[: draw.randint(size * 4 // 5, size)]) + draw.choice(["", " ", " X", " " + passage]))
    texts += [passage + " " + " ".join(draw.choices(words, k=draw.randint(0, 12))) for _ in range(40)]
    return texts + ["", " \n", None, texts[5].upper(), texts[40]]


def test_stage_against_brute_force(spark, documents):
    texts = corpus(random.Random(3))
    wanted = sorted(set(groups(texts)))
    docs = documents(*enumerate(texts), root=1, f="clash")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == wanted
    assert 20 < len(wanted) < len(texts) - 20


def test_tiles_and_blocks_lose_nothing(documents, monkeypatch):
    texts = corpus(random.Random(8))
    monkeypatch.setattr(jaccard, "TILE", 16)
    monkeypatch.setattr(jaccard, "BLOCK", 150)
    found = jaccard.groups_of(documents(*enumerate(texts))).collect()
    wanted = groups(texts)
    pairs = {(r["root"], wanted[r["doc_id"]]) for r in found}
    assert len(found) == len(texts) and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_a_block_of_many_links_hands_on_a_spanning_set():
    draw = np.random.default_rng(4)
    base = np.unique(draw.integers(0, 2**63, 500).astype(np.uint64))
    sets = [np.unique(np.concatenate((base[k:], draw.integers(0, 2**63, k).astype(np.uint64)))) for k in range(60)]
    tile = (np.arange(60), np.array([len(s) for s in sets]), np.array([jaccard.words(s) for s in sets]).view(np.uint64))
    half = tuple(x[::2] for x in tile), tuple(x[1::2] for x in tile)
    for a, b in (jaccard.compared(tile, tile, True), jaccard.compared(*half, False)):
        assert 0 < len(a) <= 120
        root = list(range(60))
        for x, y in zip(a.tolist(), b.tolist()):
            root = [root[x] if r == root[y] else r for r in root]
        assert len(set(root)) == 1


def test_bits_at_the_limit():
    draw = np.random.default_rng(1)
    most = 0
    for size in (4, 5, 8, 12, 20, 45, 100, 450) * 40:
        a = draw.integers(0, 2**63, size).astype(np.uint64)
        extra = draw.integers(0, 2**63, max(1, size // 4)).astype(np.uint64) if size >= 4 else a[:0]
        w, v = (np.array(jaccard.words(np.unique(x))).view(np.uint64) for x in (a, np.concatenate((a, extra))))
        bits = np.bitwise_count(w ^ v)
        most = max(most, int(bits.sum()))
        assert bits[:2].sum() <= jaccard.HALF
    assert 40 < most <= jaccard.RADIUS


def test_edges(documents):
    same = "the quick brown fox jumps over the lazy dog"
    df = documents((7, same), (3, same.upper()), (3, same.upper()), (None, same), (9, None), (8, ""), (5, "alone"), (None, "unnamed"))
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in jaccard.keep_one(df).collect()) == [(False, 3), (False, 5), (False, 8), (True, None)]
    assert jaccard.keep_one(df.filter("doc_id > 99")).count() == 0
