import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from planmark.operators import near_text
from tests.conftest import rows


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").strip(" ").lower())
    return frozenset(" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def expected(data, least=0.8):
    sets = [shingles(t) for _, t in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(data)), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] == sets[b] or shared / max(1, len(sets[a] | sets[b])) >= least:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    same, group = {}, {}
    for k, (i, _) in enumerate(data):
        same[sets[k]] = min(i, same.get(sets[k], i))
        group[find(k)] = min(i, group.get(find(k), i))
    return sorted((i, same[sets[k]], group[find(k)]) for k, (i, _) in enumerate(data))


def corpus(seed=5):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = ["", None, "  \n", "One two", " one TWO ", "a b c d e f"]
    for size in (3, 6, 12, 30, 60, 150, 400) * 3:
        base = draw.choices(words, k=size)
        for _ in range(6):
            edited = list(base)
            for k in draw.sample(range(size), min(size, draw.randint(0, 1 + size // 40))):
                edited[k] = draw.choice(words)
            texts.append(" ".join(edited))
    return [(i * 2 + 1, t) for i, t in enumerate(draw.sample(texts, len(texts)))]


def found(spark, data, **options):
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("f", F.lit(1)).withColumn("t", F.lit("x")).repartition(4)
    return rows(near_text.near_duplicate_text(df, **options), "doc_id", "text_id", "group_id")


def test_against_all_pairs(spark):
    data = corpus()
    assert found(spark, data) == expected(data)
    wanted = expected(data)
    assert any(g != i for i, _, g in wanted) and any(t != g for _, t, g in wanted)


def test_crowded_bucket_splits(spark, monkeypatch):
    """One bucket for all texts of a passage: split into blocks, nothing is lost."""
    monkeypatch.setattr(near_text, "BLOCK", 7)
    draw = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    passage = draw.choices(words, k=60)
    data = [(i, " ".join(passage + draw.choices(words, k=draw.randint(0, 30)))) for i in range(120)]
    assert found(spark, data) == expected(data)


def test_bands_find_pairs_at_the_limit():
    draw = np.random.default_rng(2)
    missed = 0
    for _ in range(400):
        a = draw.integers(0, 2**63, 90).astype(np.uint64)
        b = np.concatenate((a[:80], draw.integers(0, 2**63, 10).astype(np.uint64)))
        missed += not set(near_text.band_keys(a)) & set(near_text.band_keys(b))
    assert missed == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_text.near_duplicate_text(df).count() == 0
