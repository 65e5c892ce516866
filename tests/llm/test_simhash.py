import re

import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st

from planmark.llm import simhash
from planmark.llm.components import components


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["A", "bÉ", "c", " x", "ß", " ", "\n", "\x1c", "dd "]), max_size=30))
def test_fingerprint(parts):
    text = " ".join(parts)
    assert simhash.fingerprint(text) % 2**64 == plain(text)


def partition(values, radius):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_groups_against_all_pairs(spark):
    draw = np.random.default_rng(1)
    values = [0, 1, 2**64 - 1, 7, 15]
    for _ in range(40):
        base = int(draw.integers(0, 2**63)) * 2 + 1
        chain = base
        for _ in range(int(draw.integers(1, 8))):
            values.append(chain)
            for bit in draw.integers(0, 64, int(draw.integers(1, 5))):
                chain ^= 1 << int(bit)
    values = sorted(set(values))
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "f long")
    for tile in (4, 512):
        found = {r["f"] % 2**64: r["root"] for r in simhash.group(df, tile=tile).collect()}
        wanted = partition(values, simhash.RADIUS)
        groups = {}
        for v, w in zip(values, wanted):
            groups.setdefault(w, set()).add(found[v])
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_a_crowd_gives_few_links(spark):
    values = sorted({(1 << a) | (1 << b) for a in range(64) for b in range(64)} - {1 << 63})
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "f long")
    made = simhash.links(df).count()
    assert made <= 40 * len(values) < len(values) ** 2 / 8
    assert len({r["root"] for r in simhash.group(df).collect()}) == 1


def test_components_of_a_long_chain(spark):
    n = 300
    links = spark.createDataFrame([((i * 7919) % n, ((i + 1) * 7919) % n) for i in range(n - 1)] + [(1000, 1001), (5, 5)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert {roots[i] for i in range(n)} == {0} and roots[1001] == 1000 and len(roots) == n + 2
    assert components(links.filter("a < 0")).count() == 0


def test_edges_of_the_operator(documents):
    same = "the quick brown fox jumps over the lazy dog again and again"
    df = documents(
        (7, same), (3, same.upper()), (3, same.upper()), (None, same), (9, None), (8, ""), (4, " \n\t "), (5, "alone here"),
        (None, "nobody names this one"), fingerprint="clash", component_id=0, s_id=1,
    )
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == 9
    by_text = {}
    for r in rows:
        by_text.setdefault((r["doc_id"], r["component_id"]), r["fingerprint"])
    assert {k for k in by_text} == {(7, 3), (3, 3), (None, 3), (9, 4), (8, 4), (4, 4), (5, 5), (None, None)}
    assert by_text[(9, 4)] == "0" * 16
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 3), (False, 4), (False, 5), (True, None)]
    assert simhash.near_duplicates(df.filter("doc_id > 99")).count() == 0
