"""The manifest against a plain tree built on the driver."""

import hashlib
import zlib

from pyspark.sql import functions as F

from planmark.llm import merkle
from planmark.llm.queries import remainder


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, text):
    values = (doc["doc_id"], doc["source"], doc["lang"], doc["n_chars"], text)
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests):
    """The root, and for every leaf its siblings level by level as (left, right)."""
    paths = [[] for _ in digests]
    owners, level = [[i] for i in range(len(digests))], digests
    while len(level) > 1:
        up, held = [], []
        for a in range(0, len(level), 3):
            run = level[a : a + 3]
            for k in range(len(run)):
                for i in owners[a + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha(*run))
            held.append(sum(owners[a : a + 3], []))
        level, owners = up, held
    return level[0], paths


def expected(rows, tamper):
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    by, subroots = {}, []
    for s in sources:
        mine = sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        root, paths = tree([leaf(r, r["text"]) for r in mine])
        by[s] = (mine, paths)
        subroots.append(root)
    root, tops = tree(subroots)
    out = []
    for s, subroot, top in zip(sources, subroots, tops):
        for r, path in zip(*by[s]):
            path = path + top
            found = leaf(r, tamper(r))
            for left, right in path:
                found = sha(left, found, right)
            out.append((r["doc_id"], leaf(r, r["text"]), subroot, root, sha(*(a + b for a, b in path)), found, found == root))
    return sorted(out, key=repr)


def cut(r):
    return r["text"].replace("\n", "") if r["text"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 else r["text"]


def tampered():
    return {"text": F.when(remainder(2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


def test_trees_of_many_sizes(documents):
    sizes = [1, 2, 3, 4, 27, 28, 81, 82, 244, 300]
    rows = [(1000 * k + 7 * i, f"text {i}\nwith\nlines", "en", f"source {n}") for k, n in enumerate(sizes) for i in range(n)]
    df = documents(*rows)
    got = sorted((tuple(r) for r in merkle.prove(df, tampered()).collect()), key=repr)
    assert got == expected([r.asDict() for r in df.collect()], cut)


def test_edges(documents):
    rows = [(None, None), (None, "x"), (1, ""), (1, None), (2, "same"), (2, "same"), (2, "same"), (3, "y" * 200_000 + "\n"), (9, "ünï\n")]
    df = documents(*rows, tree=1, lo="x", digest=2, path=3, n=4, level=5).withColumn("lang", F.when(F.col("doc_id") == 9, F.lit(None)).otherwise(F.col("lang")))
    df = df.withColumn("source", F.when(F.col("doc_id") == 1, F.lit(None)).otherwise(F.col("source")))
    got = sorted((tuple(r) for r in merkle.prove(df, tampered()).collect()), key=repr)
    assert got == expected([r.asDict() for r in df.collect()], cut)


def test_empty_table(documents):
    assert merkle.prove(documents((1, "x")).limit(0)).count() == 0


def test_manifest_nodes_nest(documents):
    df = documents(*[(i, str(i)) for i in range(100)])
    leaves = df.select(F.col("source").alias("tree"), F.col("doc_id").alias("key"), merkle.leaf(*map(F.col, merkle.COLUMNS)).alias("digest"))
    nodes = merkle.manifest(merkle.build(merkle.ranked(leaves, ["key", "digest"]))).collect()
    assert len(nodes) == len({(r["level"], r["lo"]) for r in nodes}) == 100 + 34 + 12 + 4 + 2 + 1
    by = {(r["level"], r["lo"]): r for r in nodes}
    for r in nodes:
        inside = sorted((x for x in nodes if x["level"] == r["level"] - 1 and r["lo"] <= x["lo"] and x["hi"] <= r["hi"]), key=lambda x: x["lo"])
        assert r["level"] == 0 or r["digest"] == sha(*(x["digest"] for x in inside))
    assert by[5, 0]["hi"] == 100
