"""Near-duplicate texts of a whole table: MinHash bands find candidates, exact similarity decides.

Texts are compared as sets of word shingles after lower-casing and trimming; two texts are linked when the
Jaccard similarity of their sets reaches ``least``. Texts with equal sets are one class and are never compared. A
signature of ``BANDS`` bands of ``ROWS`` minima misses a pair at the default limit of 0.8 with a probability below
4 in a million. In a band bucket every class is first compared with the bucket's lowest one, so that a
large group of near copies costs a comparison for each member; only classes that are still in different groups then meet each
other, and a bucket of more than ``BLOCK`` of them is split into pairs of blocks that different tasks compare.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from planmark.operators.view_groups import connected_components
from planmark.session import cut_lineage

BANDS, ROWS = 24, 4
#: Classes of a bucket on one side of a block.
BLOCK = 256
_WORDS = re.compile("[^\\x20\\x09-\\x0D]+")
_SEEDS = np.random.default_rng(20).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the different runs of ``width`` words; of the whole where there are fewer; none without words."""
    words = _WORDS.findall(text)
    runs = {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else ()
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(r.encode("utf-8", "surrogatepass")) for r in runs), np.uint64, len(runs)))


def band_keys(found: np.ndarray) -> list[int]:
    """A key for each band of the signature."""
    if not len(found):
        return [0] * BANDS
    lowest = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for a in range(0, len(found), 4096):
        mixed = found[a : a + 4096, None] * _SEEDS[None, :]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        lowest = np.minimum(lowest, mixed.min(axis=0))
    return [
        int(np.uint64(xxhash.xxh3_64_intdigest(lowest[k : k + ROWS].tobytes(), k)).view(np.int64)) for k in range(0, BANDS * ROWS, ROWS)
    ]


_DESCRIBED = pa.struct([("f", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int64())), ("s", pa.list_(pa.int64()))])


def described(texts: DataFrame, width: int) -> DataFrame:
    """Adds ``c``: class, number of shingles, band keys and the set of ``t``."""

    @F.arrow_udf("struct<f:long,n:int,keys:array<long>,s:array<long>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                found = shingle_set(text, width)
                f = int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))
                out.append({"f": f, "n": len(found), "keys": band_keys(found), "s": found.view(np.int64)})
            yield pa.array(out, _DESCRIBED)

    return texts.withColumn("c", cut.asNondeterministic()("t"))


def _close(a: Column, b: Column, shared: Column, least: float) -> Column:
    return shared >= F.lit(least) * (a + b - shared) - F.lit(1e-9)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets (f, n, s) are similar."""
    sides = [sets.select(F.col("f").alias(k), F.col("n").alias(f"n_{k}"), F.col("s").alias(f"s_{k}")) for k in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    return both.filter(_close(F.col("n_a"), F.col("n_b"), F.size(F.array_intersect("s_a", "s_b")), least)).select("a", "b")


def _possible(least: float) -> Column:
    return F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b") - F.lit(1e-9)


def near_duplicate_text(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8, width: int = 5
) -> DataFrame:
    """(doc_id, text_id, group_id) for every row: the smallest id with an equal set of shingles, and the smallest id
    of its group of linked texts.

    Null and wordless texts are one class. Null ids have rows but never name a class that has another id. Repeated rows
    belong to one class; an empty table gives an empty result.
    """
    if not 0.5 <= least <= 1:
        raise ValueError("the bands are laid out for limits from 0.5 to 1")
    narrow = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.lower(F.trim(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))).alias("t"))
    rows = cut_lineage(described(narrow, width).select("doc_id", "c.*"))
    ids = rows.select("doc_id", "f")
    classes = cut_lineage(rows.groupBy("f").agg(F.min("doc_id").alias("text_id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("s").alias("s")))
    sets = classes.select("f", "n", "s")
    places = classes.select("f", "n", F.explode("keys").alias("key"))
    buckets = places.groupBy("key").agg(F.min_by(F.struct("f", "n"), "f").alias("low"), F.count("*").alias("members")).filter("members > 1")
    places = cut_lineage(places.join(buckets, "key"))
    first = places.select(F.col("low.f").alias("a"), F.col("low.n").alias("n_a"), F.col("f").alias("b"), F.col("n").alias("n_b"))
    first = cut_lineage(first.filter("a <> b").filter(_possible(least)).select("a", "b").distinct())
    linked = cut_lineage(_verified(first, sets, least))
    roots = connected_components(linked).select(F.col("node").alias("f"), F.col("component").alias("root"))
    apart = places.select("key", "f", "n").join(roots, "f", "left").withColumn("root", F.coalesce("root", "f"))
    split = apart.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    apart = apart.join(split.filter("r0 <> r1").select("key", "blocks"), "key")
    own = F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int")
    dealt = apart.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = cut_lineage(dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "f", "n", "root"))
    left = dealt.filter("own = i").select("key", "i", "j", F.col("f").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("r_a"))
    right = dealt.filter("own = j").select("key", "i", "j", F.col("f").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("r_b"))
    met = left.join(right, ["key", "i", "j"]).filter("r_a <> r_b and (i <> j or a < b)").filter(_possible(least))
    rest = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    linked = linked.unionByName(_verified(cut_lineage(rest), sets, least))
    roots = connected_components(linked).select(F.col("node").alias("f"), F.col("component").alias("root"))
    named = cut_lineage(classes.select("f", "text_id").join(roots, "f", "left").withColumn("root", F.coalesce("root", "f")))
    lowest = named.groupBy("root").agg(F.min("text_id").alias("group_id"))
    return ids.join(named.join(lowest, "root").select("f", "text_id", "group_id"), "f").select("doc_id", "text_id", "group_id")
