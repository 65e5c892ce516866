"""Near duplicates by Jaccard similarity of word shingles: SimHash candidates in tiles, then whole sets.

Texts with equal sets of shingles are one class, so copies are never compared. A class has a SimHash of 256 bits over
its different shingles. Sets that reach ``LEAST`` / ``OF`` differ in at most ``RADIUS`` bits but for about one pair in a
million (a bit differs with probability 0.15 at the limit, 0.19 for the smallest sets), while unrelated sets
differ in 128 on average. Classes lie in bands of set size and are dealt into tiles; a pair of tiles whose sizes can
reach the limit, and whose population counts lie within the radius, is one numpy block of exclusive-or and bit
counts, two words first. A block hands on a spanning set of its candidate links.

What the links connect is compared by whole sets: small components many to a task, large ones in
pairs of blocks of bounded size. An upper bound of the shared shingles, from counts in ``BUCKETS`` buckets,
rules out most pairs; pairs that are connected already are skipped, as only groups are wanted.

At scale: texts move once to meet their components, and again only if they have a candidate. Tiled
comparison is quadratic in the number of classes within a band of sizes.

Behaviour at the edges: null and wordless texts are one class; a text of fewer words than a shingle is
one shingle; very long texts are compared whole; of ties the smallest id and then text digest stays; repeated rows have
one class; null ids come last; an empty table gives an empty result; other columns, whatever their names, are untouched.
Shingles and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from planmark.llm.common import bound_batches, text_of
from planmark.llm.components import components
from planmark.llm.simhash import first_of_groups, shingle_hashes
from planmark.session import cut_lineage

SHINGLE = 5
#: The limit as a fraction.
LEAST, OF = 4, 5
#: Bits of a fingerprint of 256 that may differ, and of its first 128.
RADIUS, HALF = 80, 46
#: Bands of set size between a size and the largest that it can be similar to.
STEPS = 4
#: Classes of a tile; shingles of a task or block of whole sets; buckets of the upper bound.
TILE, BLOCK, BUCKETS = 4096, 4_000_000, 1024
_WORDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """The different shingles of ``text`` as sorted hashes."""
    return np.unique(np.array(shingle_hashes(text, width), dtype=np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles reach the limit."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return OF * shared >= LEAST * (len(a) + len(b) - shared)


_SHIFT = np.arange(8, dtype=np.int64) * 256
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def words(found: np.ndarray) -> list[int]:
    """Four words of 64 bits, signed: bit by bit the majority over mixed hashes of the set."""
    out = []
    for constant in _WORDS:
        mixed = (found ^ (found >> np.uint64(31))) * constant
        mixed ^= mixed >> np.uint64(29)
        octets = mixed.astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = np.bincount((octets + _SHIFT).ravel(), minlength=2048).reshape(8, 256) @ _BITS
        bits = (2 * ones.ravel() > len(found)).astype(np.uint8)
        out.append(int(np.packbits(bits, bitorder="little").view("<i8")[0]))
    return out


_CLASS = pa.struct([("f", pa.int64()), ("n", pa.int32()), ("w", pa.list_(pa.int64()))])


def classes(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_id, f, n, w) for every row: class, number of shingles, fingerprint."""
    bound_batches(df)
    narrow = df.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("t"))

    @F.arrow_udf("struct<f:long,n:int,w:array<long>>")
    def described(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                found = shingles(x)
                f = int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))
                out.append({"f": f, "n": len(found), "w": words(found)})
            yield pa.array(out, _CLASS)

    return narrow.select("doc_id", F.md5("t").alias("text_id"), described.asNondeterministic()("t").alias("c")).select(
        "doc_id", "text_id", "c.*"
    )


def tiles(single: DataFrame) -> DataFrame:
    """(band, tile, members): classes (f, n, w) dealt into tiles of their band of sizes."""
    band = F.floor(F.log(F.greatest("n", F.lit(1))) * (STEPS / math.log(OF / LEAST))).cast("int")
    placed = single.withColumn("band", band)
    # a band for each quarter step of a logarithm: a few hundred rows
    dealt = placed.groupBy("band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("n_tiles"))
    number = F.pmod(F.xxhash64("f"), F.col("n_tiles")).cast("int")
    return placed.join(dealt, "band").groupBy("band", number.alias("tile")).agg(F.collect_list(F.struct("f", "n", "w")).alias("members"))


def _arrays(members: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = members.values
    f, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("f", "n"))
    w = flat.field("w").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 4)
    return f, n, w


def compared(mine: tuple, other: tuple, same: bool, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Candidate links (a, b) between two tiles; where they are many, as many as connect the same classes."""
    (f, n, w), (g, m, v) = mine, other
    ones = [np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (w, v)]
    if not len(f) or not len(g) or ones[0].min() - ones[1].max() > RADIUS or ones[1].min() - ones[0].max() > RADIUS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = [], []
    for a in range(0, len(f), rows):
        part = slice(a, a + rows)
        near = np.bitwise_count(w[part, 0][:, None] ^ v[:, 0][None, :])
        near += np.bitwise_count(w[part, 1][:, None] ^ v[:, 1][None, :])
        i, j = np.nonzero(near <= HALF)
        i += a
        ok = np.bitwise_count(w[i] ^ v[j]).sum(axis=1, dtype=np.int64) <= RADIUS
        ok &= (OF * np.minimum(n[i], m[j]) >= LEAST * np.maximum(n[i], m[j])) & (f[i] != g[j])
        if same:
            ok &= i < j
        left.append(i[ok])
        right.append(j[ok])
    i, j = np.concatenate(left), np.concatenate(right)
    if len(i) <= len(f) + len(g):
        return f[i], g[j]
    of_left, of_right = np.arange(len(f)), np.arange(len(f), len(f) + len(g))
    if same:
        of_right = of_left
    while True:  # the lowest place that each reaches
        before = of_left.copy(), of_right.copy()
        np.minimum.at(of_right, j, of_left[i])
        np.minimum.at(of_left, i, of_right[j])
        if (before[0] == of_left).all() and (before[1] == of_right).all():
            break
    if same:
        used = np.unique(np.concatenate((i, j)))
        a, b = f[used], f[of_left[used]]
    else:
        used, met = np.unique(i), np.unique(j)
        a, b = np.concatenate((f[used], g[met])), f[np.concatenate((of_left[used], of_right[met]))]
    apart = a != b
    return a[apart], b[apart]


def candidates(single: DataFrame) -> DataFrame:
    """(a, b): links that connect every two classes (f, n, w) within the radius."""
    laid = cut_lineage(tiles(single).withColumn("tile_id", F.struct("band", "tile")))
    ids = laid.select("tile_id")
    other = laid.select(F.col("tile_id").alias("other_id"), F.col("members").alias("others"))
    steps = F.explode(F.array(*[F.lit(k) for k in range(STEPS + 2)]))
    met = (
        ids.withColumn("step", steps).withColumn("to", F.col("tile_id.band") + F.col("step"))
        .join(ids.select(F.col("tile_id.band").alias("to"), F.col("tile_id").alias("other_id")), "to")
        .filter("step > 0 or tile_id.tile <= other_id.tile").select("tile_id", "other_id")
    )
    pairs = met.join(laid.select("tile_id", "members"), "tile_id").join(other, "other_id")
    pairs = pairs.select("members", "others", (F.col("tile_id") == F.col("other_id")).alias("same"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                a, b = compared(_arrays(batch.column(0)[k]), _arrays(batch.column(1)[k]), batch.column(2)[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def joined(f: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect the similar ones among these sets."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sets, names, sizes = [sets[i] for i in order], [f[i] for i in order], sizes[order]
    counts = np.stack([np.bincount((s % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) for s in sets])
    counts = counts.astype(np.uint16 if counts.max() < 65536 else np.int64)
    root = np.arange(len(sets))
    out = []
    for i in range(len(sets)):
        last = int(np.searchsorted(sizes, sizes[i] * OF // LEAST, side="right"))
        rest = np.arange(i + 1, last)
        rest = rest[root[rest] != root[i]]
        for a in range(0, len(rest), 256):
            part = rest[a : a + 256]
            most = np.minimum(counts[i], counts[part]).sum(axis=1, dtype=np.int64)
            for j in part[OF * most >= LEAST * (sizes[i] + sizes[part] - most)].tolist():
                if root[i] != root[j] and similar(sets[i], sets[j]):
                    out.append((names[i], names[j]))
                    root[root == root[j]] = root[i]
    return out


def verified(df: DataFrame, text: str, single: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): links that connect all similar classes, for candidate components ``roots`` (node, root)."""
    placed = cut_lineage(single.join(roots, F.col("f") == F.col("node")).select("f", "n", "text_id", "root"))
    size = placed.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    total = placed.agg(F.sum("n")).first()[0] or 0
    packs = max(1, -(-total // BLOCK))
    texts = df.select(text_of(text).alias("t")).withColumn("text_id", F.md5("t"))
    placed = placed.join(size, "root").select("f", "text_id", "root", "blocks")
    # a text that stands in many rows is taken once
    found = texts.join(placed, "text_id").groupBy("f", "root", "blocks").agg(F.first("t").alias("t"))
    own = F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = found.select("f", "root", "t", "blocks", own.alias("own"), others.alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    pack = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(packs)).cast("string")).otherwise(
        F.concat_ws("/", "root", low.cast("string"), high.cast("string"))
    )

    def check(table: pa.Table) -> pa.Table:
        groups: dict[int, tuple[list, list]] = {}
        for f, root, t in zip(*(table[k].to_pylist() for k in ("f", "root", "t"))):
            names, sets = groups.setdefault(root, ([], []))
            names.append(f)
            sets.append(shingles(t))
        links = [x for names, sets in groups.values() for x in joined(names, sets)]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return pairs.select(pack.alias("pack"), "f", "root", "t").groupBy("pack").applyInArrow(check, "a long, b long")


def groups_of(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_id, root) for every row of ``df``: root names its group of near duplicates."""
    described = cut_lineage(classes(df, doc_id, text))
    single = cut_lineage(
        described.groupBy("f").agg(F.first("n").alias("n"), F.first("w").alias("w"), F.min("text_id").alias("text_id"))
    )
    near = components(candidates(single.select("f", "n", "w")))
    roots = components(verified(df, text, single.select("f", "n", "text_id"), near)).withColumnRenamed("node", "f")
    return described.select("doc_id", "text_id", "f").join(roots, "f", "left").select(
        "doc_id", "text_id", F.coalesce("root", "f").alias("root")
    )


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: of each group the one with the smallest id (null last), then the
    smallest text digest; of equal rows one."""
    return first_of_groups(df, groups_of(df, doc_id, text), doc_id, text)
