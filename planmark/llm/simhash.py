"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints are one class, so copies are never compared. Classes lie in cells by the
population counts of their four 16-bit quarters. Two fingerprints that differ in r bits differ by r
at most in the sum over the quarters' counts, so a cell meets only the cells within that distance;
all other pairs of tiles are skipped unseen, and nothing within the radius is missed. A cell's
classes are dealt into tiles of about ``TILE``; a pair of tiles is one row and one numpy block of
exclusive-or and bit counts. A block with more links than nodes hands on a spanning set of them, so
that a large group of near copies costs no quadratic output.

Behaviour at the edges: a null or wordless text has fingerprint 0, linked like any other; repeated
rows have one class; a null id never becomes a component's id unless all its ids are null; an empty
table gives an empty result; columns beside id and text are left to the caller's table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from planmark.llm.common import bound_batches, spare, text_of
from planmark.llm.components import components
from planmark.session import cut_lineage

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints on one side of a block, on average where a cell is full.
TILE = 512
_SHIFT = np.arange(8, dtype=np.int64) * 256
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str, width: int = SHINGLE, seed: int = SEED) -> list[int]:
    """Unsigned 64-bit hashes of all word shingles; one of the whole text where it has fewer words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII blanks
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = [0, *ends[: len(words) - width].tolist()]
    return [digest(joined[a:b], seed) for a, b in zip(begins, (ends[width - 1 :] - 1).tolist())]


def fingerprint(text: str, width: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits as a signed number: the majority over the hashes of all word shingles."""
    hashes = shingle_hashes(text, width, seed)
    if not hashes:
        return 0
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.bincount((octets + _SHIFT).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = (2 * ones.ravel() > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds ``out``, the fingerprint of ``text`` as a long."""

    bound_batches(df)

    @F.arrow_udf("long")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(x or "") for x in batch.to_pylist()], pa.int64())

    return df.withColumn(out, hashed.asNondeterministic()(F.col(f"`{text}`").cast("string")))


def _quarter(column: str, i: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(column, 16 * i).bitwiseAND(F.lit(65535).cast("long"))).cast("int")


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of quarter counts within the radius, one of each opposite two."""
    steps = range(-radius, radius + 1)
    return [d for d in product(steps, repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]


def tiles(classes: DataFrame, tile: int = TILE) -> DataFrame:
    """(q0..q3, tile, members): the classes (column ``f``) of a cell dealt into tiles."""
    quarters = [_quarter("f", i).alias(f"q{i}") for i in range(4)]
    placed = classes.select("f", *quarters)
    names = [f"q{i}" for i in range(4)]
    # 17^4 rows at most
    dealt = placed.groupBy(*names).agg(F.ceil(F.count("*") / tile).alias("n_tiles"))
    number = F.pmod(F.xxhash64("f"), F.col("n_tiles")).cast("int")
    return (
        placed.join(dealt, names).withColumn("tile", number)
        .groupBy(*names, "tile").agg(F.collect_list("f").alias("members"))
    )


def _close(mine: np.ndarray, other: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    # unsigned: numpy counts the bits of a negative number's absolute value
    near = np.bitwise_count(mine.view(np.uint64)[:, None] ^ other.view(np.uint64)[None, :]) <= radius
    if same:
        np.fill_diagonal(near, True)
    rows, columns = np.nonzero(near)
    if len(rows) > len(mine) + len(other):  # a spanning set: everyone with the lowest row it reaches
        top = len(mine)
        of_row = np.arange(top)
        while True:
            of_column = np.where(near, of_row[:, None], top).min(axis=0)
            reached = np.where(near, of_column[None, :], top).min(axis=1)
            reached = np.minimum(of_row, reached)
            if (reached == of_row).all():
                break
            of_row = reached
        met = near.any(axis=1)
        left = np.concatenate([mine[met], other[of_column < top]])
        right = mine[np.concatenate([of_row[met], of_column[of_column < top]])]
    else:
        left, right = mine[rows], other[columns]
    apart = left != right
    return left[apart], right[apart]


def links(classes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) between different fingerprints (column ``f``) within the radius: as many as connect all
    that are connected."""
    laid = cut_lineage(tiles(classes, tile))
    steps = F.array(*[F.array(*[F.lit(x) for x in d]) for d in _offsets(radius)])
    target = [(F.col(f"q{i}") + F.col("step")[i]).alias(f"q{i}") for i in range(4)]
    visitors = laid.withColumn("step", F.explode(steps)).select(
        *target, F.col("tile").alias("v_tile"), F.col("members").alias("v_members"),
        F.exists("step", lambda x: x != 0).alias("elsewhere"),
    )
    met = laid.join(visitors, [f"q{i}" for i in range(4)]).filter("elsewhere or tile <= v_tile")
    pairs = met.select("members", "v_members", (~F.col("elsewhere") & (F.col("tile") == F.col("v_tile"))).alias("same"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, same = batch.columns
            found = [
                _close(*(side[i].values.to_numpy(zero_copy_only=False) for side in (left, right)), same[i].as_py(), radius)
                for i in range(len(batch))
            ]
            a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
            b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def group(hashed: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(f, root) for every fingerprint of ``hashed`` (column ``f``): root names its component."""
    classes = cut_lineage(hashed.select("f").distinct())
    roots = components(links(classes, radius, tile)).withColumnRenamed("node", "of")
    return classes.join(roots, F.col("f") == F.col("of"), "left").select("f", F.coalesce("root", "f").alias("root"))


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, tile: int = TILE
) -> DataFrame:
    """(doc_id, text_id, fingerprint, component_id, root) for every row of ``df``.

    ``text_id`` is the digest of the text; ``root`` names the component even where all ids are null.
    """
    narrow = df.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("t"))
    hashed = fingerprints(narrow, "t", "f").select("doc_id", F.md5("t").alias("text_id"), "f")
    hashed = cut_lineage(hashed)
    lowest = hashed.groupBy("f").agg(F.min("doc_id").alias("low"))
    grouped = cut_lineage(lowest.join(group(hashed, radius, tile), "f"))
    named = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    per_class = grouped.join(named, "root").select("f", "root", "component_id")
    return hashed.join(per_class, "f").select(
        "doc_id", "text_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id", "root"
    )


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stay: of each component the one with the smallest id (null last), then
    the smallest text digest; of equal rows one."""
    return first_of_groups(df, near_duplicates(df, doc_id, text, **options), doc_id, text)


def first_of_groups(df: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``keep_one`` for the groups ``found`` (doc_id, text_id, root)."""
    k_id, k_text = spare(df, "k_id", "k_text")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id")
    kept = found.groupBy("root").agg(F.min(first).alias("k")).select(
        F.col("k.doc_id").alias(k_id), F.col("k.text_id").alias(k_text)
    )
    own_id, own_text, no = spare(df, "s_id", "s_text", "s_no")
    rows = df.withColumns({own_id: F.col(f"`{doc_id}`"), own_text: F.md5(text_of(text))})
    stay = rows.join(kept, F.col(own_id).eqNullSafe(F.col(k_id)) & (F.col(own_text) == F.col(k_text)), "left_semi")
    one = Window.partitionBy(own_id, own_text).orderBy(F.lit(0))
    return stay.withColumn(no, F.row_number().over(one)).filter(F.col(no) == 1).select(*df.columns)
