"""File digests and average hashes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from planmark.session import cut_lineage


def duplicate_files(files: DataFrame, key: str, content: str) -> DataFrame:
    """Digests held by more than one file: number of files, first file."""
    return (
        files.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("digest"))
        .agg(F.count("*").alias("files"), F.min(key).alias("first_file"))
        .where(F.col("files") > 1)
    )


def average_hash(cells: Column) -> Column:
    """64 cells of an 8×8 grid to 64 bits, a bit per cell above the mean, first cell highest."""
    values = F.transform(cells, lambda c: c.cast("double"))
    mean = F.aggregate(values, F.lit(0.0), lambda s, c: s + c) / 64
    return F.aggregate(
        values,
        F.lit(0).cast("bigint"),
        lambda bits, c: F.shiftleft(bits, 1).bitwiseOR(F.when(c > mean, F.lit(1)).otherwise(F.lit(0)).cast("bigint")),
    )


#: A key that more hashes share is cut by further bits.
CROWD = 2_048


def similar_hashes(
    hashed: DataFrame, threshold: float = 0.9, bands: int = 8, crowd: int = CROWD
) -> DataFrame:
    """Images whose 64-bit hashes agree in at least ``threshold`` of the bits.

    Images with one and the same hash form a group: the first stands for all, and each other
    member gets one row that names it, so copies give rows, not pairs. Groups are then compared.
    With at most d differing bits, bands−d bands stay equal, so the join key is every choice of
    that many bands; a pair counts only at its first such choice, hence no distinct.

    Where more than ``crowd`` hashes share a key, it is cut once more: of d + 1 pieces, dealt over
    all 64 bits in turn, one at least is equal too. Each piece joins the key, a pair counts at its
    first equal piece, and a crowd falls apart into some 2^(64 / (d + 1)) parts a piece.

    The hashes are written once and read three times. Rows with keys are sorted and merged: a group
    makes dozens of them, which the planner does not foresee, so it would take them for a small side
    and gather them all on the driver.
    """
    most = int((1 - threshold) * 64 + 1e-9)
    equal = bands - most
    if equal < 1:
        raise ValueError("threshold too low for the number of bands")
    if 64 % bands:
        raise ValueError("bands must divide 64")
    width = 64 // bands
    hashed = cut_lineage(hashed.select("vec_id", "hash"))
    groups = hashed.groupBy("hash").agg(F.min("vec_id").alias("head"))
    members = (
        hashed.join(groups, "hash")
        .where(F.col("vec_id") != F.col("head"))
        .select(F.col("head").alias("a"), F.col("vec_id").alias("b"), F.lit(1.0).alias("similarity"))
    )
    band = lambda h, i: F.shiftrightunsigned(h, width * i).bitwiseAND(F.lit((1 << width) - 1))
    keys = F.array(*[
        F.struct(
            F.lit(sum(1 << i for i in choice)).alias("choice"),
            F.xxhash64(*[band(F.col("hash"), i) for i in choice]).alias("digest"),
        )
        for choice in combinations(range(bands), equal)
    ])
    keyed = groups.select("hash", "head", F.explode(keys).alias("k")).select("hash", "head", "k.*")
    masks = [sum(1 << i for i in range(p, 64, most + 1)) for p in range(most + 1)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    part = lambda p: F.col("hash").bitwiseAND(F.lit(signed[p]).cast("bigint"))
    pieces = F.array(*[
        F.struct(F.lit(p).alias("piece"), part(p).alias("bits")) for p in range(most + 1)
    ])
    whole = F.array(F.struct(F.lit(-1).alias("piece"), F.lit(0).cast("bigint").alias("bits")))
    crowded = (
        keyed.groupBy("choice", "digest").agg(F.count("*").alias("n")).where(F.col("n") > crowd).drop("n")
        .withColumn("cut", F.lit(True))
    )
    spread = (
        keyed.join(crowded, ["choice", "digest"], "left")
        .select("hash", "head", "choice", "digest", F.inline(F.when(F.col("cut"), pieces).otherwise(whole)))
    )
    on = ["choice", "digest", "piece", "bits"]
    other = spread.select(F.col("hash").alias("hash2"), F.col("head").alias("head2"), *on)
    apart = F.col("hash").bitwiseXOR(F.col("hash2"))
    band_of_difference = lambda i: F.call_function("shiftrightunsigned", apart, i * width).bitwiseAND(
        F.lit((1 << width) - 1)
    )
    equal_bands = F.filter(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: band_of_difference(i) == 0)
    first = F.aggregate(
        F.slice(equal_bands, 1, equal), F.lit(0), lambda bits, i: bits + F.call_function("shiftleft", F.lit(1), i)
    )
    first_piece = F.coalesce(*[
        F.when(apart.bitwiseAND(F.lit(signed[p]).cast("bigint")) == 0, F.lit(p)) for p in range(most + 1)
    ])
    pairs = (
        spread.hint("merge").join(other, on)
        .where((F.col("head") < F.col("head2")) & (F.bit_count(apart) <= most) & (F.col("choice") == first))
        .where((F.col("piece") == -1) | (F.col("piece") == first_piece))
        .select(
            F.col("head").alias("a"), F.col("head2").alias("b"),
            (1.0 - F.bit_count(apart) / 64.0).alias("similarity"),
        )
    )
    return members.unionByName(pairs)

