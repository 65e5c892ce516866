"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Each shard of the index posts its vectors
in one inverted file per pivot, with the pivot's place in the vector's order. A query walks the files
of its own nearest pivots and adds up what turns into the footrule distance between the two orders
(pivots that one of them lacks count as the place after the last); the nearest by footrule are then
reranked by the exact inner product in double precision.

Inner products become distances by one more component that fills every vector up to the largest norm;
pivots and orders live in that space, scores do not.

Scale. Equal vectors are one entry, with as many of their smallest ids as a result can need. Shards
hold about ``SHARD`` entries and are met by blocks of queries, so a task holds one shard and one block.
The share of a shard that is reranked is measured, not guessed: a bounded sample of the queries is
compared with every vector, and the footrule ranks of their true neighbours tell which share finds
``RECALL`` of them. Data without structure needs a large one.

Behaviour at the edges: vectors that are null, zero, hold null or non-finite components, have a null
id or another dimension than most vectors (the smaller if tied) take no part; rows with equal id and
vector are one; fewer candidates than asked for give fewer results; ties in score go to the smaller
id; an empty table gives an empty result; other columns, such as a very long text, are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from planmark.session import cut_lineage

PIVOTS, PREFIX = 256, 64
#: Vectors that pivots are chosen from; of those nearer than ``APART`` (a cosine) only the first is one.
PIVOT_SAMPLE, APART = 2_048, 0.8
SHARD, QUERY_BLOCK = 8_192, 4_096
#: Recall that the share of a shard to rerank is chosen for, on so many sampled queries, and its least.
RECALL, PROBES, RERANK_LEAST = 0.96, 128, 100
_INDEX = "shard int, cids binary, lows binary, vectors binary, ends binary, members binary, places binary"


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): the distinct rows that take part, as double vectors."""
    vector = F.col(f"`{embedding}`").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), vector.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    )
    widths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    return rows.filter(F.size("v") == (widths["width"] if widths else 0)).distinct()


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(cid, v, low, ids): one row per distinct vector, with its k + 1 smallest ids."""
    turn = Window.partitionBy("v").orderBy("vec_id")
    first = rows.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= k + 1)
    grouped = first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return grouped.select(F.monotonically_increasing_id().alias("cid"), "v", F.col("ids")[0].alias("low"), "ids")


def _filled(vectors: np.ndarray, largest: float) -> np.ndarray:
    rest = np.maximum(largest**2 - (vectors**2).sum(axis=1), 0.0)
    return np.hstack([vectors, np.sqrt(rest)[:, None]])


def _orders(filled: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    return np.argsort(-(filled @ pivots.T), axis=1, kind="stable")[:, :prefix]


def choose_pivots(sample: np.ndarray, count: int, apart: float = APART) -> np.ndarray:
    """Unit vectors of ``sample`` in its order, leaving out those near an earlier one, as a crowd of
    near copies would otherwise fill every order with places that tell nothing apart."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen: list[int] = []
    for i in range(len(unit)):
        if len(chosen) == count:
            break
        if not chosen or (unit[chosen] @ unit[i]).max() <= apart:
            chosen.append(i)
    left = [i for i in range(len(unit)) if i not in set(chosen)]
    return unit[sorted([*chosen, *left[: count - len(chosen)]])]


def build(entries: DataFrame, pivots: np.ndarray, largest: float, prefix: int, shards: int) -> DataFrame:
    """One row per shard: its vectors and its inverted files (members and places, by pivot)."""

    def post(part: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(part["v"].to_numpy()).astype(np.float64)
        orders = _orders(_filled(vectors, largest), pivots, prefix)
        size, width = orders.shape
        pivot = orders.ravel()
        member, place = np.repeat(np.arange(size), width), np.tile(np.arange(width), size)
        by_pivot = np.argsort(pivot, kind="stable")
        ends = np.cumsum(np.bincount(pivot, minlength=len(pivots)))
        return pd.DataFrame([{
            "shard": int(part["shard"].iloc[0]), "cids": part["cid"].to_numpy(np.int64).tobytes(),
            "lows": part["low"].to_numpy(np.int64).tobytes(), "vectors": vectors.tobytes(),
            "ends": ends.astype(np.int64).tobytes(), "members": member[by_pivot].astype(np.int32).tobytes(),
            "places": place[by_pivot].astype(np.int16).tobytes(),
        }])

    shard = F.pmod(F.xxhash64("cid"), F.lit(shards)).cast("int")
    return entries.select(shard.alias("shard"), "cid", "low", "v").groupBy("shard").applyInPandas(post, _INDEX)


class _Shard:
    """The inverted files of one row of the index."""

    def __init__(self, row):
        self.cids, self.lows = np.frombuffer(row.cids, np.int64), np.frombuffer(row.lows, np.int64)
        self.vectors = np.frombuffer(row.vectors, np.float64).reshape(len(self.cids), -1)
        self.ends, self.members = np.frombuffer(row.ends, np.int64), np.frombuffer(row.members, np.int32)
        self.begins, self.places = np.concatenate(([0], self.ends[:-1])), np.frombuffer(row.places, np.int16)

    def nearness(self, order: np.ndarray) -> np.ndarray:
        """What grows as the footrule falls: footrule = width * (width + 1) - 2 * nearness."""
        near, width = np.zeros(len(self.cids), np.int32), len(order)
        for j, p in enumerate(order):
            a, b = self.begins[p], self.ends[p]
            near[self.members[a:b]] += width - np.maximum(self.places[a:b], j)
        return near


def _asked(queries: pd.DataFrame, pivots: np.ndarray, prefix: int):
    vectors = np.stack(queries["v"].to_numpy()).astype(np.float64)
    flat = np.hstack([vectors, np.zeros((len(vectors), 1))])
    return zip(queries["cid"], vectors, _orders(flat, pivots, prefix))


def _search(pivots: np.ndarray, prefix: int, k: int, share: float, least: int) -> Callable:
    def search(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        for row in index.itertuples():
            if not len(queries):
                continue
            held = _Shard(row)
            keep = min(len(held.cids), max(least, int(np.ceil(share * len(held.cids)))))
            for cid, vector, order in _asked(queries, pivots, prefix):
                near = held.nearness(order)
                last = np.partition(near, len(near) - keep)[len(near) - keep]
                chosen = np.flatnonzero(near >= last)  # all that tie with the last
                score = held.vectors[chosen] @ vector
                best = np.lexsort((held.lows[chosen], -score))[: k + 1]
                found += zip([cid] * len(best), held.cids[chosen[best]], held.lows[chosen[best]], score[best])
        return pd.DataFrame(found, columns=["q", "cid", "low", "score"])

    return search


def _ranks(pivots: np.ndarray, prefix: int, k: int) -> Callable:
    """The k + 1 truly nearest of each probe in a shard, and the share of it that would have found them."""

    def rank(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        for row in index.itertuples():
            if not len(queries):
                continue
            held = _Shard(row)
            for cid, vector, order in _asked(queries, pivots, prefix):
                near, score = held.nearness(order), held.vectors @ vector
                best = np.lexsort((held.lows, -score))[: k + 1]
                ahead = len(near) - np.searchsorted(np.sort(near), near[best], side="right")
                found += zip([cid] * len(best), held.lows[best], score[best], (ahead + 1) / len(near))
        return pd.DataFrame(found, columns=["q", "low", "score", "share"])

    return rank


def needed_share(
    index: DataFrame, probes: DataFrame, shards: int, chosen: np.ndarray, prefix: int, k: int, recall: float = RECALL
) -> float:
    """Share of every shard to rerank so that ``recall`` of the true neighbours of the probes (cid, v) are found.

    ``probes`` are few (``PROBES``); each meets every shard, and k + 1 numbers of each come to the driver.
    """
    asked = probes.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    ranked = index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(
        _ranks(chosen, prefix, k), "q long, low long, score double, share double"
    )
    best = Window.partitionBy("q").orderBy(F.desc("score"), "low")
    top = ranked.withColumn("turn", F.row_number().over(best)).filter(F.col("turn") <= k + 1)
    shares = [r["share"] for r in top.select("share").collect()]
    return float(np.quantile(shares, recall, method="higher")) if shares else 1.0


def neighbours(
    df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
    pivots: int = PIVOTS, prefix: int = PREFIX, share: float | None = None, least: int = RERANK_LEAST,
    shard: int = SHARD, query_block: int = QUERY_BLOCK, recall: float = RECALL, probes: int = PROBES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that ``is_query`` (a condition on
    ``vec_id``), by inner product, among all rows but its own id. The share of each shard to rerank is
    measured for ``recall`` on ``probes`` queries unless ``share`` is given."""
    rows = cut_lineage(usable(df, vec_id, embedding))
    entries = cut_lineage(classes(rows, k))
    asking = cut_lineage(
        rows.filter(is_query).join(entries.select("cid", "v"), "v").select(F.col("vec_id").alias("query_id"), "cid")
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    size, largest = entries.agg(F.count("*"), F.max(norm)).first()
    wanted = asking.select("cid").distinct()
    shards, blocks = max(1, -(-size // shard)), max(1, -(-wanted.count() // query_block))
    # at most PIVOT_SAMPLE vectors come to the driver, and ``pivots`` of them go out with the functions
    sample = entries.select("v").orderBy(F.xxhash64("v"), "v").limit(max(pivots, PIVOT_SAMPLE)).collect()
    if not sample:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chosen = choose_pivots(_filled(np.array([r["v"] for r in sample], np.float64), largest), pivots)
    index = cut_lineage(build(entries, chosen, largest, prefix, shards))
    if share is None:
        some = entries.join(wanted, "cid").orderBy(F.xxhash64(F.lit("probe"), "v"), "v").limit(probes).select("cid", "v")
        share = needed_share(index, some, shards, chosen, prefix, k, recall)
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    each_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    left = index.withColumn("block", each_block)
    right = (
        entries.join(wanted, "cid").select("cid", "v", F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int").alias("block"))
        .withColumn("shard", each_shard)
    )
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(
        _search(chosen, prefix, k, share, least), "q long, cid long, low long, score double"
    )
    best = Window.partitionBy("q").orderBy(F.desc("score"), "low")
    top = found.withColumn("turn", F.row_number().over(best)).filter(F.col("turn") <= k + 1)
    opened = top.join(entries.select("cid", "ids"), "cid").select("q", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    opened = opened.withColumn("turn", F.row_number().over(by_id)).filter(F.col("turn") <= k + 1).drop("turn")
    each = opened.join(asking.withColumnRenamed("cid", "q"), "q").filter("vec_id <> query_id")
    final = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
