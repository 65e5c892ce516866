"""Merkle manifest of a dataset with nested-interval labels.

Rows are leaves of one tree per source, three children to a node; the trees' roots are the leaves of
a tree of sources. A node is a row (tree, level, lo, hi, digest): it covers the leaves with ranks lo
to hi - 1 of its tree. A node contains another when its interval does; what a parent's interval holds
one level below, without the node's own interval, are the node's siblings. Ancestors are attached by
joins on (tree, bucket), where a bucket is a block of ``BLOCK`` leaves of ``STRIDE`` levels, so
containment is looked for in one block at a time and no key is larger than a block.

At scale: texts are read once and never leave their task, only digests move. Ranks come from a range
partitioning by (source, id, digest) written once, so a source that holds most rows is many ranges.
Trees are built block by block, ``STRIDE`` levels a step, and proofs are handed down the same way:
steps grow with the logarithm of the largest source, and each works on an 81st of the rows before.

Behaviour at the edges: null columns count as ``-``; null ids come first, and rows of one source and id are
ordered by their leaves; repeated rows are leaves of their own; an empty text differs from a null one;
very long texts are digested where they lie; an empty table gives an empty result. Columns other than
the digested ones are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from planmark.session import cut_lineage

FANOUT = 3
#: Levels built in one step, and the leaves below a node so many levels up.
STRIDE = 4
BLOCK = FANOUT**STRIDE
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _part(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row's values."""
    return F.sha2(F.concat(*[_part(v) for v in values]), 256)


def ranked(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``lo``, the place of every row in its ``tree`` from 0 by ``order``, and ``n``, the rows of the tree.

    Equal rows may change places. A tree is cut into ranges, whose rows are numbered apart.
    """
    by = ["tree", *order]
    single = leaves.withColumn("row_no", F.monotonically_increasing_id())  # spreads equal rows
    ranged = single.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by], "row_no").drop("row_no")
    ranged = cut_lineage(ranged.withColumn("range_no", F.spark_partition_id()))
    sizes = cut_lineage(ranged.groupBy("tree", "range_no").agg(F.count("*").alias("own")))
    before = Window.partitionBy("tree").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("tree").alias("s_tree"), F.col("range_no").alias("s_no"), F.coalesce(F.sum("own").over(before), F.lit(0)).alias("start"),
        F.sum("own").over(Window.partitionBy("tree")).alias("n"),
    )
    inside = Window.partitionBy("tree", "range_no").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = ranged.withColumn("no", F.row_number().over(inside) - 1)
    same = F.col("tree").eqNullSafe(F.col("s_tree")) & (F.col("range_no") == F.col("s_no"))
    return numbered.join(starts, same).withColumn("lo", F.col("start") + F.col("no")).drop("s_tree", "s_no", "start", "no", "range_no")


def _above(digests: Column, more: Column) -> Column:
    """The digests one level up, null where ``digests`` are the top of their tree."""
    runs = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / FANOUT).cast("int"))
    joined = F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(digests, r * FANOUT + 1, FANOUT), ""), 256))
    return F.when(more & digests.isNotNull(), joined)


def build(leaves: DataFrame) -> list[DataFrame]:
    """The nodes (tree, level, lo, hi, digest) above and with ``leaves`` (tree, lo, n, digest), a table for each
    step of ``STRIDE`` levels; the last level of a step is also the first of the next.

    ``root`` marks the top node of each tree.
    """
    steps, level = [], 0
    below = leaves.select("tree", "lo", "n", "digest")
    while True:
        width = FANOUT**level
        count = F.ceil(F.col("n") / width)
        blocks = (
            below.groupBy("tree", F.floor(F.col("lo") / (width * BLOCK)).alias("block"))
            .agg(F.sort_array(F.collect_list(F.struct("lo", "digest"))).alias("nodes"), F.first("n").alias("n"))
            .withColumn("l0", F.transform("nodes", lambda x: x["digest"]))
        )
        for i in range(STRIDE):
            blocks = blocks.withColumn(f"l{i + 1}", _above(F.col(f"l{i}"), count > FANOUT**i))
        size = lambda i: F.lit(width * FANOUT**i).cast("long")
        first = F.col("block") * (width * BLOCK)

        def labelled(i: int) -> Column:
            return F.transform(f"l{i}", lambda d, j: F.struct(
                F.lit(level + i).alias("level"), (first + j * size(i)).cast("long").alias("lo"),
                F.least(first + (j + 1) * size(i), F.col("n")).cast("long").alias("hi"), d.alias("digest"),
                (F.ceil(F.col("n") / size(i)) == 1).alias("root"),
            ))

        none = F.array().cast("array<struct<level:int,lo:bigint,hi:bigint,digest:string,root:boolean>>")
        kinds = [F.coalesce(labelled(i), none) for i in range(STRIDE + 1)]
        nodes = F.inline(F.concat(*kinds))
        step = cut_lineage(blocks.select("tree", "block", "n", nodes))
        steps.append(step)
        level += STRIDE
        below = step.filter((F.col("level") == level) & ~F.col("root")).select("tree", "lo", "n", "digest")
        if below.isEmpty():
            return steps


def manifest(steps: list[DataFrame]) -> DataFrame:
    """All nodes once: (tree, level, lo, hi, digest)."""
    parts = [
        s.filter(F.col("level") > i * STRIDE) if i else s for i, s in enumerate(steps)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("tree", "level", "lo", "hi", "digest")


def tree_roots(steps: list[DataFrame]) -> DataFrame:
    """(tree, digest): the top node of every tree."""
    out = steps[0].filter("root")
    for s in steps[1:]:
        out = out.unionByName(s.filter("root"))
    return out.select("tree", "digest")


def _within(inner_lo: Column, inner_hi: Column, outer: Column) -> Column:
    return (outer["lo"] <= inner_lo) & (inner_hi <= outer["hi"])


def _siblings(lo: Column, hi: Column, nodes: Column) -> Column:
    """[(left, right)] of every level on the way up through the nodes of one block: digests of the siblings
    before and after, joined."""
    ancestors = F.sort_array(F.transform(
        F.filter(nodes, lambda m: _within(lo, hi, m) & (m["level"] > F.col("level"))),
        lambda m: F.struct(m["level"].alias("level"), m["lo"].alias("lo"), m["hi"].alias("hi")),
    ))

    def around(parent: Column) -> Column:
        level = F.filter(nodes, lambda m: (m["level"] == parent["level"] - 1) & _within(m["lo"], m["hi"], parent))
        text = lambda keep: F.array_join(F.transform(F.array_sort(F.filter(level, keep)), lambda m: m["digest"]), "")
        return F.struct(text(lambda m: m["hi"] <= lo).alias("left"), text(lambda m: m["lo"] >= hi).alias("right"))

    return F.transform(ancestors, around)


def paths(steps: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, lo, path, ...) of every leaf: siblings from the leaf up, with the path of its tree behind.

    ``above``: (tree, path, more columns to hand down), one row a tree.
    """
    handed = [c for c in above.columns if c not in ("tree", "path")]
    tops = above.select(F.col("tree").alias("a_tree"), F.col("path").alias("a_path"), *[F.col(c).alias(f"a_{c}") for c in handed])
    known: DataFrame | None = None
    for i in range(len(steps) - 1, -1, -1):
        base, width = i * STRIDE, FANOUT ** (i * STRIDE) * BLOCK
        step = steps[i]
        member = F.struct("level", "lo", "hi", "digest")
        blocks = step.groupBy("tree", "block").agg(
            F.collect_list(member).alias("members"), F.max(F.when(F.col("root"), F.lit(True)).otherwise(F.lit(False))).alias("top")
        )
        same_tree = F.col("tree").eqNullSafe(F.col("a_tree"))
        done = blocks.filter("top").join(tops, same_tree).select("tree", "block", "members", "a_path", *[f"a_{c}" for c in handed])
        if known is not None:
            upper = known.select(F.col("tree").alias("k_tree"), F.floor(F.col("lo") / width).alias("k_block"), F.col("path").alias("a_path"), *[F.col(c).alias(f"a_{c}") for c in handed])
            at = F.col("tree").eqNullSafe(F.col("k_tree")) & (F.col("block") == F.col("k_block"))
            done = done.unionByName(blocks.filter("not top").join(upper, at).select(*done.columns))
        context = done.withColumnsRenamed({"tree": "d_tree", "block": "d_block"})
        rows = step.filter(F.col("level") == base).select("tree", "block", "level", "lo", "hi")
        met = rows.join(context, F.col("tree").eqNullSafe(F.col("d_tree")) & (F.col("block") == F.col("d_block")))
        own = _siblings(F.col("lo"), F.col("hi"), F.col("members"))
        known = cut_lineage(met.select("tree", "lo", F.concat(own, "a_path").alias("path"), *[F.col(f"a_{c}").alias(c) for c in handed]))
    return known


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


_PATH = "array<struct<left:string,right:string>>"


def prove(df: DataFrame, altered: dict[str, Column] | None = None, columns: Sequence[str] = COLUMNS, tree: str = "source", order: str = "doc_id") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``df``.

    ``altered``: other values of some columns, as a later reader finds them; ``folded_root`` is computed from these
    and the proof of the original row.
    """
    now = altered or {}
    given = [F.col(f"`{c}`") for c in columns]
    leaves = cut_lineage(df.select(
        F.col(f"`{tree}`").alias("tree"), F.col(f"`{order}`").alias("key"), leaf(*given).alias("digest"),
        leaf(*[now.get(c, v) for c, v in zip(columns, given)]).alias("found"),
    ))
    placed = cut_lineage(ranked(leaves, ["key", "digest"]))
    steps = build(placed)
    subroots = cut_lineage(tree_roots(steps).select("tree", F.col("digest").alias("subroot")))
    # UTF-8 order is the order of the bytes
    sources = cut_lineage(ranked(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("key"), F.col("subroot").alias("digest")), ["key"]))
    tops = build(sources)
    root = tree_roots(tops).first()
    value = F.lit(root["digest"] if root else None).cast("string")
    start = sources.sparkSession.createDataFrame([(0, [])], f"tree int, path {_PATH}")
    of_source = paths(tops, start)
    above = sources.join(of_source.select("lo", "path"), "lo").select(F.col("key").alias("tree"), "path", F.col("digest").alias("subroot"))
    proven = paths(steps, above).withColumnsRenamed({"tree": "p_tree", "lo": "p_lo"})
    met = placed.join(proven, (F.col("lo") == F.col("p_lo")) & F.col("tree").eqNullSafe(F.col("p_tree")))
    proof = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    out = met.select(
        F.col("key").alias(order), F.col("digest").alias("leaf"), "subroot", value.alias("root"),
        F.sha2(proof, 256).alias("proof_sha256"), fold(F.col("found"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
