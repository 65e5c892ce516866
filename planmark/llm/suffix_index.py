"""Repeated byte strings across documents by a logarithmic family of suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller id goes.

Strings that are equal share their smallest hashed substring of ``SEED`` bytes (the anchor), so all strings
of a document fall into stretches of one anchor, and a stretch can only meet stretches of equal anchor
hash. First the anchors of all documents meet in shards as hashes; those that one text alone
holds cannot repeat. Stretches of the others, with their bytes, go to the shard of their anchor. A shard takes its
documents in batches by ascending id: a batch gets its suffix array (the sorted strings that start
in it), which is scanned against every level of the shard's index family for equal strings, then becomes
level 0; two levels of one size merge into one of twice the size, so n batches are held in log n
sorted arrays. What an older level holds belongs to smaller ids.

At scale: exact copies of a text are told apart by a digest and only the first is indexed. Texts are written once in
batches of bounded size, compressed and bucketed by batch, and later steps join what belongs to a batch without moving
texts; shards and buckets grow in number with the input. A passage that very many documents hold is one
anchor entry per batch and document, and its equal stretches are met by look-up before anything is sorted. A hash
collision only lets more stretches travel; strings are compared byte by byte.

Behaviour at the edges: a null text is empty; texts below ``LENGTH`` bytes lose nothing; very long texts are a batch of
their own; null ids come after all others, and rows of one id do not remove each other's bytes; repeated rows have
equal results; an empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from planmark.llm.common import bound_batches, text_of
from planmark.session import cut_lineage, ensure_checkpoint_dir

#: Bytes of a string that counts as repeated; bytes of an anchor.
LENGTH, SEED = 50, 24
#: Bytes of text of a batch of documents, and of the documents whose anchors meet in one shard.
BATCH, SHARD = 4_000_000, 16_000_000
LEAST_SHARDS, MOST_BUCKETS = 24, 65536
#: Strings of a batch of the index family.
STRINGS = 1 << 17
_LAST = 2**63 - 1
_MANY = 2**32 - 1
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


def anchors(flat: np.ndarray, seed: int = SEED, length: int = LENGTH) -> np.ndarray:
    """For every string of ``length`` bytes of ``flat`` the smallest hash of its substrings of ``seed`` bytes."""
    parts, width = {}, 1
    h = flat.astype(np.uint64) * _MIX[0]
    h ^= h >> np.uint64(29)
    while width <= seed:
        parts[width] = h
        h = h[: len(h) - width] * _MIX[1] + h[width:]
        h ^= h >> np.uint64(32)
        h *= _MIX[2]
        width *= 2
    out, at = None, 0
    for width in sorted(parts, reverse=True):
        if seed & width:
            piece = parts[width][at : at + len(flat) - seed + 1]
            if out is None:
                out = piece.copy()
            else:
                out = out * _MIX[1] + piece
                out ^= out >> np.uint64(31)
                out *= _MIX[2]
            at += width
    window, width = length - seed + 1, 1
    while width * 2 <= window:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    if width < window:
        out = np.minimum(out[: len(out) - window + width], out[window - width :])
    return out


def stretches(texts: list[bytes], step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first string, strings, anchor hash) of all stretches: runs of strings of one anchor."""
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    found = []
    for a in range(0, max(len(flat) - LENGTH + 1, 0), step):
        found.append(anchors(flat[a : a + step + LENGTH - 1]))
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), sizes)[: len(hashes)]
    inside = np.arange(len(hashes)) + LENGTH <= ends[doc]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new & inside)
    stops = np.flatnonzero(np.concatenate((new[1:] | ~inside[1:], [True])) & inside) + 1 if len(hashes) else starts
    return doc[starts], starts - (ends - sizes)[doc[starts]], stops - starts, hashes[starts]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Family:
    """Sorted arrays of strings in levels of geometric size; batches come in ascending order."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, np.ndarray]] = []  # (batches held, sorted different strings), largest first

    def add(self, strings: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Which of ``strings`` an older batch holds, or this one under a smaller ``order`` (ascending)."""
        by = np.argsort(strings, kind="stable")  # ``order`` ascends
        array, place = strings[by], order[by]
        new = np.ones(len(array), dtype=bool)
        new[1:] = array[1:] != array[:-1]
        runs = np.cumsum(new) - 1
        keys = array[new]
        known = np.zeros(len(keys), dtype=bool)
        for _, level in self.levels:
            at = np.searchsorted(level, keys)
            known |= level[np.minimum(at, len(level) - 1)] == keys
        out = np.zeros(len(strings), dtype=bool)
        if len(keys):
            out[by] = known[runs] | (place > place[new][runs])
            self._push(1, keys)
        return out

    def _push(self, size: int, keys: np.ndarray) -> None:
        while self.levels and self.levels[-1][0] <= size:
            older, level = self.levels.pop()
            both = np.sort(np.concatenate((level, keys)), kind="stable")  # merges two runs
            keys, size = both[np.concatenate(([True], both[1:] != both[:-1]))], size + older
        self.levels.append((size, keys))


def repeated(ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first byte, byte after) of what goes of a shard's stretches: ``ids`` of their documents, byte
    ``sizes``, and all bytes one after the other."""
    order = np.argsort(ids, kind="stable")
    ends = np.cumsum(sizes)
    raw = flat.tobytes()
    family, seen = Family(), {}
    out = []
    covered = np.zeros(len(ids), dtype=bool)
    fresh: list[int] = []
    waiting = 0

    def flush() -> None:
        nonlocal fresh, waiting
        part = np.array(fresh, dtype=np.int64)
        count = sizes[part] - LENGTH + 1
        first = _ragged(ends[part] - sizes[part], count)
        strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, LENGTH)[first]).view(f"S{LENGTH}").ravel()
        hit = family.add(strings, np.repeat(ids[part], count))
        of, at = np.repeat(part, count), first - np.repeat(ends[part] - sizes[part], count)
        of, at = of[hit], at[hit]
        if len(of):
            start = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1))))
            last = np.append(start[1:], len(of)) - 1
            out.append((of[start], at[start], at[last] + LENGTH))
        fresh, waiting = [], 0

    previous = None
    listed, stops, begins = ids.tolist(), ends.tolist(), (ends - sizes).tolist()
    for i in order.tolist():
        if waiting >= STRINGS and listed[i] != previous:  # batches end with a document
            flush()
        previous = listed[i]
        body = raw[begins[i] : stops[i]]
        owner = seen.get(body)
        if owner is None:
            seen[body] = previous
        elif owner < previous:
            covered[i] = True
            continue
        fresh.append(i)
        waiting += stops[i] - begins[i] - LENGTH + 1
    if fresh:
        flush()
    whole = np.flatnonzero(covered)
    out.append((whole, np.zeros(len(whole), np.int64), sizes[whole]))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def _table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _kinds(df: DataFrame, function, schema: StructType, buckets: int, columns: dict[str, str]) -> list[DataFrame]:
    """What ``function`` makes of the batches of ``df``, written once, bucketed by batch: a table for each kind of row."""
    spark = df.sparkSession
    name = f"suffix_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/{name}"
    made = df.mapInArrow(function, schema)
    made.write.option("path", path).partitionBy("kind").bucketBy(buckets, "batch").saveAsTable(name)
    return [spark.table(name).filter(F.col("kind") == kind).selectExpr(*names.split()) for kind, names in columns.items()]


def _per_batch(df: DataFrame, buckets: int, value: Column) -> DataFrame:
    """(batch, value): all rows of a batch together, laid out like the bucketed tables."""
    return df.repartition(buckets, "batch").groupBy("batch").agg(value).hint("shuffle_hash")


def _texts(narrow: DataFrame, buckets: int) -> list[DataFrame]:
    """Texts (batch, ids, digests, sizes, body), and rows (batch, idx, doc_id, place, digest, n_bytes, small)."""
    kind = narrow.schema["doc_id"].dataType
    schema = StructType(
        _parse_datatype_string("kind string, batch long, ids array<long>, digests array<binary>, sizes array<int>, body binary, idx int").fields
        + [StructField("doc_id", kind)] + _parse_datatype_string("place long, digest binary, n_bytes long, small binary").fields
    )
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = 0, [], 0

        def written() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, size
            batch = TaskContext.get().partitionId() << 32 | number
            ids, places, digests, texts = ([row[k] for row in held] for k in range(4))
            sizes, n = [len(t) for t in texts], len(texts)
            yield _table(
                arrow, kind=["texts"], batch=[batch], ids=[places], digests=[digests], sizes=[sizes],
                body=[zstandard.compress(b"".join(texts), 3)],
            )
            yield _table(
                arrow, kind=["rows"] * n, batch=[batch] * n, idx=list(range(n)), doc_id=ids, place=places, digest=digests,
                n_bytes=sizes, small=[t if len(t) < LENGTH else None for t in texts],
            )
            number, held, size = number + 1, [], 0

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and size + len(row[3]) > BATCH:
                    yield from written()
                held.append(row)
                size += len(row[3])
        if held:
            yield from written()

    return _kinds(narrow, cut, schema, buckets, {"texts": "batch ids digests sizes body", "rows": "batch idx doc_id place digest n_bytes small"})


def _local(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors of a batch are shared by two of its documents, and which are asked about elsewhere: of an anchor
    that is shared here one, so that the same passage in all documents is one entry of a batch."""
    known, asked = np.zeros(len(doc), dtype=bool), np.ones(len(doc), dtype=bool)
    if len(doc):
        order = np.argsort(hashes, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(hashes[order]) != 0)))
        owner = doc[order]
        many = np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts)
        known[order] = np.repeat(many, np.diff(np.append(starts, len(order))))
        asked = ~known
        asked[order[starts]] = True
    return known, asked


def _anchored(texts: DataFrame, first: DataFrame, shards: int, buckets: int) -> list[DataFrame]:
    """Stretches (batch, stretch_sizes, shard_of, known, asked) and asked anchors (batch, shard, hashes, docs) of the
    documents ``first`` (batch, idx)."""
    schema = _parse_datatype_string(
        "kind string, batch long, stretch_sizes binary, shard_of binary, known binary, asked binary, shard int, hashes binary, docs binary"
    )
    arrow = to_arrow_schema(schema)

    def anchor(row: dict) -> Iterator[pa.RecordBatch]:
        batch, ends = row["batch"], np.cumsum(row["sizes"])
        raw, used = zstandard.decompress(row["body"]), set(row["used"])
        texts_ = [raw[b - n : b] if i in used else b"" for i, (b, n) in enumerate(zip(ends.tolist(), row["sizes"]))]
        doc, _, count, hashes = stretches(texts_)
        shard = (hashes >> np.uint64(32)).astype(np.int64) % shards
        known, asked = _local(doc, hashes)
        yield _table(
            arrow, kind=["stretches"], batch=[batch],
            stretch_sizes=[zstandard.compress(np.concatenate((np.bincount(doc, minlength=len(texts_)), count)).astype("<u4").tobytes(), 3)],
            shard_of=[zstandard.compress(shard.astype("<u4").tobytes(), 3)],
            known=[np.packbits(known).tobytes()], asked=[np.packbits(asked).tobytes()],
        )
        order = np.flatnonzero(asked)
        order = order[np.argsort(shard[order], kind="stable")]
        if len(order):
            bounds = np.flatnonzero(np.concatenate(([True], np.diff(shard[order]) != 0, [True])))
            low, owner = hashes[order].astype("<u4"), np.where(known[order], _MANY, doc[order]).astype("<u4")
            parts = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:])]
            yield _table(
                arrow, kind=["anchors"] * len(parts), batch=[batch] * len(parts), shard=[int(shard[order[p.start]]) for p in parts],
                hashes=[low[p].tobytes() for p in parts], docs=[owner[p].tobytes() for p in parts],
            )

    used = _per_batch(first, buckets, F.collect_list("idx").alias("used"))
    met = texts.select("batch", "sizes", "body").join(used, "batch")
    return _kinds(met, _by_row(anchor), schema, buckets, {"stretches": "batch stretch_sizes shard_of known asked", "anchors": "batch shard hashes docs"})


def _by_row(function):
    """``function`` for the rows of batches, one in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield from function(batch.slice(i, 1).to_pylist()[0])

    return run


def _shared(anchors_: DataFrame) -> DataFrame:
    """(batch, shard, bits): which anchors of a batch more than one text holds."""

    def met(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, "<u4") for x in table["hashes"].to_pylist()]
        docs = np.frombuffer(b"".join(table["docs"].to_pylist()), "<u4").astype(np.int64)
        sizes = np.array([len(h) for h in hashes])
        flat = np.concatenate(hashes)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int64) << 32, sizes) | docs
        order = np.argsort(flat, kind="stable")
        flat, owner, several = flat[order], owner[order], docs[order] == _MANY
        starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        many = (np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts)) | np.logical_or.reduceat(several, starts)
        shared = np.zeros(len(flat), dtype=bool)
        shared[order] = np.repeat(many, np.diff(np.append(starts, len(flat))))
        bits = [np.packbits(x).tobytes() for x in np.split(shared, np.cumsum(sizes)[:-1])]
        keep = [any(b) for b in bits]
        return pa.table({
            "batch": pa.array([b for b, k in zip(table["batch"].to_pylist(), keep) if k], pa.int64()),
            "shard": pa.array([s for s, k in zip(table["shard"].to_pylist(), keep) if k], pa.int32()),
            "bits": pa.array([b for b, k in zip(bits, keep) if k], pa.binary()),
        })

    return anchors_.groupBy("shard").applyInArrow(met, "batch long, shard int, bits binary")


_STRETCHES = "shard int, batch long, ids binary, docs binary, firsts binary, sizes binary, body binary, gone binary"


def _sent(texts: DataFrame, cut: DataFrame, shared: DataFrame, shards: int, buckets: int) -> DataFrame:
    """Stretches of shared anchors by shard, equal ones of a batch once: ``gone`` has the spans of its others, in any shard."""
    arrow = to_arrow_schema(_parse_datatype_string(_STRETCHES))

    def of_batch(row: dict) -> Iterator[pa.RecordBatch]:
        ids, sizes = np.array(row["ids"], np.int64), np.array(row["sizes"], np.int64)
        raw = zstandard.decompress(row["body"])
        flat = np.frombuffer(raw, np.uint8)
        counts = np.frombuffer(zstandard.decompress(row["stretch_sizes"]), "<u4").astype(np.int64)
        per_doc, count = counts[: len(ids)], counts[len(ids) :]
        n = len(count)
        shard = np.frombuffer(zstandard.decompress(row["shard_of"]), "<u4").astype(np.int64)
        known, asked = (np.unpackbits(np.frombuffer(row[k], np.uint8), count=n).astype(bool) for k in ("known", "asked"))
        order = np.flatnonzero(asked)
        order = order[np.argsort(shard[order], kind="stable")]
        for flag in row["flags"]:
            mine = order[slice(*np.searchsorted(shard[order], (flag["shard"], flag["shard"] + 1)))]
            known[mine] |= np.unpackbits(np.frombuffer(flag["bits"], np.uint8), count=len(mine)).astype(bool)
        doc = np.repeat(np.arange(len(ids)), per_doc)
        used = np.flatnonzero(known)
        used = used[np.argsort(ids[doc[used]], kind="stable")]
        before = np.concatenate(([0], np.cumsum(count)))
        first = before[used] - before[np.cumsum(per_doc) - per_doc][doc[used]]
        width = count[used] + LENGTH - 1
        begin = (np.cumsum(sizes) - sizes)[doc[used]] + first
        owners: dict[bytes, int] = {}
        stay = np.ones(len(used), dtype=bool)
        for k, (a, b, i) in enumerate(zip(begin.tolist(), (begin + width).tolist(), ids[doc[used]].tolist())):
            if owners.setdefault(raw[a:b], i) < i:
                stay[k] = False
        spans = np.stack((doc[used], first, first + width), axis=1)[~stay].astype("<u4")
        used, first, width, begin = used[stay], first[stay], width[stay], begin[stay]
        by = np.argsort(shard[used], kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], np.diff(shard[used][by]) != 0, [True]))) if len(by) else np.zeros(1, int)
        spare = row["batch"] % shards
        if len(spans):
            empty = b""
            yield _table(arrow, shard=[spare], batch=[row["batch"]], ids=[empty], docs=[empty], firsts=[empty], sizes=[empty], body=[empty], gone=[spans.tobytes()])
        for a, b in zip(edges[:-1], edges[1:]):
            mine = by[a:b]
            yield _table(
                arrow, shard=[int(shard[used[mine[0]]])], batch=[row["batch"]], ids=[ids[doc[used[mine]]].astype("<i8").tobytes()],
                docs=[doc[used[mine]].astype("<u4").tobytes()], firsts=[first[mine].astype("<u4").tobytes()],
                sizes=[width[mine].astype("<u4").tobytes()], body=[flat[_ragged(begin[mine], width[mine])].tobytes()], gone=[b""],
            )

    flags = _per_batch(shared, buckets, F.collect_list(F.struct("shard", "bits")).alias("flags"))
    none = F.array().cast("array<struct<shard:int,bits:binary>>")
    # a batch without an answer may still share anchors within itself
    met = texts.select("batch", "ids", "sizes", "body").join(cut.hint("shuffle_hash"), "batch").join(flags, "batch", "left")
    return met.withColumn("flags", F.coalesce("flags", none)).mapInArrow(_by_row(of_batch), _STRETCHES)


def _found(sent: DataFrame) -> DataFrame:
    """(batch, spans): what goes, as packed (document, first byte, byte after)."""

    def scan(table: pa.Table) -> pa.Table:
        columns = {name: table[name].to_pylist() for name in ("batch", "ids", "docs", "firsts", "sizes", "body", "gone")}
        joined = lambda name, kind: np.frombuffer(b"".join(columns[name]), kind).astype(np.int64)
        row = np.repeat(np.arange(len(table)), [len(x) // 4 for x in columns["sizes"]])
        docs, firsts = joined("docs", "<u4"), joined("firsts", "<u4")
        which, a, b = repeated(joined("ids", "<i8"), joined("sizes", "<u4"), np.frombuffer(b"".join(columns["body"]), np.uint8))
        spans = np.stack((docs[which], firsts[which] + a, firsts[which] + b), axis=1).astype("<u4")
        spans = spans[np.argsort(row[which], kind="stable")]
        ends = np.cumsum(np.bincount(row[which], minlength=len(table)))
        parts = [x.tobytes() + gone for x, gone in zip(np.split(spans, ends[:-1]), columns["gone"])]
        keep = [i for i, p in enumerate(parts) if p]
        return pa.table({
            "batch": pa.array([columns["batch"][i] for i in keep], pa.int64()), "spans": pa.array([parts[i] for i in keep], pa.binary()),
        })

    return sent.groupBy("shard").applyInArrow(scan, "batch long, spans binary")


_RESULT = "digest binary, spans array<struct<start:int,stop:int>>, n_removed long, kept_sha256 string, kept binary"


def _cut(texts: DataFrame, first: DataFrame, found: DataFrame, with_text: bool, buckets: int) -> DataFrame:
    """(digest, spans, n_removed, kept_sha256, kept) of the documents ``first``."""
    arrow = to_arrow_schema(_parse_datatype_string(_RESULT))

    def finish(row: dict) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(np.array(row["sizes"], np.int64))
        begins = np.concatenate(([0], ends[:-1]))
        flat = np.frombuffer(zstandard.decompress(row["body"]), np.uint8)
        gone = np.frombuffer(b"".join(row["spans"] or []), "<u4").astype(np.int64).reshape(-1, 3)
        edge = np.zeros(len(flat) + 1, dtype=np.int32)
        np.add.at(edge, begins[gone[:, 0]] + gone[:, 1], 1)
        np.add.at(edge, begins[gone[:, 0]] + gone[:, 2], -1)
        out = np.cumsum(edge[:-1]) > 0
        results = {k: [] for k in ("digest", "spans", "n_removed", "kept_sha256", "kept")}
        for i in row["used"]:
            mine = out[begins[i] : ends[i]]
            steps = np.flatnonzero(np.diff(np.concatenate(([False], mine, [False])).astype(np.int8)))
            kept = flat[begins[i] : ends[i]][~mine].tobytes()
            results["digest"].append(row["digests"][i])
            results["spans"].append([{"start": int(x), "stop": int(y)} for x, y in steps.reshape(-1, 2)])
            results["n_removed"].append(int(mine.sum()))
            results["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            results["kept"].append(kept if with_text else None)
        yield _table(arrow, **results)

    used = _per_batch(first, buckets, F.collect_list("idx").alias("used"))
    spans = _per_batch(found, buckets, F.collect_list("spans").alias("spans"))
    met = texts.select("batch", "digests", "sizes", "body").join(used, "batch").join(spans, "batch", "left")
    return met.mapInArrow(_by_row(finish), _RESULT)


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept]) for every row of ``df``.

    ``spans`` are the removed byte ranges; ``kept`` the bytes left, on request. Ids are integers.
    """
    bound_batches(df)
    narrow = df.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LAST)).alias("place"), text_of(text).alias("t")
    ).select("doc_id", "place", F.unhex(F.sha2("t", 256)).alias("digest"), F.col("t").cast("binary").alias("b"))
    total = df.agg(F.sum(F.octet_length(text_of(text)))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-total // SHARD))
    buckets = min(shards, MOST_BUCKETS)
    texts, listed = _texts(narrow, buckets)
    # of rows of one text, the one with the smallest id is indexed
    lowest = cut_lineage(listed.groupBy("digest").agg(F.min(F.struct("place", "batch", "idx")).alias("k"), F.first("n_bytes").alias("n_bytes")))
    first = cut_lineage(lowest.filter(F.col("n_bytes") >= LENGTH).select("k.batch", "k.idx"))
    cut, anchored = _anchored(texts, first, shards, buckets)
    shared = cut_lineage(_shared(anchored))
    found = cut_lineage(_found(_sent(texts, cut, shared, shards, buckets)))
    results = cut_lineage(_cut(texts, first, found, with_text, buckets))
    lowest = lowest.select("digest", F.col("k.place").alias("lowest"))
    short, later = F.col("n_bytes") < LENGTH, F.col("place") > F.col("lowest")
    nothing = F.array().cast("array<struct<start:int,stop:int>>")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("stop")))
    pick = lambda a, b, c, name: F.when(short, a).when(later, b).otherwise(F.col(c)).alias(name)
    zero = F.lit(0).cast("long")
    out = listed.join(lowest, "digest").join(results, "digest", "left").select(
        "doc_id", "n_bytes", pick(zero, F.col("n_bytes"), "n_removed", "n_removed"),
        pick(F.lower(F.hex("digest")), F.sha2(F.lit(""), 256), "kept_sha256", "kept_sha256"), pick(nothing, whole, "spans", "spans"),
        *([pick(F.col("small"), F.lit(b""), "kept", "kept")] if with_text else []),
    )
    return out.withColumn("n_spans", F.size("spans").cast("long"))
