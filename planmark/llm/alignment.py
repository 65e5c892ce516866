"""Cross-tokenizer alignment with inverted pair bitmaps.

Two tokenizers cut the same bytes; where both end a token at the same byte, the two tokens are
linked. Documents are dealt into chunks of bounded size, each within one task. For every pair of
linked ids a chunk holds the documents as compressed bitmaps, one plane for each binary digit of the
pair's multiplicity in a document: sorted 16-bit numbers while a plane is sparse, a plain bitmap
beyond. OR-ing the planes and counting bits gives the pair's documents; the planes' counts by
powers of two give its links. Both are summed over chunks, and the scores go back along the
postings: every document adds up the scores of its pairs, once per link.

At scale: the texts are read once and never shuffled; a chunk's bitmaps are bounded by the chunk, so a
pair that all documents hold is one small row per chunk, counted before any shuffle; scores meet postings by a
join on the pair and return by the chunk. Links become postings (pair, document, multiplicity) after each block
of ``BLOCK`` characters, a chunk ends at ``POSTINGS`` postings, and its bitmaps are made ``SLICE`` postings at a time, so
that beside one text a task's memory depends neither on the number of documents nor on their links. Tokens of a unit (a stretch
between plain single blanks, which neither tokenizer crosses) are remembered per worker in ``REMEMBERED`` bytes; those
not met of late go.

Behaviour at the edges: a null or empty text, and one whose tokens of either kind do not give back
blank and text, has no tokens and zeros; a long text is aligned in stretches of about ``BLOCK`` characters, from plain blank
to plain blank (without any, at once); ties for a best
pair all count; repeated rows are counted each; an empty table gives an empty result; only the id and
the text are read, so other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from planmark.llm.common import bound_batches
from planmark.session import cut_lineage, ensure_checkpoint_dir

#: Documents and postings of a chunk (it ends with the document and the block that reach either).
DOCUMENTS, POSTINGS = 8192, 2_000_000
#: Characters whose links are held before they become postings.
BLOCK = 500_000
#: Postings whose bitmaps are made at a time (one pair more at most), and bitmaps that are read at a time.
SLICE, ROWS = 200_000, 1_000
#: Documents of a chunk from which a plane is a bitmap of ``DOCUMENTS`` bits.
DENSE = DOCUMENTS // 16
#: Bytes of units that a worker process remembers, one half met of late, the other before.
REMEMBERED = 200_000_000
_B_BITS = 24
#: A blank that no unit crosses.
_PLAIN = re.compile(r"(?<=\S) (?=\S)")


def byte_level() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, the
    others for characters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def load_byte_tokens(path: str) -> dict[bytes, int]:
    """Tokens and ids of a byte-level vocabulary file whose ids are also the order of its merges."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    of = byte_level()
    tokens = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if all(c in of for c in token)}
    merged = [bytes(of[c] for c in "".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    ids = [tokens[m] for m in merged]
    if ids != sorted(ids):
        raise ValueError("the ids of this vocabulary do not follow its merges")
    kept = set(ids) | {i for t, i in tokens.items() if len(t) == 1}
    return {t: i for t, i in tokens.items() if i in kept}


def piece_bytes(model) -> list[bytes]:
    """The bytes of every piece."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return out


class Aligner:
    """Aligned units of texts; ``codes`` gives a text as numbers of units, or None where it has no tokens."""

    def __init__(self, byte_path: str, pattern: str, piece_path: str) -> None:
        import sentencepiece

        tokens = load_byte_tokens(byte_path)
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=tokens, special_tokens={})
        self.a_bytes = {i: t for t, i in tokens.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.b_bytes = piece_bytes(self.b)
        # pieces that hold a blank behind other characters could cross units
        self.whole = any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(len(self.b_bytes)))
        self.forget()

    def forget(self) -> None:
        """Remember no unit."""
        self._number_anew()
        self.older: tuple = ({},)

    def age(self) -> None:
        """Number units anew. Those met since the last time need not be aligned again; others are forgotten."""
        self.older = (self.known, self.sizes, self.ends, self.pairs, self.groups)
        self._number_anew()

    def _number_anew(self) -> None:
        self.known: dict[str, int] = {}
        self.sizes = array("q")  # a, b, groups of each unit
        self.ends = array("q", [0])
        self.pairs = array("q")
        self.groups: list[str] = []
        self.held = 0

    def align(self, unit: str, b: list[int] | None = None) -> tuple[list[int], list[int], list[list[int]], list[int]] | None:
        """Ids of both kinds of blank and ``unit``, ends of its groups as (a, b) places, linked pairs. ``b``: the second ids, if known."""
        a = self.a.encode_ordinary(" " + unit)
        if b is None:
            b = self.b.encode(unit)
        a_bytes, b_bytes = list(map(self.a_bytes.__getitem__, a)), list(map(self.b_bytes.__getitem__, b))
        raw = (" " + unit).encode("utf-8", "surrogatepass")
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            return None
        place = dict(zip(accumulate(map(len, b_bytes)), count()))
        cuts = [(i, place[end]) for i, end in enumerate(accumulate(map(len, a_bytes))) if end in place]
        return a, b, cuts, [a[i] << _B_BITS | b[j] for i, j in cuts]

    def code(self, unit: str, b: list[int] | None = None) -> int:
        """The number of a unit; -1 if it has no tokens."""
        found = self.known.get(unit)
        if found is not None:
            return found
        sizes, pairs, groups = self.before(unit) or self.describe(unit, b)
        self.held += 4 * len(unit) + 10 * len(pairs) + len(groups) + 300
        if not groups:
            self.known[unit] = -1
            return -1
        number = self.known[unit] = len(self.groups)
        self.groups.append(groups)
        self.sizes.extend(sizes)
        self.pairs.extend(pairs)
        self.ends.append(len(self.pairs))
        return number

    def before(self, unit: str) -> tuple | None:
        """What ``describe`` gives, if the unit was met before units were last numbered anew."""
        i = self.older[0].get(unit)
        if i is None:
            return None
        _, sizes, ends, pairs, groups = self.older
        return ((), (), "") if i < 0 else (sizes[3 * i : 3 * i + 3], pairs[ends[i] : ends[i + 1]], groups[i])

    def describe(self, unit: str, b: list[int] | None = None) -> tuple:
        """Sizes, linked pairs and groups of a unit; empty if it has no tokens."""
        aligned = self.align(unit, b)
        if aligned is None:
            return (), (), ""
        a, b, cuts, pairs = aligned
        spelled_a, spelled_b = list(map(str, a)), list(map(str, b))
        parts, i, j = [], 0, 0
        for x, y in cuts:
            parts.append(f"{','.join(spelled_a[i : x + 1])}|{','.join(spelled_b[j : y + 1])}")
            i, j = x + 1, y + 1
        return (len(a), len(b), len(cuts)), pairs, ";".join(parts)

    def codes(self, text: str) -> list[int] | None:
        """Numbers of the units of blank and ``text``."""
        if not text:
            return None
        pieces = [text] if self.whole else text.split(" ")
        if not self.whole and ("" in pieces or list(map(str.strip, pieces)) != pieces):
            pieces = list(units(pieces))
        found = list(map(self.known.get, pieces))
        if None in found:
            missing = {p for p, x in zip(pieces, found) if x is None}
            new = [p for p in missing if p not in self.older[0]]
            for unit, b in zip(new, self.b.encode(new, num_threads=1)):  # one call is faster than many
                self.code(unit, b)
            for unit in missing.difference(new):
                self.code(unit)
            found = list(map(self.known.__getitem__, pieces))
        return None if -1 in found else found

    def stretches(self, text: str) -> Iterator[str]:
        """``text`` in parts of ``BLOCK`` characters and up to the next plain blank, which is left out."""
        start = 0
        while not self.whole and len(text) - start > BLOCK and (blank := _PLAIN.search(text, start + BLOCK)):
            yield text[start : blank.start()]
            start = blank.end()
        yield text[start:] if start else text


def units(pieces: list[str]) -> Iterator[str]:
    """``pieces`` between blanks, joined again where a blank stands beside white space."""
    held = [pieces[0]]
    for piece in pieces[1:]:
        if held[-1] and piece and not held[-1][-1].isspace() and not piece[0].isspace():
            yield " ".join(held)
            held = [piece]
        else:
            held.append(piece)
    yield " ".join(held)


@lru_cache(maxsize=1)
def worker_aligner(byte_path: str, pattern: str, piece_path: str) -> Aligner:
    """One for all tasks of a worker process, so that the vocabularies are held once and units stay known."""
    return Aligner(byte_path, pattern, piece_path)


def planes(pairs: np.ndarray, docs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(pair, documents, links, bitmaps) for postings sorted by pair, then document number.

    Bitmaps of a pair as 16-bit numbers: how many planes, how many documents in each, then each
    plane's documents, or its bitmap where they are many.
    """
    starts = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(pairs))))
    links = np.add.reduceat(times, starts)
    n_docs = np.diff(np.append(starts, len(pairs)))
    digits = np.array([int(x).bit_length() for x in np.maximum.reduceat(times, starts)])
    deep = int(digits.max())
    cards = np.zeros((len(starts), deep), dtype=np.int64)
    members = []
    for k in range(deep):
        has = (times >> k & 1).astype(bool)
        cards[:, k] = np.bincount(of[has], minlength=len(starts))
        members.append(docs[has].astype("<u2"))
    body = np.where(cards >= DENSE, DOCUMENTS // 16, cards)
    width = 1 + digits + body.sum(axis=1)
    at = np.concatenate(([0], np.cumsum(width)))
    out = np.zeros(at[-1], dtype="<u2")
    out[at[:-1]] = digits
    place = at[:-1] + 1 + digits
    for k in range(deep):
        used = digits > k
        out[at[:-1][used] + 1 + k] = cards[used, k]
        first = np.cumsum(cards[:, k]) - cards[:, k]
        sparse = cards[:, k] < DENSE
        n = np.where(sparse, cards[:, k], 0)
        flat = np.repeat(place - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[flat] = members[k][np.repeat(sparse, cards[:, k])]
        for i in np.flatnonzero(~sparse):
            bits = np.zeros(DOCUMENTS, dtype=np.uint8)
            bits[members[k][first[i] : first[i] + cards[i, k]]] = 1
            out[place[i] : place[i] + DOCUMENTS // 16] = np.packbits(bits, bitorder="little").view("<u2")
        place = place + body[:, k]
    raw = out.tobytes()
    return pairs[starts], n_docs, links, [raw[2 * a : 2 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def read_planes(bitmaps: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row of ``bitmaps``, document number, plane) of all postings, plane by plane."""
    flat = np.frombuffer(b"".join(bitmaps), dtype="<u2")
    at = np.cumsum([0, *(len(x) // 2 for x in bitmaps)])[:-1]
    digits = flat[at].astype(np.int64)
    place = at + 1 + digits
    for k in range(int(digits.max(initial=0))):
        rows = np.flatnonzero(digits > k)
        card = flat[at[rows] + 1 + k].astype(np.int64)
        sparse = card < DENSE
        n = np.where(sparse, card, 0)
        where = np.repeat(place[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield np.repeat(rows, n), flat[where].astype(np.int64), k
        for i in rows[~sparse]:
            found = np.flatnonzero(np.unpackbits(flat[place[i] : place[i] + DOCUMENTS // 16].view(np.uint8), bitorder="little"))
            yield np.full(len(found), i), found, k
        place[rows] += np.where(sparse, card, DOCUMENTS // 16)


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of (keys, times) as one, every key once."""
    keys, times = (np.concatenate(x) for x in zip(*runs))
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys, times) if len(starts) == len(keys) else (keys[starts], np.add.reduceat(times, starts, dtype=times.dtype))


class _Chunk:
    """Documents of a task until they are written as rows of the two kinds."""

    def __init__(self, schema: pa.Schema, aligner: Aligner) -> None:
        self.schema, self.aligner, self.number = schema, aligner, 0
        self.clear()

    def clear(self) -> None:
        self.ids, self.digests, self.sums = [], [], np.zeros((DOCUMENTS, 3), dtype=np.int64)
        self.void: list[int] = []  # documents whose first stretches have tokens, but not all
        self.waiting: list[tuple[int, list[int]]] = []  # documents and units of a block
        self.size, self.postings, self.held, self.most = 0, [], 0, POSTINGS

    @property
    def full(self) -> bool:
        return len(self.ids) == DOCUMENTS or self.held >= POSTINGS

    def add(self, doc_id, text: str | None) -> None:
        idx, digest = len(self.ids), hashlib.sha256()
        self.ids.append(doc_id)
        for n, part in enumerate(self.aligner.stretches(text or "")):
            if self.size >= BLOCK:
                self.settle()
            codes = self.aligner.codes(part)
            self.size += len(part)
            if codes is None:
                digest = None
                if n:
                    self.void.append(idx)
                break
            digest.update((";" * (n > 0) + ";".join(map(self.aligner.groups.__getitem__, codes))).encode())
            self.waiting.append((idx, codes))
        self.digests.append(digest.hexdigest() if digest else "")

    def settle(self) -> None:
        """Turn the links that wait into sorted postings: pair and document as one number, and how often."""
        aligner = self.aligner
        if self.waiting:
            doc = np.repeat([d for d, _ in self.waiting], [len(c) for _, c in self.waiting])
            flat = np.concatenate([np.array(c, dtype=np.int64) for _, c in self.waiting])
            sizes, ends = np.frombuffer(aligner.sizes, np.int64).reshape(-1, 3), np.frombuffer(aligner.ends, np.int64)
            np.add.at(self.sums, doc, sizes[flat])
            width = ends[flat + 1] - ends[flat]
            where = np.repeat(ends[flat] - (np.cumsum(width) - width), width) + np.arange(width.sum())
            keys = np.frombuffer(aligner.pairs, np.int64)[where] * DOCUMENTS + np.repeat(doc, width)
            del sizes, ends, where
            keys.sort()
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            self.postings.append((keys[starts], np.diff(np.append(starts, len(keys))).astype(np.int32)))
            self.held += len(starts)
            self.waiting = []
        self.size = 0
        if self.held > self.most:  # a long text's pairs come in every block
            self.postings = [merged(self.postings)]
            self.held = len(self.postings[0][0])
            self.most = max(POSTINGS, 2 * self.held)
        if aligner.held > REMEMBERED // 2:
            aligner.age()

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        n, chunk = len(self.ids), TaskContext.get().partitionId() << 32 | self.number
        self.number += 1
        self.sums[self.void] = 0
        n_a, n_b, n_groups = self.sums[:n].T
        yield self.batch("docs", chunk, n, idx=np.arange(n), doc_id=self.ids, n_a=n_a, n_b=n_b, n_groups=n_groups, groups_sha256=self.digests)
        keys, times = merged(self.postings) if self.postings else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.postings = []
        if self.void:
            kept = ~np.isin(keys % DOCUMENTS, self.void)
            keys, times = keys[kept], times[kept]
        a = 0
        while a < len(keys):  # whole pairs
            b = len(keys)
            if b - a > SLICE:
                b = int(np.searchsorted(keys, (keys[a + SLICE] // DOCUMENTS + 1) * DOCUMENTS))
            pair, docs, links, bitmaps = planes(keys[a:b] // DOCUMENTS, keys[a:b] % DOCUMENTS, times[a:b].astype(np.int64))
            yield self.batch("pairs", chunk, len(pair), pair=pair, docs=docs, links=links, planes=bitmaps)
            a = b
        self.clear()

    def batch(self, kind: str, chunk: int, n: int, **columns) -> pa.RecordBatch:
        given = {"kind": [kind] * n, "chunk": np.full(n, chunk), **columns}
        return pa.RecordBatch.from_arrays(
            [pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in self.schema], schema=self.schema
        )


def postings(df: DataFrame, byte_path: str, pattern: str, piece_path: str, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Written tables: documents (chunk, idx, doc_id, n_a, n_b, n_groups, groups_sha256), and pairs of
    each chunk (chunk, pair, docs, links, planes)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bound_batches(df)
    narrow = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    long, whole = T.LongType(), T.IntegerType()
    schema = T.StructType([
        T.StructField(n, t) for n, t in [
            ("kind", T.StringType()), ("chunk", long), ("idx", whole), ("doc_id", narrow.schema["doc_id"].dataType), ("n_a", long),
            ("n_b", long), ("n_groups", long), ("groups_sha256", T.StringType()), ("pair", long), ("docs", long), ("links", long),
            ("planes", T.BinaryType()),
        ]
    ])
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(arrow, worker_aligner(byte_path, pattern, piece_path))
        for batch in batches:
            for number, body in zip(*batch.columns):
                chunk.add(number.as_py(), body.as_py())
                if chunk.full:
                    yield from chunk.rows()
        if chunk.ids:
            yield from chunk.rows()

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/alignment-{uuid.uuid4().hex}"
    narrow.mapInArrow(cut, schema).write.partitionBy("kind").parquet(path)
    rest = T.StructType([f for f in schema if f.name != "kind"])
    written = spark.read.schema(T.StructType([*rest, schema["kind"]])).parquet(path)
    documents = written.filter("kind = 'docs'").select("chunk", "idx", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    return documents, written.filter("kind = 'pairs'").select("chunk", "pair", "docs", "links", "planes")


def pair_scores(pairs: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, docs, links, best) of every linked pair: documents, links, and whether no other pair
    of its B id has more links."""
    counted = cut_lineage(pairs.groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links")))
    counted = counted.select("pair", F.shiftright("pair", _B_BITS).alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1)).alias("b_id"), "docs", "links")
    highest = counted.groupBy("b_id").agg(F.max("links").alias("most"))
    return counted.join(highest, "b_id").select("pair", "a_id", "b_id", "docs", "links", (F.col("links") == F.col("most")).alias("best"))


def document_scores(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """(chunk, idx, n_best, count_sum): scores returned along the postings."""
    scored = pairs.select("chunk", "pair", "planes").join(scores.select("pair", F.col("links").alias("score"), "best"), "pair")

    def returned(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        score = table["score"].to_numpy().astype(np.int64)
        best = table["best"].to_numpy(zero_copy_only=False).astype(np.int64)
        totals, bests = np.zeros(DOCUMENTS, np.int64), np.zeros(DOCUMENTS, np.int64)
        for a in range(0, len(score), ROWS):
            for rows, docs, k in read_planes(table["planes"].slice(a, ROWS).to_pylist()):
                np.add.at(totals, docs, score[a + rows] << k)
                np.add.at(bests, docs, best[a + rows] << k)
        used = np.flatnonzero(totals)
        chunk = pa.array(np.full(len(used), table["chunk"][0].as_py()), pa.int64())
        return pa.table({"chunk": chunk, "idx": pa.array(used, pa.int32()), "n_best": bests[used], "count_sum": totals[used]})

    return scored.select("chunk", "planes", "score", "best").groupBy("chunk").applyInArrow(
        returned, "chunk long, idx int, n_best long, count_sum long"
    )


def align(df: DataFrame, byte_path: str, pattern: str, piece_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``df``.

    No token is empty, so a group has exactly one link: that of its last two tokens.
    """
    documents, pairs = postings(df, byte_path, pattern, piece_path, doc_id, text)
    back = document_scores(pairs, cut_lineage(pair_scores(pairs)))
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return documents.join(back, ["chunk", "idx"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256"
    )
