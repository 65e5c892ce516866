"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte pieces. Every adjacent pair whose joined bytes are a token
waits in the bucket of that token's rank; two levels of bitmaps tell which buckets hold something,
so the next rank is found by two find-first-set steps whatever the length of the pre-token. Inside
a bucket the leftmost position comes first. Entries are never searched for removal: an entry whose
position has another rank by now is stale and skipped. The cost of a pre-token of n bytes is
O(n log n) at worst, where rescanning for the best pair would be O(n^2).

Behaviour at the edges: a null text is an empty text and gives no ids; text is encoded as UTF-8;
strings that look like special tokens are ordinary text; equal texts give equal ids; of equal pairs the leftmost merges
first; a very long text is encoded as a whole, in an Arrow slice of its own; an empty table gives an empty one; columns beside
the text are passed through untouched, and an existing column of the output's name is replaced.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from planmark.llm.common import bound_batches, slices

#: A leaf word of the bitmap has 2 to this power bits. The word above has a bit for each leaf.
LEAF = 8
LOW = (1 << LEAF) - 1
#: Characters of short pre-tokens that share a queue: few enough for its lists to stay in the processor's cache.
QUEUED = 2_000
#: Pre-tokens whose ids a worker process remembers. When as many are new, those not met since go
#: (some 200 MB for both generations).
REMEMBERED = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: merge the pair of lowest rank, leftmost first, until none is left."""
    return merge_all([piece], ranks)[0]


def merge_all(pieces: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Ids of each pre-token, all of them in one queue, as no pair reaches across pre-tokens and a rank
    that many of them hold is then found once.

    The queue is written out in the loop, as calls would dominate: ``buckets`` holds the positions of
    each rank (a heap), ``leaves`` a bit for each rank, ``top`` a bit for each leaf that is not empty. A bucket is
    emptied at one go unless a merge lets a lower rank appear.
    """
    rank_of = ranks.get
    out: list[list[int]] = [[] for _ in pieces]
    bounds, at, parts = [], 0, []
    for n, piece in enumerate(pieces):
        whole = rank_of(piece)
        if whole is not None:
            out[n].append(whole)
        elif piece:
            bounds.append((n, at, at + len(piece)))
            parts.append(piece)
            at += len(piece)
    body, size = b"".join(parts), at
    waiting = [rank_of(body[i : i + 2]) for i in range(size)]  # rank of the pair that starts here
    after = list(range(1, size + 1))  # where the next piece starts
    before = list(range(-1, size))
    edge = bytearray(size + 1)  # 1 where a pre-token ends
    for _, start, end in bounds:
        before[start] = -1
        waiting[end - 1] = None
        edge[end] = 1
    buckets: dict[int, list[int]] = {}
    for i, rank in enumerate(waiting):
        if rank is not None:
            bucket = buckets.get(rank)
            if bucket is None:
                buckets[rank] = [i]
            else:
                bucket.append(i)  # ascending, hence a heap
    leaves: dict[int, int] = {}
    top = 0
    for rank in buckets:
        leaf = rank >> LEAF
        leaves[leaf] = leaves.get(leaf, 0) | 1 << (rank & LOW)
        top |= 1 << leaf
    while top:
        leaf = (top & -top).bit_length() - 1
        word = leaves[leaf]
        rank = leaf << LEAF | (word & -word).bit_length() - 1
        bucket = buckets[rank]
        while bucket:
            left = heappop(bucket) if len(bucket) > 1 else bucket.pop()
            if waiting[left] != rank:
                continue  # stale
            right = after[left]
            end = after[left] = after[right]
            waiting[right] = None
            lowest = rank
            if edge[end]:
                waiting[left] = None
            else:
                before[end] = left
                grown = waiting[left] = rank_of(body[left : after[end]])
                if grown is not None:
                    held = buckets.get(grown)
                    if held is None:
                        buckets[grown] = [left]
                        leaf = grown >> LEAF
                        leaves[leaf] = leaves.get(leaf, 0) | 1 << (grown & LOW)
                        top |= 1 << leaf
                    else:
                        heappush(held, left)
                    if grown < lowest:
                        lowest = grown
            start = before[left]
            if start >= 0:
                joined = waiting[start] = rank_of(body[start:end])
                if joined is not None:
                    held = buckets.get(joined)
                    if held is None:
                        buckets[joined] = [start]
                        leaf = joined >> LEAF
                        leaves[leaf] = leaves.get(leaf, 0) | 1 << (joined & LOW)
                        top |= 1 << leaf
                    else:
                        heappush(held, start)
                    if joined < lowest:
                        lowest = joined
            if lowest < rank:
                break
        if not bucket:
            del buckets[rank]
            leaf = rank >> LEAF
            leaves[leaf] ^= 1 << (rank & LOW)
            if not leaves[leaf]:
                top ^= 1 << leaf
    for n, start, end in bounds:
        ids = out[n]
        while start < end:
            stop = after[start]
            ids.append(ranks[body[start:stop]])
            start = stop
    return out


class Encoder:
    """Ids of texts. Works unit by unit: no pre-token crosses a blank between two characters that are not
    white space, except by taking it as its first character, so a unit with its blank has the same ids everywhere.
    A blank beside other white space belongs to a longer unit."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.after_blank: dict[str, bytes] = {}  # ids of a pre-token that begins with a blank
        self.other: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})  # the same, not met of late

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit numbers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The same for each text; pre-tokens that none of them met before are merged in one queue."""
        if len(self.after_blank) + len(self.other) > REMEMBERED:
            self.older = (self.after_blank, self.other)
            self.after_blank, self.other = {}, {}
        get, rows, new, firsts = self.after_blank.get, [], set(), set()
        for text in texts:
            pieces = text.split(" ")
            if "" in pieces or list(map(str.strip, pieces)) != pieces:
                pieces = list(_units(pieces))
            found = list(map(get, pieces))
            found[0] = self.other.get(pieces[0])
            if found[0] is None:
                firsts.add(pieces[0])
            missing = [i for i, x in enumerate(found) if x is None] if None in found else []
            new.update(pieces[i] for i in missing if i)
            rows.append((pieces, found, missing))
        rare, rare_first = self._learn(new, firsts) if new or firsts else ({}, {})
        out, get_first = [], self.other.get
        for pieces, found, missing in rows:
            for i in missing:
                unit = pieces[i]
                known = get(unit) if i else get_first(unit)
                found[i] = known if known is not None else (rare if i else rare_first)[unit]
            out.append(b"".join(found))
        return out

    def _learn(self, new: set[str], firsts: set[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Make known the units ``new``, each behind a blank, and ``firsts``, which have none. Those that are too
        long to be remembered are returned."""
        cut: list[tuple[bool, str, list[str]]] = []
        pending: dict[str, bytes] = {}  # pre-tokens, with their blank
        older, older_first = self.older
        for unit in new:
            found = older.get(unit)
            if found is not None:
                self.after_blank[unit] = found
            elif unit.isascii() and unit.isalpha():
                piece = " " + unit  # one pre-token
                pending[piece] = b""
                if len(unit) > 63:
                    cut.append((True, unit, [piece]))
            else:
                cut.append((True, unit, self.find(" " + unit)))
        cut += [(False, unit, self.find(unit)) for unit in firsts]
        for _, _, pieces in cut:
            for piece in pieces:
                if piece not in pending and self._known(piece) is None:
                    pending[piece] = b""
        names = list(pending)
        for a, b in slices(names, QUEUED):
            for piece, ids in zip(names[a:b], merge_all([x.encode() for x in names[a:b]], self.ranks)):
                packed = pending[piece] = array("i", ids).tobytes()
                if len(piece) <= 64:
                    if piece[0] == " ":
                        self.after_blank[piece[1:]] = packed
                    else:
                        self.other[piece] = packed
        rare: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        for behind, unit, pieces in cut:
            ids = b"".join([pending[x] if x in pending else self._known(x) for x in pieces])
            if not behind:
                rare[1][unit] = ids
            elif len(unit) <= 24:
                self.after_blank[unit] = ids
            else:
                rare[0][unit] = ids
        return rare

    def _known(self, piece: str) -> bytes | None:
        """The ids of a pre-token met before."""
        side, key = (0, piece[1:]) if piece[0] == " " else (1, piece)
        known = self.other if side else self.after_blank
        found = known.get(key)
        if found is None:
            found = self.older[side].get(key)
            if found is not None:
                known[key] = found
        return found


def _units(pieces: list[str]) -> Iterator[str]:
    """``pieces`` between blanks, joined again where white space stands on either side of the blank."""
    held = [pieces[0]]
    for piece in pieces[1:]:
        if held[-1] and piece and not held[-1][-1].isspace() and not piece[0].isspace():
            yield " ".join(held)
            held = [piece]
        else:
            held.append(piece)
    yield " ".join(held)


@lru_cache(maxsize=1)
def worker_encoder(path: str, pattern: str) -> Encoder:
    """One for all tasks of a worker process, so that pre-tokens merged once stay known."""
    return Encoder(load_ranks(path), pattern)


def _lists(parts: list[bytes], width: int, values) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // width for x in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values(b"".join(parts)))


def _encode(encoder: Encoder, texts: list[str]) -> pa.Array:
    chunks = [
        _lists(encoder.encode_all(texts[a:b]), 4, lambda raw: pa.array(np.frombuffer(raw, "<i4")))
        for a, b in slices(texts)
    ]
    return pa.concat_arrays(chunks) if chunks else pa.array([], pa.list_(pa.int32()))


def _decode(tokens: dict[int, bytes], ids: pa.Array) -> pa.Array:
    """The bytes of each list of ids; one list at a time is in memory as numbers."""
    values, of = ids.values, ids.offsets.to_pylist()
    valid = ids.is_valid().to_pylist()
    out = []
    for ok, a, b in zip(valid, of[:-1], of[1:]):
        mine = values.slice(a, b - a) if ok else values.slice(0, 0)
        if mine.null_count:
            mine = mine.drop_null()
        try:
            out.append(b"".join(map(tokens.__getitem__, mine.to_numpy(zero_copy_only=False).tolist())))
        except KeyError as e:
            raise ValueError(f"id {e} is not in the vocabulary") from None
    return pa.array(out, pa.binary())


def _book(words: dict[int, bytes]) -> pa.Array:
    """``words`` by id, null where an id has none."""
    return pa.array([words.get(i) for i in range(max(words) + 1)], pa.large_binary())


def _digests(book: pa.Array, ids: pa.Array, less: int = 0) -> list[str]:
    """For each list of ids the digest of its words joined, without the last ``less`` bytes."""
    words = book.take(ids.flatten())
    _, places, body = words.buffers()
    starts = np.frombuffer(places, np.int64)[ids.offsets.to_numpy()] if len(words) else np.zeros(len(ids) + 1, np.int64)
    body = memoryview(body or b"")
    bounds = starts.tolist()
    return [hashlib.sha256(body[a : max(a, b - less)]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]


def encode_text(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``, the token ids of ``text`` (array of int). Narrow: no row moves.

    ``path`` is the rank file; workers read it where they run, as it is installed on every machine.
    """

    bound_batches(df)

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = worker_encoder(path, pattern)
        for batch in batches:
            yield _encode(encoder, [x or "" for x in batch.to_pylist()])

    # so that no later projection computes the ids a second time
    return df.withColumn(out, encoded.asNondeterministic()(F.col(f"`{text}`").cast("string")))


def decode_ids(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``, the bytes of the tokens in ``ids`` (empty for null or no ids; a null id has none).

    An id that the rank file does not hold ends the task with a ValueError.
    """

    bound_batches(df)

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = {i: t for t, i in load_ranks(path).items()}
        for batch in batches:
            yield _decode(tokens, batch)

    return df.withColumn(out, decoded.asNondeterministic()(F.col(f"`{ids}`")))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """Adds ``out``, a struct of the ids of ``text``, their digest (of decimal ids with a blank between) and that of the bytes
    they decode to: ``ids``, ``ids_sha256``, ``decoded_sha256``. Texts and ids pass to Python and back once."""

    bound_batches(df)

    @F.arrow_udf("struct<ids:array<int>,ids_sha256:string,decoded_sha256:string>")
    def done(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = worker_encoder(path, pattern)
        tokens = _book({i: t for t, i in encoder.ranks.items()})
        digits = _book({i: b"%d " % i for i in encoder.ranks.values()})
        for batch in batches:
            texts = [x or "" for x in batch.to_pylist()]
            for a, b in slices(texts):
                ids = _encode(encoder, texts[a:b])
                spelled, bodies = _digests(digits, ids, 1), _digests(tokens, ids)
                yield pa.StructArray.from_arrays([ids, pa.array(spelled, pa.string()), pa.array(bodies, pa.string())], ["ids", "ids_sha256", "decoded_sha256"])
            if not texts:
                yield pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    return df.withColumn(out, done.asNondeterministic()(F.col(f"`{text}`").cast("string")))
