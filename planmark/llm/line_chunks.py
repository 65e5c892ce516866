"""Line dedup by content-defined chunks.

A text is its lines (split at \\n); lines of white space only separate. A line goes if it lies in a
passage that occurs again earlier, in this or another document, by document id and place: a passage
is two or more lines in a row, or one line of ``LONG_LINE`` words or more. Overlaps count, and
passages are judged on the input, so of every passage one copy stays.

Two neighbouring lines are the smallest passage, and every longer one is made of them. To find
repeats without grouping every pair of neighbours, a rolling hash over the hashes of the last
``WINDOW`` lines ends a chunk where it falls on a multiple of ``DIVISOR``: boundaries depend on nearby
lines alone and fall alike wherever a passage stands. A chunk also holds the line after it, so each pair
of neighbours lies in one chunk. Chunks with equal digests go whole but for the first. Only the first
chunk of each digest is opened into its pairs and long lines, which are grouped in turn: that finds the
ends of passages, and short ones between foreign lines, which share no whole chunk. The boundaries
decide what is grouped when, never what is found. All that goes has been compared byte by byte with
the copy that stays.

Digests and places are grouped with partial aggregates. Bytes of repeated chunks and pairs meet the
bytes of the copy that stays in groups of about ``COPIES`` rows: a passage with more copies is dealt out
over numbered parts. Texts move twice, compressed: to hand over those bytes, and to take the removals; both joins
are merge joins at every size, as neither the lists nor the texts have a bound.

Behaviour at the edges: a null text stays null and an empty one empty; a text that occurs earlier as a
whole becomes empty or keeps its lines of white space; very long texts are cut like others, in one
task each; rows with equal id and text are one document and get one result; of equal texts the one
with the smallest id stays, of equal passages within a text the first; null ids come last in the
order; passages with equal digests and different bytes both stay; a short line that repeats without its
neighbours stays; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from planmark.llm.common import WORD, bound_batches, spare, text_of
from planmark.session import cut_lineage

WINDOW, DIVISOR = 2, 3
#: Words that make a single line a passage.
LONG_LINE = 50
#: Copies of a passage whose bytes meet those of the first in one group.
COPIES = 1_000
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_GONE = pow(_BASE, WINDOW, 1 << 64)
_WORD = re.compile(WORD)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _is_long(line: str) -> bool:
    return len(line) >= 2 * LONG_LINE - 1 and len(_WORD.findall(line)) >= LONG_LINE


def chunk_ends(lines: list[str]) -> list[int]:
    """The index of each line after which a chunk ends; the last line always is one."""
    hashes, rolling, out = [xxhash.xxh64_intdigest(_bytes(x)) for x in lines], 0, []
    for i, own in enumerate(hashes):
        rolling = (rolling * _BASE + own) & _MASK
        if i >= WINDOW:
            rolling = (rolling - hashes[i - WINDOW] * _GONE) & _MASK
        if (rolling >> 32) % DIVISOR == 0 or i == len(lines) - 1:
            out.append(i)
    return out


def chunks(lines: list[str]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(first line, line after the last, the passages to look for in it) of each chunk of a text's lines."""
    filled = [i for i, x in enumerate(lines) if x and not x.isspace()]
    last, start = len(filled) - 1, 0
    for end in chunk_ends([lines[i] for i in filled]):
        inside = []
        for k in range(start, end + 1):
            if k < last:
                inside.append((filled[k], filled[k + 1] + 1))
            if _is_long(lines[filled[k]]):
                inside.append((filled[k], filled[k] + 1))
        if inside:
            yield filled[start], filled[min(end + 1, last)] + 1, inside
        start = end + 1


def _halves(lines: list[str], first: int, after: int) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(_bytes("\n".join(lines[first:after])))
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


_PLACE = [("first", pa.int32()), ("after", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]


def _places(columns: list[list]) -> list[pa.Array]:
    return [pa.array(values, kind) for values, (_, kind) in zip(columns, _PLACE)]


def _digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = [name for name, _ in _PLACE]
    for batch in batches:
        outer, inner = [[], [], [], []], [[], [], [], []]
        of_text, of_chunk = [0], [0]
        for text in batch:
            lines = (text.as_py() or "").split("\n")
            for first, after, inside in chunks(lines):
                for to, value in zip(outer, (first, after, *_halves(lines, first, after))):
                    to.append(value)
                for a, b in inside:
                    for to, value in zip(inner, (a, b, *_halves(lines, a, b))):
                        to.append(value)
                of_chunk.append(len(inner[0]))
            of_text.append(len(outer[0]))
        pairs = pa.StructArray.from_arrays(_places(inner), names)
        lists = pa.ListArray.from_arrays(pa.array(of_chunk, pa.int32()), pairs)
        found = pa.StructArray.from_arrays([*_places(outer), lists], [*names, "inside"])
        yield pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), found)


_KIND = "struct<first:int,after:int,h1:long,h2:long"
_CHUNKS = f"array<{_KIND},inside:array<{_KIND}>>>>"


def _packed(text: pa.Array) -> pa.Array:
    """Texts compressed one by one, for the shuffles."""
    pack = zstandard.ZstdCompressor(level=3).compress
    return pa.array([pack(_bytes(x.as_py())) if x.is_valid else None for x in text], pa.binary())


def _opened(packed: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass") if packed else ""


def _bodies(packed: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for body, wanted in zip(packed, spans):
        lines = _opened(body.as_py()).split("\n")
        out.append(["\n".join(lines[s["first"] : s["after"]]) for s in wanted.as_py() or []])
    return pa.array(out, pa.list_(pa.string()))


def without(text: str, spans: list[dict]) -> tuple[str, int]:
    """``text`` without the lines of ``spans``, and the number of stretches that went."""
    lines, kept, at, runs = text.split("\n"), [], 0, 0
    for first, after in sorted((s["first"], s["after"]) for s in spans):
        if first > at or not runs:
            kept += lines[at:first]
            runs += 1
        at = max(at, after)
    return "\n".join(kept + lines[at:]), runs


def _without(packed: pa.Array, spans: pa.Array) -> pa.Array:
    texts, runs = [], []
    for body, gone in zip(packed, spans):
        body, gone = _opened(body.as_py()) if body.is_valid else None, gone.as_py()
        body, n = (body, 0) if body is None or not gone else without(body, gone)
        texts.append(body)
        runs.append(n)
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(runs, pa.int64())], ["text", "runs"])


def _called(fn, kind: str, *columns: Column) -> Column:
    """Evaluated once, wherever the result is used."""
    return F.arrow_udf(fn, kind).asNondeterministic()(*columns)


_AT = ["c_id", "c_text", "first", "after"]


def _repeats(places: DataFrame) -> DataFrame:
    """The places whose digest occurs again, with its number of places and whether one is the first."""
    order = F.struct(F.col("c_id").isNull().alias("none"), *_AT)
    repeated = places.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(order).alias("one")).filter("n > 1")
    is_first = (
        F.col("c_id").eqNullSafe(F.col("one.c_id")) & (F.col("c_text") == F.col("one.c_text"))
        & (F.col("first") == F.col("one.first"))
    )
    return places.join(repeated, ["h1", "h2"]).select(*_AT, "h1", "h2", "n", is_first.alias("is_first"))


def removals(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(c_id, c_text, gone): for each document that loses something, the places of what goes."""
    bound_batches(df)
    documents = df.select(F.col(f"`{doc_id}`").alias("c_id"), F.col(f"`{text}`").cast("string").alias("t"))
    documents = documents.filter("t is not null").withColumn("c_text", F.unhex(F.md5("t")))
    cut = documents.withColumn("found", _called(_digests, _CHUNKS, F.col("t"))).select("c_id", "c_text", "found")
    places = cut_lineage(cut.select("c_id", "c_text", F.inline("found")))  # rows of one document are all first
    whole = cut_lineage(_repeats(places.drop("inside")))
    copies = whole.filter("not is_first").select(
        F.col("c_id").alias("w_id"), F.col("c_text").alias("w_text"), F.col("first").alias("w_first")
    )
    is_copy = F.col("c_id").eqNullSafe(F.col("w_id")) & (F.col("c_text") == F.col("w_text")) & (F.col("first") == F.col("w_first"))
    opened = cut_lineage(places.join(copies, is_copy, "left_anti").select("c_id", "c_text", F.inline("inside")))
    parts = F.ceil(F.col("n") / COPIES).cast("int")
    part = F.pmod(F.xxhash64(*_AT), F.col("parts")).cast("int")
    marked = (
        whole.withColumn("is_chunk", F.lit(True)).unionByName(_repeats(opened).withColumn("is_chunk", F.lit(False)))
        .withColumn("parts", parts).withColumn("part", part).drop("n")
    )
    held = [c for c in marked.columns if c not in ("c_id", "c_text")]
    wanted = marked.groupBy("c_id", "c_text").agg(F.collect_set(F.struct(*held)).alias("spans")).select(
        F.col("c_id").alias("w_id"), F.col("c_text").alias("w_text"), "spans"
    )
    compressed = documents.select("c_id", "c_text", _called(_packed, "binary", F.col("t")).alias("t"))
    bodies = cut_lineage(
        compressed.join(wanted.hint("merge"), F.col("c_id").eqNullSafe(F.col("w_id")) & (F.col("c_text") == F.col("w_text")))
        .withColumn("bodies", _called(_bodies, "array<string>", F.col("t"), F.col("spans")))
        .select("c_id", "c_text", F.explode(F.arrays_zip("spans", "bodies")).alias("p"))
        .select("c_id", "c_text", "p.spans.*", F.col("p.bodies").alias("body"))
    )
    group = ["is_chunk", "h1", "h2", "part"]
    firsts = (
        bodies.filter("is_first").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(*group, F.col("body").alias("o_body")).distinct()
    )
    gone = bodies.filter("not is_first").join(firsts, group).filter(F.col("body") == F.col("o_body"))
    return gone.groupBy("c_id", "c_text").agg(F.collect_set(F.struct("first", "after")).alias("gone"))


def dedup_lines(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str | None = None, count: str | None = None
) -> DataFrame:
    """``df`` with repeated passages removed from ``text`` (or written to ``out``); ``count`` names a
    column for the number of stretches of lines that went."""
    lost = removals(df, doc_id, text)
    key_id, key_text, spans, clean, packed = spare(df, "chunk_id", "chunk_text", "chunk_spans", "chunk_clean", "chunk_packed")
    lost = cut_lineage(lost).select(
        F.col("c_id").alias(f"{key_id}_g"), F.col("c_text").alias(f"{key_text}_g"), F.col("gone").alias(spans)
    )
    rows = df.withColumns({
        key_id: F.col(f"`{doc_id}`"), key_text: F.unhex(F.md5(text_of(text))),
        packed: _called(_packed, "binary", F.col(f"`{text}`").cast("string")),
    })
    rows = rows if out else rows.drop(text)
    same = F.col(key_id).eqNullSafe(F.col(f"{key_id}_g")) & (F.col(key_text) == F.col(f"{key_text}_g"))
    joined = rows.join(lost.hint("merge"), same, "left").drop(f"{key_id}_g", f"{key_text}_g", key_id, key_text)
    call = _called(_without, "struct<text:string,runs:long>", F.col(packed), F.col(spans))
    cleaned = {out or text: F.col(f"{clean}.text")}
    if count:
        cleaned[count] = F.col(f"{clean}.runs")
    names = list(dict.fromkeys([*df.columns, *cleaned]))
    return joined.withColumn(clean, call).withColumns(cleaned).select(*[F.col(f"`{c}`") for c in names])
