"""Text blocks to typed entities."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from planmark import reference as ref
from planmark.functions import bbox as bb, text as tx, units
from planmark.operators import spatial
from planmark.operators.ordered import following

# Every match holds one of these pieces, and a test for the piece is far cheaper than the pattern.
_PREFILTER = {
    "PART_NUMBER": r"[A-Z]{2}[-_]?[A-Z0-9]{4}",
    "DIMENSION": r"[\d.±\s](?:[cm]?m|in(?:ch)?|\")\b",
    "WEIGHT": r"(?i)[\d.\s](?:kg|g|lbs|oz)\b",
    "THREAD_SPEC": r"M\d|\d\s*UN[CF]",
    "MATERIAL": r"(?i)steel|aluminum|brass|stainless|titanium|plastic",
    "SURFACE_FINISH": r"(?:Ra|N)\s*\d",
    "TOLERANCE": "±",
}


def enabled_types(types: list[str] | None) -> list[str]:
    """Empty means all."""
    return [t for t in ref.ENTITY_TYPES if not types or t in types]


def _matches(text: Column, kind: str) -> Column:
    """Struct of kind, confidence and the array of matches."""
    pattern, confidence = ref.REGEX_LAYERS[kind]
    found = F.when(
        text.rlike(tx.UNICODE + _PREFILTER[kind]),
        F.regexp_extract_all(text, F.lit(tx.UNICODE + pattern), F.lit(0)),
    ).otherwise(F.array().cast("array<string>"))
    return F.struct(F.lit(kind).alias("entity_type"), F.lit(confidence).alias("confidence"), found.alias("found"))


def regex_entities(text_blocks: DataFrame, types: list[str] | None = None, strict: bool = False) -> DataFrame:
    """All pattern layers in one pass over the text. Layers and then their matches become rows, in compiled code, as a function
    over the items of an array would be interpreted.

    ``strict`` asks part numbers for a digit, which drops all-caps words.
    """
    kinds = [k for k in ref.REGEX_LAYERS if k in enabled_types(types)]
    if not kinds:
        return _finish(text_blocks.where(F.lit(False)).withColumn("hit", F.lit(None).cast(
            "struct<entity_type:string,original_text:string,occurrence:bigint,confidence:double>")), "regex")
    layers = F.array(*[_matches(F.col("content"), kind) for kind in kinds])
    place = ["text_id", "drawing_id", "bbox"]
    found = (
        text_blocks.select(*place, F.explode(layers).alias("layer"))
        .select(*place, "layer", F.posexplode("layer.found").alias("no", "match"))
        .select(*place, F.struct(
            "layer.entity_type", F.col("match").alias("original_text"), (F.col("no") + 1).cast("bigint").alias("occurrence"),
            "layer.confidence",
        ).alias("hit"))
    )
    kind = F.col("hit.entity_type")
    number = tx.ascii_digits(
        F.regexp_extract("hit.original_text", tx.UNICODE + r"\d+\.?\d*", 0)
    ).try_cast("double")
    keep = (kind != "DIMENSION") | number.isNotNull()
    if strict:
        keep = keep & ((kind != "PART_NUMBER") | F.col("hit.original_text").rlike(r"\d"))
    return _finish(found.where(keep), "regex")


def entity_id() -> Column:
    return tx.make_id("ENT", *map(F.col, ("source_text_id", "entity_type", "occurrence", "extraction_method")))


def _finish(found: DataFrame, method: str) -> DataFrame:
    text = F.col("hit.original_text")
    rows = found.select(
        "drawing_id",
        F.col("hit.entity_type").alias("entity_type"),
        F.trim(text).alias("value"),
        text.alias("original_text"),
        F.col("hit.confidence").alias("confidence"),
        F.lit(method).alias("extraction_method"),
        F.col("text_id").alias("source_text_id"),
        F.col("hit.occurrence").alias("occurrence"),
        "bbox",
    )
    return rows.select(entity_id().alias("entity_id"), "*")


def naming_blocks(text_blocks: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Blocks that may hold a name: a plain substring test spares the others the split into tokens."""
    return text_blocks.where(tx.contains_any(F.lower("content"), [name.lower() for name in (names or ref.OEM_NAMES)]))


def dictionary_entities(text_blocks: DataFrame, names: list[str] | DataFrame | None = None) -> DataFrame:
    """Manufacturer names as whole tokens, any case, a row for every mention; each is linked to the first block of
    its drawing that holds the text of the mention, and mentions of a block are numbered in reading order. A list of
    names is a literal set, a table of names is joined."""
    tokens = F.split("content", r"[^A-Za-z0-9]+")
    place = ["drawing_id", "block_no", "text_id"]
    if isinstance(names, DataFrame):
        known = names.select(F.lower("name").alias("known")).distinct()
        likely = text_blocks
        mentions = likely.select(*place, F.posexplode(tokens).alias("pos", "token")).join(
            known, F.lower("token") == F.col("known"), "left_semi"
        )
    else:
        known = [name.lower() for name in (names or ref.OEM_NAMES)]
        likely = naming_blocks(text_blocks, names)
        mentions = likely.select(*place, F.posexplode(tokens).alias("pos", "token")).where(F.lower("token").isin(known))
    mentions = mentions.where("token <> ''")
    first = (
        mentions.select("drawing_id", "token").distinct()
        .join(likely.select(*place, "content", "bbox"), "drawing_id").where(F.contains("content", "token"))
        .groupBy("drawing_id", "token")
        .agg(F.min_by(F.struct("text_id", "bbox"), F.struct("block_no", "text_id")).alias("block"))
    )
    order = Window.partitionBy("drawing_id", "block.text_id").orderBy("block_no", "text_id", "pos")
    found = mentions.join(first, ["drawing_id", "token"]).withColumn("no", F.row_number().over(order).cast("bigint"))
    found = found.select("drawing_id", "token", "no", "block.*")
    hit = F.struct(
        F.lit("OEM").alias("entity_type"),
        F.col("token").alias("original_text"),
        F.col("no").alias("occurrence"),
        F.lit(ref.DICTIONARY_CONFIDENCE).alias("confidence"),
    )
    return _finish(found.withColumn("hit", hit), "spacy")


def extract_entities(
    text_blocks: DataFrame,
    types: list[str] | None = None,
    names: list[str] | DataFrame | None = None,
    strict: bool = False,
) -> DataFrame:
    """Pattern layers and dictionary layer. Their types differ, so no cross-layer copy can arise."""
    found = regex_entities(text_blocks, types, strict)
    if "OEM" in enabled_types(types):
        found = found.unionByName(dictionary_entities(text_blocks, names))
    return found


def normalized_value(kind: Column, value: Column) -> Column:
    """STRUCT with the parsed number, unit and base-unit value for dimensions and weights."""
    dim = F.when(kind == "DIMENSION", units.dimension_value(value))
    weight = F.when(kind == "WEIGHT", units.weight_value(value))
    return F.struct(
        value.alias("raw"),
        F.coalesce(dim["value"], weight["value"]).alias("value"),
        F.coalesce(dim["unit"], weight["unit"]).alias("unit"),
        dim["tolerance"].alias("tolerance"),
        dim["is_diameter"].alias("is_diameter"),
        dim["value_mm"].alias("value_mm"),
        weight["value_kg"].alias("value_kg"),
    )


def with_normalized(entities: DataFrame) -> DataFrame:
    return entities.withColumn(
        "normalized_value", normalized_value(F.col("entity_type"), F.col("value"))
    )


def type_filter(entities: DataFrame, types: list[str] | None) -> DataFrame:
    return entities.where(F.col("entity_type").isin(types)) if types else entities


def missing_critical(drawings: DataFrame, entities: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(drawing, type) for each critical type a drawing lacks."""
    types = types or ref.CRITICAL_TYPES
    have = entities.where(F.col("entity_type").isin(types)).select("drawing_id", "entity_type")
    wanted = drawings.select("drawing_id", F.explode(F.array(*map(F.lit, types))).alias("entity_type"))
    return wanted.join(have, ["drawing_id", "entity_type"], "left_anti")


def dedup_entities(new: DataFrame, existing: DataFrame, min_iou: float = 0.3) -> DataFrame:
    """Drop a new row when an existing one has the same type and text and overlaps it,
    or when either box is missing."""
    old = existing.select(
        "drawing_id",
        "entity_type",
        F.lower("value").alias("folded"),
        F.col("bbox").alias("old_bbox"),
    ).distinct()
    return (
        new.withColumn("folded", F.lower("value"))
        .join(
            old.withColumnsRenamed({"drawing_id": "d", "entity_type": "t", "folded": "f"}),
            (F.col("drawing_id") == F.col("d"))
            & (F.col("entity_type") == F.col("t"))
            & (F.col("folded") == F.col("f"))
            & (
                F.col("bbox").isNull()
                | F.col("old_bbox").isNull()
                | (bb.iou(F.col("bbox"), F.col("old_bbox")) >= min_iou)
            ),
            "left_anti",
        )
        .drop("folded")
    )


# ---- model replies -------------------------------------------------------------------------


def reply_entities(replies: DataFrame, default: float = ref.MODEL_REPLY_CONFIDENCE) -> DataFrame:
    """JSON replies (drawing_id, reply_id, reply) to entity rows; a malformed reply gives none,
    an entry of unknown type or without a value ends its reply."""
    schema = "struct<entities:array<struct<type:string,value:string,confidence:double>>>"
    rows = replies.select(
        "drawing_id", "reply_id", F.posexplode(F.from_json("reply", schema)["entities"]).alias("i", "e")
    )
    bad = F.col("e.value").isNull() | F.coalesce(~F.col("e.type").isin(ref.ENTITY_TYPES), F.lit(True))
    flagged = rows.withColumn("bad", bad)
    first_bad = flagged.groupBy("reply_id").agg(F.min(F.when(F.col("bad"), F.col("i"))).alias("stop"))
    return (
        flagged.join(first_bad, "reply_id")
        .where(F.col("stop").isNull() | (F.col("i") < F.col("stop")))
        .select(
            tx.make_id("ENT", F.col("reply_id"), F.col("i"), F.lit("llm")).alias("entity_id"),
            "drawing_id",
            F.col("e.type").alias("entity_type"),
            F.col("e.value").alias("value"),
            F.col("e.value").alias("original_text"),
            F.coalesce(F.col("e.confidence"), F.lit(default)).alias("confidence"),
            F.lit("llm").alias("extraction_method"),
            F.lit(None).cast("bigint").alias("source_text_id"),
            (F.col("i") + 1).cast("bigint").alias("occurrence"),
            F.lit(None).cast("struct<x:int,y:int,width:int,height:int>").alias("bbox"),
        )
    )


def apply_ocr_corrections(
    text_blocks: DataFrame, replies: DataFrame, threshold: float = ref.LOW_TEXT_CONFIDENCE
) -> DataFrame:
    """Replace text and confidence of weak blocks by verification replies (text_id, reply)."""
    fixed = replies.select(
        "text_id",
        F.lit(True).alias("checked"),
        F.from_json("reply", "struct<corrected_text:string>")["corrected_text"].alias("fixed"),
    )
    weak = (F.col("confidence") < threshold) & F.col("checked")
    text = F.coalesce(F.when(weak, F.col("fixed")), F.col("content"))
    score = F.when(weak, F.when(text != F.col("content"), F.lit(0.95)).otherwise(F.lit(0.85)))
    return (
        text_blocks.join(fixed, "text_id", "left")
        .withColumn("new_confidence", F.coalesce(score, F.col("confidence")))
        .withColumn("content", text)
        .drop("confidence", "checked", "fixed")
        .withColumnRenamed("new_confidence", "confidence")
    )


def assessment_scores(replies: DataFrame) -> DataFrame:
    """Quality replies from 0–10 to 0–1; a missing score or an unreadable reply counts 5."""
    parsed = F.from_json(
        "reply",
        "struct<overall_quality:double,complexity:double,text_clarity:double,"
        "shape_clarity:double,recommended_pipeline:string>",
    )
    part = lambda name: F.coalesce(F.col("p")[name] / 10.0, F.lit(0.5))
    return replies.withColumn("p", parsed).select(
        "drawing_id",
        part("overall_quality").alias("overall_quality"),
        part("complexity").alias("complexity_score"),
        part("text_clarity").alias("text_clarity"),
        part("shape_clarity").alias("shape_clarity"),
        F.coalesce(F.col("p.recommended_pipeline"), F.lit("baseline")).alias("recommended_pipeline"),
    )


def merge_ocr_engines(primary: DataFrame, fallback: DataFrame, threshold: float = ref.LOW_TEXT_CONFIDENCE) -> DataFrame:
    """Take the fallback reading of a weak block where it is strictly more confident."""
    other = fallback.select(
        "text_id", F.col("content").alias("other"), F.col("confidence").alias("other_confidence")
    )
    better = (F.col("confidence") < threshold) & (F.col("other_confidence") > F.col("confidence"))
    better = F.coalesce(better, F.lit(False))
    cleaned = F.replace(tx.normalize_whitespace(F.col("other")), F.lit("|"), F.lit("I"))
    return (
        primary.join(other, "text_id", "left")
        .withColumn("better", better)
        .withColumn("content", F.when(F.col("better"), cleaned).otherwise(F.col("content")))
        .withColumn("ocr_engine", F.when(F.col("better"), "easyocr").otherwise(F.col("ocr_engine")))
        .withColumn(
            "confidence",
            F.when(F.col("better"), F.col("other_confidence")).otherwise(F.col("confidence")),
        )
        .drop("better", "other", "other_confidence")
    )


# ---- title block ---------------------------------------------------------------------------


def mark_title_blocks(text_blocks: DataFrame, width: int, height: int) -> DataFrame:
    """Blocks in the lower right corner of the page get the region ``title_block``."""
    corner = (F.col("bbox.x") > 0.6 * width) & (F.col("bbox.y") > 0.7 * height)
    return text_blocks.withColumn(
        "region_type", F.when(corner, F.lit("title_block")).otherwise(F.col("region_type"))
    )


def title_block_region(marked: DataFrame) -> DataFrame:
    """Union box of the title block, one row per drawing that has one."""
    box = F.col("bbox")
    return (
        marked.where(F.col("region_type") == "title_block")
        .groupBy("drawing_id")
        .agg(
            F.min(bb.left(box)).alias("x1"),
            F.min(bb.top(box)).alias("y1"),
            F.max(bb.right(box)).alias("x2"),
            F.max(bb.bottom(box)).alias("y2"),
            F.count("*").alias("blocks"),
        )
        .select(
            "drawing_id",
            bb.from_corners(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))).alias("bbox"),
            F.lit(0.8).alias("confidence"),
            "blocks",
        )
    )


def title_block_fields(marked: DataFrame, names: list[str] | None = None) -> DataFrame:
    """First part number, manufacturer, scale, date and revision of the joined title-block text.

    The texts of a drawing are never joined in memory. Part number and date hold no blank, so
    they lie inside one block. Scale and revision may start at the end of one block and go on in
    the next, so each block is read together with the block that follows it. Blocks of blanks and
    colons alone are passed over, however many stand between, as both patterns run across them.
    """
    title = marked.where(F.col("region_type") == "title_block").select(
        "drawing_id", "text_id", "block_no", "content"
    )
    speaks = F.coalesce(F.col("content").rlike(tx.UNICODE + r"[^:\s]"), F.lit(False))
    joined = following(title.where(speaks), ["drawing_id"], "block_no", "text_id", "content", "next_content")
    silent = title.where(~speaks).withColumn("next_content", F.lit(None).cast("string"))
    joined = joined.unionByName(silent)
    own = F.col("content")
    pair = F.concat_ws(" ", own, F.col("next_content"))

    def inside(pattern: str, group: int = 0) -> Column:
        return F.nullif(F.regexp_extract(own, tx.UNICODE + pattern, group), F.lit(""))

    def across(pattern: str) -> Column:
        """A match that begins in this block; one that begins in the next block is left to it."""
        start = F.regexp_instr(pair, F.lit(tx.UNICODE + pattern))
        begins_here = (start > 0) & (start <= F.length(own))
        return F.when(begins_here, F.nullif(F.regexp_extract(pair, tx.UNICODE + pattern, 1), F.lit("")))

    lowered = F.lower(own)
    known = names or ref.OEM_NAMES
    oems = F.array_compact(F.array(*[F.when(lowered.contains(n.lower()), F.lit(n)) for n in known]))
    order = F.struct("block_no", "text_id")
    first = lambda value: F.min_by(F.col(value), F.when(F.col(value).isNotNull(), order))
    return (
        joined.select(
            "drawing_id", "block_no", "text_id",
            inside(ref.PART_NUMBER_PATTERN).alias("part_number"),
            F.array_min(oems).alias("oem"),
            across(ref.SCALE_PATTERN).alias("scale"),
            inside(ref.DATE_PATTERN).alias("date"),
            across(ref.REVISION_PATTERN).alias("revision"),
        )
        .groupBy("drawing_id")
        .agg(
            first("part_number").alias("part_number"),
            F.min("oem").alias("oem"),
            first("scale").alias("scale"),
            first("date").alias("date"),
            first("revision").alias("revision"),
        )
    )


# ---- search --------------------------------------------------------------------------------


def entity_tokens(entities: DataFrame) -> DataFrame:
    """Token table of type, value and original text."""
    # blanks around the original text hold no tokens, so where they are all that differs it need not be cut as well
    other = F.when(F.trim("original_text") == F.col("value"), None).otherwise(F.col("original_text"))
    text = F.lower(F.concat_ws(" ", "entity_type", "value", other))
    tokens = F.array_remove(F.array_distinct(F.split(text, r"[^\p{L}\p{N}]+")), "")
    return entities.select("drawing_id", "entity_id", "entity_type", F.explode(tokens).alias("token"))


def entity_search(entities: DataFrame, query: str) -> DataFrame:
    """Entities that hold every token of the query."""
    wanted = sorted({t for t in re.split(r"[\W_]+", query.lower()) if t})
    return (
        entity_tokens(entities)
        .where(F.col("token").isin(wanted))
        .groupBy("drawing_id", "entity_id", "entity_type")
        .agg(F.count("*").alias("hits"))
        .where(F.col("hits") == len(wanted))
        .drop("hits")
    )


# ---- fuzzy match of a text to its block ------------------------------------------------------


def fuzzy_block_match(
    wanted: DataFrame, text_blocks: DataFrame, threshold: float = 0.85, dense_limit: int = spatial.DENSE_LIMIT
) -> DataFrame:
    """Block of the same drawing that holds the text, else the most similar one at or above the
    threshold; ``wanted`` has drawing_id, wanted_id and text. An empty text matches nothing.

    Texts and blocks of a small drawing are paired on the drawing alone, in one task and without keys made of letters;
    a drawing with more of both than twice ``dense_limit`` takes the join on pieces of text.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and not above 1")
    wanted = wanted.select("wanted_id", "drawing_id", "text")
    rows = wanted.select("drawing_id").unionByName(text_blocks.select("drawing_id"))
    dense = spatial.dense_drawings(rows, 2 * dense_limit)
    few = _match_in_small(spatial.without_dense(wanted, dense), spatial.without_dense(text_blocks, dense), threshold)
    many = dense and _match_by_pieces(spatial.only_dense(wanted, dense), spatial.only_dense(text_blocks, dense), threshold)
    return spatial.union_parts(few, many)


def _close(threshold: float) -> Column:
    """Whether ``text`` and ``content`` can reach the ratio: it is at most that of the shorter length, and Levenshtein is a
    lower bound of the insertions and deletions that it allows."""
    total = F.length("text") + F.length("content")
    shorter = 2 * F.least(F.length("text"), F.length("content")) >= threshold * total - 1e-6
    return shorter & (F.levenshtein(F.col("text"), F.col("content")) <= (1 - threshold) * total)


def _match_in_small(wanted: DataFrame, text_blocks: DataFrame, threshold: float) -> DataFrame:
    """All steps keep the rows of a drawing where one shuffle by drawing has put them."""
    from planmark.functions.similarity import ratio_similarity

    blocks = (
        text_blocks.select("drawing_id", "content", "block_no", "text_id").repartition("drawing_id")
        .groupBy("drawing_id", "content").agg(F.min(F.struct("block_no", "text_id")).alias("block"))
    )
    texts = (
        wanted.where("text <> ''").repartition("drawing_id")
        .groupBy("drawing_id", "text").agg(F.collect_list(F.struct("wanted_id")).alias("asked"))
    )
    holds = F.col("content").contains(F.col("text"))
    met = (
        texts.join(blocks.hint("merge"), "drawing_id").where(holds | _close(threshold))
        .groupBy("drawing_id", "text")
        .agg(
            F.first("asked").alias("asked"),
            F.min(F.when(holds, F.col("block"))).alias("holding"),
            F.collect_list(F.when(~holds, F.struct("content", "block"))).alias("similar"),
        )
    )
    # a block that holds the text settles it, so nothing is compared then
    open_ones = F.when(F.col("holding").isNull(), F.col("similar"))
    ratio = ratio_similarity("text", "s.content")
    best = (
        met.select("drawing_id", "text", "asked", "holding", F.explode_outer(open_ones).alias("s"))
        .withColumn("ratio", ratio)
        .groupBy("drawing_id", "text")
        .agg(
            F.first("asked").alias("asked"),
            F.first("holding").alias("holding"),
            F.min(F.when(F.col("ratio") >= threshold, F.struct((-F.col("ratio")).alias("ratio"), "s.block"))).alias("near"),
        )
        .where(F.col("holding").isNotNull() | F.col("near").isNotNull())
    )
    exact = F.col("holding").isNotNull()
    return best.select(
        F.explode("asked.wanted_id").alias("wanted_id"),
        "drawing_id",
        F.coalesce("holding.text_id", "near.block.text_id").alias("text_id"),
        F.when(exact, F.lit(1.0)).otherwise(-F.col("near.ratio")).alias("ratio"),
        exact.alias("exact"),
    )


def _match_by_pieces(wanted: DataFrame, text_blocks: DataFrame, threshold: float) -> DataFrame:
    """A ratio of at least ``threshold`` leaves at most (1-t)(a+b) insertions and deletions, so of
    that many plus one pieces of the text one survives whole in the block: the join runs on
    (drawing, leading pair of letters of a piece). Levenshtein, a lower bound of those edits,
    thins the candidates before Python sees them. Where a piece would be shorter than two letters,
    single letters are the key: a ratio above zero needs a common one.
    """
    from planmark.functions.similarity import ratio_similarity

    # equal texts of a drawing are compared once: the first block stands for its copies
    blocks = (
        text_blocks.groupBy("drawing_id", "content")
        .agg(F.min(F.struct("block_no", "text_id")).alias("first"))
        .select("drawing_id", "content", "first.*")
    )
    texts = wanted.select("drawing_id", "text").distinct()
    pairs_of = lambda c: F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    )
    letters_of = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    size = F.length("text")
    # at most so many characters of both are not matched; every matched one is matched in order
    edits = F.floor((1 - threshold) * size * (1 + (2 - threshold) / threshold)).cast("int")
    piece = F.floor(size / (edits + 1)).cast("int")
    starts = F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1)), F.greatest(piece, F.lit(1)))
    pieces = F.when(
        piece >= 2, F.transform(starts, lambda i: F.substring(F.col("text"), i, F.lit(2)))
    ).otherwise(letters_of(F.col("text")))
    asked = texts.select("drawing_id", "text", F.explode(F.array_distinct(pieces)).alias("pair"))
    offered = blocks.select(
        "*", F.explode(F.array_union(pairs_of(F.col("content")), letters_of(F.col("content")))).alias("pair")
    )
    hit = asked.join(offered, ["drawing_id", "pair"]).where(F.col("content").contains(F.col("text")) | _close(threshold))
    candidates = hit.drop("pair").dropDuplicates(["drawing_id", "text", "content"])
    exact = F.col("content").contains(F.col("text"))
    holding = candidates.where(exact).select("*", F.lit(1.0).alias("ratio"), F.lit(1).alias("exact"))
    similar = (
        candidates.where(~exact)
        .withColumn("ratio", ratio_similarity("text", "content"))
        .where(F.col("ratio") >= threshold)
        .withColumn("exact", F.lit(0))
    )
    order = F.struct(
        F.col("exact"),
        F.when(F.col("exact") == 1, F.lit(0.0)).otherwise(F.col("ratio")).alias("rank"),
        (-F.col("block_no")).alias("first"),
    )
    best = (
        holding.unionByName(similar)
        .groupBy("drawing_id", "text")
        .agg(
            F.max_by("text_id", order).alias("text_id"),
            F.max_by("ratio", order).alias("ratio"),
            F.max_by(F.col("exact") == 1, order).alias("exact"),
        )
    )
    return (
        wanted.select("wanted_id", "drawing_id", "text")
        .join(best, ["drawing_id", "text"])
        .select("wanted_id", "drawing_id", "text_id", "ratio", "exact")
    )
