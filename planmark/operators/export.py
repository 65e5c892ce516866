"""Flat and nested forms of the result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from planmark import reference as ref
from planmark.session import cut_lineage

ELEMENTS_PER_DOCUMENT = 10_000


def guarded(value: Column) -> Column:
    """A quote before text that a spreadsheet would run as a formula; empty for null."""
    text = F.coalesce(value, F.lit(""))
    risky = F.substring(text, 1, 1).isin(ref.CSV_FORMULA_PREFIXES)
    return F.when(risky, F.concat(F.lit("'"), text)).otherwise(text)


def fixed(value: Column, digits: int = 4) -> Column:
    """Fixed number of decimals, halves of the exact binary value to even; empty for null."""
    text = F.replace(F.format_number(value.cast("double"), digits), F.lit(","), F.lit(""))
    return F.coalesce(text, F.lit(""))


def export_summary(
    drawings: DataFrame, entities: DataFrame, detections: DataFrame, associations: DataFrame,
    title_blocks: DataFrame, flags: DataFrame,
) -> DataFrame:
    """One flat row per drawing."""
    n = lambda df, name: df.groupBy("drawing_id").agg(F.count("*").alias(name))
    ent = entities.groupBy("drawing_id").agg(
        F.count("*").alias("entity_count"),
        F.bool_or(F.col("entity_type") == "PART_NUMBER").alias("has_part_number"),
    )
    titled = title_blocks.select("drawing_id", F.lit(True).alias("has_title_block")).distinct()
    joined = drawings
    for child in (
        ent, n(detections, "detection_count"), n(associations, "association_count"), titled,
        n(flags, "review_flag_count"),
    ):
        joined = joined.join(child, "drawing_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return joined.select(
        "drawing_id", "source_file",
        F.date_format("processing_timestamp", "yyyy-MM-dd HH:mm:ss").alias("processing_timestamp"),
        fixed(F.col("overall_confidence")).alias("overall_confidence"),
        "needs_review", "status", zero("entity_count"), zero("detection_count"), zero("association_count"),
        no("has_part_number"), no("has_title_block"), zero("review_flag_count"),
    )


def _with_source(rows: DataFrame, drawings: DataFrame) -> DataFrame:
    return rows.join(drawings.select("drawing_id", "source_file"), "drawing_id")


def export_entities(entities: DataFrame, drawings: DataFrame) -> DataFrame:
    return _with_source(entities, drawings).select(
        "drawing_id", "source_file", "entity_id", "entity_type",
        guarded(F.col("value")).alias("value"), guarded(F.col("original_text")).alias("original_text"),
        fixed(F.col("confidence")).alias("confidence"), "extraction_method",
        *[F.col(f"bbox.{p}").alias(f"bbox_{p}") for p in ("x", "y", "width", "height")],
    )


def export_detections(detections: DataFrame, drawings: DataFrame) -> DataFrame:
    return _with_source(detections, drawings).select(
        "drawing_id", "source_file", "detection_id", "class_name",
        fixed(F.col("confidence")).alias("confidence"),
        *[F.col(f"bbox.{p}").alias(f"bbox_{p}") for p in ("x", "y", "width", "height")],
        *[
            fixed(F.col(f"bbox_normalized.{p}")).alias(f"bbox_norm_{p}")
            for p in ("x_center", "y_center", "width", "height")
        ],
    )


def export_associations(associations: DataFrame, drawings: DataFrame) -> DataFrame:
    return _with_source(associations, drawings).select(
        "drawing_id", "source_file", "association_id", "text_id", F.col("detection_id").alias("shape_id"),
        "relationship_type", fixed(F.col("confidence")).alias("confidence"),
        fixed(F.col("distance_pixels")).alias("distance_pixels"),
    )


def nested_documents(
    drawings: DataFrame, children: dict[str, tuple[DataFrame, str]], elements: int = ELEMENTS_PER_DOCUMENT
) -> DataFrame:
    """One nested row per drawing; ``children`` maps a list name to (table, key column).

    Drawings and the rows of all lists are one union, shuffled once by drawing and gathered in one
    aggregate; lists are ordered by key, then by the other columns, and missing ones are empty. A drawing
    with more than ``elements`` rows in a list is spread over numbered parts by the digest of the row, so
    no list outgrows a task and no row is lost. Only drawings that need several parts are listed, in a
    small table of known size.
    """
    rows = None
    for name, (table, key) in children.items():
        row = F.struct(key, *[c for c in table.columns if c not in ("drawing_id", key)])
        own = table.where("drawing_id is not null").select(
            "drawing_id", F.lit(name).alias("n_list"), F.xxhash64(row).alias("n_digest"), row.alias(name)
        )
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    need = F.ceil(F.count("*") / elements).cast("int")
    needed = cut_lineage(
        rows.groupBy("drawing_id", "n_list").agg(need.alias("need")).where("need > 1")
        .groupBy("drawing_id").agg(F.max("need").alias("parts"))
    )

    def placed(df: DataFrame, part: Column) -> DataFrame:
        known = df.join(needed, "drawing_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        return known.withColumn("part", part)

    heads = drawings.select("drawing_id", F.struct(*drawings.columns).alias("n_own"))
    heads = placed(heads, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lists = placed(rows, F.pmod("n_digest", "parts").cast("int")).drop("n_list", "n_digest")
    gathered = heads.unionByName(lists, allowMissingColumns=True).groupBy("drawing_id", "part").agg(
        F.first("n_own", ignorenulls=True).alias("n_own"), F.max("parts").alias("parts"),
        *[F.array_sort(F.collect_list(name)).alias(name) for name in children],
    )
    return gathered.where("n_own is not null").select("n_own.*", "parts", "part", *children)


def nested_json_export(
    drawings: DataFrame, children: dict[str, tuple[DataFrame, str]], elements: int = ELEMENTS_PER_DOCUMENT,
    roots: DataFrame | None = None, edges: DataFrame | None = None,
) -> DataFrame:
    """(drawing_id, part, document) with the document as JSON text.

    With ``roots`` (drawing_id, root_id) and ``edges`` (drawing_id, parent_id, child_id, relationship,
    confidence) a document has a ``hierarchy`` of root component and assemblies, null where it has neither.
    """
    if edges is not None:
        children = {**children, "assemblies": (edges, "parent_id")}
        drawings = drawings.join(
            roots.select("drawing_id", F.col("root_id").alias("root_component_id")), "drawing_id", "left"
        )
    nested = nested_documents(drawings, children, elements)
    if edges is not None:
        parts = ("root_component_id", "assemblies")
        any_part = F.col(parts[0]).isNotNull() | (F.size(parts[1]) > 0)
        nested = nested.withColumn("hierarchy", F.when(any_part, F.struct(*parts))).drop(*parts)
    return nested.select("drawing_id", "part", F.to_json(F.struct(*nested.columns), {"ignoreNullFields": "false"}).alias("document"))


def json_schema_check(documents: DataFrame) -> DataFrame:
    """Errors of each document (columns doc_id, document): required fields, confidence, lists."""
    value = F.try_parse_json("document")
    with_doc = documents.withColumn("v", value)
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    kind_of = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    present = lambda field: get(f"$.{field}", "variant").isNotNull()
    required = [
        F.when(~present(f), F.lit(f"Missing required field: {f}"))
        for f in ("drawing_id", "source_file", "processing_timestamp")
    ]
    confidence = get("$.overall_confidence", "double")
    numeric = kind_of("$.overall_confidence").rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)")
    score = F.when(
        present("overall_confidence"),
        F.when(~numeric, F.lit("Invalid confidence type")).when(
            ~confidence.between(0.0, 1.0), F.lit("Confidence out of range [0.0, 1.0]")
        ),
    )

    def listed(field: str, label: str, singular: str, needed: tuple[str, str]) -> Column:
        items = get(f"$.{field}", "array<variant>")
        bad_list = F.when(
            present(field) & ~kind_of(f"$.{field}").startswith("ARRAY"), F.array(F.lit(f"{label} must be a list"))
        )

        def faults(item: Column, i: Column) -> Column:
            prefix = F.concat(F.lit(f"{singular} "), i.cast("string"))
            is_object = F.schema_of_variant(item).startswith("OBJECT")
            lacks = [
                F.when(
                    F.try_variant_get(item, f"$.{name}", "variant").isNull(),
                    F.concat(prefix, F.lit(f" missing {name}")),
                )
                for name in needed
            ]
            return F.when(~is_object, F.array(F.concat(prefix, F.lit(" must be a dictionary")))).otherwise(
                F.array_compact(F.array(*lacks))
            )

        each = F.flatten(F.transform(items, faults))
        return F.coalesce(bad_list, each, F.array().cast("array<string>"))

    errors = F.concat(
        F.array_compact(F.array(*required, score)),
        listed("entities", "Entities", "Entity", ("entity_type", "value")),
        listed("detections", "Detections", "Detection", ("class_name", "bbox")),
    )
    unreadable = F.array(F.lit("Not a JSON document"))
    return with_doc.select(
        "doc_id", F.when(F.col("v").isNull(), unreadable).otherwise(errors).alias("errors")
    )
