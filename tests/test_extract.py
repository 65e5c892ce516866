from pyspark.sql import functions as F

from planmark.functions import bbox as bb
from planmark.operators import extract
from tests.conftest import rows


def blocks(spark, *contents, drawing=1):
    data = [(i, drawing, i, text, 0.9) for i, text in enumerate(contents)]
    df = spark.createDataFrame(data, "text_id bigint, drawing_id bigint, block_no bigint, content string, confidence double")
    return df.withColumn("bbox", bb.box(F.lit(0), F.col("text_id") * 30, F.lit(100), F.lit(20))).withColumn(
        "region_type", F.lit("title_block")
    ).withColumn("ocr_engine", F.lit("paddleocr"))


SAMPLE = ["PART NO: ABC-12345-REV2", "Ø25.4 ± 0.1 mm", "MATERIAL: Steel 304", "WEIGHT: 2.5 kg", "M8 x 1.25"]


def test_patterns(spark):
    found = extract.regex_entities(blocks(spark, *SAMPLE))
    assert set(rows(found, "source_text_id", "entity_type", "value")) == {
        (0, "PART_NUMBER", "ABC-12345-REV2"),
        (1, "DIMENSION", "Ø25.4 ± 0.1 mm"),
        (1, "TOLERANCE", "± 0.1 mm"),
        (2, "MATERIAL", "Steel 304"),
        (2, "PART_NUMBER", "MATERIAL"),
        (3, "WEIGHT", "2.5 kg"),
        (3, "PART_NUMBER", "WEIGHT"),
        (4, "THREAD_SPEC", "M8"),
    }
    strict = extract.regex_entities(blocks(spark, *SAMPLE), ["PART_NUMBER"], strict=True)
    assert rows(strict, "value") == [("ABC-12345-REV2",)]


def test_ids_are_stable(spark):
    one, two = (rows(extract.extract_entities(blocks(spark, *SAMPLE)), "entity_id") for _ in range(2))
    assert one == two and len(set(one)) == len(one)


def test_dictionary(spark):
    df = blocks(spark, "bearing by skf", "SKFX, SKF and SKF", "Timken SKF", "none")
    found = rows(extract.dictionary_entities(df), "value", "source_text_id", "occurrence")
    # every mention, at the first block that holds its text
    assert found == [("SKF", 1, 1), ("SKF", 1, 2), ("SKF", 1, 3), ("Timken", 2, 1), ("skf", 0, 1)]
    ids = rows(extract.dictionary_entities(df), "entity_id")
    assert len(set(ids)) == len(ids)
    names = spark.createDataFrame([("Bearing",)], "name string")
    assert rows(extract.dictionary_entities(df, names), "value", "source_text_id") == [("bearing", 0)]


def test_a_mention_lies_in_an_earlier_block(spark):
    df = blocks(spark, "type SKF22", "by SKF")
    assert rows(extract.dictionary_entities(df), "value", "source_text_id", "occurrence") == [("SKF", 0, 1)]


def test_title_block_spans_blocks(spark):
    df = blocks(spark, "SCALE:", "1:5 REV", "B 3/04/2024", "PN ABC-10020 Timken", "SKF SCALE 2:1")
    found = extract.title_block_fields(df).first().asDict()
    assert found == {
        "drawing_id": 1, "part_number": "ABC-10020", "oem": "SKF", "scale": "1:5", "date": "3/04/2024", "revision": "B",
    }


def test_replies(spark):
    df = spark.createDataFrame(
        [
            (1, 1, '{"entities":[{"type":"OEM","value":"SKF"},{"type":"WEIGHT","value":"2 kg","confidence":0.4}]}'),
            (1, 2, '{"entities":[{"type":"OEM","value":"A"},{"type":"WRONG","value":"B"},{"type":"OEM","value":"C"}]}'),
            (1, 3, "no json"),
        ],
        "drawing_id bigint, reply_id bigint, reply string",
    )
    assert rows(extract.reply_entities(df), "entity_type", "value", "confidence") == [
        ("OEM", "A", 0.9), ("OEM", "SKF", 0.9), ("WEIGHT", "2 kg", 0.4),
    ]


def test_fuzzy_match_against_brute_force(spark, views):
    import difflib

    texts = views.text_blocks
    wanted = texts.select("drawing_id", F.col("text_id").alias("wanted_id"), F.translate("content", "0O1", "OQl").alias("text"))
    found = {r["wanted_id"]: (r["text_id"], r["exact"]) for r in extract.fuzzy_block_match(wanted, texts).collect()}
    by_drawing = {}
    for r in texts.orderBy("block_no").collect():
        by_drawing.setdefault(r["drawing_id"], []).append((r["text_id"], r["content"]))
    for r in wanted.collect():
        offered = by_drawing[r["drawing_id"]]
        best = next(((i, True) for i, c in offered if r["text"] in c), None)
        if best is None:
            ratio, top = 0.0, None
            for i, c in offered:
                now = difflib.SequenceMatcher(None, r["text"], c).ratio()
                if now > ratio and now >= 0.85:
                    ratio, top = now, i
            best = None if top is None else (top, False)
        assert found.get(r["wanted_id"]) == best, r
