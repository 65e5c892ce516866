import math

import pytest
from pyspark.sql import functions as F

from planmark.functions import bbox as bb, text as tx, units
from planmark.functions.similarity import ratio_similarity


def value(spark, column, **literals):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()])
    return df.select(column.alias("r")).first()["r"]


def box(x, y, w, h):
    return bb.box(*(F.lit(v) for v in (x, y, w, h)))


@pytest.mark.parametrize(
    "make, expected",
    [
        (lambda: tx.normalize_whitespace(F.lit("  a \t b\n\nc ")), "a b c"),
        (lambda: tx.normalize_whitespace(F.lit("a  b")), "a b"),
        (lambda: tx.remove_special_characters(F.lit("A-1 (b)! c.d"), "-."), "A-1 b c.d"),
        (lambda: tx.extract_numbers(F.lit("1,5 and -3.25 and 1,234.5 and 7")), [1.5, -3.25, 7.0]),
        (lambda: tx.extract_pattern(F.lit("abc 123"), r"\d+"), "123"),
        (lambda: tx.extract_pattern(F.lit("abc"), r"\d+"), None),
        (lambda: tx.normalize_symbols(F.lit("Ø25 ±0.1 90°")), "diameter25 plus_minus0.1 90degrees"),
        (lambda: tx.split_camel_case(F.lit("partNumberX")), "part Number X"),
        (lambda: tx.truncate_text(F.lit("abcdefghij"), 8), "abcde..."),
        (lambda: tx.truncate_text(F.lit("abc"), 8), "abc"),
        (lambda: tx.capitalize_first(F.lit("steel plate")), "Steel plate"),
        (lambda: tx.normalize_line_endings(F.lit("a\r\nb\rc")), "a\nb\nc"),
        (lambda: tx.clean_ocr_text(F.lit("|l O .. x ,y")), "I1 0. x,y"),
        (lambda: tx.extract_words(F.lit("a bc, def-g"), 2), ["bc", "def"]),
        (lambda: tx.count_words(F.lit("a bc, def-g")), 4),
        (lambda: tx.is_numeric_text(F.lit("1,234.50 a")), True),
        (lambda: tx.is_numeric_text(F.lit(" ,.")), False),
        (lambda: tx.looks_like_dimension(F.lit("Ø25 ±0.1mm")), True),
        (lambda: tx.looks_like_dimension(F.lit("NOTE: 25 mm")), False),
        (lambda: tx.text_type(F.lit("25.4 mm")), "dimension"),
        (lambda: tx.text_type(F.lit("BOLT")), "label"),
        (lambda: tx.text_type(F.lit("see the other sheet")), "note"),
        (lambda: tx.feature_type(F.lit("Ø25 mm"), F.lit("gear")), "diameter"),
        (lambda: tx.feature_type(F.lit("R5"), F.lit("gear")), "radius"),
        (lambda: tx.feature_type(F.lit("10x20"), F.lit("plate")), "length_width"),
        (lambda: tx.feature_type(F.lit("M8"), F.lit("bolt")), "thread_size"),
        (lambda: tx.feature_type(F.lit("10"), F.lit("hole")), "diameter"),
        (lambda: tx.safe_filename(F.lit('dir/a<b>:c?.pdf ')), "a_b__c_.pdf"),
        (lambda: tx.safe_filename(F.lit("...")), "unnamed"),
        (lambda: tx.safe_filename(F.lit("abcdefgh.pdf"), 8), "abcd.pdf"),
        (lambda: tx.export_filename(F.lit("a/b\\c")), "a_b_c"),
        (lambda: tx.ensure_extension(F.lit("a.PDF"), "pdf"), "a.PDF"),
        (lambda: tx.ensure_extension(F.lit("a.txt"), ".pdf"), "a.txt.pdf"),
        (lambda: tx.is_drawing_id(F.lit("DWG-20250101-120000-0a1b2c3d")), True),
        (lambda: tx.is_email(F.lit("a.b@c.org")), True),
        (lambda: tx.is_url(F.lit("https://x.org/a b")), False),
        (lambda: tx.json_ok(F.lit('{"a":1}')), True),
        (lambda: tx.json_ok(F.lit("{a")), False),
        (lambda: tx.token_estimate(F.lit("one two  three")), 3),
        (lambda: tx.token_estimate(F.lit(""), "provider"), 1),
        (lambda: units.detect_unit(F.lit("25 mg")), "g"),
        (lambda: units.detect_unit(F.lit("mg")), "mg"),
        (lambda: units.detect_unit(F.lit("1.5 inch")), "inch"),
        (lambda: units.convert_unit(F.lit(1.0), F.lit("inch"), F.lit("mm")), 25.4),
        (lambda: units.convert_unit(F.lit(1.0), F.lit("kg"), F.lit("mm")), None),
        (lambda: units.convert_unit(F.lit(1.0), F.lit("ell"), F.lit("mm")), None),
        (lambda: bb.iou(box(0, 0, 10, 10), box(0, 0, 10, 10)), 1.0),
        (lambda: bb.iou(box(0, 0, 10, 10), box(0, 0, 5, 5)), 0.25),
        (lambda: bb.iou(box(0, 0, 10, 10), box(10, 0, 10, 10)), 0.0),
        (lambda: bb.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)), 0.0),
        (lambda: bb.distance(box(0, 0, 10, 10), box(13, 14, 5, 5)), 5.0),
        (lambda: bb.distance(box(0, 0, 10, 10), box(10, 10, 5, 5)), 0.0),
        (lambda: bb.contains(box(0, 0, 10, 10), box(0, 0, 10, 10)), True),
        (lambda: bb.overlaps(box(0, 0, 10, 10), box(10, 10, 5, 5)), True),
        (lambda: bb.point_in(F.lit(10), F.lit(0), box(0, 0, 10, 10)), True),
        (lambda: bb.edge_distance(F.lit(3.0), F.lit(5.0), box(0, 0, 10, 10)), 3.0),
        (lambda: bb.edge_distance(F.lit(13.0), F.lit(14.0), box(0, 0, 10, 10)), 5.0),
        (lambda: bb.aspect_ratio(box(0, 0, 10, 4)), 2.5),
        (lambda: bb.aspect_ratio(box(0, 0, 10, 0)), None),
        (lambda: bb.points_to_pixels(F.lit(10.0), 150), 20),
        (lambda: bb.segment_hits(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0), box(4, 4, 2, 2)), True),
        (lambda: bb.segment_hits(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0), box(4, 1, 2, 2)), False),
        (lambda: bb.segment_hits(F.lit(5.0), F.lit(0.0), F.lit(5.0), F.lit(9.0), box(4, 4, 2, 2)), True),
    ],
)
def test_scalar(spark, make, expected):
    found = value(spark, make())
    if isinstance(expected, float):
        assert math.isclose(found, expected, abs_tol=1e-9)
    else:
        assert found == expected


def test_box_results(spark):
    as_tuple = lambda c: tuple(value(spark, c))
    assert as_tuple(bb.expand(box(5, 5, 10, 10), 10)) == (0, 0, 25, 25)
    assert as_tuple(bb.clip(box(90, 90, 20, 20), 100, 100)) == (90, 90, 10, 10)
    assert as_tuple(bb.intersection(box(0, 0, 10, 10), box(5, 5, 10, 10))) == (5, 5, 5, 5)
    assert as_tuple(bb.intersection(box(0, 0, 1, 1), box(5, 5, 10, 10))) == (0, 0, 0, 0)
    assert as_tuple(bb.scale(box(10, 10, 5, 5), 0.5)) == (12, 12, 2, 2)
    back = as_tuple(bb.denormalize(bb.normalize(box(100, 50, 33, 21), 1000, 800), 1000, 800))
    assert all(abs(a - b) <= 1 for a, b in zip(back, (100, 50, 33, 21)))
    points = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((1.9, 2.2), (9.7, 2.0), (9.1, 8.8))])
    assert as_tuple(bb.points_to_bbox(points)) == (1, 2, 8, 6)


def test_dimension_value(spark):
    parsed = value(spark, units.dimension_value(F.lit("Ø25.4 ± 0.1 mm")))
    assert (parsed["value"], parsed["tolerance"], parsed["unit"], parsed["is_diameter"]) == (25.4, 0.1, "mm", True)
    inch = value(spark, units.dimension_value(F.lit("1 inch")))
    assert (inch["value"], inch["unit"]) == (1.0, "inch") and math.isclose(inch["value_mm"], 25.4)
    assert value(spark, units.dimension_value(F.lit("none"))) is None


def test_similarity(spark):
    df = spark.createDataFrame([("ABC-123", "ABC-12З"), ("a", "b")], "l string, r string")
    found = [r[0] for r in df.select(ratio_similarity("l", "r")).collect()]
    assert math.isclose(found[0], 12 / 14) and found[1] == 0.0
