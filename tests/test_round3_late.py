"""Findings of round 3 that were mended last."""

from planmark.operators import extract


def test_fuzzy_match_of_small_drawings_as_by_pieces(spark):
    kinds = "drawing_id long, block_no long, text_id long, content string"
    words = ["PART NO: ABC-10017", "PART NO: ABC-10071", "BOLT", "", "Ø12.5 ± 0.1 mm", "WEIGHT: 10.25 kg", "BOLT"]
    blocks = spark.createDataFrame([(d, i, 10 * d + i, w) for d in (1, 2) for i, w in enumerate(words)] + [(3, 0, 30, None)], kinds)
    asked = ["PART NQ: ABC-lOOl7", "BOLT", "", "WEIGHT: lO.25 kg", "NO: ABC", "BOLT", "elsewhere", None]
    wanted = spark.createDataFrame(
        [(d, 100 * d + i, w) for d in (1, 2, 3) for i, w in enumerate(asked)], "drawing_id long, wanted_id long, text string"
    )
    for threshold in (0.2, 0.6, 0.85, 1.0):
        ways = [sorted(map(tuple, extract.fuzzy_block_match(wanted, blocks, threshold, limit).collect())) for limit in (64, 0)]
        assert ways[0] == ways[1] and {101, 105} <= {r[0] for r in ways[0]}
    plan = extract.fuzzy_block_match(wanted, blocks)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan  # no rows made of pairs of letters
