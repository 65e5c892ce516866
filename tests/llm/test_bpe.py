import base64
import hashlib
import itertools
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from planmark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS, public_tokenizers.PATTERN)


def ids(text):
    raw = ENCODER.encode(text)
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'sa.1 　é"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_as_the_library(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)


def test_all_short_white_space_as_the_library():
    for size in range(7):
        for letters in itertools.product(" \n\t\r\xa0\u3000a", repeat=size):
            text = "".join(letters)
            assert ids(text) == REFERENCE.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("text", [
    "", " ", "   ", "a  b", "a \n b", "\n\n a", "it's we'll I'd", "x" * 5000, "ab" * 4000, "日本語テキスト" * 50, "<|endoftext|>",
    "aaaa aaaa   ", " a   b", "tab\tand  two", "é ², ٣ _under_",
])
def test_cases_as_the_library(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)


def test_random_bytes_of_one_pre_token():
    draw = random.Random(3)
    for size in (1, 2, 3, 10, 500, 20_000):
        piece = "".join(draw.choice("etaoinabc") for _ in range(size))
        assert bpe.merge(piece.encode(), RANKS) == REFERENCE.encode_ordinary(piece)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    small = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for text in ("one two three four five", "six seven, eight.", "one two three"):
        raw = small.encode(text)
        assert [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)] == REFERENCE.encode_ordinary(text)


def test_operator_round_trip(documents):
    texts = [None, "", "plain words", "plain words", "Ünï çödé 日本", "y" * 30_000, "two  blanks\n"]
    df = documents(*[(i if i else None, t) for i, t in enumerate(texts)], ids="clash", decoded=1)
    out = bpe.decode_ids(bpe.encode_text(df, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(out) == len(texts)
    for row in out:
        assert list(row["ids"]) == REFERENCE.encode_ordinary(row["text"] or "")
        assert bytes(row["decoded"]) == (row["text"] or "").encode()


def test_empty_table_and_bad_id(spark, documents):
    none = documents((1, "x")).filter("doc_id > 1")
    assert bpe.decode_ids(bpe.encode_text(none, PATH, public_tokenizers.PATTERN), PATH).count() == 0
    odd = spark.createDataFrame([([60_000],)], "ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode_ids(odd, PATH).collect()
    some = spark.createDataFrame([(None,), ([],), ([64, None, 65],)], "ids array<int>")
    back = {bytes(r["decoded"]) for r in bpe.decode_ids(some, PATH).collect()}
    token = {v: k for k, v in RANKS.items()}
    assert back == {b"", token[64] + token[65]}
    assert base64.b64encode(token[64])


def test_round_trip_in_one_pass(documents):
    texts = [None, "", "a \xa0 \xa0b", "plain words, twice, plain words", "y" * 30_000, "z " * 700_000]
    df = documents(*[(i, t) for i, t in enumerate(texts)], tokens2=1, ids="clash")
    for row in bpe.round_trip(df, PATH, public_tokenizers.PATTERN).collect():
        want = REFERENCE.encode_ordinary(row["text"] or "")
        assert row["tokens"]["ids"] == want and row["ids"] == "clash"
        assert row["tokens"]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert row["tokens"]["decoded_sha256"] == hashlib.sha256((row["text"] or "").encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_pre_tokens_share_a_queue():
    draw = random.Random(5)
    pieces = ["".join(draw.choice("etaoin 'é日") for _ in range(draw.choice((0, 1, 2, 5, 9, 40)))).encode() for _ in range(400)]
    assert bpe.merge_all(pieces, RANKS) == [bpe.merge(x, RANKS) for x in pieces]
    # "abc" ranks below "ab": it goes first although other places of "ab" wait
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"ab": 301, b"abca": 302, b"ca": 303}
    for piece in (b"abcab", b"ababcaab", b"aabcabca"):
        want = tiktoken.Encoding("odd", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary(piece.decode())
        assert bpe.merge_all([b"abx", piece, b"xabcab"], ranks)[1] == want


def test_texts_encoded_together_as_alone():
    texts = ["one, two  three", "", " two\n", "two one", "z" * 70 + " " + "z" * 70, " \xa0 \xa0", "y-y " * 30]
    together = bpe.Encoder(RANKS, public_tokenizers.PATTERN).encode_all(texts)
    assert together == [bpe.Encoder(RANKS, public_tokenizers.PATTERN).encode(x) for x in texts]
    for raw, text in zip(together, texts):
        assert [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)] == REFERENCE.encode_ordinary(text)
