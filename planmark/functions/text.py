"""Text expressions: Columns in, Columns out, all inside the JVM."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column, functions as F

from planmark import reference as ref

UNICODE = "(?U)"  # Java \b \d \s cover Unicode only with this flag

#: Every decimal digit beyond ASCII, by the Unicode tables, and the ASCII digit it stands for.
_DIGITS = [chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
_VALUES = "".join(str(unicodedata.decimal(d)) for d in _DIGITS)


def ascii_digits(text: Column) -> Column:
    """Decimal digits of all scripts as 0 to 9, so that a cast reads them."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, "".join(_DIGITS), _VALUES)).otherwise(text)


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, UNICODE + r"\s+", " "))


def remove_special_characters(text: Column, keep: str = "") -> Column:
    kept = "".join("\\" + ch for ch in keep)
    cleaned = F.regexp_replace(text, rf"{UNICODE}[^a-zA-Z0-9\s{kept}]", "")
    return normalize_whitespace(cleaned)


def extract_numbers(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"-?\d+(?:[.,]\d+)*"), F.lit(0))
    parsed = F.transform(
        found, lambda number: F.replace(number, F.lit(","), F.lit(".")).try_cast("double")
    )
    return F.array_compact(parsed)


def extract_pattern(text: Column, pattern: str) -> Column:
    """First match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def normalize_symbols(text: Column) -> Column:
    return reduce(
        lambda done, pair: F.replace(done, F.lit(pair[0]), F.lit(pair[1])),
        ref.SYMBOL_WORDS.items(),
        text,
    )


def split_camel_case(text: Column) -> Column:
    return F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")


def truncate_text(text: Column, max_length: int, suffix: str = "...") -> Column:
    keep = max_length - len(suffix)
    return F.when(F.length(text) <= max_length, text).otherwise(
        F.concat(F.substring(text, 1, keep), F.lit(suffix))
    )


def capitalize_first(text: Column) -> Column:
    rest = F.substring(text, F.lit(2), F.length(text))
    return F.concat(F.upper(F.substring(text, 1, 1)), rest)


def normalize_line_endings(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def clean_ocr_text(text: Column) -> Column:
    swapped = F.translate(text, "|Ol", "I01")
    merged = F.regexp_replace(swapped, "[.,;:!?]{2,}", ".")
    tight = F.regexp_replace(merged, UNICODE + r"\s([.,;:!?])", "$1")
    return normalize_whitespace(tight)


def extract_words(text: Column, min_length: int = 2) -> Column:
    words = F.regexp_extract_all(text, F.lit(UNICODE + r"\b[a-zA-Z0-9]+\b"), F.lit(0))
    return F.filter(words, lambda word: F.length(word) >= min_length)


def count_words(text: Column) -> Column:
    return F.size(extract_words(text, 1))


def is_numeric_text(text: Column) -> Column:
    packed = F.translate(text, " ,.", "")
    digits = F.length(F.regexp_replace(packed, UNICODE + r"[^\d]", ""))
    return F.coalesce(F.try_divide(digits, F.length(packed)) > 0.7, F.lit(False))


def looks_like_dimension(text: Column) -> Column:
    """Has a digit and a dimension word, and none of the title words."""
    return (
        ~text.rlike(UNICODE + ref.TITLE_WORDS)
        & text.rlike(r"\d")
        & text.rlike(UNICODE + ref.DIMENSION_WORDS)
    )


def text_type(text: Column) -> Column:
    letters = F.replace(text, F.lit(" "), F.lit(""))
    return (
        F.when(text.rlike(r'\d+\.?\d*\s*(mm|cm|in|inch|")'), F.lit("dimension"))
        .when((F.length(text) <= 10) & letters.rlike(r"^\p{L}+$"), F.lit("label"))
        .otherwise(F.lit("note"))
    )


def feature_type(value: Column, class_name: Column) -> Column:
    value, shape = F.lower(value), F.lower(class_name)
    by_cross = lambda other: F.when(value.contains("x"), F.lit("length_width")).otherwise(F.lit(other))
    return (
        F.when(value.rlike(r"(ø|diameter|dia\.?)\s*\d+\.?\d*"), F.lit("diameter"))
        .when(value.rlike(r"r\s*\d+\.?\d*"), F.lit("radius"))
        .when(shape.isin("circle", "hole", "cylinder", "shaft"), by_cross("diameter"))
        .when(shape.isin("rectangle", "block", "plate"), by_cross("dimension"))
        .when(
            shape.isin("bolt", "screw", "thread"),
            F.when(value.contains("m") | value.contains("thread"), F.lit("thread_size"))
            .otherwise(F.lit("length")),
        )
        .otherwise(by_cross("dimension"))
    )


def safe_filename(name: Column, max_length: int = 255) -> Column:
    """Last path element without characters that file systems refuse."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    clean = F.regexp_replace(base, r'[<>:"\\|?*]', "_")
    clean = F.regexp_replace(clean, r"^[. ]+|[. ]+$", "")
    named = F.when(clean == "", F.lit("unnamed")).otherwise(clean)
    extension = file_extension(named)
    stem = F.substring(named, F.lit(1), F.length(named) - F.length(extension))
    short = F.concat(F.substring(stem, F.lit(1), max_length - F.length(extension)), extension)
    return F.when(F.length(named) > max_length, short).otherwise(named)


def export_filename(name: Column) -> Column:
    """Name cleaning of the exporters: path separators become underscores too."""
    clean = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")
    clean = F.regexp_replace(clean, r"^[. ]+|[. ]+$", "")
    return F.when(clean == "", F.lit("unnamed")).otherwise(clean)


def file_extension(name: Column) -> Column:
    """Extension with its point; leading points belong to the name."""
    return F.regexp_extract(name, r"[^./](?:[^/]*?)(\.[^./]*)$", 1)


def ensure_extension(name: Column, extension: str) -> Column:
    extension = extension if extension.startswith(".") else "." + extension
    return F.when(F.lower(file_extension(name)) == extension.lower(), name).otherwise(
        F.concat(name, F.lit(extension))
    )


def split_path(path: Column) -> Column:
    """Struct of directory, name and extension."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    extension = file_extension(base)
    return F.struct(
        F.regexp_extract(path, r"^(.*?)/+[^/]*$", 1).alias("directory"),
        F.substring(base, F.lit(1), F.length(base) - F.length(extension)).alias("name"),
        extension.alias("extension"),
    )


def make_id(prefix: str, *keys: Column) -> Column:
    """Deterministic identifier, so that a rerun writes the same ids."""
    joined = F.concat_ws("|", *[key.cast("string") for key in keys])
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(joined, 256), 1, 16))


def is_drawing_id(text: Column) -> Column:
    return text.rlike(r"^[A-Z]+-\d{8}-\d{6}-[a-f0-9]{8}$")


def is_email(text: Column) -> Column:
    return text.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")


def is_url(text: Column) -> Column:
    return text.rlike(UNICODE + r"^https?://[^\s/$.?#].[^\s]*$")


def json_ok(text: Column) -> Column:
    """One whole JSON value and nothing after it.

    Spark's readers stop behind the first value, take single quotes and line breaks in strings, and
    the variant reader refuses repeated keys. So the text has to be the only element of a list and
    the only member of an object, and without its strings it must hold no quote.
    """
    alone = (F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1) & F.get_json_object(
        F.concat(F.lit('{"v":'), text, F.lit("}")), "$"
    ).isNotNull()
    without_strings = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'"[^"\x00-\x1F]*"', "")
    looks_so = text.rlike(r'^[ \t\r\n]*[\[{"0-9tfn-]')
    ok = F.when(looks_so, F.coalesce(alone, F.lit(False)) & ~without_strings.rlike("['\"]")).otherwise(False)
    return F.when(text.isNotNull(), ok)


def token_estimate(text: Column, rule: str = "gateway") -> Column:
    """Tokens from words: ×1.33 truncated, or ``provider``: at least 1, words×4/3 truncated."""
    trimmed = normalize_whitespace(text)
    words = F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " ")))
    if rule == "gateway":
        return (words * F.lit(1.33)).cast("bigint")
    return F.greatest(F.lit(1), F.floor(words * 4 / 3)).cast("bigint")


def contains_any(text: Column, words: list[str]) -> Column:
    """True where any of the literal words occurs."""
    return text.rlike("|".join(re.escape(word) for word in words))


def levenshtein_similarity(left: Column, right: Column) -> Column:
    a, b = F.lower(F.trim(left)), F.lower(F.trim(right))
    longest = F.greatest(F.length(a), F.length(b))
    return F.coalesce(1 - F.try_divide(F.levenshtein(a, b), longest), F.lit(1.0))
