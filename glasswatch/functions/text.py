"""Column functions on text: clip, hash, entropy, versions, control codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glasswatch.functions.regex_dialect import Pattern

CLIP_LENGTH = 48
ELLIPSIS = "…"
_BLANKS = Pattern(r"\s+").java()
_TRIM = Pattern(r"^\s+|\s+$").java()
# Terminal control sequences (fixed value).
ANSI = Pattern(r"[\u001b\u009b][[\]()#;?]*(?:[0-9]{1,4}(?:;[0-9]{0,4})*)?[0-9A-ORZcf-nqry=><]")


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, _TRIM, "")


def is_blank(text: Column) -> Column:
    """Null, empty or white space only, with ECMAScript white space."""
    return text.isNull() | ~text.rlike(Pattern(r"\S").java())


def clip(text: Column, limit: int = CLIP_LENGTH) -> Column:
    """White space runs become one space, ends trimmed, cut to ``limit`` plus an ellipsis."""
    flat = js_trim(F.regexp_replace(text, _BLANKS, " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit(ELLIPSIS))).otherwise(flat)


def _utf16_units(text: Column) -> Column:
    """UTF-16 code units of ``text`` as ARRAY<BIGINT>."""
    digits = F.hex(F.encode(text, "UTF-16BE"))
    count = (F.length(digits) / 4).cast("int")
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substr(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))


def djb2(text: Column) -> Column:
    """h = h * 33 + c modulo 2**32 over UTF-16 units, from 5381."""
    return F.aggregate(_utf16_units(text), F.lit(5381).cast("bigint"),
                       lambda h, c: F.pmod(h * 33 + c, F.lit(1 << 32)))


def content_hash(text: Column) -> Column:
    """One-way tag written in place of content: ``h`` and lower-case hex."""
    return F.concat(F.lit("h"), F.lower(F.hex(djb2(text))))


def client_id(text: Column) -> Column:
    """``c-`` and the magnitude of the signed 32-bit hash in hex."""
    h = djb2(text)
    return F.concat(F.lit("c-"), F.lower(F.hex(F.when(h >= 1 << 31, F.lit(1 << 32) - h).otherwise(h))))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character."""
    chars = F.split(text, "")
    size = F.length(text)
    bits = F.aggregate(
        F.array_sort(F.array_distinct(chars)), F.lit(0.0),
        lambda acc, c: acc - (F.size(F.filter(chars, lambda x: x == c)) / size)
        * F.log2(F.size(F.filter(chars, lambda x: x == c)) / size))
    return F.when(size > 0, bits).otherwise(F.lit(0.0))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI.java(), "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def version_parts(version: Column) -> Column:
    """Three numbers; a missing or non-numeric part counts as 0."""
    parts = F.split(F.coalesce(version, F.lit("")), r"\.")
    return F.array(*[F.coalesce(js_number(F.try_element_at(parts, F.lit(i))), F.lit(0.0)) for i in (1, 2, 3)])


def js_number(text: Column) -> Column:
    """ECMAScript's Number() of a string without signs of infinity: decimal or 0x, 0o, 0b literals; else null.

    Spark's own cast also takes ``15d``, ``5f`` and ``Infinity``."""
    flat = F.trim(text)
    decimal = F.when(flat.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), flat.try_cast("double"))
    based = [F.when(flat.rlike(f"^0[{p}{p.upper()}][{digits}]+$"), F.conv(F.substring(flat, 3, 2**31 - 1), base, 10).cast("double"))
             for p, digits, base in (("x", "0-9a-fA-F", 16), ("o", "0-7", 8), ("b", "01", 2))]
    return F.when(flat == "", F.lit(0.0)).otherwise(F.coalesce(decimal, *based))


def version_outdated(current: Column, latest: Column) -> Column:
    known = F.coalesce(latest, F.lit("")) != ""
    return known & (version_parts(latest) > version_parts(current))


def size_kb(size_bytes: Column) -> Column:
    """Rounded kilobytes, never below 1 (halves round up)."""
    return F.greatest(F.lit(1), F.floor(F.coalesce(size_bytes, F.lit(0)) / 1024 + 0.5).cast("bigint"))
