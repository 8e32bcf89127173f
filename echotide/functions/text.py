"""String expressions shared by the operators. Everything is Column -> Column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use one computed value several times in an expression without computing it again.

    Separate projections would do as well, but a filter on the result is pushed down through
    them and repeats the value once per use, which multiplies over several steps.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# All characters of the Unicode category Zs, and those of Java's \s.
SPACES = "".join(chr(c) for c in (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000))
WHITESPACE = "\t\n\x0b\f\r"


def trim_spaces(value: Column) -> Column:
    """Strip Unicode space characters (not tabs or newlines) from both ends."""
    return F.btrim(value, F.lit(SPACES))


def strip_whitespace(value: Column) -> Column:
    """Strip every kind of whitespace from both ends."""
    return F.regexp_replace(value, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def blank_to_null(value: Column) -> Column:
    return F.nullif(trim_spaces(value), F.lit(""))


def tidy_content(value: Column, empty_marker: str) -> Column:
    """Trim, collapse whitespace runs, and mark missing text. Most texts hold no run, which a plain search tells."""
    trimmed = trim_spaces(value)
    runs = any_present(trimmed, ("  ", *WHITESPACE))
    return (
        F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit(empty_marker))
        .when(runs, F.regexp_replace(trimmed, r"\s+", " ")).otherwise(trimmed)
    )


def slug(value: Column) -> Column:
    lowered = F.lower(trim_spaces(F.coalesce(value, F.lit(""))))
    return F.btrim(F.regexp_replace(lowered, "[^a-z0-9]+", "_"), F.lit("_"))


def count_present(text: Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases occur somewhere in the text."""
    return reduce(add, [F.contains(text, F.lit(p)).cast("int") for p in phrases])


def any_present(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(p)) for p in phrases])


def excerpt(content: Column, label: str | None = None, width: int = 180) -> Column:
    """Up to `width` characters, centred on the first word of the label found in the text."""
    text = F.replace(strip_whitespace(F.coalesce(content, F.lit(""))), F.lit("\n"), F.lit(" "))
    length = F.length(text)
    result = F.concat(rstrip(F.substring(text, 1, width)), F.lit("..."))
    words = [w.lower() for w in (label or "").split() if len(w) >= 4]
    for word in reversed(words):
        found = F.instr(F.lower(text), word) - 1
        begin = F.greatest(F.lit(0), found - width // 2)
        end = F.least(length, begin + width)
        body = strip_whitespace(F.substring(text, begin + 1, end - begin))
        centred = F.concat(
            F.when(begin > 0, F.lit("...")).otherwise(F.lit("")),
            body,
            F.when(end < length, F.lit("...")).otherwise(F.lit("")),
        )
        result = F.when(found >= 0, centred).otherwise(result)
    return F.when(length <= width, text).otherwise(result)


def rstrip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)[\s\x1c-\x1f]+$", "")


def compact_quote(text: Column, width: int = 120) -> Column:
    clean = F.replace(strip_whitespace(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" "))
    return F.when(F.length(clean) <= width, clean).otherwise(
        F.concat(rstrip(F.substring(clean, 1, width)), F.lit("..."))
    )


def fixed_text(value: Column, digits: int) -> Column:
    """A non-negative number with 1 or 2 decimals, rounding the binary value half to even.

    Spark's own formatting rounds the printed decimal half up, which differs on values such
    as 35.25. The fraction is exact as a multiple of 2^-56, so integers settle the rounding.
    """
    unit, scale = 1 << 56, 10**digits
    whole = F.floor(value).cast("bigint")
    scaled = ((value - whole) * F.lit(float(unit))).cast("bigint") * scale
    low = F.shiftright(scaled, 56)
    rest = scaled - F.shiftleft(low, 56)
    half = F.lit(unit // 2)
    up = (rest > half) | ((rest == half) & (low % 2 == 1))
    units = whole * scale + low + up.cast("bigint")
    return F.concat(
        F.floor(units / scale).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad((units % scale).cast("string"), digits, "0"),
    )


def percent_text(share: Column) -> Column:
    return F.concat(fixed_text(share * 100, 1), F.lit("%"))


def parse_json(text: Column) -> Column:
    """A JSON document as a variant; null unless the text holds exactly one document.

    Parsing alone stops after the first document, so it is read as the only item of a list.
    """
    wrapped = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return bind(wrapped, lambda items: F.when(F.size(items) == 1, F.get(items, F.lit(0))))


def _code_units(code: Column) -> Column:
    """A code point as one or two JSON escapes."""

    def unit(value: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(value)), 4, "0"))

    above = code - 0x10000
    pair = F.concat(unit(F.shiftright(above, 10) + 0xD800), unit(above % 1024 + 0xDC00))
    return F.when(code < 0x10000, unit(code)).otherwise(pair)


def ascii_json(text: Column) -> Column:
    """JSON text with everything beyond ASCII, which only its strings can hold, as escapes."""
    escaped = F.transform(F.split(text, ""), lambda c: F.when(F.ascii(c) <= 126, c).otherwise(_code_units(F.ascii(c))))
    return F.when(F.rlike(text, F.lit(r"[^\x00-\x7E]")), F.array_join(escaped, "")).otherwise(text)


def json_string(value: Column) -> Column:
    """A JSON string literal in pure ASCII, for keys that are hashed."""

    def escape(char: Column) -> Column:
        code = F.ascii(char)
        return (
            F.when(char == '"', '\\"').when(char == "\\", "\\\\")
            .when(char == "\n", "\\n").when(char == "\r", "\\r").when(char == "\t", "\\t")
            .when(char == "\f", "\\f").when(char == "\b", "\\b")
            .when((code >= 32) & (code <= 126), char)
            .otherwise(_code_units(code))
        )

    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.concat(F.lit('"'), F.array_join(F.transform(chars, escape), ""), F.lit('"'))
