"""Coercions, presence tests, tokens, URLs, hashes and formatters as Column functions.

Six rules turn text into whole numbers in this domain and none agrees with another, so each has a name
of its own here. Everything is built-in expressions; nothing leaves code generation for Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def strings(*values: Column) -> Column:
    """The non-null ones of some string columns as an array."""
    return F.array_compact(F.array(*values)) if values else F.array().cast("array<string>")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- whole numbers ------------------------------------------------------------------------------------


def int_or_null(c: Column) -> Column:
    """Text without commas that is a plain integer; anything else is null."""
    text = F.trim(F.replace(c.cast("string"), F.lit(","), F.lit("")))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def int_or_zero(c: Column) -> Column:
    """As :func:`int_or_null`, with 0 for null ('650000.0' is 0 too)."""
    return F.coalesce(int_or_null(c), F.lit(0).cast("bigint"))


def int_truncated(c: Column) -> Column:
    """Text or number read as a float and cut towards zero ('12.5' is 12); null where it is no number."""
    number = F.trim(F.replace(c.cast("string"), F.lit(","), F.lit(""))).try_cast("double")
    return F.when(~F.isnan(number), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("bigint"))


def int_half_even(c: Column) -> Column:
    """Read as a float and rounded half to even."""
    number = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(number), F.bround(number, 0).cast("bigint"))


def bucket(c: Column, size: int) -> Column:
    """The multiple of ``size`` at or below a number; null for negative numbers and null."""
    number = c.cast("bigint")
    return F.when(number >= 0, (number - F.pmod(number, F.lit(size))).cast("bigint"))


def float_or_null(c: Column, percent: bool = False) -> Column:
    """A number in text, commas (and a percent sign) ignored."""
    text = F.replace(c.cast("string"), F.lit(","), F.lit(""))
    return F.trim(F.replace(text, F.lit("%"), F.lit("")) if percent else text).try_cast("double")


def ratio(part: Column, total: Column, digits: int = 4) -> Column:
    """A share, rounded; 0 of an empty total."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.bround(part.cast("double") / F.nullif(total, F.lit(0)), digits))


# --- presence -----------------------------------------------------------------------------------------


def is_present(c: Column, kind: T.DataType) -> Column:
    """Not null; text neither blank nor 'unknown'; collections not empty. 0 and false are present."""
    if isinstance(kind, T.StringType):
        return F.coalesce(~F.lower(F.trim(c)).isin("", "unknown"), F.lit(False))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def has_value(c: Column, kind: T.DataType) -> Column:
    """Not null and not blank; unlike :func:`is_present` the word 'unknown' is a value."""
    return F.coalesce(F.trim(c) != "", F.lit(False)) if isinstance(kind, T.StringType) else c.isNotNull()


def first_filled(*columns: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def joined_filled(separator: str, *columns: Column) -> Column:
    """The filled ones, joined."""
    return F.concat_ws(separator, *[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns])


# --- text, URLs, hashes -------------------------------------------------------------------------------


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c.cast("string"), r"(?U)\s+", " "))


def token(c: Column) -> Column:
    """Lower-case letters and digits, anything else a single blank; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.trim(c.cast("string")), F.lit(""))), "[^a-z0-9]+", " "))


def normal_url(c: Column) -> Column:
    """Scheme (https if none) and host in lower case, single slashes, no trailing slash, query or fragment."""

    def built(scheme: Column, host: Column, path: Column) -> Column:
        rooted = F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
        return F.concat(F.when(scheme == "", F.lit("https")).otherwise(F.lower(scheme)), F.lit("://"), F.lower(host), rooted)

    def of(bare: Column) -> Column:
        # scheme, //host and path of a text always match, each of the first two possibly empty
        parts = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/]*))?(.*)$"
        path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, parts, 3), "/+", "/"), "/$", "")
        return bind(path, lambda p: built(F.regexp_extract(bare, parts, 1), F.regexp_extract(bare, parts, 2), p))

    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return bind(F.regexp_replace(text, r"[?#].*$", ""), lambda bare: F.when((bare == "") & (text == ""), F.lit("")).otherwise(of(bare)))


def short_hash(c: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def hash_share(seed: str, *keys: Column) -> Column:
    """A number in [0, 1] that depends on seed and keys alone: 48 bits of SHA-256."""
    digits = F.substring(F.sha2(F.concat_ws("|", F.lit(seed), *keys), 256), 1, 12)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(float(16**12 - 1))


def in_test(seed: str, share: float, *keys: Column) -> Column:
    """:func:`hash_share` under ``share``, compared as hexadecimal digits."""
    low, high = 0, 16**12  # the least number whose share is not under it; none is, if that is 16**12
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if middle / float(16**12 - 1) < share else (low, middle)
    digest = F.sha2(F.concat_ws("|", F.lit(seed), *keys), 256)
    return digest < F.lit(f"{low:012x}") if low < 16**12 else digest.isNotNull()


def mapped(values: dict[str, object], key: Column) -> Column:
    """A constant look-up table; null for other keys."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


# --- presentation -------------------------------------------------------------------------------------


def money_text(c: Column) -> Column:
    """Rupees as lakh or crore."""
    return F.when(c >= 10_000_000, F.concat(F.format_number(c / 10_000_000, 2), F.lit(" Cr"))).when(c >= 100_000, F.concat(F.format_number(c / 100_000, 2), F.lit(" L"))).otherwise(F.format_number(c, 0))


def percent_text(c: Column, digits: int = 2) -> Column:
    return F.concat(F.format_number(c * 100, digits), F.lit("%"))
