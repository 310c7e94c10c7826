"""Column expressions for cleaning and shaping raw fields."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Page shown for an event type, and the page for any other type.
PAGE_FOR_EVENT = {"view": "product", "add_to_cart": "cart", "purchase": "cart", "search": "search"}
DEFAULT_PAGE = "home"

SNIPPET_CHARS = 200
DECIMAL = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?))\s*$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lenient_double(col: Column | str) -> Column:
    """Number, or NULL when the text is not one. NaN counts as missing.

    The pattern keeps out what only the JVM reads as a number: type suffixes (12d, 3F) and hexadecimal.
    """
    value = _c(col).try_cast("double")
    return F.when(_c(col).cast("string").rlike(DECIMAL) & ~F.isnan(value), value)


def safe_float(col: Column | str) -> Column:
    return F.coalesce(lenient_double(col), F.lit(0.0))


def parse_price(col: Column | str) -> Column:
    return lenient_double(F.trim(F.translate(_c(col).cast("string"), "$,", "")))


def first_or(col: Column | str, default: str = "Unknown") -> Column:
    return F.coalesce(F.try_element_at(_c(col), F.lit(1)), F.lit(default))


def snippet(col: Column | str, chars: int = SNIPPET_CHARS) -> Column:
    """The catalogue's short description: list parts joined by a blank, first `chars` characters."""
    return F.substring(F.coalesce(F.array_join(_c(col), " "), F.lit("")), 1, chars)


def key_or(first: Column | str, second: Column | str) -> Column:
    return F.coalesce(F.nullif(_c(first), F.lit("")), _c(second))


def map_or_empty(col: Column | str) -> Column:
    return F.coalesce(_c(col), F.create_map().cast("map<string,string>"))


def map_get(col: Column | str, key: str, default: str | None = None) -> Column:
    value = F.try_element_at(map_or_empty(col), F.lit(key))
    return value if default is None else F.coalesce(value, F.lit(default))


def page_for(event_type: Column | str) -> Column:
    pairs: Iterable[Column] = [F.lit(x) for kv in PAGE_FOR_EVENT.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _c(event_type)), F.lit(DEFAULT_PAGE))


def hour_fraction(epoch: Column | str) -> Column:
    """Hour of day scaled to [0, 1]."""
    return F.hour(F.timestamp_seconds(_c(epoch))) / F.lit(23.0)


def epoch_seconds(ts: Column | str) -> Column:
    return F.unix_micros(_c(ts).cast("timestamp")) / F.lit(1e6)


def hash_key(col: Column | str, seed: int) -> Column:
    """Uniform, repeatable sort key for exact sampling."""
    return F.md5(F.concat(_c(col).cast("string"), F.lit(f":{seed}")))


def hash_uniform(col: Column | str, seed: int) -> Column:
    """Uniform number in (0, 1) from 52 bits of the hash key."""
    bits = F.conv(F.substring(hash_key(col, seed), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))
