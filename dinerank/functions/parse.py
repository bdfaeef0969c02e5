"""Ingest-side parsing expressions: rating, cost, votes, cuisines, city,
searchable location, budget band, stable id.

Each function takes raw columns and returns a ``Column``; nothing here runs
Python per row.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from dinerank.functions.text import _c, clean_string, computed_once, lower_strip, ustrip

# An unsigned decimal number: digits, optionally a dot and more digits.
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"

# City spellings (lower-cased) and the canonical city they mean.
CITY_ALIASES = {
    "bengaluru": "Bangalore",
    "bangalore": "Bangalore",
    "banglore": "Bangalore",
    "bengalore": "Bangalore",
    "btm bangalore": "Bangalore",
    "new delhi": "New Delhi",
    "delhi": "Delhi",
}

# Separator of the id payload (a vertical bar).
ID_SEPARATOR = "|"


def parse_cuisines(col) -> Column:
    """Comma-separated tags -> lower-cased, stripped, non-blank array; NULL -> []."""
    text = clean_string(col)
    tags = F.transform(F.split(text, ","), lambda x: lower_strip(x))
    return F.coalesce(F.filter(tags, lambda x: x != F.lit("")), F.array().cast("array<string>"))


def parse_rating(col) -> Column:
    """First unsigned number in the text, at most 5.0; no number (NEW, -, blank,
    NULL, ...) gives 0.0.

    The "no number" test comes before the clamp: ``least`` skips NULLs and
    would otherwise turn a missing number into 5.0.
    """
    found = F.regexp_extract(clean_string(col), NUMBER, 1)
    return computed_once(found, lambda n: F.when(n.isNull() | (n == F.lit("")), F.lit(0.0)).otherwise(
        F.least(F.lit(5.0), n.cast("double"))))


def parse_cost(col) -> Column:
    """Cost for two. Commas removed, every number collected; with two or more
    numbers and a range marker ('-' anywhere, or 'to' in any case) the largest
    wins, else the first. No number -> NULL. '0' gives 0.0 (band 'low')."""
    def cost_of(text: Column, nums: Column) -> Column:
        is_range = (F.size(nums) >= 2) & (
            F.contains(text, F.lit("-")) | F.contains(F.lower(text), F.lit("to"))
        )
        return (
            F.when(F.size(nums) == 0, F.lit(None).cast("double"))
            .when(is_range, F.array_max(nums))
            .otherwise(F.try_element_at(nums, F.lit(1)))
        )

    def numbers(text: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(NUMBER), 1),
            lambda x: x.cast("double"),
        )

    return computed_once(clean_string(col), lambda text: computed_once(numbers(text), lambda nums: cost_of(text, nums)))


def parse_votes(col) -> Column:
    """Python ``int(text)``: surrounding whitespace allowed, '1,234', '4.7', ''
    and junk give NULL. Digit groups joined by single underscores ('1_000')
    are accepted, as Python does."""
    c = _c(col)
    return computed_once(ustrip(c.cast("string")), lambda text: F.coalesce(
        text.try_cast("bigint"),
        F.when(text.rlike(r"^[+-]?[0-9]+(_[0-9]+)+$"), F.replace(text, F.lit("_"), F.lit("")).try_cast("bigint")),
    ))


def city_alias(city) -> Column:
    """Canonical spelling of a city (case-insensitive alias lookup); unknown
    names are kept, stripped."""
    c = _c(city)
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(CITY_ALIASES.items())])
    return F.coalesce(F.try_element_at(lookup, lower_strip(c)), ustrip(c))


def extract_city(address) -> Column:
    """Last non-blank comma part of the (cleaned) address, then the alias map;
    '' when there is none."""
    parts = F.filter(F.transform(F.split(_c(address), ","), lambda x: ustrip(x)), lambda x: x != F.lit(""))
    last = F.try_element_at(parts, F.lit(-1))
    return computed_once(last, lambda city: F.coalesce(city_alias(city), F.lit("")))


def searchable_location(locality, city, address) -> Column:
    """``"locality, city"`` lower-cased, skipping blanks; both blank -> the
    lower-cased address. Inputs are cleaned strings ('' for missing)."""
    joined = F.concat_ws(", ", F.nullif(_c(locality), F.lit("")), F.nullif(_c(city), F.lit("")))
    return F.coalesce(F.nullif(F.lower(joined), F.lit("")), F.lower(F.coalesce(_c(address), F.lit(""))))


def budget_band(cost, low_max: float = 500.0, medium_max: float = 1500.0) -> Column:
    """Inclusive bands: <= low_max 'low', <= medium_max 'medium', else 'high';
    NULL cost -> NULL."""
    c = _c(cost)
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(c <= F.lit(float(low_max)), F.lit("low"))
        .when(c <= F.lit(float(medium_max)), F.lit("medium"))
        .otherwise(F.lit("high"))
    )


def stable_id(name, address, row_index) -> Column:
    """First 16 hex digits of SHA-256 over ``name|address|row_index``."""
    payload = F.concat_ws(ID_SEPARATOR, _c(name), F.coalesce(_c(address), F.lit("")), _c(row_index).cast("string"))
    return F.substring(F.sha2(payload, 256), 1, 16)
