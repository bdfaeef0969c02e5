"""Column expressions (JVM-side, codegen-friendly) used by the operators."""

from dinerank.functions.text import clean_string, lower_strip, title_case, ustrip
from dinerank.functions.parse import (
    budget_band,
    city_alias,
    extract_city,
    parse_cost,
    parse_cuisines,
    parse_rating,
    parse_votes,
    searchable_location,
    stable_id,
)

__all__ = [
    "budget_band", "city_alias", "clean_string", "extract_city", "lower_strip",
    "parse_cost", "parse_cuisines", "parse_rating", "parse_votes",
    "searchable_location", "stable_id", "title_case", "ustrip",
]
