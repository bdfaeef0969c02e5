"""Display labels for final recommendation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinerank.functions.text import title_case
from dinerank.operators.merge import dedup_recommendations

NA = "N/A"


def cost_label(cost: Column) -> Column:
    """'₹1,200 for two' (half-even rounding, thousands separators); NULL -> 'N/A'."""
    return F.when(cost.isNull(), F.lit(NA)).otherwise(
        F.concat(F.lit("₹"), F.format_number(cost, 0), F.lit(" for two")))


def cuisines_label(cuisines: Column) -> Column:
    """Title-cased tags joined by ', '; no tags -> 'N/A'."""
    return F.when(F.coalesce(F.size(cuisines), F.lit(0)) <= 0, F.lit(NA)).otherwise(
        F.array_join(F.transform(cuisines, lambda c: title_case(c)), ", "))


def location_label(location: Column) -> Column:
    return title_case(F.replace(location, F.lit(", "), F.lit(" · ")))


def budget_label(band: Column) -> Column:
    return F.coalesce(band, F.lit("unknown"))


def budget_chip(band: Column) -> Column:
    """Card chip: 'Low Budget' / 'Medium Budget' / 'High Budget'; NULL -> 'Unknown budget'."""
    return F.coalesce(F.concat(F.initcap(band), F.lit(" Budget")), F.lit("Unknown budget"))


def rating_label(rating: Column) -> Column:
    return F.format_number(rating, 1)


def cuisine_head(cuisines: Column, n: int) -> Column:
    return F.slice(cuisines, 1, n)


def display_rows(recs: DataFrame) -> DataFrame:
    """Recommendations (deduplicated by name again) with their labels."""
    return dedup_recommendations(recs).select(
        "request_id", "rank", "listing_id", "name",
        location_label(F.col("location")).alias("location_label"),
        rating_label(F.col("rating")).alias("rating_label"),
        cuisines_label(F.col("cuisines")).alias("cuisines_label"),
        cost_label(F.col("estimated_cost")).alias("cost_label"),
        budget_label(F.col("budget_band")).alias("budget_label"),
        budget_chip(F.col("budget_band")).alias("budget_chip"),
        "explanation",
    )
