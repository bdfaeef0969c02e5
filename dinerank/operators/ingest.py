"""Ingest: raw listing rows -> canonical, typed listing table.

One lazy chain of projections and one filter: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dinerank.functions.parse import (
    budget_band,
    extract_city,
    parse_cost,
    parse_cuisines,
    parse_rating,
    parse_votes,
    searchable_location,
    stable_id,
)
from dinerank.functions.text import clean_string, lower_strip, ustrip
from dinerank.params import DEFAULT, Params
from dinerank.schemas import COST_COLUMN, check_raw_columns

# Raw column -> canonical field it feeds.
COLUMN_MAP = {
    "name": "name",
    "locality": "location",
    "address": "address",
    "cuisines": "cuisines",
    "cost": COST_COLUMN,
    "rating": "rate",
    "votes": "votes",
    "rest_type": "rest_type",
    "online_order": "online_order",
    "book_table": "book_table",
    "url": "url",
}


def _raw(df: DataFrame, canonical: str) -> Column:
    src = COLUMN_MAP[canonical]
    if src in df.columns:
        return F.col(f"`{src}`")
    return F.lit(None).cast("string")


def position(col: Column) -> Column:
    """A row position that must not be null."""
    return F.coalesce(col.cast("bigint"), F.raise_error(F.lit("a raw row has a null row_index")).cast("bigint"))


def with_row_index(raw: DataFrame, name: str = "row_index", origin: list[str] | None = None) -> DataFrame:
    """Attach the source position (0, 1, 2, ...) when the data has none.

    ``origin`` columns (dropped here) tell where a run of rows comes from, in
    order: file and first byte for a file scan, so that positions follow file
    names and bytes however the files are dealt to tasks. Without them rows
    are numbered in partition order. Rows per origin are counted once; offsets
    are a running sum over that small table, joined back.
    """
    if name in raw.columns:
        return raw
    own = origin or ["_part"]
    numbered = raw.withColumn("_at", F.monotonically_increasing_id())
    if not origin:
        numbered = numbered.withColumn("_part", F.shiftrightunsigned("_at", 33))
    counts = numbered.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy(*own).rowsBetween(Window.unboundedPreceding, -1)  # a row per file split
    offsets = counts.select(*own, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        numbered.join(F.broadcast(offsets), own)
        .withColumn(name, (F.col("_offset") + F.col("_at") - F.col("_first")).cast("bigint"))
        .select(*[F.col(f"`{c}`") for c in raw.columns if c not in (origin or [])], name)
    )


def project_columns(raw: DataFrame) -> DataFrame:
    """Rename the 11 used raw columns to canonical names, drop the rest."""
    check_raw_columns(raw)
    return raw.select(*[_raw(raw, c).alias(c) for c in COLUMN_MAP], F.col("row_index"))


def normalize_listings(raw: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Raw rows -> canonical listings (blank names dropped).

    Output: ``id, name, location, cuisines, rating, estimated_cost,
    budget_band, metadata struct<locality, city, address, votes, rest_type,
    online_order, book_table, url, source_row_index>``.
    """
    check_raw_columns(raw)
    raw = with_row_index(raw)
    base = raw.select(
        clean_string(_raw(raw, "name")).alias("name"),
        F.coalesce(clean_string(_raw(raw, "address")), F.lit("")).alias("address"),
        F.coalesce(clean_string(_raw(raw, "locality")), F.lit("")).alias("locality"),
        _raw(raw, "cuisines").alias("_cuisines"),
        _raw(raw, "rating").alias("_rate"),
        _raw(raw, "cost").alias("_cost"),
        _raw(raw, "votes").alias("_votes"),
        clean_string(_raw(raw, "rest_type")).alias("rest_type"),
        clean_string(_raw(raw, "online_order")).alias("online_order"),
        clean_string(_raw(raw, "book_table")).alias("book_table"),
        clean_string(_raw(raw, "url")).alias("url"),
        position(F.col("row_index")).alias("row_index"),
    ).where(F.col("name").isNotNull())
    typed = base.select(
        "*",
        extract_city(F.col("address")).alias("city"),
        parse_cost(F.col("_cost")).alias("estimated_cost"),
    )
    return typed.select(
        stable_id(F.col("name"), F.col("address"), F.col("row_index")).alias("id"),
        F.col("name"),
        searchable_location(F.col("locality"), F.col("city"), F.col("address")).alias("location"),
        parse_cuisines(F.col("_cuisines")).alias("cuisines"),
        parse_rating(F.col("_rate")).alias("rating"),
        F.col("estimated_cost"),
        budget_band(F.col("estimated_cost"), params.budget_low_max, params.budget_medium_max).alias("budget_band"),
        F.struct(
            F.col("locality"),
            F.col("city"),
            F.col("address"),
            parse_votes(F.col("_votes")).alias("votes"),
            F.col("rest_type"),
            F.col("online_order"),
            F.col("book_table"),
            F.col("url"),
            F.col("row_index").alias("source_row_index"),
        ).alias("metadata"),
    )


def preprocess(listings: DataFrame) -> DataFrame:
    """Clean pass over canonical listings: drop blank names, strip names,
    strip+lower locations, strip+lower+drop-blank cuisine tags."""
    return listings.where(ustrip(F.col("name")) != F.lit("")).withColumns({
        "name": ustrip(F.col("name")),
        "location": lower_strip(F.col("location")),
        "cuisines": F.filter(F.transform("cuisines", lambda c: lower_strip(c)), lambda c: c != F.lit("")),
    })


def ingest(raw: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Full ingest transformation: normalise then clean."""
    return preprocess(normalize_listings(raw, params))


def flatten_listings(listings: DataFrame) -> DataFrame:
    """Scalar-only view of canonical listings (arrays joined by ',', metadata
    fields lifted) for comparison and export."""
    return listings.select(
        "id", "name", "location",
        F.array_join("cuisines", ",").alias("cuisines"),
        "rating", "estimated_cost", "budget_band",
        *[F.col(f"metadata.{f}").alias(f) for f in
          ("locality", "city", "address", "votes", "rest_type", "online_order", "book_table", "url", "source_row_index")],
    )


def ingest_stats(raw: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row of ingest quality counts: read, normalised, dropped, written.

    A single aggregation pass over the raw scan (partial aggregates per task).
    """
    check_raw_columns(raw)
    name = clean_string(_raw(raw, "name"))
    kept = name.isNotNull() & (ustrip(name) != F.lit(""))
    return raw.agg(
        F.count(F.lit(1)).cast("bigint").alias("rows_read"),
        F.count_if(name.isNotNull()).cast("bigint").alias("rows_normalized"),
        F.count_if(~F.coalesce(kept, F.lit(False))).cast("bigint").alias("rows_dropped"),
        F.count_if(F.coalesce(kept, F.lit(False))).cast("bigint").alias("rows_written"),
    )
