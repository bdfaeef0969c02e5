"""Distinct-value vocabularies and the form pickers built on them.

Each vocabulary is a column-pruned scan -> partial distinct per task ->
shuffle -> final distinct -> range-partitioned sort; no value list ever
passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dinerank.functions.text import title_case, ustrip

# Area label shown in the picker -> substring used as filter.
AREA_OPTIONS = {
    "HSR Layout": "HSR",
    "Indiranagar": "Indiranagar",
    "Koramangala": "Koramangala",
    "Whitefield": "Whitefield",
    "Jayanagar": "Jayanagar",
    "Marathahalli": "Marathahalli",
    "Banashankari": "Banashankari",
    "Bellandur": "Bellandur",
    "Electronic City": "Electronic City",
    "BTM": "BTM",
    "Domlur": "Domlur",
    "Hebbal": "Hebbal",
    "JP Nagar": "JP Nagar",
    "MG Road": "MG Road",
    "Richmond Road": "Richmond Road",
}
CUSTOM_AREA_OPTION = "Other (type custom area)"
# The two cuisine input modes of the form.
PICK_CUISINE_MODE = "Pick a cuisine"
CUSTOM_CUISINE_MODE = "Enter custom cuisine"

# Cuisines offered first, in this order.
POPULAR_CUISINES = [
    "North Indian", "South Indian", "Chinese", "Italian", "Mughlai",
    "Fast Food", "Cafe", "Biryani", "Continental", "Thai",
]
# Picker used when the vocabulary cannot be read.
FALLBACK_CUISINES = ["North Indian", "Chinese", "Italian", "Mughlai"]
MAX_EXTRA_AREAS = 30
MAX_EXTRA_CUISINES = 20


def distinct_cities(listings: DataFrame) -> DataFrame:
    city = ustrip(F.col("metadata.city"))
    return listings.select(city.alias("city")).where(F.col("city") != "").distinct().orderBy("city")


def distinct_areas(listings: DataFrame) -> DataFrame:
    area = ustrip(F.col("metadata.locality"))
    return listings.select(area.alias("area")).where(F.col("area") != "").distinct().orderBy("area")


def distinct_cuisines(listings: DataFrame) -> DataFrame:
    return listings.select(F.explode("cuisines").alias("cuisine")).distinct().orderBy("cuisine")


def vocabulary(values: DataFrame, kind: str, name: str) -> DataFrame:
    """Sorted values of one kind (``city``, ``area`` or ``cuisine``) from the counted
    values of a published version: no listing is read."""
    return values.where(F.col("kind") == kind).select(F.col("value").alias(name)).orderBy(name)


def _fixed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def area_picker(listings: DataFrame) -> DataFrame:
    """``(block, pos, label)``: the fixed area labels, then up to 30 dataset
    areas not already offered (sorted), then the custom option."""
    return pick_areas(distinct_areas(listings))


def pick_areas(areas: DataFrame) -> DataFrame:
    """:func:`area_picker` over distinct ``areas(area)``."""
    spark = areas.sparkSession
    known = _fixed(spark, [(v.lower(),) for v in AREA_OPTIONS.values()], "known string")
    extras = (
        areas.join(F.broadcast(known), F.lower(F.col("area")) == F.col("known"), "left_anti")
        .orderBy("area").limit(MAX_EXTRA_AREAS)
    )
    w = Window.orderBy("area")  # at most 30 rows: the limit is the feature
    extras = extras.select(F.lit(1).alias("block"), F.row_number().over(w).alias("pos"), F.col("area").alias("label"))
    head = _fixed(spark, [(0, i + 1, label) for i, label in enumerate(AREA_OPTIONS)], "block int, pos int, label string")
    tail = _fixed(spark, [(2, 1, CUSTOM_AREA_OPTION)], "block int, pos int, label string")
    return head.unionByName(extras.select(
        F.col("block").cast("int"), F.col("pos").cast("int"), "label")).unionByName(tail)


def cuisine_picker(listings: DataFrame) -> DataFrame:
    """``(block, pos, label)``: popular cuisines present in the vocabulary
    (equal to, or contained in, some tag), then up to 20 other tags
    title-cased and sorted."""
    return pick_cuisines(distinct_cuisines(listings))


def pick_cuisines(vocab: DataFrame) -> DataFrame:
    """:func:`cuisine_picker` over a distinct vocabulary ``vocab(cuisine)``."""
    spark = vocab.sparkSession
    popular = _fixed(spark, [(i + 1, c, c.lower()) for i, c in enumerate(POPULAR_CUISINES)],
                     "pos int, label string, key string")
    # The ten fixed rows are the broadcast side of the substring join; the
    # vocabulary streams past them.
    hits = vocab.join(F.broadcast(popular), F.contains(vocab.cuisine, popular.key)).select("pos", "label", "key")
    present = hits.distinct()
    extras = (
        vocab.join(F.broadcast(present.select("key")), vocab.cuisine == F.col("key"), "left_anti")
        .select(title_case(F.col("cuisine")).alias("label"))
        .orderBy("label").limit(MAX_EXTRA_CUISINES)
    )
    w = Window.orderBy("label")  # at most 20 rows
    extras = extras.select(F.lit(1).alias("block"), F.row_number().over(w).alias("pos"), "label")
    w0 = Window.orderBy("pos")  # at most 10 rows
    head = present.select(F.lit(0).alias("block"), F.row_number().over(w0).alias("pos"), "label")
    return head.unionByName(extras).select(F.col("block").cast("int"), F.col("pos").cast("int"), "label")


def cuisine_picker_at(spark: SparkSession, base: str) -> DataFrame:
    """:func:`cuisine_picker` from the values published at ``base``; the fixed
    list where there are none to read."""
    from dinerank.sources.listings import commits, scan_listings, scan_values

    try:
        if commits(spark, base):  # a committed version has rows
            return pick_cuisines(vocabulary(scan_values(spark, base), "cuisine", "cuisine"))
        return cuisine_picker(scan_listings(spark, base))
    except (FileNotFoundError, ValueError):
        return _fixed(spark, [(0, i + 1, c) for i, c in enumerate(FALLBACK_CUISINES)], "block int, pos int, label string")


def area_picker_at(spark: SparkSession, base: str) -> DataFrame:
    """:func:`area_picker` from the values published at ``base``."""
    from dinerank.sources.listings import scan_values

    return pick_areas(vocabulary(scan_values(spark, base), "area", "area"))


def resolve_area(picks: DataFrame, pick: str = "pick", custom: str = "custom") -> DataFrame:
    """Map an area pick to its filter value: the custom option takes the typed
    text, a known label its substring, anything else itself (stripped)."""
    spark = picks.sparkSession
    labels = _fixed(spark, list(AREA_OPTIONS.items()), "_label string, _value string")
    joined = picks.join(F.broadcast(labels), F.col(pick) == F.col("_label"), "left")
    value = (
        F.when(F.col(pick) == F.lit(CUSTOM_AREA_OPTION), ustrip(F.col(custom)))
        .when(F.col("_value").isNotNull(), F.col("_value"))
        .otherwise(ustrip(F.col(pick)))
    )
    return joined.withColumn("area", value).drop("_label", "_value")


def resolve_cuisine(mode, pick, custom) -> Column:
    """The typed text in custom mode (as typed), else the picked value."""
    def c(x):
        return F.col(x) if isinstance(x, str) else x
    return F.when(c(mode) == F.lit(CUSTOM_CUISINE_MODE), c(custom)).otherwise(c(pick))
