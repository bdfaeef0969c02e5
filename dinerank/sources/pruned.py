"""Reads of a published listing table that skip row groups.

The values that a few ids or requests can match are resolved first, on small
tables, and then stand in the scan's own filter, where row-group statistics
(rows are sorted by band and location) and the Bloom filters of the ids apply.
With more values than a filter should name, the rows are found by a join or by
the match itself: the results are the same either way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dinerank.operators.match import KEY, substring_pairs, valid_requests
from dinerank.params import DEFAULT, Params
from dinerank.sources.listings import lookup_by_ids, scan_listings, scan_values

#: Values that a scan's filter may name.
NAMED = 200


def any_of(tests: list[Column]) -> Column:
    """Disjunction, as a tree of little depth. Equalities are pushed down one by
    one; of a long IN list only its least and greatest value would be."""
    if not tests:
        return F.lit(False)
    while len(tests) > 1:
        tests = [reduce(lambda a, b: a | b, tests[i:i + 2]) for i in range(0, len(tests), 2)]
    return tests[0]


def lookup_published(spark: SparkSession, base: str, ids: DataFrame, id_col: str = "id", pos_col: str = "pos",
                     number: int | None = None) -> DataFrame:
    """:func:`~dinerank.sources.listings.lookup_by_ids` in the table published at
    ``base``. Up to NAMED different ids stand in the scan's filter, so only row
    groups whose Bloom filter may hold one are read; null ids give nothing."""
    listings = scan_listings(spark, base, number)
    wanted = ids.where(F.col(id_col).isNotNull())
    named = [r[0] for r in wanted.select(id_col).distinct().limit(NAMED + 1).collect()]
    if len(named) <= NAMED:
        listings = listings.where(any_of([F.col("id") == F.lit(i) for i in sorted(named)]))
    return lookup_by_ids(listings, wanted, id_col, pos_col)


def scan_matching(spark: SparkSession, base: str, requests: DataFrame, params: Params = DEFAULT, number: int | None = None) -> DataFrame:
    """The published listings whose location and band some valid request asks for:
    all that matching can use. The requests are resolved on the version's counted
    places; up to NAMED (location, band) pairs stand in the scan's filter, beyond
    that the whole table is returned."""
    listings = scan_listings(spark, base, number)
    places = scan_values(spark, base, number).where("kind = 'place'").select(F.col("value").alias("location"), F.col("band").alias("budget"))
    keys = valid_requests(requests, params).select(*KEY).distinct()
    asked = keys.join(substring_pairs(keys, "loc_q", places, "location"), "loc_q").select("location", "budget")
    found = places.join(asked, ["location", "budget"], "left_semi").distinct().limit(NAMED + 1).collect()
    if len(found) > NAMED:
        return listings
    bands = sorted({r["budget"] for r in found})
    return listings.where(any_of([
        (F.col("budget_band") == b) & any_of([F.col("location") == r["location"] for r in sorted(found) if r["budget"] == b]) for b in bands]))
