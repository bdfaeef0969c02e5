"""Reference SQL (DuckDB dialect) for the query catalogue.

Each catalogue entry has an independent, brute-force SQL statement over the
driver tables: the listing filter is a plain per-request theta-join here,
whereas the Spark plans use key coalescing and equi-joins. Agreement between
the two is the correctness check.
"""

from __future__ import annotations

from dinerank.functions.parse import CITY_ALIASES
from dinerank.sources.fixtures import raw_listings_sql, requests_sql

NUM = r"([0-9]+(?:\.[0-9]+)?)"


def _city_case(x: str) -> str:
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in CITY_ALIASES.items())
    return f"(case lower(trim({x})) {whens} else trim({x}) end)"


def _clean(x: str) -> str:
    return f"nullif(trim({x}), '')"


CUISINES = (
    "coalesce(list_filter(list_transform(string_split({c}, ','), lambda x: lower(trim(x))), "
    "lambda x: x <> ''), cast([] as varchar[]))"
)

RATING = (
    "(case when coalesce(regexp_extract({c}, '" + NUM + "', 1), '') = '' then cast(0.0 as double) "
    "else least(cast(5.0 as double), cast(regexp_extract({c}, '" + NUM + "', 1) as double)) end)"
)

COST = (
    "(case when len(regexp_extract_all(replace({c}, ',', ''), '" + NUM + "', 1)) = 0 "
    "or {c} is null then cast(null as double) "
    "when len(regexp_extract_all(replace({c}, ',', ''), '" + NUM + "', 1)) >= 2 "
    "and (contains({c}, '-') or contains(lower({c}), 'to')) "
    "then list_max(list_transform(regexp_extract_all(replace({c}, ',', ''), '" + NUM + "', 1), "
    "lambda x: cast(x as double))) "
    "else cast(regexp_extract_all(replace({c}, ',', ''), '" + NUM + "', 1)[1] as double) end)"
)

BAND = (
    "(case when {c} is null then null when {c} <= 500 then 'low' "
    "when {c} <= 1500 then 'medium' else 'high' end)"
)

CITY_PARTS = "list_filter(list_transform(string_split({a}, ','), lambda x: trim(x)), lambda x: x <> '')"


def listing_ctes() -> str:
    """CTEs ``raw_listings``, ``norm`` (normalised, before the clean pass) and
    ``listings`` (final canonical rows, metadata fields flattened)."""
    city = "coalesce(" + _city_case(CITY_PARTS.format(a="address") + "[-1]") + ", '')"
    return f"""
raw_listings as ({raw_listings_sql()}),
norm0 as (
  select {_clean('name')} as name,
         coalesce({_clean('address')}, '') as address,
         coalesce({_clean('location')}, '') as locality,
         {_clean('cuisines')} as c_cuisines,
         {_clean('rate')} as c_rate,
         {_clean('"approx_cost(for two people)"')} as c_cost,
         votes as c_votes,
         {_clean('rest_type')} as rest_type, {_clean('online_order')} as online_order,
         {_clean('book_table')} as book_table, {_clean('url')} as url,
         row_index
  from raw_listings),
norm1 as (
  select *, {city} as city, {COST.format(c='c_cost')} as estimated_cost
  from norm0 where name is not null),
norm as (
  select substr(sha256(concat_ws('|', name, address, cast(row_index as varchar))), 1, 16) as id,
         name,
         coalesce(nullif(lower(concat_ws(', ', nullif(locality, ''), nullif(city, ''))), ''), lower(address)) as location,
         {CUISINES.format(c='c_cuisines')} as cuisines,
         {RATING.format(c='c_rate')} as rating,
         estimated_cost,
         {BAND.format(c='estimated_cost')} as budget_band,
         locality, city, address, try_cast(trim(c_votes) as bigint) as votes,
         rest_type, online_order, book_table, url, row_index as source_row_index
  from norm1),
listings as (
  select id, trim(name) as name, lower(trim(location)) as location,
         list_filter(list_transform(cuisines, lambda x: lower(trim(x))), lambda x: x <> '') as cuisines,
         rating, estimated_cost, budget_band, locality, city, address, votes,
         rest_type, online_order, book_table, url, source_row_index
  from norm where trim(name) <> '')"""


VALID = (
    "nullif(trim(location), '') is not null and budget in ('low', 'medium', 'high') "
    "and nullif(trim(cuisine), '') is not null and min_rating is not null and not isnan(min_rating) "
    "and min_rating >= 0 and min_rating <= 5 and coalesce(top_k, 5) between 1 and 20"
)


def request_ctes() -> str:
    """CTEs ``requests_fx`` (raw) and ``req`` (valid, cleaned, with queries)."""
    return f"""
requests_fx as ({requests_sql()}),
req as (
  select request_id, trim(location) as location, budget, trim(cuisine) as cuisine, min_rating,
         nullif(trim(additional_preferences), '') as additional_preferences,
         cast(coalesce(top_k, 5) as integer) as top_k,
         lower(trim(location)) as loc_q, lower(trim(cuisine)) as cui_q
  from requests_fx where {VALID})"""


QUALITY = "rating desc, coalesce(votes, 0) desc, lower(name), id"


def candidate_ctes(cap: int = 30) -> str:
    """CTEs ``matches`` (all four filters), ``dedup`` and ``cands`` (capped)."""
    return f"""
matches as (
  select r.request_id, l.*
  from req r join listings l
    on l.budget_band = r.budget and contains(l.location, r.loc_q)
   and (r.cui_q = '' or len(list_filter(l.cuisines, lambda c: contains(c, r.cui_q))) > 0)
   and l.rating >= r.min_rating),
dedup as (
  select * from (
    select *, row_number() over (partition by request_id, lower(trim(name)) order by {QUALITY}) as rn
    from matches where trim(name) <> '') where rn = 1),
cands as (
  select * from (
    select * exclude (rn), row_number() over (partition by request_id order by {QUALITY}) as pos
    from dedup) where pos <= {cap})"""


def with_ctes(*parts: str) -> str:
    return "with " + ",".join(p.strip().rstrip(",") for p in parts) + "\n"
