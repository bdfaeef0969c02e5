"""DuckDB SQL per catalogue key (see :mod:`dinerank.plans.oracle`)."""

from __future__ import annotations

from dinerank.operators import vocab
from dinerank.operators.merge import FALLBACK_SUMMARY, GENERIC_EXPLANATION
from dinerank.operators.replies import DEFAULT_EXPLANATION
from dinerank.plans import oracle as O
from dinerank.plans.recommend import EMPTY_FILTER_MESSAGE, NO_CANDIDATES_SUMMARY
from dinerank.sources.fixtures import reply_items_sql

L, R, C = O.listing_ctes(), O.request_ctes(), O.candidate_ctes()
RI = reply_items_sql()


def _w(*parts):
    return O.with_ctes(*parts)


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fmt(template: str, *args: str) -> str:
    """SQL concatenation of a '%s' template."""
    pieces = template.split("%s")
    out = [_lit(pieces[0])]
    for arg, piece in zip(args, pieces[1:]):
        out += [f"({arg})", _lit(piece)]
    return " || ".join(p for p in out if p != "''")


FLAT = ("id, name, location, array_to_string(cuisines, ',') as cuisines, rating, estimated_cost, budget_band, "
        "locality, city, address, votes, rest_type, online_order, book_table, url, source_row_index")
CLEAN = "nullif(trim({x}), '')"
COST_COL = '"approx_cost(for two people)"'
LAST_PART = O.CITY_PARTS.format(a="coalesce(nullif(trim(address), ''), '')") + "[-1]"

GENERIC = _fmt(
    GENERIC_EXPLANATION, "c.location",
    "case when len(c.cuisines) > 0 then array_to_string(c.cuisines, ', ') else r.cuisine end",
    "r.budget", "cast(r.min_rating as varchar)",
)

REJECT = f"""case
  when nullif(trim(location), '') is null then 'location: must not be empty'
  when budget is null or budget not in ('low', 'medium', 'high') then 'budget: must be one of low, medium, high'
  when nullif(trim(cuisine), '') is null then 'cuisine: must not be empty'
  when min_rating is null or isnan(min_rating) or min_rating < 0 or min_rating > 5 then 'min_rating: must be between 0 and 5'
  when coalesce(top_k, 5) < 1 or coalesce(top_k, 5) > 20 then 'top_k: must be between 1 and 20'
  end"""

# Sanitised reply items and the merge, in plain SQL.
SAN = f"""
known as (
  select ri.* from reply_items ri
  where exists (select 1 from cands c where c.request_id = ri.request_id and c.id = ri.listing_id)),
first_ids as (
  select * from (select *, row_number() over (partition by request_id, listing_id order by pos) as rn from known)
  where rn = 1),
san as (
  select request_id, listing_id,
         cast(row_number() over (partition by request_id order by rank, pos) as bigint) as rank,
         coalesce(nullif(trim(explanation), ''), {_lit(DEFAULT_EXPLANATION)}) as explanation, pos
  from first_ids)"""


def merge_ctes(items_where: str = "true") -> str:
    return f"""
pool as (
  select s.request_id, c.id, c.name, 0 as src, s.rank as ord, s.explanation as expl
  from san s join cands c on c.request_id = s.request_id and c.id = s.listing_id where {items_where}
  union all
  select request_id, id, name, 1, pos, null from cands),
pool1 as (
  select * from (select *, row_number() over (partition by request_id, lower(trim(name)) order by src, ord) as rn
                 from pool where trim(name) <> '') where rn = 1),
merged as (
  select p.request_id, cast(row_number() over (partition by p.request_id order by src, ord) as bigint) as rank,
         p.id as listing_id, p.src, p.expl
  from pool1 p),
recs as (
  select m.request_id, m.rank, m.listing_id,
         coalesce(nullif(m.expl, ''), {GENERIC}) as explanation,
         case when m.src = 0 then 'reply' else 'backfill' end as source
  from merged m join req r on r.request_id = m.request_id
  join cands c on c.request_id = m.request_id and c.id = m.listing_id
  where m.rank <= r.top_k)"""


FALLBACK_RECS = f"""
fb as (
  select c.request_id, cast(c.pos as bigint) as rank, c.id as listing_id, {GENERIC} as explanation,
         'backfill' as source
  from cands c join req r on r.request_id = c.request_id where c.pos <= r.top_k)"""

STATS = """
tot as (select r.request_id, count(m.id) as total from req r left join matches m on m.request_id = r.request_id group by 1),
cc as (select r.request_id, count(c.id) as cc from req r left join cands c on c.request_id = r.request_id group by 1)"""

TITLE = ("array_to_string(list_transform(regexp_extract_all({x}, '(\\pL+|\\PL+)', 1), "
         "lambda p: upper(substring(p, 1, 1)) || lower(substring(p, 2))), '')")

FENCED_RE2 = r"(?is)```(?:json)?\s*(\{.*?\})\s*```"
BLOCK = (
    f"case when regexp_extract(raw, '{FENCED_RE2}', 1) <> '' then regexp_extract(raw, '{FENCED_RE2}', 1) "
    "when strpos(raw, '{') > 0 and strpos(reverse(raw), '}') > 0 "
    "and length(raw) - strpos(reverse(raw), '}') + 1 > strpos(raw, '{') "
    "then substring(raw, strpos(raw, '{'), length(raw) - strpos(reverse(raw), '}') + 2 - strpos(raw, '{')) end"
)

AREA_LABELS = "[" + ", ".join(_lit(k) for k in vocab.AREA_OPTIONS) + "]"
AREA_CASE = "case pick " + " ".join(f"when {_lit(k)} then {_lit(v)}" for k, v in vocab.AREA_OPTIONS.items()) + " end"
POPULAR = "(values " + ", ".join(f"({i + 1}, {_lit(c)}, {_lit(c.lower())})" for i, c in enumerate(vocab.POPULAR_CUISINES)) + ") as p(pos, label, key)"
KNOWN_AREAS = "(values " + ", ".join(f"({_lit(v.lower())})" for v in vocab.AREA_OPTIONS.values()) + ") as k(known)"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["scan_raw"] = _w(L) + "select * replace (row_number() over (order by row_index) - 1 as row_index) from raw_listings"
    q["project_columns"] = _w(L) + (
        f"select name, location as locality, address, cuisines, {COST_COL} as cost, rate as rating, votes, "
        "rest_type, online_order, book_table, url, row_index from raw_listings")
    q["clean_strings"] = _w(L) + "select row_index, " + ", ".join(
        f"{CLEAN.format(x=c)} as {c}" for c in ("name", "address", "location")) + " from raw_listings"
    cu = O.CUISINES.format(c=CLEAN.format(x="cuisines"))
    q["parse_cuisines"] = _w(L) + f"select row_index, array_to_string({cu}, ',') as cuisines, cast(len({cu}) as bigint) as n_cuisines from raw_listings"
    q["parse_rating"] = _w(L) + f"select row_index, {O.RATING.format(c=CLEAN.format(x='rate'))} as rating from raw_listings"
    cost = O.COST.format(c=CLEAN.format(x=COST_COL))
    q["parse_cost"] = _w(L) + f"select row_index, {cost} as estimated_cost from raw_listings"
    q["parse_votes"] = _w(L) + "select row_index, try_cast(trim(votes) as bigint) as votes from raw_listings"
    q["extract_city"] = _w(L) + f"select row_index, coalesce({O._city_case(LAST_PART)}, '') as city from raw_listings"
    q["city_alias"] = _w(L) + (
        f"select distinct raw_city, {O._city_case('raw_city')} as city from "
        f"(select {LAST_PART} as raw_city from raw_listings) where raw_city is not null")
    q["search_location"] = _w(L) + "select source_row_index as row_index, location from norm"
    q["budget_band"] = _w(L) + (
        f"select row_index, {cost} as estimated_cost, {O.BAND.format(c=cost)} as budget_band from raw_listings")
    q["stable_id"] = _w(L) + "select source_row_index as row_index, id from norm"
    q["normalize_listings"] = _w(L) + f"select {FLAT} from norm"
    for k in ("preprocess", "ingest", "roundtrip_parquet", "scan_listings"):
        q[k] = _w(L) + f"select {FLAT} from listings"
    q["sanitize_nan"] = _w(L) + "select id, estimated_cost, rating from listings"
    q["manifest"] = _w(L) + "select count(*) as row_count from listings"
    q["ingest_stats"] = _w(L) + (
        "select count(*) as rows_read, count(nullif(trim(name), '')) as rows_normalized, "
        "count(*) filter (where nullif(trim(name), '') is null) as rows_dropped, "
        "count(*) filter (where nullif(trim(name), '') is not null) as rows_written from raw_listings")

    q["clean_requests"] = _w(R) + (
        "select request_id, location, budget, cuisine, min_rating, additional_preferences, "
        "cast(top_k as bigint) as top_k, loc_q, cui_q from req")
    q["applied_filters"] = _w(R) + (
        "select request_id, location as f_location, budget as f_budget, cuisine as f_cuisine, "
        "cast(min_rating as varchar) as f_min_rating from req")
    q["truncate_text"] = (
        "select doc_id, case when length(text) > 500 then substring(text, 1, 500) || '...' "
        "else coalesce(text, 'none specified') end as text from documents")
    q["fallback_explanations"] = _w(L, R, C, FALLBACK_RECS) + "select request_id, rank, listing_id, explanation from fb"
    q["recommend_fallback"] = q["fallback_explanations"]
    q["stream_recommend"] = q["fallback_explanations"]
    n_expr = "least(r.top_k, count(*))"
    summary = _fmt(FALLBACK_SUMMARY, f"cast({n_expr} as varchar)", "r.cuisine", "r.location", "r.budget")
    q["fallback_summary"] = _w(L, R, C) + (
        f"select r.request_id, {summary} as summary from req r join cands c on c.request_id = r.request_id "
        "group by r.request_id, r.top_k, r.cuisine, r.location, r.budget")
    q["cuisine_head"] = _w(L) + (
        "select id, array_to_string(cuisines[1:3], ',') as head3, array_to_string(cuisines[1:2], ',') as head2 from listings")
    q["resolve_area"] = _w(R, f"""
picks as (
  select request_id,
         case request_id % 3 when 0 then {AREA_LABELS}[cast(floor(request_id / 3) as bigint) % 15 + 1]
                             when 1 then {_lit(vocab.CUSTOM_AREA_OPTION)} else location end as pick,
         ' ' || coalesce(location, '') || ' ' as custom, cuisine
  from requests_fx)""") + f"""
select request_id,
       case when pick = {_lit(vocab.CUSTOM_AREA_OPTION)} then trim(custom)
            when ({AREA_CASE}) is not null then {AREA_CASE}
            else trim(pick) end as area,
       case when request_id % 2 = 0 then cuisine else 'North Indian' end as cuisine
from picks"""

    q["filter_location"] = _w(L, R) + (
        "select r.request_id, (select count(*) from listings l where contains(l.location, r.loc_q)) as n_matches from req r")
    q["filter_budget"] = _w(L, R) + (
        "select r.request_id, (select count(*) from listings l where l.budget_band = r.budget) as n_matches from req r")
    q["filter_cuisine"] = _w(L, R) + (
        "select r.request_id, (select count(*) from listings l where r.cui_q = '' or "
        "len(list_filter(l.cuisines, lambda c: contains(c, r.cui_q))) > 0) as n_matches from req r")
    q["filter_min_rating"] = _w(L, R) + (
        "select r.request_id, (select count(*) from listings l where l.rating >= r.min_rating) as n_matches from req r")
    q["filter_all"] = _w(L, R, C, STATS) + "select request_id, total as n_matches from tot"
    q["validate_requests"] = _w(R) + f"select request_id, {REJECT} as reject_reason from requests_fx"

    q["lookup_by_ids"] = _w(L, R, C, RI) + (
        "select ri.request_id, cast(ri.pos as bigint) as pos, l.id, l.name from reply_items ri join listings l on l.id = ri.listing_id")
    q["merge_replies"] = _w(L, R, C, RI, SAN, merge_ctes()) + "select request_id, rank, listing_id, explanation, source from recs"
    q["backfill"] = _w(L, R, C, RI, SAN, merge_ctes()) + "select request_id, rank, listing_id, source from recs"
    q["drop_unknown_ids"] = _w(L, R, C, RI, SAN) + "select request_id, cast(pos as bigint) as pos, listing_id from known"
    q["dedup_reply_ids"] = _w(L, R, C, RI) + (
        "select request_id, cast(pos as bigint) as pos, listing_id from (select *, row_number() over "
        "(partition by request_id, listing_id order by pos) as rn from reply_items) where rn = 1")
    q["renumber_ranks"] = _w(L, R, C, RI, SAN) + "select request_id, listing_id, rank from san"
    q["sanitize_replies"] = _w(L, R, C, RI, SAN) + "select request_id, listing_id, rank, explanation from san"
    q["cuisine_picker"] = _w(L, f"""
vocab as (select distinct unnest(cuisines) as cuisine from listings),
present as (select p.* from {POPULAR} where exists (select 1 from vocab v where contains(v.cuisine, p.key))),
extras as (
  select {TITLE.format(x='cuisine')} as label from vocab
  where cuisine not in (select key from present) order by label limit {vocab.MAX_EXTRA_CUISINES})""") + """
select cast(0 as bigint) as block, cast(row_number() over (order by pos) as bigint) as pos, label from present
union all
select 1, row_number() over (order by label), label from extras"""
    q["area_picker"] = _w(L, f"""
areas as (select distinct trim(locality) as area from listings where trim(locality) <> ''),
extras as (select area from areas where lower(area) not in (select known from {KNOWN_AREAS})
           order by area limit {vocab.MAX_EXTRA_AREAS})""") + f"""
select cast(block as bigint) as block, cast(pos as bigint) as pos, label from (
  select * from (values {", ".join(f"(0, {i + 1}, {_lit(k)})" for i, k in enumerate(vocab.AREA_OPTIONS))}) as h(block, pos, label)
  union all select 1, row_number() over (order by area), area from extras
  union all select 2, 1, {_lit(vocab.CUSTOM_AREA_OPTION)})"""
    q["batch_match"] = _w(L, R, C) + "select request_id, id as listing_id from matches"

    q["count_listings"] = _w(L) + "select count(*) as n_listings from listings"
    q["match_stats"] = _w(L, R, C, STATS) + (
        "select t.request_id, t.total as total_before_cap, c.cc as candidate_count, t.total = 0 as is_empty, "
        "t.total > c.cc as was_capped from tot t join cc c using (request_id)")
    q["distinct_cities"] = _w(L) + "select distinct trim(city) as city from listings where trim(city) <> '' order by 1"
    q["distinct_areas"] = _w(L) + "select distinct trim(locality) as area from listings where trim(locality) <> '' order by 1"
    q["distinct_cuisines"] = _w(L) + "select distinct unnest(cuisines) as cuisine from listings order by 1"
    dedup_all = (
        f"select id, name, rating, votes from (select *, row_number() over (partition by lower(trim(name)) "
        f"order by {O.QUALITY}) as rn from listings where trim(name) <> '') where rn = 1")
    q["dedup_agg"] = _w(L) + dedup_all
    q["dedup_by_name"] = _w(L) + dedup_all
    q["dedup_recommendations"] = _w(L, R, C, """
recs_in as (
  select request_id, cast(pos as bigint) as rank, id as listing_id, name from cands
  union all
  select request_id, cast(pos + 30 as bigint), id || '#dup', upper(name) from cands)""") + """
select request_id, rank, listing_id from (
  select *, row_number() over (partition by request_id, lower(trim(name)) order by rank) as rn
  from recs_in where trim(name) <> '') where rn = 1"""
    q["quality_sort"] = _w(L) + "select id, name, rating, votes from listings"
    q["top_candidates"] = _w(L) + (
        f"select cast(row_number() over (order by {O.QUALITY}) as bigint) as pos, id from ({dedup_all}) "
        f"order by {O.QUALITY} limit 30")
    q["recommend_topk"] = _w(L, R, C) + (
        "select c.request_id, cast(c.pos as bigint) as pos, c.id from cands c join req r using (request_id) where c.pos <= r.top_k")

    q["extract_json_block"] = _w(L, R, C, RI) + f"select request_id, {BLOCK} as block from replies"
    q["parse_replies"] = _w(L, R, C, RI) + """
select request_id, request_id % 10 in (0, 1, 2) as valid,
       case when request_id % 10 in (0, 1, 2) then 'Top picks for request ' || cast(request_id as varchar) end as summary,
       case when request_id % 10 in (0, 1, 2) then (
         select string_agg(listing_id || '|' || cast(rank as varchar) || '|' || explanation, ';' order by pos)
         from reply_items i where i.request_id = rp.request_id) else '' end as items
from replies rp"""
    option = ("'{\"restaurant_id\":' || to_json(c.id) || ',\"name\":' || to_json(c.name) || ',\"location\":' || to_json(c.location) || "
              "',\"cuisines\":' || to_json(c.cuisines) || ',\"rating\":' || cast(c.rating as varchar) || ',\"estimated_cost\":' || "
              "coalesce(cast(c.estimated_cost as varchar), 'null') || ',\"budget_band\":' || to_json(c.budget_band) || '}'")
    wishes = ("case when length(r.additional_preferences) > 500 then substring(r.additional_preferences, 1, 500) || '...' "
              "else coalesce(r.additional_preferences, 'none specified') end")
    q["prompts"] = _w(L, R, C) + f"""
select c.request_id, cast(r.top_k as bigint) as top_k, string_agg(c.id, ',' order by c.pos) as allowed_ids,
       {_lit("The user message is one JSON object about a diner. Its `options` are the only places that exist for you, known by the ids in `allowed_ids`. Pick up to `pick` of them, best first, judged by `diner`, and say in a sentence why each one suits. Reply with a single JSON object shaped like `reply_example` and nothing else.")} as system_text,
       '{{"diner":{{"location":' || to_json(r.location) || ',"budget":' || to_json(r.budget) || ',"cuisine":' || to_json(r.cuisine)
         || ',"min_rating":' || cast(r.min_rating as varchar) || ',"wishes":' || to_json({wishes}) || '}},"pick":' || cast(r.top_k as varchar)
         || ',"options":[' || string_agg({option}, ',' order by c.pos) || '],"allowed_ids":[' || string_agg(to_json(c.id), ',' order by c.pos)
         || '],"reply_example":{{"summary":"optional remark","recommendations":[{{"restaurant_id":"an allowed id","rank":1,"explanation":"reason"}}]}}}}'
         as user_text
from cands c join req r using (request_id)
group by c.request_id, r.top_k, r.location, r.budget, r.cuisine, r.min_rating, r.additional_preferences"""
    q["select_candidates"] = _w(L, R, C) + "select request_id, cast(pos as bigint) as pos, id from cands"
    q["recommend"] = _w(L, R, C, RI, SAN, merge_ctes(), FALLBACK_RECS) + """
select request_id, rank, listing_id, explanation, source from recs where request_id % 10 in (0, 1, 2)
union all
select request_id, rank, listing_id, explanation, source from fb where request_id % 10 not in (0, 1, 2)"""
    in_time = "(request_id % 10 in (0, 1, 2) and request_id * 7 % 20 <= 10)"
    q["stream_replies"] = _w(L, R, C, RI, SAN, merge_ctes(), FALLBACK_RECS) + f"""
select request_id, rank, listing_id, explanation, source from recs where {in_time}
union all
select request_id, rank, listing_id, explanation, source from fb where not {in_time}"""
    fb_summary = _fmt(FALLBACK_SUMMARY, "cast(least(r.top_k, c.cc) as varchar)", "r.cuisine", "r.location", "r.budget")
    q["responses"] = _w(L, R, C, STATS, """
x as (select r.*, t.total, c.cc, r.request_id % 10 in (0, 1, 2) and c.cc > 0 as ok
      from req r join tot t using (request_id) join cc c using (request_id))""") + f"""
select request_id,
       case when total = 0 or cc = 0 then 'empty' when ok then 'success' else 'fallback' end as status,
       case when total = 0 then null when cc = 0 then {_lit(NO_CANDIDATES_SUMMARY)}
            when ok then 'Top picks for request ' || cast(request_id as varchar)
            else {fb_summary.replace('c.cc', 'cc').replace('r.', '')} end as summary,
       case when total = 0 then {_lit(EMPTY_FILTER_MESSAGE)} end as message,
       total as candidates_considered, cc as candidates_sent,
       not (total = 0 or cc = 0 or ok) as llm_fallback,
       case when total > 0 then total > cc end as was_capped,
       cast(least(top_k, cc) as bigint) as n_recommendations
from x
union all
select request_id, 'rejected', null, reject_reason, 0, 0, false, null, 0
from (select request_id, {REJECT} as reject_reason from requests_fx) where reject_reason is not null"""
    q["score_prompts"] = _w(L, R, C) + (
        "select request_id, '{\"summary\": null, \"recommendations\": [' || "
        "string_agg('{\"restaurant_id\": \"' || id || '\", \"rank\": ' || cast(pos as varchar) || "
        "', \"explanation\": \"\"}', ', ' order by pos) || ']}' as raw, "
        "cast(null as varchar) as error, cast(1 as bigint) as attempts from cands group by request_id")
    title_loc = TITLE.format(x="replace(c.location, ', ', ' · ')")
    title_tag = TITLE.format(x="t")
    q["display_rows"] = _w(L, R, C, FALLBACK_RECS) + f"""
select fb.request_id, fb.rank, fb.listing_id, c.name,
       {title_loc} as location_label,
       format('{{:.1f}}', c.rating) as rating_label,
       case when len(c.cuisines) = 0 then 'N/A'
            else array_to_string(list_transform(c.cuisines, lambda t: {title_tag}), ', ') end as cuisines_label,
       case when c.estimated_cost is null then 'N/A'
            else '₹' || format('{{:,.0f}}', c.estimated_cost) || ' for two' end as cost_label,
       coalesce(c.budget_band, 'unknown') as budget_label,
       case c.budget_band when 'low' then 'Low Budget' when 'medium' then 'Medium Budget'
            when 'high' then 'High Budget' else 'Unknown budget' end as budget_chip,
       fb.explanation
from fb join cands c on c.request_id = fb.request_id and c.id = fb.listing_id"""
    q["published_values"] = _w(L) + """
select kind, value, cast(null as varchar) as band, count(*) as n from (
  select 'city' as kind, trim(city) as value from listings where trim(city) <> ''
  union all select 'area', trim(locality) from listings where trim(locality) <> ''
  union all select 'cuisine', unnest(list_distinct(cuisines)) from listings) group by kind, value
union all
select 'place', location, budget_band, count(*) from listings group by location, budget_band"""
    q["published_lookup"] = _w(L) + (
        f"select b.pos, id, l.name, l.location, l.rating from (select cast(row_number() over (order by {O.QUALITY}) as bigint) as pos, id "
        f"from ({dedup_all}) order by {O.QUALITY} limit 30) b join listings l using (id)")
    q["published_area_picker"] = q["area_picker"]
    q["published_cuisine_picker"] = q["cuisine_picker"]
    q["select_candidates_pruned"] = _w(L, R, C) + (
        "select request_id, cast(pos as bigint) as pos, id from cands join req using (request_id) where req.budget = 'low'")
    q["score_journal"] = f"select request_id, raw, error, cast(0 as bigint) as attempts from ({q['score_prompts']})"
    q["reply_content"] = _w(L, R, C, RI) + "select request_id, raw as content from replies"
    return q
