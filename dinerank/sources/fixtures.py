"""Fixture tables derived from the driver's TPC-H-like tables.

``raw_listings`` has one row per distinct ``(l_partkey, l_suppkey)`` of
lineitem (quantity summed) joined to part/supplier/nation/region;
``requests`` has one row per customer. The column expressions are plain
SQL valid in Spark and DuckDB, so the oracle SQL reuses the very same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dinerank.schemas import COST_COLUMN, RAW_COLUMNS

# The fixture column definitions (shared with the oracle SQL).
RAW_EXPRS = {
    "row_index": "l_partkey * 1000000 + l_suppkey",
    "name": (
        "case when l_partkey % 97 = 0 then '   ' "
        "when l_suppkey % 3 = 0 then upper(concat(p_name, ' ', p_brand)) "
        "when l_suppkey % 3 = 1 then concat('  ', p_name, ' ', p_brand, ' ') "
        "else concat(p_name, ' ', p_brand) end"
    ),
    "address": (
        "concat(s_name, ', ', n_name, ', ', case s_suppkey % 4 when 0 then 'Bengaluru' "
        "when 1 then 'delhi' when 2 then r_name else ' ' end)"
    ),
    "location": "case when s_suppkey % 11 = 0 then null else concat(' ', n_name) end",
    "cuisines": "case when l_partkey % 13 = 0 then null else concat(' ', p_type, ', ', p_brand, ' ,') end",
    COST_COLUMN: (
        "case l_partkey % 7 when 0 then '-' "
        "when 1 then concat(cast(l_partkey % 1000 as varchar(20)), '-', cast(l_partkey % 1000 + 300 as varchar(20))) "
        "when 2 then concat('₹1,', cast(100 + l_partkey % 900 as varchar(20)), ' for two') "
        "when 3 then null else cast(l_partkey % 2500 as varchar(20)) end"
    ),
    "rate": (
        "case l_partkey % 9 when 0 then 'NEW' when 1 then '-' when 2 then null "
        "else concat(cast(cast(floor(p_size / 10) as int) as varchar(20)), '.', "
        "cast(p_size % 10 as varchar(20)), '/5') end"
    ),
    "votes": "case when l_partkey % 17 = 0 then 'n/a' else cast(cast(qty as bigint) as varchar(20)) end",
}

REQUEST_EXPRS = {
    "request_id": "c_custkey",
    "location": (
        "case c_custkey % 6 when 0 then 'BANGALORE' when 1 then concat(' ', n_name, ' ') "
        "when 2 then r_name when 3 then 'delhi' when 4 then '50%' else '  ' end"
    ),
    "budget": "case c_custkey % 7 when 0 then 'low' when 1 then 'high' when 2 then 'Low' else 'medium' end",
    "cuisine": (
        "case c_custkey % 5 when 0 then 'Brand#1' when 1 then ' economy ' when 2 then 'o' "
        "when 3 then 'STANDARD' else '' end"
    ),
    "min_rating": "cast((c_custkey % 12) * 0.5 as double)",
    "additional_preferences": (
        "case when c_custkey % 9 = 0 then null when c_custkey % 9 = 1 then '  ' "
        "else concat('note ', c_name) end"
    ),
    "top_k": "cast(c_custkey % 23 as int)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string raw listing table plus ``row_index`` (see module doc)."""
    # Dealt by part, rows are summed where they lie and meet their part there: one shuffle, not two.
    qty = (
        table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity").repartition("l_partkey")
        .groupBy("l_partkey", "l_suppkey")
        .agg(F.sum("l_quantity").alias("qty"))
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    joined = (
        qty.join(part, qty.l_partkey == part.p_partkey)
        .join(supplier, qty.l_suppkey == supplier.s_suppkey)
        .join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
    )
    cols = []
    for c in RAW_COLUMNS:
        if c in RAW_EXPRS:
            cols.append(F.expr(RAW_EXPRS[c]).cast("string").alias(c))
        else:
            cols.append(F.lit(None).cast("string").alias(c))
    cols.append(F.expr(RAW_EXPRS["row_index"]).cast("bigint").alias("row_index"))
    return joined.select(*cols)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One preference request per customer (see module doc)."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(
        region, nation.n_regionkey == region.r_regionkey
    )
    return joined.select(
        F.expr(REQUEST_EXPRS["request_id"]).cast("bigint").alias("request_id"),
        *[F.expr(REQUEST_EXPRS[c]).alias(c) for c in
          ("location", "budget", "cuisine", "min_rating", "additional_preferences", "top_k")],
    )


# ---------------------------------------------------------------- oracle SQL

def _q(name: str) -> str:
    return '"' + name + '"'


def raw_listings_sql() -> str:
    """DuckDB body of the ``raw_listings`` CTE."""
    cols = []
    for c in RAW_COLUMNS:
        if c in RAW_EXPRS:
            cols.append(f"cast({RAW_EXPRS[c]} as varchar) as {_q(c)}")
        else:
            cols.append(f"cast(null as varchar) as {_q(c)}")
    cols.append(f"cast({RAW_EXPRS['row_index']} as bigint) as row_index")
    return (
        "select " + ", ".join(cols) + " from (select l_partkey, l_suppkey, sum(l_quantity) as qty "
        "from lineitem group by l_partkey, l_suppkey) q "
        "join part on q.l_partkey = p_partkey join supplier on q.l_suppkey = s_suppkey "
        "join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"
    )


def requests_sql() -> str:
    """DuckDB body of the ``requests`` CTE."""
    cols = [f"cast({REQUEST_EXPRS['request_id']} as bigint) as request_id"] + [
        f"{REQUEST_EXPRS[c]} as {c}"
        for c in ("location", "budget", "cuisine", "min_rating", "additional_preferences", "top_k")
    ]
    return (
        "select " + ", ".join(cols) + " from customer join nation on c_nationkey = n_nationkey "
        "join region on n_regionkey = r_regionkey"
    )


# ---------------------------------------------------------- reply fixtures
#
# reply_items: from the capped candidates, positions 1..n with reversed ranks
# (7 - pos), n = 1 + request_id % 6 (so many replies are shorter than top_k), a
# blank explanation where pos % 4 = 0, then a repeat of the first id (pos 7,
# rank 2) and an unknown id 'zzz' (pos 8, rank 1).
# replies: the JSON text of those items, shaped by request_id % 10: plain,
# fenced with prose, embedded in prose, truncated, prose only, blank, NULL, and
# three that break the schema: a rank of 0 added, an item that is not an
# object, a null explanation.

UNKNOWN_ID = "zzz"
BROKEN_ITEMS = (
    '{"restaurant_id":"zzz","rank":0,"explanation":"x"}',
    "17",
    '{"restaurant_id":"zzz","rank":1,"explanation":null}',
)
REPLY_PROSE = "I cannot rank these right now."


def reply_items(candidates: DataFrame) -> DataFrame:
    """``(request_id, pos, listing_id, rank, explanation)``."""
    base = candidates.where(F.col("pos") <= 1 + F.col("request_id") % 6).select(
        "request_id",
        F.col("pos").cast("int").alias("pos"),
        F.col("id").alias("listing_id"),
        (F.lit(7) - F.col("pos")).cast("bigint").alias("rank"),
        F.when(F.col("pos") % 4 == 0, F.lit(" ")).otherwise(F.concat(F.lit("fits: "), F.col("name"))).alias("explanation"),
    )
    first = candidates.where(F.col("pos") == 1)
    repeat = first.select("request_id", F.lit(7).alias("pos"), F.col("id").alias("listing_id"),
                          F.lit(2).cast("bigint").alias("rank"), F.lit("again").alias("explanation"))
    unknown = first.select("request_id", F.lit(8).alias("pos"), F.lit(UNKNOWN_ID).alias("listing_id"),
                           F.lit(1).cast("bigint").alias("rank"), F.lit("unknown").alias("explanation"))
    return base.unionByName(repeat).unionByName(unknown)


def replies(items: DataFrame) -> DataFrame:
    """``(request_id, raw)`` reply texts built from ``reply_items`` (at most
    eight items per request, so the per-request list is bounded)."""
    per_req = items.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct(
            "pos", F.struct("listing_id", "rank", "explanation").alias("it")))).alias("_its")
    )
    doc = F.to_json(F.struct(
        F.concat(F.lit("Top picks for request "), F.col("request_id").cast("string")).alias("summary"),
        F.transform("_its", lambda x: F.struct(
            x["it"]["listing_id"].alias("restaurant_id"), x["it"]["rank"].alias("rank"),
            x["it"]["explanation"].alias("explanation"))).alias("recommendations"),
    ))
    kind = F.col("request_id") % 10
    broken = lambda item: F.regexp_replace(F.col("_doc"), r"\]\}$", f",{item}]}}")
    raw = (
        F.when(kind == 0, doc)
        .when(kind == 1, F.concat(F.lit("Here you go:\n```json\n"), doc, F.lit("\n```\nEnjoy!")))
        .when(kind == 2, F.concat(F.lit("Sure! "), doc, F.lit(" Hope this helps.")))
        .when(kind == 3, F.expr("substring(_doc, 1, length(_doc) - 10)"))
        .when(kind == 4, F.lit(REPLY_PROSE))
        .when(kind == 5, F.lit("   "))
        .when(kind == 7, broken(BROKEN_ITEMS[0]))
        .when(kind == 8, broken(BROKEN_ITEMS[1]))
        .when(kind == 9, broken(BROKEN_ITEMS[2]))
    )
    return per_req.withColumn("_doc", doc).select("request_id", raw.alias("raw"))


def reply_items_sql() -> str:
    """DuckDB CTEs ``reply_items`` and ``replies`` (need ``cands``)."""
    item = ("'{\"restaurant_id\":\"' || listing_id || '\",\"rank\":' || cast(rank as varchar) || "
            "',\"explanation\":\"' || explanation || '\"}'")
    doc = ("'{\"summary\":\"Top picks for request ' || cast(request_id as varchar) || "
           "'\",\"recommendations\":[' || string_agg(" + item + ", ',' order by pos) || ']}'")
    return f"""
reply_items as (
  select request_id, cast(pos as integer) as pos, id as listing_id, cast(7 - pos as bigint) as rank,
         case when pos % 4 = 0 then ' ' else 'fits: ' || name end as explanation
  from cands where pos <= 1 + request_id % 6
  union all
  select request_id, 7, id, 2, 'again' from cands where pos = 1
  union all
  select request_id, 8, '{UNKNOWN_ID}', 1, 'unknown' from cands where pos = 1),
reply_docs as (
  select request_id, {doc} as doc from reply_items group by request_id),
replies as (
  select request_id,
         case request_id % 10
           when 0 then doc
           when 1 then 'Here you go:' || chr(10) || '```json' || chr(10) || doc || chr(10) || '```' || chr(10) || 'Enjoy!'
           when 2 then 'Sure! ' || doc || ' Hope this helps.'
           when 3 then substring(doc, 1, length(doc) - 10)
           when 4 then '{REPLY_PROSE}'
           when 5 then '   '
           when 7 then substring(doc, 1, length(doc) - 2) || ',{BROKEN_ITEMS[0]}' || ']}}'
           when 8 then substring(doc, 1, length(doc) - 2) || ',{BROKEN_ITEMS[1]}' || ']}}'
           when 9 then substring(doc, 1, length(doc) - 2) || ',{BROKEN_ITEMS[2]}' || ']}}'
           else null end as raw
  from reply_docs)"""
