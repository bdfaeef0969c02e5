"""Matching preference requests against listings, set-based.

The reference answers one request by scanning every listing. Here a whole
table of requests is answered in one job:

1. **Coalesce requests** to distinct criteria keys ``(loc_q, budget, cui_q)``,
   each with a 64-bit id ``kid``.
2. **Profiles.** The predicates look at ``(location, budget_band, cuisines)`` only.
   A distinct profile has a 64-bit id ``pid``, a hash of its columns, so a listing
   knows its profile without a join and no array is ever a join key.
3. **Inverted tag index.** Location and cuisine substrings are resolved against
   the distinct locations and tags with an exact gram equi-join
   (``substring_pairs``). Tags give posting lists ``(location, band, cuisine
   query) -> pid``; keys meet them on equality, so only true pairs are made.
4. **State per profile**, one hash aggregation over the listings: rows and name
   marks per rating and band of votes. Summed per key it gives the rating histogram
   behind ``total_before_cap``, and how far down the quality order a key's
   best ``n`` names can lie at most; only listings above that are sorted.
5. **Apply ``min_rating`` after the cap**: the quality order starts with
   rating, so filtering the capped prefix equals capping the filtered set.

Plans stay lazy and carry no broadcast hints: the planner decides from its
own size estimates (:func:`batch_match` alone counts what it sends). Intermediates are written only into a caller's ``Scratch``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dinerank.functions.text import clean_string, lower_strip, ustrip
from dinerank.params import DEFAULT, Params
from dinerank.schemas import BUDGET_LEVELS
from dinerank.session import NO_LIMIT, Scratch, byte_size

KEY = ["loc_q", "budget", "cui_q"]

# Messages for rejected requests, in checking order.
REJECT_LOCATION = "location: must not be empty"
REJECT_BUDGET = "budget: must be one of low, medium, high"
REJECT_CUISINE = "cuisine: must not be empty"
REJECT_MIN_RATING = "min_rating: must be between 0 and 5"
REJECT_TOP_K = "top_k: must be between 1 and 20"


# ------------------------------------------------------------------ requests

def clean_requests(requests: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Strip required text, blank optional text -> NULL, missing top_k -> default,
    and add the lower-cased match queries ``loc_q`` / ``cui_q``."""
    return requests.withColumns({
        "location": ustrip(F.col("location")),
        "cuisine": ustrip(F.col("cuisine")),
        "additional_preferences": clean_string(F.col("additional_preferences")),
        "top_k": F.coalesce(F.col("top_k").cast("int"), F.lit(params.default_top_k)),
    }).withColumns({
        "loc_q": F.lower(F.col("location")),
        "cui_q": F.lower(F.col("cuisine")),
    })


def reject_reason(params: Params = DEFAULT) -> Column:
    """First failing rule, in field order; NULL when the request is valid."""
    loc = clean_string(F.col("location"))
    cui = clean_string(F.col("cuisine"))
    m = F.col("min_rating")
    k = F.coalesce(F.col("top_k").cast("int"), F.lit(params.default_top_k))
    return (
        F.when(loc.isNull(), F.lit(REJECT_LOCATION))
        .when(~F.coalesce(F.col("budget").isin(*BUDGET_LEVELS), F.lit(False)), F.lit(REJECT_BUDGET))
        .when(cui.isNull(), F.lit(REJECT_CUISINE))
        # NaN >= 0 is true in Spark, so NaN is rejected explicitly.
        .when(m.isNull() | F.isnan(m) | (m < 0) | (m > 5), F.lit(REJECT_MIN_RATING))
        .when((k < 1) | (k > params.max_top_k), F.lit(REJECT_TOP_K))
    )


def validate_requests(requests: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """All requests, cleaned, with ``reject_reason`` (NULL = valid)."""
    return clean_requests(requests.withColumn("reject_reason", reject_reason(params)), params)


def valid_requests(requests: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return validate_requests(requests, params).where(F.col("reject_reason").isNull()).drop("reject_reason")


def applied_filters(requests: DataFrame) -> Column:
    """The four hard filters of a (cleaned) request as a string map; free text
    is never a filter."""
    return F.create_map(
        F.lit("location"), F.col("location"),
        F.lit("budget"), F.col("budget"),
        F.lit("cuisine"), F.col("cuisine"),
        F.lit("min_rating"), F.col("min_rating").cast("string"),
    )


# ------------------------------------------------------------- substring join

def _grams(text: Column, n: int) -> Column:
    """Distinct substrings of length ``n``; the whole text when it is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


def substring_pairs(queries: DataFrame, q: str, texts: DataFrame, t: str, gram: int = 3) -> DataFrame:
    """All ``(q, t)`` with ``t`` containing ``q`` (literal, case-sensitive).

    A query of at least ``gram`` characters is keyed by the one of its grams
    that the fewest texts contain, so a prefix or word common to many
    queries does not bring them together; a query with a gram that no text
    has is dropped. A shorter query is keyed by itself against the
    substrings of its length, the empty query by ''. The equi-join on the key
    is followed by the exact ``contains`` test. Inputs are reduced to distinct
    values first.
    """
    qd = queries.select(F.col(q).alias("_q")).where(F.col("_q").isNotNull()).distinct()
    td = texts.select(F.col(t).alias("_t")).where(F.col("_t").isNotNull()).distinct()
    lengths = F.array_union(F.array(F.lit(0)), F.sequence(F.lit(1), F.lit(gram)))
    short = F.flatten(F.transform(lengths, lambda k: F.when(k == 0, F.array(F.lit(""))).otherwise(
        F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.greatest(F.length("_t") - k + 1, F.lit(1))), lambda i: F.substring(F.col("_t"), i, k))))))
    keyed = td.select("_t", F.explode(F.array_distinct(short)).alias("_g"))
    used = keyed.groupBy("_g").agg(F.count(F.lit(1)).alias("_df"))
    own = qd.select("_q", F.explode(F.when(F.length("_q") == 0, F.array(F.lit(""))).otherwise(_grams(F.col("_q"), gram))).alias("_g"))
    rarest = (
        own.join(used, "_g", "left").groupBy("_q")
        .agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), F.col("_g").alias("g"))).alias("_r"))
        .where(F.col("_r.df") > 0).select("_q", F.col("_r.g").alias("_g"))
    )
    return (
        rarest.join(keyed, "_g")
        .where(F.contains(F.col("_t"), F.col("_q")))
        .select(F.col("_q").alias(q), F.col("_t").alias(t))
    )


# --------------------------------------------------------------------- match

def quality_order(prefix: str = "") -> list[Column]:
    """Total order of listings: rating desc, votes desc (NULL as 0),
    lower(name) asc, id asc."""
    p = prefix
    return [
        F.col(f"{p}rating").desc(),
        F.coalesce(F.col(f"{p}votes"), F.lit(0)).desc(),
        F.lower(F.col(f"{p}name")).asc(),
        F.col(f"{p}id").asc(),
    ]


def listing_columns(listings: DataFrame) -> DataFrame:
    """The listing fields matching, ranking and prompts need (prunes the scan)."""
    return listings.select(
        "id", "name", "location", "cuisines", "rating", "estimated_cost", "budget_band",
        F.col("metadata.votes").alias("votes"),
    )


def cuisine_match(cui_q: Column) -> Column:
    """Blank query, or some tag contains it."""
    return (cui_q == F.lit("")) | F.exists(F.col("cuisines"), lambda c: F.contains(c, cui_q))


PROFILE = ["location", "budget_band", "cuisines"]


def profile_id() -> Column:
    """64-bit id of a listing's profile."""
    return F.xxhash64(*PROFILE)


def criteria(requests: DataFrame) -> DataFrame:
    """The distinct criteria of valid requests, with their 64-bit id ``kid``."""
    return requests.select(*KEY).distinct().withColumn("kid", F.xxhash64(*KEY))


def match_profiles(profiles: DataFrame, keys: DataFrame) -> DataFrame:
    """``(kid, pid)``: the profiles (``pid`` and the PROFILE columns) that match each key, whatever the rating."""
    tags = profiles.select("pid", "location", "budget_band", F.explode(F.array_distinct("cuisines")).alias("tag"))
    postings = (
        tags.join(substring_pairs(keys, "cui_q", tags, "tag"), "tag")
        .select("location", F.col("budget_band").alias("budget"), "cui_q", "pid").distinct()
    )
    located = keys.join(substring_pairs(keys, "loc_q", profiles, "location"), "loc_q")
    return located.join(postings, ["location", "budget", "cui_q"]).select("kid", "pid")


def _votes_band() -> Column:
    """A coarse scale that never falls where votes rise."""
    return F.floor(F.log2(F.greatest(F.coalesce(F.col("votes"), F.lit(0)), F.lit(0)) + 1)).cast("int")


#: Name marks per 64-bit word, and cap rows that one word is taken for.
_MARKS, _PER_WORD = 64, 16


def listing_states(listings: DataFrame, n: int) -> DataFrame:
    """Per profile, rating and band of votes: ``_n`` rows, and in ``_m0``, ``_m1``, ...
    a mark for the hash of every name that is not blank. All of it merges by sum
    and bitwise or, so it is combined before the one shuffle."""
    words = max(1, -(-n // _PER_WORD))
    name = lower_strip(F.col("name"))
    mark = F.when(name != F.lit(""), F.pmod(F.xxhash64(name), F.lit(words * _MARKS)))
    lst = listings.select(*PROFILE, "rating", _votes_band().alias("_v"), mark.alias("_mark"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_mark", F.lit(_MARKS)).cast("int"))
    marks = [F.bit_or(F.when(F.floor(F.col("_mark") / _MARKS) == j, bit).otherwise(F.lit(0).cast("long"))).alias(f"_m{j}") for j in range(words)]
    return lst.groupBy(*PROFILE, "rating", "_v").agg(F.count(F.lit(1)).alias("_n"), *marks).withColumn("pid", profile_id())


def key_states(states: DataFrame, matched: DataFrame) -> DataFrame:
    """The states summed per key, rating and band of votes."""
    marks = [c for c in states.columns if c.startswith("_m")]
    return matched.join(states.select("pid", "rating", "_v", "_n", *marks), "pid").groupBy("kid", "rating", "_v").agg(
        F.sum("_n").alias("_n"), *[F.bit_or(m).alias(m) for m in marks])


def depth_bounds(sums: DataFrame, n: int) -> DataFrame:
    """``kid, _r, _b``: rating and band of votes down to which a key surely has ``n``
    different names (fewer marks than names can be set, never more). No row for a key with too few."""
    marks = [c for c in sums.columns if c.startswith("_m")]
    # At most one row per rating and band of votes in a window.
    down = Window.partitionBy("kid").orderBy(F.col("rating").desc(), F.col("_v").desc())
    names = sum((F.bit_count(F.bit_or(m).over(down)) for m in marks), F.lit(0))
    enough = sums.select("kid", F.struct("rating", "_v").alias("_at"), names.alias("_names")).where(F.col("_names") >= n)
    return enough.groupBy("kid").agg(F.max("_at").alias("_at")).select("kid", F.col("_at.rating").alias("_r"), F.col("_at._v").alias("_b"))


def dedup_by_name(df: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Best listing per case-insensitive stripped name (within ``group``);
    blank names never survive."""
    group = list(group or [])
    name_key = lower_strip(F.col("name"))
    w = Window.partitionBy(*[F.col(g) for g in group], name_key).orderBy(*quality_order())
    return (
        df.where(name_key != F.lit(""))
        .withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") == 1)
        .drop("_rn")
    )


def cap_by_quality(df: DataFrame, group: list[str], n: int, pos: str = "pos") -> DataFrame:
    """First ``n`` rows of each group in quality order, numbered 1..n."""
    w = Window.partitionBy(*group).orderBy(*quality_order())
    return df.withColumn(pos, F.row_number().over(w)).where(F.col(pos) <= n)


def key_candidates(listings: DataFrame, matched: DataFrame, bounds: DataFrame, n: int) -> DataFrame:
    """The best ``n`` distinct names of each key, with ``pos``; only listings of
    matched profiles and within the key's bound are sorted."""
    wanted = matched.join(bounds, "kid", "left")
    rows = listing_columns(listings).withColumns({"pid": profile_id(), "_v": _votes_band()}).join(wanted, "pid")
    near = rows.where(F.col("_r").isNull() | (F.col("rating") > F.col("_r")) | ((F.col("rating") == F.col("_r")) & (F.col("_v") >= F.col("_b"))))
    return cap_by_quality(dedup_by_name(near.drop("pid", "_v", "_r", "_b"), ["kid"]), ["kid"], n)


def select_candidates(listings: DataFrame, requests: DataFrame, params: Params = DEFAULT,
                      scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidate selection for a table of requests.

    Returns ``(candidates, stats)``:
    ``candidates(request_id, pos, id, name, location, cuisines, rating,
    estimated_cost, budget_band, votes)`` and one row per valid request
    ``stats(request_id, total_before_cap, candidate_count, is_empty, was_capped)``.
    ``total_before_cap`` counts matches before name dedup.

    With ``scratch`` the profile states, the key-profile pairs, the key states
    and the per-key candidates are written there once and shared by both
    outputs; without it both plans are lazy.
    """
    keep = scratch.cut if scratch else (lambda df: df)
    n = params.max_candidates
    req = valid_requests(requests, params).withColumn("kid", F.xxhash64(*KEY))
    # A null rating passes no threshold and stands last in every order.
    rated = listings.where(F.col("rating").isNotNull() & F.col("budget_band").isNotNull())
    states = keep(listing_states(rated.withColumn("votes", F.col("metadata.votes")), n))
    profiles = keep(states.select("pid", *PROFILE).distinct())
    matched = keep(match_profiles(profiles, criteria(req)))
    sums = keep(key_states(states, matched))
    cands_k = keep(key_candidates(rated, matched, depth_bounds(sums, n), n))
    hist = sums.groupBy("kid", "rating").agg(F.sum("_n").alias("_n"))

    # Per (key, min_rating): matches and candidates passing the threshold.
    thresholds = req.select("kid", "min_rating").distinct()
    totals = (
        thresholds.join(hist, "kid")
        .where(F.col("rating") >= F.col("min_rating"))
        .groupBy("kid", "min_rating")
        .agg(F.sum("_n").cast("bigint").alias("total_before_cap"))
    )
    cand_counts = (
        thresholds.join(cands_k.select("kid", "rating"), "kid")
        .where(F.col("rating") >= F.col("min_rating"))
        .groupBy("kid", "min_rating")
        .agg(F.count(F.lit(1)).cast("bigint").alias("candidate_count"))
    )
    tk = ["kid", "min_rating"]
    stats = (
        req.select("request_id", *tk)
        .join(totals, tk, "left")
        .join(cand_counts, tk, "left")
        .select(
            "request_id",
            F.coalesce("total_before_cap", F.lit(0)).cast("bigint").alias("total_before_cap"),
            F.coalesce("candidate_count", F.lit(0)).cast("bigint").alias("candidate_count"),
        )
        .withColumns({
            "is_empty": F.col("total_before_cap") == 0,
            "was_capped": F.col("total_before_cap") > F.col("candidate_count"),
        })
    )

    # Requests pick up their key's candidates; the rating cut keeps a prefix,
    # so positions stay 1..n.
    candidates = (
        req.select("request_id", *tk)
        .join(cands_k, "kid")
        .where(F.col("rating") >= F.col("min_rating"))
        .select("request_id", F.col("pos").cast("int").alias("pos"), "id", "name", "location",
                "cuisines", "rating", "estimated_cost", "budget_band", "votes")
    )
    return candidates, stats


#: Requests of one key and threshold that one row of a table of them holds at most.
_RUN = 1024
#: Bytes in memory of tables that are sent to every task, whatever their files take.
_SENT_BYTES = 32 << 20
#: Listings of one class that give out their pairs together: a page of 20,000 rows repeats them often.
_BLOCK = 128
#: Listings per task that writes pairs, on the average: a file's dictionary of ids (1 MB) holds twice as many.
_TILE = 20_000


def request_runs(requests: DataFrame) -> DataFrame:
    """``kid, min_rating, ids``: the requests (with ``kid``) of each key and threshold, ``_RUN`` at most in a row."""
    at = Window.partitionBy("kid", "min_rating").orderBy("request_id")
    run = F.floor((F.row_number().over(at) - 1) / _RUN).alias("_run")
    # A null id would not be collected by itself.
    return requests.select("kid", "min_rating", "request_id", run).groupBy("kid", "min_rating", "_run").agg(
        F.collect_list(F.struct("request_id")).alias("_ids")).select("kid", "min_rating", F.col("_ids.request_id").alias("ids"))


def listing_blocks(placed: DataFrame) -> DataFrame:
    """``cid, _star, _block, _top, _listings``: the listings ``(cid, rating, id)`` of each class and star, best
    first, ``_BLOCK`` at most in a row, with the best rating among them."""
    starred = placed.withColumn("_star", F.floor(_tenth("rating") / 10))
    at = Window.partitionBy("cid", "_star").orderBy(F.col("rating").desc(), "id")
    block = F.floor((F.row_number().over(at) - 1) / _BLOCK).alias("_block")
    return starred.select("cid", "_star", "rating", "id", block).groupBy("cid", "_star", "_block").agg(
        F.max("rating").alias("_top"), F.sort_array(F.collect_list(F.struct("rating", "id")), asc=False).alias("_listings"))


def profile_classes(matched: DataFrame) -> DataFrame:
    """``(pid, cid)``: profiles that match the same keys are of one class, whose 64-bit id is a hash of the keys in any order."""
    return matched.groupBy("pid").agg(F.bit_xor("kid").alias("_x"), F.bit_xor(F.xxhash64("kid", F.lit(1))).alias("_y")).select(
        "pid", F.xxhash64("_x", "_y").alias("cid"))


def _small_enough(spark: SparkSession, *tables: DataFrame) -> bool:
    """Whether these written tables, of a few numbers a row and ``ids``, may be sent to every task. A session that forbids broadcasts has none."""
    if byte_size(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")) == NO_LIMIT:
        return False
    held = [t.agg(F.sum(F.lit(48) + (8 * F.size("ids") if "ids" in t.columns else F.lit(0)))).first()[0] or 0 for t in tables]
    return sum(held) <= _SENT_BYTES


def batch_match(listings: DataFrame, requests: DataFrame, params: Params = DEFAULT, scratch: Scratch | None = None) -> DataFrame:
    """Every ``(request_id, listing id)`` pair passing all four hard filters
    (before dedup and cap). All pairs are the feature, so no other plan uses it.

    With ``scratch`` the profiles, the key-profile pairs, their classes and the requests of each key are
    written there once. Where all but the first take few bytes they are sent to the listings, which are
    dealt out once each; else listings and requests meet in a merge, a listing once for each key.
    """
    keep = scratch.cut if scratch else (lambda df: df)
    req = valid_requests(requests, params).withColumn("kid", F.xxhash64(*KEY))
    lst = listings.where(F.col("rating").isNotNull() & F.col("budget_band").isNotNull()).select(*PROFILE, "id", "rating")
    profiles = keep(lst.select(*PROFILE).distinct().withColumn("pid", profile_id()))
    matched = keep(match_profiles(profiles, criteria(req)))
    runs = keep(request_runs(req))
    rows = lst.select(profile_id().alias("pid"), "id", "rating")
    if scratch:
        classes = keep(profile_classes(matched))
        keys = keep(classes.groupBy("cid").agg(F.min("pid").alias("pid")).join(matched, "pid").select("cid", "kid"))
        if _small_enough(scratch.spark, classes, keys, runs):
            # For one request after the other a block of listings is gone through down to its threshold. Written, the
            # request is one entry a block and the listings are the same bytes again: a pair takes a fraction of a byte.
            tiles = max(1, -(-listings.count() // _TILE))
            blocks = listing_blocks(rows.join(F.broadcast(classes), "pid")).repartitionByRange(tiles, "cid", "_star", "_block")
            met = blocks.join(F.broadcast(keys), "cid").join(F.broadcast(runs), "kid").where(F.col("_top") >= F.col("min_rating"))
            return met.select("_listings", "min_rating", F.explode("ids").alias("request_id")).select(
                "request_id", "min_rating", F.explode("_listings").alias("_l")).where(F.col("_l.rating") >= F.col("min_rating")).select(
                "request_id", F.col("_l.id").alias("listing_id"))
    per_key = rows.join(matched, "pid").select("kid", _tenth("rating"), "rating", "id")
    # A request meets the listings of its key at every tenth of a star from its own on.
    asked = runs.select("*", F.explode(F.sequence(F.floor(F.col("min_rating") * 10).cast("int"), F.lit(50))).alias("_tenth"))
    # The merge runs through the listings: those of one key and rating follow each other, and each gives out the same
    # few requests again. Written, such a run takes a fraction of what listing ids one after the other would.
    return per_key.join(asked.hint("merge"), ["kid", "_tenth"]).where(F.col("rating") >= F.col("min_rating")).select(
        F.explode("ids").alias("request_id"), F.col("id").alias("listing_id"))


def _tenth(rating: str) -> Column:
    """Tenths of a star, 0 to 50; NaN, which is greater than every threshold, and more than 5 stars as 50."""
    r = F.col(rating)
    return F.when(F.isnan(r) | (r >= 5), F.lit(50)).otherwise(F.greatest(F.floor(r * 10), F.lit(0))).cast("int").alias("_tenth")


# ------------------------------------------------ single-predicate filters

def count_location_matches(listings: DataFrame, requests: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per valid request: listings whose location contains the query."""
    req = valid_requests(requests, params)
    by_loc = listings.groupBy("location").agg(F.count(F.lit(1)).alias("_n"))
    pairs = substring_pairs(req, "loc_q", by_loc, "location")
    per_q = pairs.join(by_loc, "location").groupBy("loc_q").agg(F.sum("_n").alias("_n"))
    return _per_request(req, per_q, ["loc_q"])


def count_budget_matches(listings: DataFrame, requests: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per valid request: listings in the requested band (NULL band never matches)."""
    req = valid_requests(requests, params)
    per_band = listings.groupBy(F.col("budget_band").alias("budget")).agg(F.count(F.lit(1)).alias("_n"))
    return _per_request(req, per_band, ["budget"])


def count_cuisine_matches(listings: DataFrame, requests: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per valid request: listings with a tag containing the query."""
    req = valid_requests(requests, params)
    arrays = listings.groupBy("cuisines").agg(F.count(F.lit(1)).alias("_n"))
    tags = arrays.select("cuisines", F.explode(F.array_distinct("cuisines")).alias("tag"))
    pairs = substring_pairs(req, "cui_q", tags, "tag")
    per_q = (
        pairs.join(tags, "tag").select("cui_q", "cuisines").distinct()
        .join(arrays, "cuisines").groupBy("cui_q").agg(F.sum("_n").alias("_n"))
    )
    return _per_request(req, per_q, ["cui_q"])


def count_rating_matches(listings: DataFrame, requests: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per valid request: listings rated at least ``min_rating``.

    Ratings and thresholds both lie in [0, 5], so each threshold is expanded
    to the (at most 51) tenth-of-a-star buckets at or above it and joined to
    the rating histogram by bucket equality: a bounded fan-out instead of a
    nested-loop range join.
    """
    req = valid_requests(requests, params)
    bucket = lambda c: F.floor(c * F.lit(10.0)).cast("int")
    hist = listings.groupBy("rating").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", bucket(F.col("rating")))
    th = req.select("min_rating").distinct().select(
        "min_rating", F.explode(F.sequence(bucket(F.col("min_rating")), F.lit(50))).alias("_b"))
    per_m = (
        th.join(hist, "_b").where(F.col("rating") >= F.col("min_rating"))
        .groupBy("min_rating").agg(F.sum("_n").alias("_n"))
    )
    return _per_request(req, per_m, ["min_rating"])


def _per_request(req: DataFrame, counts: DataFrame, on: list[str]) -> DataFrame:
    return req.select("request_id", *on).join(counts, on, "left").select(
        "request_id", F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("n_matches")
    )


def dedup_by_name_agg(df: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Same result as :func:`dedup_by_name`, as an aggregate: ``min_by`` over
    the quality key, so Spark combines partially before the shuffle."""
    group = list(group or [])
    cols = [c for c in df.columns]
    quality = F.struct(
        (-F.col("rating")).alias("r"),
        (-F.coalesce(F.col("votes"), F.lit(0))).alias("v"),
        F.lower(F.col("name")).alias("n"),
        F.col("id").alias("i"),
    )
    name_key = lower_strip(F.col("name"))
    best = (
        df.where(name_key != F.lit(""))
        .groupBy(*[F.col(g) for g in group], name_key.alias("_name_key"))
        .agg(F.min_by(F.struct(*[F.col(c) for c in cols]), quality).alias("_best"))
    )
    return best.select("_best.*")


def top_listings(listings: DataFrame, n: int) -> DataFrame:
    """Single-request form of the cap: the best ``n`` distinct-name listings
    overall (distributed partial top-n, then a final merge of n rows per task)."""
    lst = dedup_by_name(listing_columns(listings))
    top = lst.orderBy(*quality_order()).limit(n)
    w = Window.orderBy(*quality_order())  # n rows only: the limit is the feature
    return top.withColumn("pos", F.row_number().over(w))
