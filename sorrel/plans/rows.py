"""Queries on nested catalog rows, written as JSON from whole tables and mapped back, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sorrel.operators import bundle
from sorrel.sources.tables import table
from sorrel.sources.work import written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


_FORMATS = {"1-URGENT": "weekly", "2-HIGH": "single_day", "3-MEDIUM": "fortnight", "4-NOT SPECIFIED": "unknown"}


def nested(spark, d):
    """Customers as programs, their nations as providers, their orders as sessions, regions as the sessions' venues."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    o = table(spark, d, "orders")
    day = lambda c: F.date_format(c, "yyyy-MM-dd'T'00:00:00")
    price, kind, bal = F.col("o_totalprice"), F.col("o_orderpriority"), F.col("c_acctbal")
    yes = F.lit("published")
    formats = F.try_element_at(F.create_map(*[F.lit(x) for kv in _FORMATS.items() for x in kv]), kind)
    venue = F.struct(F.concat(F.lit("v"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(" ").alias("neighbourhood"), F.array(F.struct(F.lower("r_name").alias("city_town"))).alias("cities"), F.col("r_regionkey").cast("string").alias("latitude"), yes.alias("publication_state"), F.when(F.col("r_name") != "ASIA", "1998").otherwise("").alias("published_at"))
    spots = F.array(F.struct(F.when(kind == "5-LOW", "soon").otherwise("available").alias("state"), F.lit("1998-01-01").alias("checked_at"), F.when(price > 100_000, (price / 1000).cast("string")).otherwise(F.floor(price / 1000).cast("string")).alias("spots_left")))
    session = F.struct(
        F.concat(F.lit("o"), "o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "draft").otherwise("published").alias("publication_state"), F.lit("1998").alias("published_at"), venue.alias("venues"), day("o_orderdate").alias("start_date"),
        F.when(price < 250_000, day("o_orderdate")).otherwise("later").alias("end_date"), formats.alias("schedule_format"), F.when(price < 400_000, F.round(price, 2).cast("string")).otherwise("ask").alias("price_amount"),
        F.when(F.col("o_orderstatus") == "O", "per_week").otherwise("per_fortnight").alias("price_unit"), F.lit("CAD").alias("currency"), (bal > 0).alias("provider_confirmed"), F.when(price > 50_000, "1998-02-03 04:05").alias("source_checked_date"), spots.alias("camp_session_spots"),
    )
    rows = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(o, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.groupBy("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "n_nationkey", "n_name").agg(F.collect_list(session).alias("camp_sessions"))  # a customer's orders
    provider = F.struct(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), yes.alias("publication_state"), F.lit("1998").alias("published_at"))
    program = F.struct(
        F.concat(F.lit("c"), "c_custkey").alias("id"), F.lower("c_name").alias("slug"), F.when(bal < 9500, F.col("c_name")).otherwise(" ").alias("name"), F.lower("c_mktsegment").alias("primary_category"),
        F.when(bal < 0, F.lit("draft")).otherwise(yes).alias("publication_state"), F.lit("1998").alias("published_at"), provider.alias("providers"), "camp_sessions",
    )
    return written(bundle.nested_programs(rows.select("c_custkey", F.to_json(program).alias("raw")), "raw", "c_custkey"), "nested")


_BASE = """WITH s AS (SELECT o.*, c.*, n_name, n_nationkey, r_name, r_regionkey, CASE WHEN r_name <> 'ASIA' THEN 'v' || r_regionkey END AS venue, CASE o_orderpriority WHEN '1-URGENT' THEN 'weekly' WHEN '2-HIGH' THEN 'single_day' WHEN '3-MEDIUM' THEN 'unknown' WHEN '4-NOT SPECIFIED' THEN 'unknown' END AS format,
 strftime(o_orderdate, '%Y-%m-%d') AS start, CASE WHEN o_totalprice < 250000 THEN strftime(o_orderdate, '%Y-%m-%d') END AS stop, CASE WHEN o_totalprice < 400000 THEN round(o_totalprice, 2) END AS price, CASE WHEN o_orderstatus = 'O' THEN 'per_week' ELSE 'unknown' END AS unit
 FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus <> 'P' AND c_acctbal >= 0 AND c_acctbal < 9500)"""


@_query(_BASE + """ SELECT 'c' || c_custkey AS program_id, 'o' || o_orderkey AS id, venue AS venue_id, start AS start_date, stop AS end_date, format AS schedule_format, price AS price_amount, unit AS price_unit, 'availability_unknown' AS registration_status,
 CASE WHEN o_orderpriority <> '5-LOW' AND (o_totalprice <= 100000 OR o_totalprice / 1000 = floor(o_totalprice / 1000)) THEN CAST(floor(o_totalprice / 1000) AS BIGINT) END AS spots_left FROM s""")
def mapped_sessions(spark, d):
    """Sessions of nested rows with their coerced values; drafts at either level are gone."""
    s = bundle.sessions_of(nested(spark, d))
    return s.select("program_id", "id", "venue_id", "start_date", "end_date", "schedule_format", "price_amount", "price_unit", "registration_status", "spot_check.spots_left")


@_query(_BASE + """, v AS (SELECT DISTINCT venue AS id, r_name AS name, lower(r_name) AS city, CAST(r_regionkey AS DOUBLE) AS latitude FROM s WHERE venue IS NOT NULL), p AS (SELECT DISTINCT 'n' || n_nationkey AS id, n_name AS name, NULL AS city, NULL AS latitude FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0 AND c_acctbal < 9500 AND c_custkey IN (SELECT o_custkey FROM orders))
SELECT 'venue' AS kind, id, name, city, latitude FROM v UNION ALL SELECT 'provider', id, name, city, latitude FROM p""")
def mapped_places(spark, d):
    """Venues and providers of nested rows, each once."""
    rows = nested(spark, d)
    v = bundle.venues_of(rows).select(F.lit("venue").alias("kind"), "id", "name", "city", "latitude")
    return v.unionByName(bundle.providers_of(rows).select(F.lit("provider").alias("kind"), "id", "name", F.lit(None).cast("string").alias("city"), F.lit(None).cast("double").alias("latitude")))


@_query(_BASE + """ SELECT 'o' || o_orderkey AS id, 'camps' AS category, c_name AS title, n_name AS provider_name, CASE WHEN venue IS NOT NULL THEN lower(r_name) END AS area, CASE WHEN format = 'single_day' THEN TRUE WHEN format = 'weekly' THEN coalesce(start = stop, FALSE) END AS single_day, CASE WHEN o_totalprice > 50000 THEN CASE WHEN c_acctbal > 0 THEN 'provider_confirmed' ELSE 'source_checked' END ELSE 'unverified' END AS verification, CASE WHEN o_totalprice > 50000 THEN '1998-02-03' END AS last_verified_on, price AS price_amount FROM s
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'play', CASE WHEN s_acctbal > 5000 THEN s_name || ', ' || n_name ELSE s_name END, NULL, CASE WHEN s_acctbal > 0 THEN n_name || ', ' || r_name ELSE r_name END, NULL, 'source_checked', '1998-01-01', NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def all_listings(spark, d):
    """Sessions and places to play in one shape."""
    camps = bundle.camp_listings(nested(spark, d))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s, bal = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")), F.col("s_acctbal")
    null = F.lit(None)
    places = s.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(bal > 5000, F.col("n_name")).alias("branch_name"), F.when(bal > 0, F.col("n_name")).alias("neighbourhood"), F.col("r_name").alias("city"), null.cast("string").alias("place_type"),
        null.cast("long").alias("age_min"), null.cast("long").alias("age_max"), null.cast("boolean").alias("age_min_inclusive"), null.cast("boolean").alias("age_max_inclusive"), F.lit("1998-01-01").alias("source_checked_date"),
    )
    types = s.select(F.col("s_suppkey").alias("id"), F.col("r_name").alias("place_type"), (bal > 0).alias("is_primary"))
    both = camps.unionByName(bundle.venue_listings(places, types))
    return both.select("id", "category", "title", "provider_name", "area", "single_day", "verification", "last_verified_on", "price_amount")


@_query(_BASE + " SELECT 'c' || c_custkey AS program_id, CASE WHEN count(price) < count(*) OR bool_or(unit = 'unknown') THEN 'unknown' ELSE 'comparable' END AS note FROM s GROUP BY 1")
def price_notes(spark, d):
    """Whether the prices of a program's sessions may be compared."""
    return bundle.price_notes(bundle.sessions_of(nested(spark, d)), "program_id")
