"""Queries on range lookups, as-of joins, name and substring indexes, medians and candidates, each over whole tables with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sorrel.operators import asof, candidates, intervals, medians, names, substrings
from sorrel.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


_BANDS_SQL = """WITH v AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders),
b AS (SELECT p_partkey AS band, CAST(p_size AS BIGINT) * 9000 AS low, CAST(p_size AS BIGINT) * 9000 + CAST(floor(p_retailprice) AS BIGINT) * 5 AS high, CAST(floor(p_retailprice * 100) AS BIGINT) AS cost FROM part),
u AS (SELECT DISTINCT v FROM v), best AS (SELECT v, min({'w': high - low, 'c': cost, 'k': band}) AS m FROM u JOIN b ON v BETWEEN low AND high GROUP BY v)
SELECT o_orderkey, m.k AS band, m.c AS band_cost FROM v LEFT JOIN best USING (v)"""


def _bands(spark, d):
    values = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").alias("v"))
    low = F.col("p_size").cast("long") * 9000
    bands = table(spark, d, "part").select(F.col("p_partkey").alias("band"), low.alias("low"), (low + F.floor("p_retailprice") * 5).alias("high"), F.floor(F.col("p_retailprice") * 100).alias("cost"))
    return values, bands


@_query(_BANDS_SQL)
def credit_bands(spark, d):
    """Each order's narrowest band of a long price list; the list's size decides how it is looked up."""
    values, bands = _bands(spark, d)
    return intervals.band_join(values, "v", bands).drop("v")


@_query(_BANDS_SQL)
def credit_bands_joined(spark, d):
    """The same by blocks of the line, as a list of any length is."""
    values, bands = _bands(spark, d)
    out = intervals.dyadic_band_join(values, "v", bands, intervals.Bands())
    return out.select("o_orderkey", F.col("band_found.band").alias("band"), F.col("band_found.cost").alias("band_cost"))


@_query("""WITH r AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + CAST(floor(l_quantity / 20) AS INTEGER) AS e FROM lineitem),
m AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT l_suppkey, min(s) AS start, max(e) AS "end", CAST(max(e) - min(s) + 1 AS BIGINT) AS days FROM g GROUP BY l_suppkey, run""")
def covered_days(spark, d):
    """The runs of days on which a supplier has something under way."""
    items = table(spark, d, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("s"), F.date_add(F.to_date("l_shipdate"), F.floor(F.col("l_quantity") / 20).cast("int")).alias("e"))
    return intervals.covered_days(items, ["l_suppkey"], "s", "e")


@_query("""WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase'), b AS (SELECT user_id, ts, max({'e': event_id, 'v': value}) AS m FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT a.event_id, a.user_id, epoch_us(a.ts) AS at_us, epoch_us(b.ts) AS version_us, b.m.e AS version, b.m.v AS version_value FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def state_at_action(spark, d):
    """Each action with the user's last purchase at or before it."""
    e = table(spark, d, "events")
    rows = e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    old = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("version"), F.col("value").alias("version_value"))
    out = asof.asof_join(rows, old, "user_id", "ts", ["version", "version_value"])
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.select("event_id", "user_id", us("ts").alias("at_us"), us("version_ts").alias("version_us"), "version", "version_value")


_PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '\\([^)]*\\)', ' ', 'g'), '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@_query(f"""WITH t AS (SELECT DISTINCT {_PLAIN.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS left_plain FROM pages),
l AS (SELECT DISTINCT {_PLAIN.format("x")} AS right_plain FROM (SELECT unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS x FROM pages))
SELECT left_plain, right_plain FROM t JOIN l ON left_plain <> '' AND right_plain <> '' AND (left_plain = right_plain OR (length(right_plain) >= 4 AND starts_with(left_plain, right_plain || ' ')) OR (length(left_plain) >= 4 AND starts_with(right_plain, left_plain || ' ')))""")
def titles_by_name(spark, d):
    """Page titles and link names that match, whole or by a prefix of words."""
    p = table(spark, d, "pages")
    titles = p.select(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    links = p.select(F.explode(F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), 1)).alias("name"))
    return names.name_matches(titles, "title", links, "name")


@_query("""WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(regexp_extract(text, '^(\\S+\\s+\\S+\\s+\\S+)', 1)), '\\s+'), lambda w: w <> '')) AS words FROM benchmark),
d AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)
SELECT item_id, count(*) AS texts, min(doc_id) AS first_text, max(doc_id) AS last_text FROM q JOIN d ON len(words) > 0 AND len(list_filter(words, lambda w: contains(low, w))) = len(words) GROUP BY item_id""")
def texts_with_words(spark, d):
    """For each benchmark item, the documents that contain all of its first three words, in whatever place."""
    q = table(spark, d, "benchmark").select("item_id", F.regexp_extract("text", r"^(\S+\s+\S+\s+\S+)", 1).alias("q"))
    found = substrings.substring_search(table(spark, d, "documents"), "doc_id", "text", q, "item_id", "q")
    return found.groupBy("item_id").agg(F.count("*").alias("texts"), F.min("doc_id").alias("first_text"), F.max("doc_id").alias("last_text"))


@_query("""WITH m AS (SELECT l_returnflag || l_linestatus AS kind, count(*) AS n, median(l_extendedprice) AS median FROM lineitem GROUP BY 1)
SELECT kind, n, median, CAST(sum(CASE WHEN median > 0 AND (l_extendedprice > 2 * median OR l_extendedprice < median / 2) THEN 1 ELSE 0 END) AS BIGINT) AS outliers FROM m JOIN lineitem ON l_returnflag || l_linestatus = kind GROUP BY ALL""")
def median_prices(spark, d):
    """The exact median price of a few very large groups, and how many prices are over twice or under half of it."""
    items = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("kind"), "l_extendedprice")
    mid = medians.exact_medians(items, "kind", "l_extendedprice")
    price, m = F.col("l_extendedprice"), F.col("median")
    return items.join(mid, "kind").groupBy("kind", "n", "median").agg(F.count_if((m > 0) & ((price > 2 * m) | (price < m / 2))).alias("outliers"))


@_query("""WITH r AS (SELECT p_partkey, CASE WHEN p_type <> 'ECONOMY' THEN p_type END AS kind, p_brand AS brand, CASE WHEN p_size <= 40 THEN p_size END AS size, CASE WHEN p_retailprice >= 950 THEN p_name END AS identity FROM part),
j AS (SELECT r.p_partkey, c.p_partkey AS hit, r.identity IS NOT NULL AND c.identity IS NOT NULL AND r.identity <> c.identity AS conflict FROM r JOIN r AS c ON (r.kind IS NULL OR r.kind = c.kind) AND r.brand = c.brand AND (r.size IS NULL OR r.size = c.size)),
n AS (SELECT p_partkey, count(*) AS blocked, count_if(NOT conflict) AS candidates, min(CASE WHEN NOT conflict THEN hit END) AS least FROM j GROUP BY 1)
SELECT p_partkey, concat_ws('|', CASE WHEN kind IS NOT NULL THEN 'kind' END, 'brand', CASE WHEN size IS NOT NULL THEN 'size' END) AS stated, CAST(coalesce(blocked, 0) AS BIGINT) AS blocked, CAST(coalesce(candidates, 0) AS BIGINT) AS candidates, CAST(coalesce(blocked - candidates, 0) AS BIGINT) AS conflicting,
 CASE WHEN candidates = 1 THEN least END AS "match", CASE WHEN candidates = 1 THEN 'MATCH' WHEN candidates > 1 THEN 'AMBIGUOUS' ELSE 'NO_MATCH' END AS outcome FROM r LEFT JOIN n USING (p_partkey)""")
def part_candidates(spark, d):
    """Parts that could be a stated part, without those whose name contradicts; types and sizes are stated by some only."""
    r = table(spark, d, "part").select("p_partkey", F.when(F.col("p_type") != "ECONOMY", F.col("p_type")).alias("kind"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") <= 40, F.col("p_size")).alias("size"), F.when(F.col("p_retailprice") >= 950, F.col("p_name")).alias("identity"))
    return candidates.candidate_counts(r, "p_partkey", r, "p_partkey", ["kind", "brand", "size"], "identity").withColumn("stated", F.array_join("stated", "|"))
