"""Named queries over the driver's tables, each with the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sorrel.functions import ages, dates, logic, money, text
from sorrel.operators import changes, intervals, joins, search, summaries
from sorrel.plans import catalog, checks, flows, ingest, lookups, pagefacts, places, rows, states
from sorrel.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return _QUERIES | places.QUERIES | catalog.QUERIES | ingest.QUERIES | checks.QUERIES | flows.QUERIES | lookups.QUERIES | pagefacts.QUERIES | rows.QUERIES | states.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | places.SQL | catalog.SQL | ingest.SQL | checks.SQL | flows.SQL | lookups.SQL | pagefacts.SQL | rows.SQL | states.SQL


def _cents(c: str) -> str:
    return f"CAST(floor({c} * 100 + 0.5) AS BIGINT)"


@_query(f"""
WITH s AS (SELECT l_orderkey, {_cents('l_extendedprice')} AS cents, CAST(l_shipdate AS DATE) AS d, l_returnflag FROM lineitem
  WHERE l_quantity BETWEEN 5 AND 40 AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_returnflag IN ('N', 'R')),
m AS (SELECT o_orderkey, o_custkey, c_mktsegment, n_name, cents, d FROM s JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderstatus IN ('O', 'F') AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')),
g AS (SELECT o_orderkey, o_custkey, c_mktsegment, n_name, count(*) AS sessions, min(cents) AS min_cents, max(cents) AS max_cents, min(d) AS first_day, max(d) AS last_day FROM m GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY min_cents, first_day, o_orderkey) AS rank FROM g
""")
def listing_search(spark, d):
    """Sessions that pass all conditions on one row, grouped by program, ranked within the provider."""
    sessions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag")
    programs = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    providers = table(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE")).join(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "n_name")
    when = F.col("l_shipdate")
    f = search.Filters([F.col("o_orderstatus").isin("O", "F")], [F.col("l_quantity").between(5, 40), when >= F.lit("1995-01-01").cast("timestamp"), when < F.lit("1998-01-01").cast("timestamp"), F.col("l_returnflag").isin("N", "R")])
    m = search.matching_sessions(programs, providers, sessions, f, "o_orderkey", "o_custkey").select("o_orderkey", "o_custkey", "c_mktsegment", "n_name", money.cents(F.col("l_extendedprice")).alias("cents"), F.to_date("l_shipdate").alias("d"))
    g = m.groupBy("o_orderkey", "o_custkey", "c_mktsegment", "n_name").agg(F.count("*").alias("sessions"), F.min("cents").alias("min_cents"), F.max("cents").alias("max_cents"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))
    return search.ranked(g, ["o_custkey"], [F.col("min_cents"), F.col("first_day"), F.col("o_orderkey")])


@_query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01')")
def awaiting_parents(spark, d):
    """Programs without any session."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return search.programs_without_sessions(c, table(spark, d, "orders").where("o_orderdate >= TIMESTAMP '1998-01-01'").select(F.col("o_custkey").alias("c_custkey")), search.Filters([F.col("c_acctbal") > 0]), "c_custkey").select("c_custkey", "c_name")


@_query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def visible_children(spark, d):
    """Children of parents that pass a gate."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return search.visible_children(o, table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_orderkey", F.col("o_orderstatus") == "F")


@_query(f"""SELECT l_orderkey, min(c) AS min_cents, max(c) AS max_cents, CASE WHEN min(c) IS NULL THEN 'none' WHEN count(DISTINCT CASE WHEN c IS NOT NULL THEN u END) > 1 THEN 'mixed' WHEN min(c) = max(c) THEN 'single' ELSE 'range' END AS price_kind,
  count(DISTINCT l_returnflag) AS states, count(*) FILTER (l_returnflag = 'N') AS open_sessions, count(*) AS sessions
FROM (SELECT l_orderkey, l_returnflag, l_linestatus AS u, CASE WHEN l_tax < 0.07 THEN {_cents('l_extendedprice')} END AS c FROM lineitem) GROUP BY l_orderkey""")
def price_summary(spark, d):
    """Prices and states of each program's sessions in one pass; unknown prices take no part."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_linestatus").alias("u"), F.when(F.col("l_tax") < 0.07, money.cents(F.col("l_extendedprice"))).alias("c"))
    return li.groupBy("l_orderkey").agg(*summaries.price_summary("c", "u"), *summaries.status_summary("l_returnflag", "N"))


@_query(f"""SELECT s_suppkey, s_name, n_name, count(DISTINCT l_orderkey) AS programs, count(*) AS sessions, CAST(sum({_cents('l_extendedprice')}) AS BIGINT) AS cents,
  array_to_string(list_sort(list(DISTINCT l_returnflag))[1:4], '|') AS flags
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def provider_groups(spark, d):
    """Programs and sessions by provider."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_returnflag", money.cents(F.col("l_extendedprice")).alias("cents"))
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_suppkey", "s_name", "n_name").agg(F.count_distinct("l_orderkey").alias("programs"), F.count("*").alias("sessions"), F.sum("cents").alias("cents"), summaries.distinct_labels("l_returnflag").alias("flags"))


@_query("SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders QUALIFY rank <= 2")
def soonest_per_parent(spark, d):
    """The two soonest of each parent."""
    return search.ranked(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 2)


@_query("""SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS rows FROM part GROUP BY p_brand UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type
UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY p_size""")
def facet_values(spark, d):
    """Values and counts of several facets from one scan."""
    return search.facet_counts(table(spark, d, "part"), ["p_brand", "p_type", "p_size"])


@_query("""SELECT p_partkey, p_name, CAST(CASE WHEN lower(trim(p_name)) = 'red' THEN 0 WHEN starts_with(lower(trim(p_name)), 'red') THEN 1 WHEN contains(lower(trim(p_name)), ' red') THEN 2 WHEN contains(lower(trim(p_name)), 'red') THEN 3 END AS INT) AS tier
FROM part WHERE contains(lower(trim(p_name)), 'red') ORDER BY tier, length(p_name), p_name, p_partkey LIMIT 12""")
def ranked_search(spark, d):
    """The best twelve hits of a text search (the limit is the feature)."""
    return search.prefix_search(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "Red", 12, "p_partkey")


_BANDS = [("small", 1, 15, 900), ("medium", 10, 30, 1500), ("large", 25, 50, 2500), ("exact", 20, 20, 700), ("any", 1, 60, 3000)]
_BAND_SQL = "(VALUES " + ", ".join(f"('{k}', {a}, {b}, {c})" for k, a, b, c in _BANDS) + ") AS b(band, low, high, cost)"


@_query(f"""SELECT p_partkey, p_size, band, CAST(cost AS INT) AS band_cost FROM part JOIN {_BAND_SQL} ON p_size BETWEEN low AND high QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY high - low, cost, band) = 1""")
def price_band_join(spark, d):
    """The narrowest band that holds a value, ties to the cheaper."""
    bands = spark.createDataFrame(_BANDS, "band string, low int, high int, cost int")
    return intervals.band_join(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", bands).where("band IS NOT NULL")


@_query("""SELECT o_orderkey, l_linenumber, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INT) AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE CAST(o_orderdate AS DATE) <= CAST(l_shipdate AS DATE) + 30 AND CAST(o_orderdate AS DATE) + 60 >= CAST(l_shipdate AS DATE)""")
def overlap_join(spark, d):
    """Keyed interval overlap."""
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("o_from"), F.date_add(F.to_date("o_orderdate"), 60).alias("o_to"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.to_date("l_shipdate").alias("l_from"), F.date_add(F.to_date("l_shipdate"), 30).alias("l_to"))
    return joins.overlap_join(o, li, ["o_orderkey"], ("o_from", "o_to"), ("l_from", "l_to")).select("o_orderkey", "l_linenumber", F.datediff("l_from", "o_from").alias("days"))


@_query("""SELECT a.p_partkey AS l_part, b.p_partkey AS r_part FROM (SELECT * FROM part WHERE p_brand = 'Brand#11') a JOIN (SELECT * FROM part WHERE p_brand = 'Brand#22') b
ON a.p_partkey - a.p_size <= b.p_partkey + b.p_size AND a.p_partkey + a.p_size >= b.p_partkey - b.p_size""")
def binned_overlap(spark, d):
    """Interval overlap without a key, by bins."""
    def ranges(brand, p):
        return table(spark, d, "part").where(F.col("p_brand") == brand).select(F.col("p_partkey").alias(f"{p}_part"), (F.col("p_partkey") - F.col("p_size")).alias(f"{p}_lo"), (F.col("p_partkey") + F.col("p_size")).alias(f"{p}_hi"))
    return joins.binned_overlap_join(ranges("Brand#11", "l"), ranges("Brand#22", "r"), ("l_lo", "l_hi"), ("r_lo", "r_hi"), 128).select("l_part", "r_part")


@_query(f"""SELECT o_custkey, {', '.join(f"CAST(sum(CASE WHEN dayofweek(o_orderdate) = {k} THEN {_cents('o_totalprice')} END) AS BIGINT) AS day_{k}" for k in range(7))} FROM orders GROUP BY o_custkey""")
def day_price_pivot(spark, d):
    """Sums by weekday as columns."""
    days = [str(k) for k in range(7)]
    o = table(spark, d, "orders").select("o_custkey", (F.dayofweek("o_orderdate") - 1).cast("string").alias("dow"), money.cents(F.col("o_totalprice")).alias("cents"))
    p = summaries.pivot_sums(o, ["o_custkey"], "dow", days, "cents")
    return p.select("o_custkey", *[F.col(f"`{k}`").alias(f"day_{k}") for k in days])


@_query(f"""WITH v AS (SELECT p_type, {_cents('p_retailprice')} AS cents FROM part), m AS (SELECT p_type, median(cents) AS median FROM v GROUP BY p_type)
SELECT p_type, any_value(median) AS median, count(*) FILTER (cents > 1.2 * median OR cents * 1.2 < median) AS outliers, count(*) AS rows FROM v JOIN m USING (p_type) GROUP BY p_type""")
def median_outliers(spark, d):
    """Exact medians and the values far from them."""
    return summaries.median_outliers(table(spark, d, "part").select("p_type", money.cents(F.col("p_retailprice")).cast("double").alias("cents")), "p_type", "cents", 1.2)


@_query("""SELECT p_brand, field, kinds FROM (SELECT p_brand, 'p_type' AS field, count(DISTINCT p_type) AS kinds FROM part GROUP BY p_brand UNION ALL SELECT p_brand, 'p_size', count(DISTINCT p_size) FROM part GROUP BY p_brand) WHERE kinds > 1""")
def disagreeing_values(spark, d):
    """Fields with more than one value within a group."""
    return summaries.disagreeing(table(spark, d, "part"), ["p_brand"], ["p_type", "p_size"])


@_query("""WITH a(age) AS (VALUES (3), (6), (12), (NULL)), t AS (SELECT p_partkey, age, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size % 9 END AS lo, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 9 + 5 END AS hi FROM part, a)
SELECT p_partkey, CAST(age AS INT) AS age, CASE WHEN age IS NULL OR (lo IS NULL AND hi IS NULL) OR lo > hi THEN 'unknown' WHEN age < lo OR age > hi THEN 'no' ELSE 'yes' END AS fit FROM t""")
def sibling_matrix(spark, d):
    """Each child's three-valued fit with each band."""
    size = F.col("p_size")
    lo, hi = F.when(size % 10 == 0, None).otherwise(size % 9), F.when(size % 7 == 0, None).otherwise(size % 9 + 5)
    kids = F.explode(F.array(F.lit(3), F.lit(6), F.lit(12), F.lit(None).cast("int")))
    t = table(spark, d, "part").select("p_partkey", lo.alias("lo"), hi.alias("hi"), kids.alias("age"))
    return t.select("p_partkey", "age", ages.age_fits(F.col("age"), F.col("lo"), F.col("hi")).alias("fit"))


@_query("""SELECT user_id, CASE WHEN bool_or(value < 1) THEN 'no' WHEN bool_or(event_type = 'error') THEN 'unknown' ELSE 'yes' END AS verdict FROM events GROUP BY user_id""")
def kleene_all(spark, d):
    """Three-valued AND per user: any no wins, then any unknown."""
    v = F.when(F.col("value") < 1, 0).when(F.col("event_type") == "error", 1).otherwise(2)
    return table(spark, d, "events").groupBy("user_id").agg(F.min(v).alias("least")).select("user_id", F.when(F.col("least") == 0, "no").when(F.col("least") == 1, "unknown").otherwise("yes").alias("verdict"))


@_query(r"""WITH h AS (SELECT doc_id, source, sha256(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g')) AS digest FROM documents)
SELECT digest, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS copies FROM h GROUP BY digest""")
def content_hash_dedupe(spark, d):
    """The first document of each normalised content."""
    return changes.keep_first_by_hash(table(spark, d, "documents").select("doc_id", "source", "text"), text.content_hash(F.col("text")), "doc_id", ["source"])


_HEX = "CAST(('0x' || substr(h, {0}, 8)) AS BIGINT)"


@_query("""WITH r AS (SELECT l_orderkey, sha256(CAST(l_partkey AS VARCHAR) || chr(31) || CAST(l_suppkey AS VARCHAR) || chr(31) || l_returnflag) AS h FROM lineitem)
SELECT l_orderkey, count(*) AS records, """ + " || '-' || ".join(f"CAST(CAST(sum({_HEX.format(1 + 8 * i)}) AS HUGEINT) % 4294967296 AS VARCHAR)" for i in range(4)) + " AS fingerprint FROM r GROUP BY l_orderkey")
def set_fingerprint(spark, d):
    """An order-independent digest of each group's records."""
    return summaries.set_fingerprint(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"), "l_orderkey", ["l_partkey", "l_suppkey", "l_returnflag"])


def _snapshots(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    old = o.where("o_orderkey % 7 <> 0")
    new = o.where("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.col("o_orderpriority")))
    return old, new


_OLD_NEW = """WITH old AS (SELECT * FROM orders WHERE o_orderkey % 7 <> 0), new AS (SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority) FROM orders WHERE o_orderkey % 5 <> 0)"""


@_query(_OLD_NEW + """, j AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, o.o_orderkey AS ok, n.o_orderkey AS nk,
 concat_ws(',', CASE WHEN o.o_orderstatus IS DISTINCT FROM n.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN o.o_orderpriority IS DISTINCT FROM n.o_orderpriority THEN 'o_orderpriority' END, CASE WHEN o.o_custkey IS DISTINCT FROM n.o_custkey THEN 'o_custkey' END) AS c
 FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey)
SELECT o_orderkey, CASE WHEN ok IS NULL THEN 'added' WHEN nk IS NULL THEN 'removed' WHEN c <> '' THEN 'changed' ELSE 'same' END AS change, CASE WHEN ok IS NOT NULL AND nk IS NOT NULL THEN c ELSE '' END AS changed FROM j""")
def snapshot_diff(spark, d):
    """Added, removed, changed and same keys of two snapshots."""
    return changes.snapshot_diff(*_snapshots(spark, d), "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_custkey"])


@_query(_OLD_NEW + """, u AS (SELECT o.o_orderkey, 'o_orderstatus' AS field, o.o_orderstatus AS old_value, n.o_orderstatus AS new_value FROM old o JOIN new n USING (o_orderkey)
 UNION ALL SELECT o.o_orderkey, 'o_orderpriority', o.o_orderpriority, n.o_orderpriority FROM old o JOIN new n USING (o_orderkey))
SELECT *, CASE WHEN old_value IS NULL THEN 'filled' WHEN new_value IS NULL THEN 'cleared' ELSE 'replaced' END AS change FROM u WHERE old_value IS DISTINCT FROM new_value""")
def field_changes(spark, d):
    """Old and new value of each field that differs."""
    return changes.field_changes(*_snapshots(spark, d), "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@_query("""WITH c AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer), n1 AS (SELECT c_nationkey AS k, count(*) AS n, min(CAST(c_custkey AS VARCHAR)) AS e FROM c WHERE c_mktsegment = 'MACHINERY' GROUP BY 1), n0 AS (SELECT regexp_replace(c_name, '[^0-9]', '', 'g') AS k, count(*) AS n, min(CAST(c_custkey AS VARCHAR)) AS e FROM c GROUP BY 1)
SELECT s_suppkey, CASE WHEN n0.n IS NOT NULL THEN 'number' WHEN n1.n IS NOT NULL THEN 'nation' ELSE 'none' END AS rule, CASE WHEN n0.n IS NOT NULL THEN 0.96 WHEN n1.n IS NOT NULL THEN 0.75 ELSE 0.0 END::DOUBLE AS confidence,
 coalesce(n0.n, n1.n, 0) AS candidates, CASE WHEN n0.n IS NOT NULL THEN CASE WHEN n0.n = 1 THEN n0.e END WHEN n1.n = 1 THEN n1.e END AS match_id
FROM supplier LEFT JOIN n0 ON CASE WHEN s_suppkey % 3 = 0 THEN regexp_replace(s_name, '[^0-9]', '', 'g') END = n0.k LEFT JOIN n1 ON s_nationkey = n1.k""")
def entity_match(spark, d):
    """The first rule with a candidate decides; several candidates are ambiguous."""
    def digits(c):
        return F.regexp_replace(c, "[^0-9]", "")
    rules = [("number", 0.96, F.when(F.col("s_suppkey") % 3 == 0, digits("s_name")), digits("c_name")), ("nation", 0.75, F.col("s_nationkey").cast("string"), F.when(F.col("c_mktsegment") == "MACHINERY", F.col("c_nationkey").cast("string")))]
    return changes.match_entities(table(spark, d, "supplier"), table(spark, d, "customer"), "s_suppkey", "c_custkey", rules)


@_query(r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, len(regexp_extract_all(html, '(?i)<a [^>]*href=["'']([^"'']*)["'']', 1)) AS links, len(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)) AS headings FROM pages""")
def page_facts(spark, d):
    """Title, links and headings of pages."""
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", text.html_title(h).alias("title"), F.size(text.html_links(h)).cast("long").alias("links"), F.size(text.headings(h)).cast("long").alias("headings"))


@_query(r"""SELECT page_id, split_part(link, '/', 2) AS section, count(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a [^>]*href=["'']([^"'']*)["'']', 1)) AS link FROM pages) WHERE link LIKE '/%' GROUP BY ALL""")
def page_links(spark, d):
    """Link counts by page and section."""
    links = table(spark, d, "pages").select("page_id", F.explode(text.html_links(F.col("html"))).alias("link")).where("link LIKE '/%'")
    return links.groupBy("page_id", F.split_part("link", F.lit("/"), F.lit(2)).alias("section")).agg(F.count("*").alias("links"))


@_query()
def html_text(spark, d):
    """The visible text of pages (entity and tag rules are tested against a plain version)."""
    return table(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("body"))


@_query(rf"""WITH p AS (SELECT page_id, lower(regexp_extract(trim(url), '^(https?)://', 1, 'i')) AS scheme, lower(regexp_extract(trim(url), '^https?://([^/?#]+)', 1, 'i')) AS host, regexp_extract(trim(url), '^https?://[^/?#]+([^?#]*)', 1, 'i') AS path,
  list_sort(list_transform(list_filter(string_split(regexp_extract(trim(url), '\?([^#]*)', 1), '&'), lambda x: x <> '' AND (lower(split_part(x, '=', 1)) IN {text.IDENTITY} OR NOT (lower(split_part(x, '=', 1)) IN {text.TRACKING} OR regexp_matches(lower(x), '^(utm_|hsa_|pk_|piwik_|matomo_)')))), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)) AS q FROM pages),
c AS (SELECT page_id, scheme, CASE WHEN scheme = 'http' THEN regexp_replace(host, ':80$', '') ELSE regexp_replace(host, ':443$', '') END AS host, regexp_replace(regexp_replace(path, '/+', '/', 'g'), '(.)/$', '\1') AS path, q FROM p)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM c WHERE host <> ''""")
def url_canonical(spark, d):
    """One form of each web page's address."""
    return table(spark, d, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical")).where("canonical LIKE 'http%'")


@_query(r"""SELECT doc_id, regexp_extract(text, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS first_date, len(regexp_extract_all(text, '\$\s?[0-9][0-9,]*')) AS prices FROM documents""")
def free_text_facts(spark, d):
    """Dates and prices in free text."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.regexp_extract(t, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).alias("first_date"), F.size(F.regexp_extract_all(t, F.lit(r"\$\s?[0-9][0-9,]*"), 0)).cast("long").alias("prices"))


@_query("""SELECT user_id, last_ts, CAST(floor((epoch(n) - epoch(last_ts)) / 3600) AS BIGINT) AS hours, CASE WHEN epoch(n) - epoch(last_ts) <= 86400 THEN 'Fresh' WHEN epoch(n) - epoch(last_ts) <= 259200 THEN 'Recently checked' ELSE 'Stale' END AS tier
FROM (SELECT user_id, date_trunc('second', max(ts)) AS last_ts FROM events GROUP BY user_id), (SELECT date_trunc('second', max(ts)) AS n FROM events)""")
def freshness_tiers(spark, d):
    """How fresh each source's last event is, against the newest."""
    e = table(spark, d, "events").select("user_id", F.date_trunc("second", "ts").alias("ts"))
    now = F.lit(e.agg(F.max("ts").alias("now")).first()["now"])  # one instant
    hours = dates.hours_since(F.col("last_ts"), now)
    return e.groupBy("user_id").agg(F.max("ts").alias("last_ts")).select("user_id", "last_ts", F.floor(hours).cast("long").alias("hours"), dates.freshness(hours).alias("tier"))


@_query("""SELECT c_custkey, next_at, row_number() OVER (ORDER BY next_at NULLS FIRST, c_custkey) AS place FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE max(o_orderdate) END AS next_at FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY c_custkey)
WHERE next_at IS NULL OR next_at <= TIMESTAMP '1998-01-01' ORDER BY place LIMIT 50""")
def due_sources(spark, d):
    """The fifty sources due first, never checked ones before others (the limit is the feature)."""
    c = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("m"))
    due = c.join(n, "c_custkey", "left").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, None).otherwise(F.col("m")).alias("next_at")).where("next_at IS NULL OR next_at <= TIMESTAMP '1998-01-01'")
    top = due.orderBy(F.col("next_at").asc_nulls_first(), "c_custkey").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("next_at").asc_nulls_first(), "c_custkey")))


@_query("SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_per_key(spark, d):
    """Each key's last snapshot in one pass."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return joins.latest_per_key(e, "user_id", "ts", ["event_id", "event_type"]).select("user_id", "ts", "event_type", "event_id")


@_query("""WITH g AS (SELECT *, max(CASE WHEN event_type <> 'error' THEN event_id END) OVER (PARTITION BY user_id) AS good FROM events)
SELECT user_id, count(*) FILTER (event_type = 'error' AND (good IS NULL OR event_id > good)) AS failures FROM g GROUP BY user_id""")
def consecutive_failures(spark, d):
    """Failures since each source's last success."""
    return joins.consecutive_failures(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", F.col("event_id"), F.col("event_type") == "error")


@_query("SELECT event_type, CAST(ts AS DATE) AS day, event_id, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS place FROM events QUALIFY place <= 3")
def daily_cap(spark, d):
    """The first three of each kind and day (the cap is the feature)."""
    e = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), "event_id", "ts")
    return search.ranked(e, ["event_type", "day"], [F.col("ts"), F.col("event_id")], 3, "place").drop("ts")


@_query("""SELECT CAST(timezone('America/Toronto', timezone('UTC', ts)) AS DATE) AS local_day, event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY ALL""")
def local_day_rollup(spark, d):
    """Counts by the local calendar day."""
    return table(spark, d, "events").groupBy(dates.local_day(F.col("ts")).alias("local_day"), "event_type").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))


@_query("""SELECT day, count(*) AS open_orders FROM (SELECT unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 2, INTERVAL 1 DAY))::DATE AS day FROM orders) GROUP BY day""")
def calendar_expand(spark, d):
    """Spans as days."""
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(F.explode(F.sequence(day, F.date_add(day, 2))).alias("day")).groupBy("day").agg(F.count("*").alias("open_orders"))


@_query(f"""WITH t AS (SELECT l_orderkey, CAST(l_quantity AS INT) AS q FROM lineitem), b AS (SELECT l_orderkey, q, cost FROM t JOIN {_BAND_SQL} ON q BETWEEN low AND high QUALIFY row_number() OVER (PARTITION BY l_orderkey, q ORDER BY high - low, cost, band) = 1),
f AS (SELECT t.l_orderkey, CAST(sum(b.cost) AS BIGINT) AS tickets, count(*) AS children FROM t JOIN (SELECT DISTINCT * FROM b) b ON t.l_orderkey = b.l_orderkey AND t.q = b.q GROUP BY t.l_orderkey)
SELECT l_orderkey, children, tickets, CASE WHEN 4000 < tickets THEN 'package' ELSE 'tickets' END AS best, CAST(floor((least(tickets, 4000) * 113 + 50) / 100) AS BIGINT) AS total FROM f""")
def family_cost(spark, d):
    """Each child's narrowest band, summed, against a package that must be strictly cheaper, with tax."""
    bands = spark.createDataFrame(_BANDS, "band string, low int, high int, cost int")
    kids = intervals.band_join(table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("int").alias("q")), "q", bands).where("band IS NOT NULL")
    f = kids.groupBy("l_orderkey").agg(F.sum("band_cost").alias("tickets"), F.count("*").alias("children"))
    return f.select("l_orderkey", "children", "tickets", F.when(F.lit(4000) < F.col("tickets"), "package").otherwise("tickets").alias("best"), money.with_tax(F.least("tickets", F.lit(4000).cast("long"))).alias("total"))


@_query("""SELECT d.doc_id, concat_ws('|', CASE WHEN l.doc_id IS NULL THEN 'label' END, CASE WHEN length(d.text) < 200 THEN 'text' END, CASE WHEN d.lang <> 'en' THEN 'translation' END) AS gaps FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def completeness_gaps(spark, d):
    """What each record lacks."""
    known = table(spark, d, "labels").select(F.col("doc_id").alias("known_id")).distinct()
    j = table(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("n")).join(known, F.col("doc_id") == F.col("known_id"), "left")
    return j.select("doc_id", F.concat_ws("|", F.when(F.col("known_id").isNull(), "label"), F.when(F.col("n") < 200, "text"), F.when(F.col("lang") != "en", "translation")).alias("gaps"))


@_query("""SELECT 'nation' AS kind, CAST(n_nationkey AS VARCHAR) AS item_id, n_name AS label FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), r_name FROM region UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_name FROM part""")
def union_items(spark, d):
    """Several kinds of items in one list."""
    t = {n: table(spark, d, n) for n in ("nation", "region", "part")}
    return search.union_items([(t["nation"], "nation", "n_nationkey", "n_name"), (t["region"], "region", "r_regionkey", "r_name"), (t["part"], "part", "p_partkey", "p_name")])


@_query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS events FROM events GROUP BY ALL")
def json_props(spark, d):
    """A field of an open bag."""
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("events"))


@_query("""SELECT c_custkey, label, value FROM (SELECT c_custkey, 'c_name' AS label, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer)""")
def fact_rows(spark, d):
    """Wide records as facts."""
    return search.fact_rows(table(spark, d, "customer"), "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])


@_query("""WITH old AS (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0), new AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_name || '*' END AS s_name, s_nationkey + 100 AS s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN 'unknown' ELSE 'yes' END AS fact FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, CASE WHEN n.s_suppkey IS NULL THEN o.s_name WHEN o.s_suppkey IS NULL THEN n.s_name ELSE coalesce(n.s_name, o.s_name) END AS s_name, CASE WHEN o.s_suppkey IS NULL THEN n.s_nationkey ELSE o.s_nationkey END AS s_nationkey,
 CASE WHEN n.s_suppkey IS NULL THEN 'no' WHEN o.s_suppkey IS NULL THEN n.fact WHEN n.fact <> 'unknown' THEN n.fact ELSE 'no' END AS fact FROM old o FULL JOIN new n ON o.s_suppkey = n.s_suppkey""")
def upsert_merge(spark, d):
    """A merge with a policy for each column."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    old = s.where("s_suppkey % 3 <> 0").withColumn("fact", F.lit("no"))
    new = s.where("s_suppkey % 5 <> 0").select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.concat("s_name", F.lit("*"))).alias("s_name"), (F.col("s_nationkey") + 100).alias("s_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, "unknown").otherwise("yes").alias("fact"))
    return changes.upsert(old, new, "s_suppkey", {"s_name": "coalesce", "s_nationkey": "keep", "fact": "tri"})


@_query("""WITH x AS (SELECT p_brand, p_type, min(p_size) AS v FROM part WHERE p_size <= 25 GROUP BY ALL), a AS (SELECT p_brand, min(p_size) AS v FROM part WHERE p_size <= 25 GROUP BY ALL)
SELECT p_partkey, coalesce(x.v, a.v) AS p_size FROM part p LEFT JOIN x USING (p_brand, p_type) LEFT JOIN a USING (p_brand)""")
def priority_lookup(spark, d):
    """The exact choice, else the least with the key."""
    p = table(spark, d, "part")
    return joins.priority_lookup(p.select("p_partkey", "p_brand", "p_type"), p.where("p_size <= 25").select("p_brand", "p_type", "p_size"), "p_brand", "p_type", "p_size").select("p_partkey", "p_size")


@_query("""SELECT o_orderkey, o_custkey, c_custkey IS NOT NULL AS available FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 2000) ON o_custkey = c_custkey""")
def saved_items(spark, d):
    """Saved items that the catalog still has, and those it lost."""
    saved = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return joins.split_available(saved, table(spark, d, "customer").where("c_acctbal > 2000").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@_query("""SELECT p_partkey, CASE WHEN p_retailprice / 50 < 15 THEN 'under_15' WHEN p_retailprice / 50 < 25 THEN '15_25' WHEN p_retailprice / 50 < 35 THEN '25_35' ELSE '35_plus' END AS band, CASE WHEN p_size / 50.0 >= 0.9 THEN 'HIGH' WHEN p_size / 50.0 >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM part""")
def derived_bands(spark, d):
    """Price and confidence bands."""
    return table(spark, d, "part").select("p_partkey", money.price_band(F.col("p_retailprice") / 50).alias("band"), logic.confidence_band(F.col("p_size") / F.lit(50.0)).alias("confidence"))
