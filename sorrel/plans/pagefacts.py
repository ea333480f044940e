"""Queries that run rules on what pages, documents and whole columns hold, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sorrel.functions import ages, dates, facts, pages, venues
from sorrel.operators import changes, ingest, locations, venue_facts, views
from sorrel.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _encoded(x: str, also: str) -> str:
    odd = "[^\\x21-\\x7e]|[" + also.replace("'", "''") + "]"
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN regexp_matches(c, '{odd}') THEN CASE c WHEN '''' THEN '%27' ELSE url_encode(c) END ELSE c END), '')"


_LINKS = """SELECT page_id, url, html, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS words, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">', 1), 1) - 1 AS pos FROM pages"""
_ABSOLUTE = " || ".join((
    "lower(regexp_extract(url, '^(https?://[^/?#]+)', 1))", _encoded("regexp_extract(href, '^([^?#]*)', 1)", '"<>`{}'), _encoded("regexp_extract(href, '^[^?#]*([?][^#]*)?', 1)", "\"<>'"), _encoded("regexp_extract(href, '(#.*)?$', 1)", '"<>`'),
))


def _links(spark, d):
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), 1).alias("href"), F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), 1).alias("text"))
    return table(spark, d, "pages").select("page_id", "url", "html", found.alias("links"))


@_query(f"WITH l AS ({_LINKS}) SELECT page_id, CAST(pos AS INTEGER) AS pos, {_ABSOLUTE} AS link FROM l")
def page_links(spark, d):
    """Every link of every page as an absolute address, taken against the page's own."""
    rows = _links(spark, d).select("page_id", "url", F.posexplode("links").alias("pos", "l"))
    return rows.select("page_id", "pos", pages.absolute_url(F.col("l.href"), F.col("url")).alias("link"))


@_query(f"""WITH l AS ({_LINKS}), a AS (SELECT page_id, pos, {_ABSOLUTE} AS link, words FROM l), r AS (SELECT *, regexp_matches(link, '^https?://([^/?#]*[.])?example[.]net([/?#]|$)') AS hosted, regexp_matches(words, '(?i)(^|[^A-Za-z0-9_À-ÿ])(the|los|die)($|[^A-Za-z0-9_À-ÿ])') AS said, contains(lower(link), 'en') AS called FROM a),
b AS (SELECT page_id, arg_min(link, pos) FILTER (hosted) AS h, arg_min(link, pos) FILTER (said) AS s, arg_min(link, pos) FILTER (called) AS c FROM r GROUP BY page_id)
SELECT page_id, coalesce(h, s, c) AS link FROM pages LEFT JOIN b USING (page_id)""")
def registration_links(spark, d):
    """The likeliest link of each page to what is looked for: a platform's host first, then words of its text, then parts of its address."""
    links = F.transform("links", lambda x: F.struct(pages.absolute_url(x["href"], F.col("url")).alias("href"), x["text"].alias("text")))
    found = pages.registration_link(links, r"(^|\.)example\.net$", ("the", "los", "die"), (), ("en",))
    return _links(spark, d).select("page_id", found["href"].alias("link"))


@_query("""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([a-z]+)', 1) AS sub, regexp_extract(html, '<h1>[^ <]+ ([^ <]+ [^ <]+)', 1) AS v FROM pages), j AS (SELECT p.*, d.text FROM p LEFT JOIN documents AS d ON page_id = doc_id),
f AS (SELECT *, trim(regexp_replace(replace(regexp_replace(regexp_replace(lower(v), '&nbsp;|&#160;', ' ', 'g'), '[‐‑‒–—―−]', '-', 'g'), '$', ''), '[\\s ]+', ' ', 'g')) AS needle, regexp_replace(replace(regexp_replace(regexp_replace(lower(text), '&nbsp;|&#160;', ' ', 'g'), '[‐‑‒–—―−]', '-', 'g'), '$', ''), '[\\s ]+', ' ', 'g') AS hay FROM j)
SELECT page_id, CASE WHEN sub = 'blog' THEN '—' WHEN sub = 'm' THEN 'feed' WHEN text IS NULL THEN 'not checked' WHEN trim(v) = '' THEN '—' WHEN needle <> '' AND contains(trim(hay), needle) THEN 'yes' ELSE 'no' END AS found FROM f""")
def values_on_source(spark, d):
    """Whether two words of a page's heading stand in the document of the same number; case, white space, dashes and dollar signs don't count."""
    sub = F.regexp_extract("url", "^https?://([a-z]+)", 1)
    adapter = F.when(sub == "blog", "manual").when(sub == "m", "feed").otherwise("page")
    p = table(spark, d, "pages").select("page_id", adapter.alias("adapter"), F.regexp_extract("html", "<h1>[^ <]+ ([^ <]+ [^ <]+)", 1).alias("v"))
    both = p.join(table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text"), "page_id", "left")
    return both.select("page_id", pages.found_on_source(F.col("adapter"), F.col("v"), F.col("text"), F.col("text").isNotNull()).alias("found"))


_CODES = {"1-URGENT": 403, "2-HIGH": 503, "3-MEDIUM": 0, "4-NOT SPECIFIED": 404, "5-LOW": 0}


@_query("""WITH l AS (SELECT l_orderkey, '[' || string_agg('{"id":"' || l_linenumber || '-' || l_partkey || '","name":"' || l_returnflag || '","dates":"' || strftime(l_shipdate, '%Y-%m-%d') || '","hours":"","ages":"O","price":null,"spots":' || CAST(l_quantity AS INTEGER) || '}', ',' ORDER BY l_linenumber || '-' || l_partkey, l_returnflag, strftime(l_shipdate, '%Y-%m-%d'), CAST(l_quantity AS INTEGER)) || ']' AS facts FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey),
o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, CASE o_orderpriority WHEN '1-URGENT' THEN 403 WHEN '2-HIGH' THEN 503 WHEN '4-NOT SPECIFIED' THEN 404 ELSE 0 END AS code, o_orderpriority = '5-LOW' AS odd FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
s AS (SELECT *, CASE WHEN o_totalprice > 450000 THEN 'ok' WHEN o_orderstatus = 'P' AND odd THEN 'error' WHEN o_orderstatus = 'P' AND code = 403 THEN 'blocked' WHEN o_orderstatus = 'P' AND code IN (0, 503) THEN 'unreachable' WHEN o_orderstatus = 'P' THEN 'error' WHEN o_totalprice < 30000 THEN 'error' ELSE 'ok' END AS status FROM o)
SELECT o_orderkey, status, CASE WHEN status = 'ok' THEN sha256(CASE WHEN o_totalprice > 450000 THEN 'Call or email' ELSE coalesce(facts, '[]') END) END AS content_hash FROM s LEFT JOIN l ON l_orderkey = o_orderkey""")
def source_readings(spark, d):
    """What a poll of each order as a feed of classes gave: its state, and a hash of the open classes' facts, whatever the order and spacing of the body."""
    one = F.struct(
        F.concat_ws("-", "l_linenumber", "l_partkey").alias("id"), F.col("l_returnflag").alias("name"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("start_date"), F.col("l_quantity").cast("int").alias("spots"), F.col("l_linestatus").alias("max_age"),
    )
    bodies = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(one)).alias("body"))  # a few lines an order
    o = table(spark, d, "orders").join(bodies, F.col("o_orderkey") == F.col("l_orderkey"))
    price, kind = F.col("o_totalprice"), F.col("o_orderpriority")
    code = F.element_at(F.create_map(*[F.lit(x) for kv in _CODES.items() for x in kv]), kind)
    body = F.when(price < 30_000, F.concat("body", F.lit("}"))).otherwise(F.concat(F.lit(' {"rows": '), "body", F.lit("} ")))
    r = pages.reading(
        F.col("o_orderstatus") != "P", code, F.when(kind == "5-LOW", "too many redirects").otherwise("timeout"), body, F.when(price > 450_000, "manual").otherwise("feed"), keep=lambda x: x["max_age"] == "O",
    )
    bare = o.select("o_orderkey", r.alias("r"))
    return bare.select("o_orderkey", "r.status", "r.content_hash")


_DAYS = ("1997-01-01", "1999-01-01")


@_query(f"""WITH c AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_acctbal AS bal, count_if(o_orderdate < TIMESTAMP '{_DAYS[0]}') AS a, count_if(o_orderdate < TIMESTAMP '{_DAYS[1]}') AS b, count_if(o_orderdate < TIMESTAMP '{_DAYS[0]}' AND o_orderstatus = 'O') AS fa, count_if(o_orderdate < TIMESTAMP '{_DAYS[1]}' AND o_orderstatus = 'O') AS fb FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
x AS (SELECT *, CASE WHEN seg = 'HOUSEHOLD' THEN 'UNSUPPORTED' WHEN b = 0 THEN 'FAILED' WHEN bal > 9000 THEN 'FAILED' WHEN a = b AND (a = 0 OR bal >= 0) THEN 'UNCHANGED_SOURCE' WHEN fb = 0 THEN 'EXTRACTION_FAILED' WHEN a > 0 AND bal < 0 AND a = b THEN 'REBASELINED' WHEN a = 0 THEN 'BASELINE' WHEN bal < 0 THEN 'CHANGED_VERSION' WHEN fa = fb THEN 'UNCHANGED_FACTS' ELSE 'CHANGED_FACTS' END AS outcome FROM c)
SELECT k AS c_custkey, outcome, outcome IN ('BASELINE', 'CHANGED_VERSION', 'CHANGED_FACTS', 'EXTRACTION_FAILED') AS changed, outcome IN ('BASELINE', 'CHANGED_VERSION', 'CHANGED_FACTS') AS candidates, CASE outcome WHEN 'UNSUPPORTED' THEN 'crawl_strategy_not_fetchable:manual' WHEN 'EXTRACTION_FAILED' THEN 'extraction_failed' WHEN 'FAILED' THEN CASE WHEN b = 0 THEN 'not_fetched' ELSE 'fetch_error' END END AS error FROM x""")
def source_cycle(spark, d):
    """A cycle over customers as sources, whose pages are their orders until a day and whose facts the open ones among them."""
    first, second = (F.col("o_orderdate") < F.lit(day).cast("timestamp") for day in _DAYS)
    open_ = F.col("o_orderstatus") == "O"
    c = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey", "c_mktsegment", "c_acctbal")
    c = c.agg(F.count_if(first).alias("a"), F.count_if(second).alias("b"), F.count_if(first & open_).alias("fa"), F.count_if(second & open_).alias("fb"))
    page = lambda n: F.sha2(n.cast("string"), 256)
    version = F.when(F.col("c_acctbal") < 0, "camp-facts-v1").otherwise("camp-facts-v2")
    known = F.col("a") > 0
    s = c.select("c_custkey", F.when(F.col("c_mktsegment") == "HOUSEHOLD", "manual").otherwise("static_html").alias("strategy"), F.lit(24).alias("hours"), F.when(known, page(F.col("a"))).alias("last_hash"), F.when(known, F.concat(version, F.lit(":sha256:"), page(F.col("fa")))).alias("last_print"))
    shots = c.where("b > 0").select("c_custkey", F.when(F.col("c_acctbal") > 9000, "error").otherwise("success").alias("status"), page(F.col("b")).alias("content_hash"), F.lit(True).alias("has_content"))
    records = c.where("b > 0").select("c_custkey", F.concat(F.lit("camp-facts-v2:sha256:"), page(F.col("fb"))).alias("fact_print"), F.col("fb").alias("n_records"))
    return ingest.process_sources(s, shots, records, "c_custkey", F.lit("1999-01-01").cast("timestamp")).select("c_custkey", "outcome", "changed", "candidates", "error")


@_query("""WITH x AS (SELECT c_custkey AS k, n_name, r_name, c_mktsegment AS seg, CAST(floor(abs(c_acctbal)) AS BIGINT) AS bal, c_acctbal < 0 AS owes FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
y AS (SELECT *, CASE r_name WHEN 'AFRICA' THEN 'ON' WHEN 'AMERICA' THEN 'ON' WHEN 'ASIA' THEN 'QC' WHEN 'EUROPE' THEN 'BC' END AS prov FROM x)
SELECT k AS c_custkey, CASE WHEN prov IS NOT NULL THEN bal || ' ' || seg || ' Rd' END AS address_line, CASE WHEN prov IS NOT NULL THEN 'St. ' || lower(seg) END AS city, prov AS province, CASE WHEN prov IS NOT NULL AND NOT owes THEN 'L' || left(CAST(bal AS VARCHAR), 1) || 'B ' || right(CAST(bal AS VARCHAR), 1) || 'M' || right(CAST(bal AS VARCHAR), 1) END AS postal_code, CASE WHEN prov IS NOT NULL THEN 1 END AS line FROM y""")
def page_addresses(spark, d):
    """The first Canadian street address among lines made of each customer's columns."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    number = F.floor(F.abs("c_acctbal")).cast("string")
    place = F.element_at(F.create_map(*map(F.lit, ("AFRICA", "Ontario", "AMERICA", "on", "ASIA", "Quebec.", "EUROPE", "BC", "MIDDLE EAST", "Texas"))), F.col("r_name"))
    code = F.when(F.col("c_acctbal") < 0, F.concat(F.lit(", "), "n_name")).otherwise(F.concat(F.lit(", l"), F.substring(number, 1, 1), F.lit("b "), F.substring(number, -1, 1), F.lit("m"), F.substring(number, -1, 1), F.lit(" Canada")))
    lines = F.array(F.concat(F.lit("Ages 5 to 9, "), "n_name"), F.concat(F.lit("Find us at  "), number, F.lit(" "), "c_mktsegment", F.lit(" Rd , St. "), F.lower("c_mktsegment"), F.lit(",  "), place, code), F.lit("9 Other Rd, Guelph, Texas"))
    found = c.select("c_custkey", pages.find_address(lines).alias("f"))
    return found.select("c_custkey", "f.value.address_line", "f.value.city", "f.value.province", "f.value.postal_code", "f.line")


_FORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '\\([^)]*\\)', ' ', 'g'), '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@_query(f"""WITH l AS ({_LINKS}), n AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, {_FORM.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS a, {_FORM.format("words")} AS b FROM l)
SELECT page_id, pos, a <> '' AND b <> '' AND (a = b OR (length(a) >= 4 AND starts_with(b, a || ' ')) OR (length(b) >= 4 AND starts_with(a, b || ' '))) AS alike FROM n""")
def names_alike(spark, d):
    """Whether the name of a page's link says the same as its title, or one goes on where the other ends."""
    rows = _links(spark, d).select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.posexplode("links").alias("pos", "l"))
    return rows.select("page_id", "pos", changes.names_match(F.col("title"), F.col("l.text")).alias("alike"))


@_query("""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9A-Za-z.:+-]*[0-9][0-9A-Za-z.:+-]*')) AS t FROM documents), n AS (SELECT t, CASE WHEN regexp_full_match(t, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(rtrim(t, '.') AS DOUBLE) END AS n FROM t WHERE NOT regexp_matches(t, '^0[xXoObB]')),
f AS (SELECT t, CASE WHEN isfinite(n) THEN n END AS number FROM n)
SELECT t, number, CASE WHEN number = floor(number) THEN TRY_CAST(number AS BIGINT) END AS whole, CASE WHEN regexp_matches(t, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN left(t, 10) END AS day, CASE WHEN regexp_matches(t, '^[0-9]{2}:[0-9]{2}') THEN left(t, 5) END AS clock, CASE WHEN number = floor(number) AND TRY_CAST(number AS BIGINT) IS NOT NULL THEN 'full' END AS state FROM f""")
def coerced_values(spark, d):
    """All texts with digits in documents as typed facts; what can't be understood is null."""
    found = F.regexp_extract_all("text", F.lit("[0-9A-Za-z.:+-]*[0-9][0-9A-Za-z.:+-]*"), 0)
    t = table(spark, d, "documents").select(F.explode(found).alias("t")).distinct().where(~F.col("t").rlike("^0[xXoObB]"))
    spot = facts.spot_check(F.lit("full"), F.col("t"), F.lit("1998-01-01"))
    return t.select("t", facts.number(F.col("t")).alias("number"), facts.whole(F.col("t")).alias("whole"), facts.iso_day(F.col("t")).alias("day"), facts.clock(F.col("t")).alias("clock"), spot["state"].alias("state"))


@_query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN month(o_orderdate) <= month(l_shipdate) THEN CASE WHEN c_nationkey % 12 + 1 BETWEEN month(o_orderdate) AND month(l_shipdate) THEN 0 ELSE 1 END WHEN c_nationkey % 12 + 1 >= month(o_orderdate) OR c_nationkey % 12 + 1 <= month(l_shipdate) THEN 0 ELSE 1 END AS off_season FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
def seasons(spark, d):
    """Whether a month lies in the season from an order's month to that of a shipment, which may go over the year's end."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    inside = dates.in_season(F.col("c_nationkey") % 12 + 1, F.month("o_orderdate"), F.month("l_shipdate"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.when(inside, 0).otherwise(1).alias("off_season"))


@_query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN n > 3 THEN TRUE ELSE s = e END WHEN o_orderstatus = 'O' THEN n > 3 AND o_totalprice > 200000 ELSE FALSE END AS single FROM orders JOIN (SELECT l_orderkey, count(*) AS n, CAST(min(l_shipdate) AS DATE) AS s, CAST(max(l_shipdate) AS DATE) AS e FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def single_days(spark, d):
    """Orders that are sessions of one day: by their format, or by equal first and last days unless the format isn't known."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.to_date(F.min("l_shipdate")).alias("s"), F.to_date(F.max("l_shipdate")).alias("e"))
    o = table(spark, d, "orders").join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    many = F.col("n") > 3
    kind = F.when((F.col("o_orderstatus") == "F") & many, "single_day").when(F.col("o_orderstatus") == "F", "weekly").when((F.col("o_orderstatus") == "O") & many & (F.col("o_totalprice") > 200_000), "single_day").otherwise("unknown")
    return o.select("o_orderkey", dates.is_single_day(F.col("s"), F.col("e"), kind).alias("single"))


_AT = "43.0 + c_acctbal / 6000 AS lat, -80.5 + c_nationkey / 10 AS lng"


def _places(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("place"), "c_name", (F.lit(43.0) + F.col("c_acctbal") / 6000).alias("lat"), (F.lit(-80.5) + F.col("c_nationkey") / 10).alias("lng"))


@_query(f"""WITH v AS (SELECT c_custkey, {_AT} FROM customer), u AS (SELECT * FROM v WHERE lat BETWEEN 43.0 AND 44.5 AND lng BETWEEN -80.5 AND -78.5), m AS (SELECT DISTINCT l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey), shown AS (SELECT * FROM m JOIN u ON o_custkey = c_custkey)
SELECT 'pin' AS what, CAST(c_custkey AS BIGINT) AS id, count(*) AS camps FROM shown GROUP BY c_custkey UNION ALL SELECT 'unmapped', l_suppkey, 0 FROM (SELECT DISTINCT l_suppkey FROM m WHERE l_suppkey NOT IN (SELECT l_suppkey FROM shown))""")
def map_pins(spark, d):
    """A pin for each customer's place within the map's box, and suppliers that no pin shows."""
    m = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", F.col("o_custkey").alias("place"))
    pins, rest = locations.map_pins(m, _places(spark, d), "place", "l_suppkey", "lat", "lng", "c_name")
    return pins.select(F.lit("pin").alias("what"), F.col("place").alias("id"), "camps").unionByName(rest.select(F.lit("unmapped").alias("what"), F.col("l_suppkey").alias("id"), F.lit(0).cast("long").alias("camps")))


@_query(f"""WITH v AS (SELECT c_custkey AS place, {_AT} FROM customer), x AS (SELECT place, 6371.0088 * sqrt(pow(radians(lng + 79.4) * cos(radians((lat + 43.65) / 2)), 2) + pow(radians(lat - 43.65), 2)) AS km FROM v) SELECT place, round(km, 6) AS km FROM x WHERE km <= 40""")
def near_places(spark, d):
    """Places within 40 km of a point, by equirectangular distance."""
    return locations.nearest_first(_places(spark, d), "lat", "lng", "place", (43.65, -79.4), 40).select("place", F.round("km", 6).alias("km"))


@_query("""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[^:]+://[^/]+/([a-z]*)', 1) AS lang, regexp_extract(url, '([0-9]+)', 1) AS n, regexp_extract(url, '[?](.*)$', 1) AS note FROM pages), q AS (SELECT *, '1998-0' || substr(n, 1, 1) || '-' || lpad(substr(n, 2), 2, '0') AS day FROM p)
SELECT page_id, coalesce(starts_with(url, 'https://') AND TRY_CAST(day AS DATE) IS NOT NULL AND (lang = 'en' OR (lang = 'fr' AND trim(note) <> '')), FALSE) AS public, CASE WHEN TRY_CAST(n AS DOUBLE) / 5 <= 90 THEN CAST(TRY_CAST(n AS DOUBLE) / 5 * 10 AS BIGINT) END AS lat FROM q""")
def public_facts(spark, d):
    """Facts with an https source, a day of the calendar and a standing that may be shown, and coordinates that may be used, of each page's address."""
    part = lambda pattern: F.regexp_extract("url", pattern, 1)
    n, lang = part("([0-9]+)"), part("^[^:]+://[^/]+/([a-z]*)")
    day = F.concat(F.lit("1998-0"), F.substring(n, 1, 1), F.lit("-"), F.lpad(F.substring(n, 2, 9), 2, "0"))
    fact = views.public_fact(F.col("url"), day, F.when(lang == "en", "verified").when(lang == "fr", "conflicting").otherwise("draft"), part("[?](.*)$"))
    at = venues.usable_coordinates(n.try_cast("double") / 5, F.lit(-79.0))
    return table(spark, d, "pages").select("page_id", fact.alias("public"), (at["lat"] * 10).cast("long").alias("lat"))


@_query("""WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT c_custkey, c_mktsegment AS seg, n_name, coalesce(n, 0) AS n, CASE WHEN c_acctbal >= 1000 THEN CAST(floor(c_acctbal / 500) AS BIGINT) END AS lo, CASE WHEN c_nationkey < 20 THEN c_nationkey END AS hi, c_acctbal AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON o_custkey = c_custkey)
SELECT c_custkey, CASE WHEN seg = 'BUILDING' THEN CASE WHEN hi IS NOT NULL THEN 'all_ages_with_limit' END WHEN lo IS NULL AND hi IS NULL THEN 'no_ages' WHEN lo IS NULL THEN 'no_minimum' WHEN hi IS NULL THEN 'no_maximum' WHEN lo > hi THEN 'crossed' END AS ages,
 CASE WHEN seg = 'MACHINERY' THEN 'kind_unknown' WHEN seg IN ('BUILDING', 'HOUSEHOLD') AND n = 0 THEN 'no_hours' END AS hours, CASE WHEN bal < 0 AND n < 5 THEN 'neither' WHEN bal < 0 THEN 'no_source' WHEN n < 5 THEN 'no_date' END AS source, CASE WHEN bal > 8000 THEN 'no' WHEN n > 12 THEN 'yes' ELSE 'unknown' END AS stroller FROM x""")
def readiness_gaps(spark, d):
    """What a customer's record as a place lacks before it can be planned with."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").join(orders, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    seg, bal, n = F.col("c_mktsegment"), F.col("c_acctbal"), F.col("n")
    return c.select(
        "c_custkey", venue_facts.ages_gap(seg == "BUILDING", F.when(bal >= 1000, F.floor(bal / 500)), F.when(F.col("c_nationkey") < 20, F.col("c_nationkey"))).alias("ages"),
        venue_facts.hours_gap(F.when(seg == "MACHINERY", "unknown").when(seg.isin("BUILDING", "HOUSEHOLD"), "fixed").otherwise("seasonal"), n).alias("hours"),
        venue_facts.verification_gap(F.when(bal >= 0, F.concat(F.lit("https://"), "c_name")).otherwise(" "), F.when(n >= 5, "1998-02-28").otherwise("1998-02-30")).alias("source"),
        venue_facts.stroller_friendly(F.when(bal > 8000, "no").otherwise("unknown"), F.when(n > 12, "yes")).alias("stroller"),
    )


@_query("""WITH s AS (SELECT l_orderkey AS k, CAST(min(l_shipdate) AS DATE) AS start FROM lineitem GROUP BY 1), x AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS as_of, floor(l_quantity / 3) AS age, CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_orderdate AS DATE) WHEN o_orderpriority <> '5-LOW' THEN start END AS assessed FROM lineitem JOIN s ON k = l_orderkey JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, assessed, CASE WHEN as_of = assessed THEN CASE WHEN age BETWEEN 5 AND 11 THEN 'yes' ELSE 'no' END ELSE 'unknown' END AS fit FROM x""")
def assessed_ages(spark, d):
    """Ages stated for a day against a session's band; they count only on the day on which the session assesses ages."""
    li = table(spark, d, "lineitem").withColumn("start", F.to_date(F.min("l_shipdate").over(Window.partitionBy("l_orderkey"))))
    rows = li.join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    rule = F.when(F.col("o_orderpriority") == "1-URGENT", "as_of_date").when(F.col("o_orderpriority") != "5-LOW", "as_of_session_start").otherwise("unknown")
    at = ages.assessment_date(rule, F.to_date("o_orderdate"), F.col("start"))
    fit = ages.stated_age_fits(F.floor(F.col("l_quantity") / 3), F.to_date("l_shipdate"), at, F.lit(5), F.lit(11))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", at.alias("assessed"), fit.alias("fit"))


@_query("""WITH p AS (SELECT l_suppkey AS v, l_returnflag || l_linenumber AS label, l_extendedprice AS amount, CASE WHEN l_quantity > 10 THEN floor(l_quantity / 5) END AS lo, CASE WHEN l_quantity < 45 THEN floor(l_quantity / 5) + l_linenumber END AS hi, l_orderkey * 100000 + l_partkey AS k, l_linestatus = 'O' AS child, l_tax > 0.06 AS free, l_discount > 0.08 AS sib FROM lineitem),
c AS (SELECT * FROM p WHERE child AND NOT free AND NOT sib), b AS (SELECT v, label FROM c QUALIFY row_number() OVER (PARTITION BY v ORDER BY coalesce(hi, 17) - coalesce(lo, 0) DESC, k) = 1)
SELECT v, label, min(amount) AS least, max(amount) AS most FROM c JOIN b USING (v, label) GROUP BY ALL""")
def everyday_prices(spark, d):
    """The everyday price of a child: of paid prices that aren't for siblings those of the ticket that most ages can use."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    p = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("v"), F.concat("l_returnflag", n.cast("string")).alias("label"), F.col("l_extendedprice").alias("amount"), F.when(q > 10, F.floor(q / 5)).alias("lo"), F.when(q < 45, F.floor(q / 5) + n).alias("hi"),
        (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("k"), F.when(F.col("l_linestatus") == "O", "child").otherwise("adult").alias("audience"), (F.col("l_tax") > 0.06).alias("free"), (F.col("l_discount") > 0.08).alias("sibling"),
    )
    return venue_facts.everyday_child_price(p, "v", "label", "amount", "lo", "hi", "k")
