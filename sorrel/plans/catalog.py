"""Queries on places, cards, identities and facts over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sorrel.functions import facts
from sorrel.functions.money import cents
from sorrel.operators import cards, locations, reconcile, venue_facts
from sorrel.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _cents(c: str) -> str:
    return f"CAST(floor({c} * 100 + 0.5) AS BIGINT)"


@_query("""WITH v AS (SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT p_partkey, p_brand, p_type FROM part WHERE lower(trim(p_brand)) IN ('brand#11', 'brand#22', 'brand#33') OR lower(trim(p_type)) IN ('brand#11', 'brand#22', 'brand#33', 'economy')),
m AS (SELECT l_partkey, s_suppkey, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN v ON l_suppkey = s_suppkey JOIN p ON l_partkey = p_partkey
 WHERE (lower(trim(n_name)) IN ('canada', 'europe', 'asia') OR lower(trim(r_name)) IN ('canada', 'europe', 'asia') OR lower(trim(s_name)) IN ('canada', 'europe', 'asia')) AND l_returnflag = 'N'
 AND CAST(l_shipdate AS DATE) + 7 >= DATE '1995-06-01' AND CAST(l_shipdate AS DATE) <= DATE '1998-06-30')
SELECT l_partkey AS p_partkey, count(*) AS sessions, count(DISTINCT s_suppkey) AS venues, min(d) AS first_day FROM m GROUP BY l_partkey""")
def place_search(spark, d):
    """Sessions by place, theme, care and date, all on one row, counted by program."""
    v = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "s_name", "n_name", "r_name")
    near = v.where(locations.location_match(F.col("s_suppkey"), [F.col("n_name"), F.col("r_name"), F.col("s_name")], ["Canada", "Europe", "Asia"], []))
    p = table(spark, d, "part").where(locations.themes_match(F.col("p_brand"), F.array("p_type"), ["Brand#11", "brand#22", "BRAND#33", "economy"])).select("p_partkey")
    day = F.to_date("l_shipdate")
    s = table(spark, d, "lineitem").where(locations.care_offered(F.when(F.col("l_returnflag") == "N", "yes")) & locations.in_dates(day, F.date_add(day, 7), "1995-06-01", "1998-06-30"))
    s = s.select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"), day.alias("d"))
    return s.join(near.select("s_suppkey"), "s_suppkey").join(p, "p_partkey").groupBy("p_partkey").agg(F.count("*").alias("sessions"), F.count_distinct("s_suppkey").alias("venues"), F.min("d").alias("first_day"))


_PLACES_SQL = """listed AS (SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA' AND s_suppkey IN (SELECT l_suppkey FROM lineitem)),
c AS (SELECT 'city' AS level, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS place, s_suppkey FROM listed UNION SELECT 'neighbourhood', trim(regexp_replace(lower(r_name), '[^a-z0-9]+', ' ', 'g')), s_suppkey FROM listed)"""


def _coverage(spark, d):
    v = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    v = v.select("s_suppkey", "n_name", "r_name", F.when(F.col("r_name") == "AFRICA", "QC").when(F.col("r_name") == "ASIA", "Ontario").alias("province"))
    return locations.coverage(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey")), v, "s_suppkey", "n_name", "r_name", "province")


@_query(f"WITH {_PLACES_SQL} SELECT level, place, count(*) AS venues FROM c GROUP BY ALL")
def listing_coverage(spark, d):
    """Venues with listed sessions by city and neighbourhood."""
    return _coverage(spark, d).groupBy("level", "place").agg(F.count("*").alias("venues"))


@_query(f"""WITH {_PLACES_SQL}, names AS (SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 100 + r_regionkey, r_name FROM region UNION ALL SELECT 200, 'CANADA' UNION ALL SELECT 201, 'Nowhere'),
i AS (SELECT id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS place FROM names), x AS (SELECT id, place, count(*) OVER (PARTITION BY place) > 1 AS ambiguous FROM i),
h AS (SELECT place, bool_or(level = 'city') AS as_city FROM c GROUP BY place), a AS (SELECT CAST(c_nationkey AS BIGINT) AS id, count(*) AS asked FROM customer GROUP BY 1 UNION ALL SELECT * FROM (VALUES (101::BIGINT, 1::BIGINT), (200, 1), (201, 1), (999, 1), (NULL, 1))),
r AS (SELECT a.id, a.asked, CASE WHEN a.id IS NULL THEN 'none' WHEN x.id IS NULL THEN 'unknown_location' WHEN as_city IS NULL THEN 'no_listings' WHEN ambiguous THEN 'unconfirmed' ELSE 'covered' END AS status, as_city, x.place FROM a LEFT JOIN x ON a.id = x.id LEFT JOIN h ON x.place = h.place)
SELECT id, asked, status, CASE WHEN status = 'covered' THEN CASE WHEN as_city THEN 'city' ELSE 'neighbourhood' END END AS matched_by, CASE WHEN status = 'covered' THEN (SELECT count(*) FROM c WHERE c.place = r.place AND c.level = CASE WHEN r.as_city THEN 'city' ELSE 'neighbourhood' END) ELSE 0 END AS venues FROM r""")
def browse_locations(spark, d):
    """Chosen places resolved to the venues that their own name covers."""
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    names = names.unionByName(table(spark, d, "region").select((F.col("r_regionkey") + 100).cast("long").alias("id"), F.col("r_name").alias("name"))).unionByName(spark.createDataFrame([(200, "CANADA"), (201, "Nowhere")], "id long, name string"))
    asked = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("id")).agg(F.count("*").alias("asked"))
    asked = asked.unionByName(spark.createDataFrame([(101, 1), (200, 1), (201, 1), (999, 1), (None, 1)], "id long, asked long"))
    c = _coverage(spark, d)
    r = locations.resolve_locations(asked, locations.location_index(names, "id", "name"), c, "id", "s_suppkey")
    n = locations.venues_of(r, c, "s_suppkey").groupBy(F.col("id").alias("of_id")).agg(F.count("*").alias("venues"))
    return r.join(n, F.col("id") == F.col("of_id"), "left").select("id", "asked", "status", "matched_by", F.coalesce("venues", F.lit(0)).alias("venues"))


_GRID = "43.0 + (s_suppkey % 17) * 0.1 AS lat, -80.5 + (s_suppkey % 23) * 0.1 AS lng"


_CARD = """CAST(l_shipdate AS DATE) AS s, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_shipdate AS DATE) + l_linenumber END AS e, CASE WHEN l_quantity > 4 THEN CASE WHEN l_linestatus = 'O' THEN '09:00' ELSE '08:30' END END AS opens, '16:00' AS closes,
 CASE WHEN l_suppkey % 5 <> 0 THEN 'V' || l_suppkey % 3 || ' · ' || l_returnflag END AS venue, CASE WHEN l_tax < 0.05 THEN CAST(l_shipdate AS DATE) - 3 END AS checked, CASE l_returnflag WHEN 'A' THEN TRUE WHEN 'R' THEN FALSE END AS confirmed,
 concat_ws(' · ', CASE WHEN l_returnflag = 'N' THEN 'before care 07:30–09:00' END, CASE l_linestatus WHEN 'O' THEN 'after care (times to confirm) · advance request; additional fee' ELSE 'after care to confirm' END) AS note"""


@_query(f"""WITH x AS (SELECT l_orderkey, {_CARD} FROM lineitem), y AS (SELECT *, opens || '–' || closes AS h FROM x),
g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT venue) AS nv, min(venue) AS v, strftime(min(s), '%b %-d') AS f, strftime(coalesce(max(e), min(s)), '%b %-d') AS t, count(h) AS nh, min(h) AS h0, max(h) AS h1, min(note) AS c0, max(note) AS c1,
 min(checked) AS k0, max(checked) AS k1, count(*) FILTER (confirmed) AS yes, count(*) FILTER (NOT confirmed) AS no FROM y GROUP BY l_orderkey)
SELECT l_orderkey, CASE nv WHEN 0 THEN 'Venue to confirm' WHEN 1 THEN v ELSE nv || ' venues' END AS venue, CASE WHEN n > 1 THEN n || ' sessions · ' ELSE '' END || CASE WHEN f = t THEN f ELSE f || ' – ' || t END AS dates,
 CASE WHEN nh = 0 THEN 'Hours to confirm' WHEN nh < n OR h0 <> h1 THEN 'Hours vary by session' ELSE h0 END AS hours, CASE WHEN c0 <> c1 THEN 'care hours vary by session' ELSE nullif(c0, '') END AS care,
 CASE WHEN k0 IS NULL THEN 'Evidence unknown' ELSE 'Checked ' || k0 || CASE WHEN k0 = k1 THEN '' ELSE '–' || k1 END || ' · ' || CASE WHEN yes = n THEN 'provider confirmed' WHEN yes > 0 THEN 'some sessions provider-confirmed' WHEN no = n THEN 'source-checked (not provider-confirmed)' ELSE 'confirmation status unknown' END END AS evidence,
 CASE WHEN k0 IS NOT NULL AND yes = n THEN TRUE WHEN k0 IS NOT NULL AND yes = 0 AND no = n THEN FALSE END AS confirmed FROM g""")
def card_summary(spark, d):
    """What a program's sessions say together: venue, dates, hours, care and evidence."""
    day, line, flag, state = F.to_date("l_shipdate"), F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_linestatus")
    none = F.lit(None).cast("string")
    s = table(spark, d, "lineitem").select(
        "l_orderkey", day.alias("s"), F.when(line % 3 != 0, F.date_add(day, line)).alias("e"), F.when(F.col("l_quantity") > 4, F.when(state == "O", "09:00").otherwise("08:30")).alias("opens"), F.lit("16:00").alias("closes"),
        F.when(F.col("l_suppkey") % 5 != 0, cards.venue_label(F.concat(F.lit("V"), (F.col("l_suppkey") % 3).cast("string")), none, flag)).alias("venue"), F.when(F.col("l_tax") < 0.05, F.date_sub(day, 3)).alias("checked"),
        F.when(flag == "A", True).when(flag == "R", False).alias("confirmed"),
        facts.care_window(F.when(flag == "N", "yes").otherwise("no"), F.lit("07:30:00"), F.lit("09:00:00"), none).alias("before"), facts.care_window(F.when(state == "O", "yes"), none, none, F.lit("yes")).alias("after"),
    )
    c = cards.card(s, "l_orderkey", venue=F.col("venue"), start=F.col("s"), end=F.col("e"), opens=F.col("opens"), closes=F.col("closes"), before=F.col("before"), after=F.col("after"), checked=F.col("checked"), confirmed=F.col("confirmed"))
    return c.select("l_orderkey", F.col("venue.label").alias("venue"), F.col("dates.label").alias("dates"), F.col("hours.label").alias("hours"), "care", F.col("evidence.label").alias("evidence"), F.col("evidence.confirmed").alias("confirmed"))


@_query("""WITH s AS (SELECT p_brand, p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_size % 9 END AS lo, CASE WHEN p_size % 5 <> 0 THEN p_size % 9 + p_size % 4 END AS hi, CASE WHEN p_size % 11 <> 0 THEN p_size % 2 = 0 END AS li, CASE WHEN p_size % 13 <> 0 THEN p_size % 3 <> 0 END AS hi_in FROM part),
b AS (SELECT p_brand, p_partkey, CASE WHEN (lo IS NULL AND hi IS NULL) OR (lo IS NOT NULL AND li IS NULL) OR (hi IS NOT NULL AND hi_in IS NULL) OR coalesce(lo > hi OR (lo = hi AND NOT (li AND hi_in)), FALSE) THEN NULL
 WHEN lo IS NOT NULL AND hi IS NOT NULL THEN 'Ages ' || CASE WHEN li THEN '' ELSE '>' END || lo || '–' || CASE WHEN hi_in THEN '' ELSE '<' END || hi WHEN lo IS NOT NULL THEN CASE WHEN li THEN 'Ages ' || lo || '+' ELSE 'Ages >' || lo END ELSE CASE WHEN hi_in THEN 'Ages up to ' || hi ELSE 'Ages <' || hi END END AS band FROM s),
e AS (SELECT p_brand, band, min(p_partkey) AS first FROM b WHERE band IS NOT NULL GROUP BY ALL), u AS (SELECT p_brand, count(*) FILTER (band IS NULL) AS unknown_ages, count(band) AS known FROM b GROUP BY p_brand), l AS (SELECT p_brand, string_agg(band, ' · ' ORDER BY first) AS bands FROM e GROUP BY p_brand)
SELECT u.p_brand, CASE WHEN known = 0 THEN 'unknown' WHEN unknown_ages = 0 THEN 'known' ELSE 'mixed' END AS ages_kind, CASE WHEN known > 0 THEN bands || CASE WHEN unknown_ages > 0 THEN ' · some session ages to confirm' ELSE '' END END AS ages_label, unknown_ages FROM u LEFT JOIN l USING (p_brand)""")
def card_ages(spark, d):
    """The distinct age bands of a program's sessions, unknown ones counted apart."""
    z = F.col("p_size")
    s = table(spark, d, "part").select("p_brand", "p_partkey", F.when(z % 7 != 0, z % 9).alias("lo"), F.when(z % 5 != 0, z % 9 + z % 4).alias("hi"), F.when(z % 11 != 0, z % 2 == 0).alias("li"), F.when(z % 13 != 0, z % 3 != 0).alias("hi_in"))
    return cards.ages_summary(s, "p_brand", "p_partkey", "lo", "hi", "li", "hi_in")


@_query(f"""WITH e AS (SELECT o_orderkey AS rec, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 7 END AS prog, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS i1, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 40 ELSE o_custkey % 40 + 100 END AS i2, o_custkey % 40 AS r1 FROM orders),
c AS (SELECT c_custkey AS id, c_custkey % 7 AS prog, CASE c_custkey % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS i1, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 40 END AS i2, CASE WHEN c_custkey <= 60 THEN c_custkey % 40 ELSE c_custkey + 1000 END AS r1 FROM customer),
x AS (SELECT rec, count(id) AS n, min(id) AS id FROM e JOIN c ON e.i1 = c.i1 AND e.i2 = c.i2 AND (e.prog IS NULL OR e.prog = c.prog) GROUP BY rec), y AS (SELECT rec, count(id) AS n, arg_min(id, id) AS id, arg_min(struct_pack(a := c.i1, b := c.i2), id) AS one FROM e JOIN c ON e.r1 = c.r1 AND (e.prog IS NULL OR e.prog = c.prog) GROUP BY rec),
k AS (SELECT e.rec, CASE WHEN i1 IS NULL THEN 'NO_MATCH' WHEN x.n = 1 THEN 'EXACT_IDENTITY' WHEN x.n > 1 THEN 'AMBIGUOUS' WHEN y.n IS NULL THEN 'NO_MATCH' WHEN y.n > 1 THEN 'AMBIGUOUS' WHEN one.b IS NULL THEN 'NO_MATCH' WHEN one.a = i1 AND one.b = i2 THEN 'SAFE_RECONCILIATION' ELSE 'IDENTITY_CHANGED' END AS kind, x.id AS xid, y.id AS yid, x.n AS xn, y.n AS yn, one, i1, i2 FROM e LEFT JOIN x USING (rec) LEFT JOIN y USING (rec))
SELECT rec AS o_orderkey, kind, CASE kind WHEN 'EXACT_IDENTITY' THEN xid WHEN 'SAFE_RECONCILIATION' THEN yid END AS match_id, coalesce(xn, yn, 0) AS candidates, CASE WHEN kind = 'IDENTITY_CHANGED' THEN concat_ws('|', CASE WHEN one.a <> i1 THEN 'priority' END, CASE WHEN one.b <> i2 THEN 'number' END) END AS changed FROM k""")
def identity_reconciliation(spark, d):
    """Records against the catalog by the dimensions that their source declares."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    e = table(spark, d, "orders").select("o_orderkey", F.when(k % 2 == 0, c % 7).alias("prog"), F.when(k % 11 != 0, F.col("o_orderpriority")).alias("priority"), F.when(k % 5 != 0, c % 40).otherwise(c % 40 + 100).cast("string").alias("number"), (c % 40).alias("rest"))
    u = F.col("c_custkey")
    names = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    cat = table(spark, d, "customer").select("c_custkey", (u % 7).alias("prog"), F.get(names, (u % 5).cast("int")).alias("c_priority"), F.when(u % 9 != 0, u % 40).alias("c_number"), F.when(u <= 60, u % 40).otherwise(u + 1000).alias("c_rest"))
    dims = [reconcile.Dimension("priority", "priority", "c_priority"), reconcile.Dimension("number", "number", "c_number", "number")]
    return reconcile.reconcile(e, cat, "o_orderkey", "c_custkey", "prog", dims, [reconcile.Dimension("rest", "rest", "c_rest", "number")])


def _option(key: str, amount: str) -> str:
    return f"""'{{"amount":' || {amount} || ',"currency":null,"key":"' || {key} || '","label":null,"unit":null}}'"""


_ONE, _TWO = _option("l_returnflag", "CAST(floor(l_tax * 100 + 0.5) AS BIGINT)"), _option("l_linestatus", "CAST(l_quantity AS BIGINT)")


@_query(f"""WITH r AS (SELECT l_orderkey, sha256('{{"type":"session","fields":{{"ageBands":[{{"ageMax":null,"ageMin":' || l_linenumber || ',"hoursEnd":null,"hoursStart":null}}],"priceOptions":[' || CASE WHEN l_returnflag < l_linestatus THEN {_ONE} || ',' || {_TWO} ELSE {_TWO} || ',' || {_ONE} END || '],"startDate":"' || strftime(l_shipdate, '%Y-%m-%d') || '"}}}}') AS h FROM lineitem)
SELECT l_orderkey, 'camp-facts-v2:sha256:' || sha256(count(*) || '-' || """ + " || '-' || ".join(f"CAST(sum(CAST('0x' || h[{1 + 8 * i}:{8 + 8 * i}] AS BIGINT)) % 4294967296 AS BIGINT)" for i in range(8)) + """) AS fingerprint FROM r GROUP BY l_orderkey""")
def fact_fingerprints(spark, d):
    """One fingerprint of a source's records, whatever their order and that of their fields and lists; what isn't a session's fact doesn't count."""
    option = lambda key, amount: F.struct(F.col(key).alias("role"), amount.alias("amount"))
    options = F.array(option("l_returnflag", cents(F.col("l_tax"))), option("l_linestatus", F.col("l_quantity").cast("long")))
    bands = F.array(F.struct(F.col("l_linenumber").alias("ageMin"), F.lit("as read").alias("copy")))
    seen = F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("value"), F.lit("as read").alias("rawValue"))
    rows = table(spark, d, "lineitem").select("l_orderkey", bands.alias("ageBands"), options.alias("priceOptions"), seen.alias("startDate"), F.col("l_partkey").cast("string").alias("externalId"), F.col("l_tax").alias("colour"))
    payload = facts.fact_payload("session", {f.name: (F.col(f.name), f.dataType) for f in rows.schema.fields[1:]})
    return rows.groupBy("l_orderkey").agg(facts.set_digest(payload).alias("fingerprint"))


@_query("""WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS BIGINT) AS p FROM lineitem), g AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'indoor' WHEN 1 THEN 'outdoor' WHEN 2 THEN 'both' WHEN 3 THEN 'primarily_outdoor' WHEN 4 THEN 'virtual' END AS setting FROM part WHERE p_size <> 50)
SELECT CASE WHEN setting IN ('indoor', 'both', 'virtual') THEN 'kept' WHEN setting IN ('outdoor', 'primarily_outdoor') THEN 'hidden_outdoor' ELSE 'hidden_unknown' END AS verdict, count(*) AS sessions FROM s LEFT JOIN g ON p = p_partkey GROUP BY 1""")
def rainy_day(spark, d):
    """Sessions under cover on a rainy day, and why the others are hidden."""
    z = F.col("p_size") % 6
    setting = F.when(z == 0, "indoor").when(z == 1, "outdoor").when(z == 2, "both").when(z == 3, "primarily_outdoor").when(z == 4, "virtual")
    p = table(spark, d, "part").where("p_size <> 50").select(F.col("p_partkey").alias("l_partkey"), setting.alias("setting"))
    return locations.rain_pivot(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), p, "l_partkey", "setting").groupBy("verdict").agg(F.count("*").alias("sessions"))


@_query("""WITH l AS (SELECT l_partkey, max(CAST(l_shipdate AS DATE)) AS last FROM lineitem WHERE l_tax > 0.02 GROUP BY 1)
SELECT p_partkey, CASE WHEN p_size <> 7 THEN coalesce(s_name, 'Provider unknown') ELSE 'Provider unknown' END AS provider_name, last AS last_verified, CASE p_size % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS ramp FROM part LEFT JOIN l ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = p_partkey % 13 WHERE p_size % 3 = 0""")
def access_overlay(spark, d):
    """Programs whose access facts are known, with the day of the last check."""
    z = F.col("p_size")
    p = table(spark, d, "part").select("p_partkey", F.when(z != 7, F.col("p_partkey") % 13).alias("s_suppkey"), F.when(z % 3 == 0, "yes").when(z % 3 == 1, "no").otherwise("?").alias("ramp"))
    s = table(spark, d, "lineitem").where("l_tax > 0.02").select(F.col("l_partkey").alias("p_partkey"), F.to_date("l_shipdate").alias("checked"))
    rows = locations.access_rows(p, table(spark, d, "supplier").select("s_suppkey", "s_name"), s, "p_partkey", "s_suppkey", "s_name", "checked", ["ramp"])
    return rows.where(locations.passes_toggles(["ramp"]))


_PRICES = """SELECT l_suppkey AS v, CASE l_linenumber % 4 WHEN 0 THEN 'addon' WHEN 1 THEN 'admission' WHEN 2 THEN 'promotion' ELSE 'package' END AS kind, CASE l_linenumber % 5 WHEN 0 THEN 'child' WHEN 1 THEN 'infant' WHEN 2 THEN 'adult' WHEN 3 THEN 'non_participant' ELSE 'other' END AS who,
 l_extendedprice AS amount, l_tax > 0.04 AS req, CASE WHEN l_discount > 0.05 THEN 'per_child' ELSE 'unknown' END AS basis, l_returnflag <> 'R' AS verified, strftime(l_shipdate, '%Y-%m-%d') AS valid_to FROM lineitem"""


def _prices(spark, d):
    n = F.col("l_linenumber")
    kind = F.when(n % 4 == 0, "addon").when(n % 4 == 1, "admission").when(n % 4 == 2, "promotion").otherwise("package")
    who = F.when(n % 5 == 0, "child").when(n % 5 == 1, "infant").when(n % 5 == 2, "adult").when(n % 5 == 3, "non_participant").otherwise("other")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("v"), kind.alias("kind"), who.alias("who"), F.col("l_extendedprice").alias("amount"), (F.col("l_tax") > 0.04).alias("req"), F.when(F.col("l_discount") > 0.05, "per_child").otherwise("unknown").alias("basis"), (F.col("l_returnflag") != "R").alias("verified"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("valid_to"))


@_query(f"WITH p AS ({_PRICES}) SELECT v, kind, count(*) AS lines, min({_cents('amount')}) AS least_cents, max({_cents('amount')}) AS most_cents FROM p WHERE verified AND (kind <> 'promotion' OR valid_to >= '1997-01-01') GROUP BY ALL")
def price_sections(spark, d):
    """A venue's live prices by section; past promotions don't show."""
    p = _prices(spark, d)
    return venue_facts.price_sections(p, "v", "kind", "amount", venue_facts.live_price(F.col("verified"), F.col("kind"), F.col("valid_to"), F.lit("1997-01-01")))


@_query(f"""WITH p AS ({_PRICES}) SELECT v, count(*) FILTER (kind = 'admission' AND who IN ('child', 'infant', 'other')) AS child, count(*) FILTER (kind = 'admission' AND who IN ('adult', 'other')) AS adult, count(*) FILTER (kind = 'admission' AND who = 'non_participant') AS watching,
 count(*) FILTER (kind = 'addon' AND req AND basis <> 'unknown') AS required, count(*) FILTER (kind = 'addon' AND req AND basis = 'unknown') AS unpriced FROM p WHERE verified GROUP BY v HAVING child > 0""")
def cost_options(spark, d):
    """What a family's estimate can use of a venue's prices."""
    return venue_facts.cost_options(_prices(spark, d).where("verified"), "v", "kind", "who", "req", "basis")
