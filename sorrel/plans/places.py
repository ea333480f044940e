"""Queries on venues, registration, costs, reviews and free text, each with its SQL.

The driver's tables have no venues or free-text cells, so each query first derives them from columns
by plain arithmetic; the SQL computes the answer from the same columns without parsing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.functions import money, normalize, registration, venues
from sorrel.operators import costs, review, search, views
from sorrel.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


_GROUP_SQL = ", ".join(
    f"CASE WHEN (mm IS NOT NULL OR my IS NOT NULL) AND coalesce(low <= my, TRUE) AND coalesce(my >= {lo}, TRUE){f' AND low <= {hi}' if hi is not None else ''} THEN '{name}' END"
    for name, lo, hi in venues.AGE_GROUPS
)


@_query(f"""WITH v AS (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_size * 4 END AS mm, CASE WHEN p_size % 5 <> 0 THEN p_size % 13 + 2 END AS my, CASE WHEN p_partkey % 4 = 0 THEN 6 END AS hard, p_partkey % 7 + 1 AS wd,
 360 + p_size * 15 AS o, (600 + p_size * 35) % 1440 AS c, 600 + p_size * 35 >= 1440 AS nd, p_retailprice / 60 AS price FROM part), w AS (SELECT *, greatest(coalesce(mm / 12, 0), coalesce(hard, 0)) AS low FROM v),
x AS (SELECT *, concat_ws('|', {_GROUP_SQL}) AS groups, concat_ws('|', CASE WHEN wd <= 5 AND o < 720 THEN 'weekday_mornings' END, CASE WHEN wd <= 5 AND o < 1050 AND c + CASE WHEN nd THEN 1440 ELSE 0 END > 930 THEN 'after_school' END,
 CASE WHEN wd >= 6 THEN 'weekends' END, CASE WHEN nd OR c > 1140 THEN 'evenings' END) AS windows FROM w)
SELECT p_partkey, groups, windows, groups LIKE '%toddlers%' AND (groups LIKE '%kids%' OR groups LIKE '%tweens%') AS mixed, windows LIKE '%weekday_mornings%' AND price < 15 AS rainy FROM x""")
def venue_facets(spark, d):
    """Age groups, opening times and two combined facets of places."""
    size, k = F.col("p_size"), F.col("p_partkey")
    closes = 600 + size * 35
    v = table(spark, d, "part").select(
        "p_partkey", venues.age_groups(F.when(size % 7 != 0, size * 4), F.when(size % 5 != 0, size % 13 + 2), F.when(k % 4 == 0, 6)).alias("g"), money.price_band(F.col("p_retailprice") / 60).alias("band"),
        venues.when_windows(F.array(F.struct((k % 7 + 1).alias("weekday"), (360 + size * 15).alias("opens"), (closes % 1440).alias("closes"), (closes >= 1440).alias("next_day")))).alias("w"),
    )
    return v.select("p_partkey", F.array_join("g", "|").alias("groups"), F.array_join("w", "|").alias("windows"), venues.mixed_ages(F.col("g")).alias("mixed"), venues.rainy_weekday_morning(F.col("w"), F.col("band")).alias("rainy"))


@_query("""SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_size % 3 = 0 AND p_retailprice > 950""")
def venue_filter(spark, d):
    """Facets of several kinds at once; a flag must be known to be true."""
    v = table(spark, d, "part").select("p_partkey", F.array("p_brand").alias("brands"), F.when(F.col("p_size") % 3 == 0, "x").otherwise("y").alias("mode"), F.when(F.col("p_retailprice") > 950, True).alias("cafe"))
    return v.where(venues.facet_filter({"brands": ["Brand#11", "Brand#12", "Brand#13"]}, {"mode": "x"}, ["cafe"])).select("p_partkey")


@_query("""WITH r AS (SELECT o_custkey, isodow(o_orderdate) AS weekday, CASE WHEN month(o_orderdate) % 2 = 0 THEN '9-5' ELSE '10-6' END AS slot FROM orders), d AS (SELECT o_custkey, weekday, array_to_string(list_sort(list(DISTINCT slot)), ', ') AS slots FROM r GROUP BY ALL),
s AS (SELECT *, CASE WHEN lag(weekday) OVER w = weekday - 1 AND lag(slots) OVER w = slots THEN 0 ELSE 1 END AS starts FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY weekday)), i AS (SELECT *, sum(starts) OVER (PARTITION BY o_custkey ORDER BY weekday) AS island FROM s)
SELECT o_custkey, CAST(min(weekday) AS INT) AS first_day, CAST(max(weekday) AS INT) AS last_day, min(slots) AS slots FROM i GROUP BY o_custkey, island""")
def hours_islands(spark, d):
    """Consecutive weekdays with equal hours as one run."""
    o = table(spark, d, "orders").select("o_custkey", (F.weekday("o_orderdate") + 1).alias("weekday"), F.when(F.month("o_orderdate") % 2 == 0, "9-5").otherwise("10-6").alias("slot"))
    return views.weekly_hours(o, "o_custkey")


@_query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS heading FROM events")
def headings_carried(spark, d):
    """Each row with the last heading above it."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return views.carry_down(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.when(F.col("event_type") == "signup", F.col("event_id"))).select("event_id", "heading")


@_query("""WITH f AS (SELECT c_nationkey AS k, c_mktsegment AS item, min(c_name) AS v FROM customer GROUP BY ALL), n AS (SELECT n_nationkey FROM nation), l AS (SELECT unnest(['BUILDING', 'MACHINERY', 'PARKING']) AS item)
SELECT n_nationkey, l.item, coalesce(v, 'unknown') AS v, TRUE AS listed FROM n, l LEFT JOIN f ON f.k = n_nationkey AND f.item = l.item UNION ALL SELECT k, item, v, FALSE FROM f WHERE item NOT IN ('BUILDING', 'MACHINERY', 'PARKING')""")
def amenity_checklist(spark, d):
    """A fixed list of items for every place, unknown where nothing is stated, then what else is stated."""
    facts = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("item"), F.col("c_name").alias("v"))
    return views.checklist(table(spark, d, "nation").select("n_nationkey"), facts, "n_nationkey", "item", "v", ["BUILDING", "MACHINERY", "PARKING"])


@_query("""SELECT l_suppkey, l_returnflag, count(DISTINCT l_partkey % 4) AS sources, CASE WHEN min(l_linestatus) <> max(l_linestatus) THEN 'mixed' WHEN count(DISTINCT l_partkey % 4) >= 2 THEN max(l_linestatus) ELSE 'thin' END AS verdict FROM lineitem WHERE l_partkey % 4 <> 3 GROUP BY ALL""")
def experience_themes(spark, d):
    """Themes with enough agreeing sources."""
    t = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", (F.col("l_partkey") % 4).alias("source"), "l_linestatus")
    return views.experience(t, spark.range(3).select(F.col("id").alias("source")), "l_suppkey", "l_returnflag", "source", "l_linestatus")


@_query("""SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, coalesce(nullif(split_part(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/', 2), ''), 'root') AS label, count(*) AS pages FROM pages GROUP BY ALL""")
def source_sections(spark, d):
    """Pages by host and first section."""
    path = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    p = table(spark, d, "pages").select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.coalesce(F.nullif(F.split_part(path, F.lit("/"), F.lit(2)), F.lit("")), F.lit("root")).alias("label"))
    return p.groupBy("host", "label").agg(F.count("*").alias("pages"))


@_query("""WITH b AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'P'), j AS (SELECT CASE WHEN l_tax > 0.06 THEN NULL ELSE l_quantity <= 25 END AS fits FROM lineitem JOIN b ON CAST(l_shipdate AS DATE) = day)
SELECT CASE WHEN fits IS NULL THEN 'unknown' WHEN fits THEN 'fits' ELSE 'refused' END AS fit, count(*) AS sessions FROM j GROUP BY ALL""")
def break_days(spark, d):
    """Sessions on break days that fit, and why the others don't."""
    days = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.to_date("o_orderdate").alias("day")).distinct()
    s = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), "l_quantity", "l_tax")
    return views.breaks_with_programs(days, s, "day", F.when(F.col("l_tax") <= 0.06, F.col("l_quantity") <= 25))[1]


@_query("""WITH l AS (SELECT user_id, event_type AS item, max(ts) AS ts, arg_max(CASE WHEN value < 50 THEN 'save' ELSE 'remove' END, (ts, CASE WHEN value < 50 THEN 'save' ELSE 'remove' END)) AS k FROM events GROUP BY ALL),
s AS (SELECT user_id, item, ts, CASE WHEN k = 'save' THEN 'active' ELSE 'past' END AS state FROM l) SELECT * FROM s QUALIFY state = 'active' OR row_number() OVER (PARTITION BY user_id, state ORDER BY ts DESC, item) <= 1""")
def shortlist_state(spark, d):
    """Saved items after all actions; one removed item a user is remembered."""
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("item"), "ts", F.when(F.col("value") < 50, "save").otherwise("remove").alias("kind"))
    return views.saved_state(e, "user_id", "item", "ts", "kind", 1).select("user_id", "item", "ts", "state")


@_query("""WITH a AS (SELECT c_custkey, [c_custkey * 3, c_custkey * 7 % 200, c_custkey * 3, 999999999] AS ids FROM customer), e AS (SELECT c_custkey, unnest(list_distinct(ids)) AS id, ids FROM a),
p AS (SELECT c_custkey, id, row_number() OVER (PARTITION BY c_custkey ORDER BY list_position(ids, id)) - 1 AS position FROM e)
SELECT c_custkey, CAST(position AS INT) AS position, CAST(id AS VARCHAR) AS p_partkey, b.p_partkey IS NOT NULL AS found, p_brand FROM p LEFT JOIN part b ON b.p_partkey = id""")
def compare_asked(spark, d):
    """Asked ids in their order, each once, with what the catalog has."""
    k = F.col("c_custkey")
    asked = table(spark, d, "customer").select("c_custkey", F.concat_ws(", ", k * 3, k * 7 % 200, k * 3, F.lit("999999999")).alias("ids"))
    return views.compare_columns(asked, table(spark, d, "part").select("p_partkey", "p_brand"), "c_custkey", "ids", "p_partkey", ["p_brand"])


@_query("""WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'confirmed_full' WHEN 'O' THEN 'confirmed_available' END AS seat, ['registration_open', 'registration_closed', 'no_upcoming_dates', 'waitlist', 'not_yet_open', 'availability_unknown', 'other'][CAST(o_orderkey % 7 AS INT) + 1] AS status,
 CASE WHEN o_custkey % 3 <> 0 THEN 'https://r/' || o_custkey END AS r, CASE WHEN o_custkey % 2 = 0 THEN 'https://w/' || o_custkey END AS w FROM orders)
SELECT o_orderkey, CASE WHEN seat = 'confirmed_full' OR status = 'registration_closed' THEN CASE WHEN w IS NOT NULL THEN 'waitlist' ELSE 'full_or_closed' END WHEN status = 'other' THEN 'availability_unknown' ELSE status END AS state,
 CASE WHEN seat = 'confirmed_full' OR status IN ('registration_closed', 'waitlist') THEN w ELSE r END AS url FROM x""")
def registration_actions(spark, d):
    """What each session's button does."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    seat = F.when(F.col("o_orderstatus") == "F", "confirmed_full").when(F.col("o_orderstatus") == "O", "confirmed_available")
    status = F.get(F.array(*map(F.lit, (*registration.STATES, "other"))), (k % 7).cast("int"))
    a = registration.registration_action(seat, status, F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("https://r/"), c)), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("https://w/"), c)))
    return table(spark, d, "orders").select("o_orderkey", a.alias("a")).select("o_orderkey", "a.state", "a.url")


@_query("""WITH n AS (SELECT date_trunc('second', max(ts)) AS now FROM events), x AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'unknown' WHEN 'view' THEN 'full' WHEN 'click' THEN 'waitlist' ELSE 'available' END AS state, CASE WHEN user_id % 5 = 0 THEN NULL ELSE event_id % 8 END AS spots, epoch(now) - epoch(date_trunc('second', ts)) AS age, timezone('America/Toronto', timezone('UTC', ts)) AS seen FROM events, n)
SELECT event_id, CASE WHEN state = 'unknown' OR age >= 604800 THEN NULL WHEN state = 'full' OR (state = 'available' AND spots = 0) THEN 'Full' WHEN state = 'waitlist' THEN 'Full · waitlist open' WHEN age >= 7200 OR spots IS NULL THEN 'Spots available' ELSE spots || CASE WHEN spots = 1 THEN ' spot left' ELSE ' spots left' END END || ' · checked ' || CASE WHEN age < 7200 THEN lower(strftime(seen, '%-I:%M %p')) ELSE strftime(seen, '%b %-d') END AS text,
 CASE WHEN state = 'unknown' OR age >= 604800 THEN NULL WHEN state = 'full' OR state = 'waitlist' OR spots = 0 THEN 'full' WHEN age >= 7200 OR spots IS NULL OR spots > 5 THEN 'open' ELSE 'warning' END AS tone FROM x""")
def seat_lines(spark, d):
    """Seat lines of readings, by their age."""
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", F.date_trunc("second", "ts").alias("ts"))
    now = F.lit(e.agg(F.max("ts").alias("now")).first()["now"])  # one instant
    kind = F.col("event_type")
    state = F.when(kind == "error", "unknown").when(kind == "view", "full").when(kind == "click", "waitlist").otherwise("available")
    line = registration.seat_line(state, F.when(F.col("user_id") % 5 != 0, F.col("event_id") % 8), F.col("ts"), F.lit(None).cast("date"), now)
    return e.select("event_id", line.alias("l")).select("event_id", "l.text", "l.tone")


@_query("""WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS e, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 3 AND year(s) <> year(e) AND month(s) <= month(e) THEN NULL ELSE s END AS start_day, CASE WHEN k = 2 THEN NULL ELSE e END AS end_day, CASE WHEN k = 2 THEN 0.7 WHEN k = 3 THEN 0.9 ELSE 0.97 END::DOUBLE AS confidence FROM x WHERE NOT (k = 3 AND year(s) <> year(e) AND month(s) <= month(e))""")
def free_text_dates(spark, d):
    """Date ranges written in four ways, read back."""
    s, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    e = F.date_add(s, (F.col("o_orderkey") % 40).cast("int"))
    text = (
        F.when(k == 0, F.concat(F.lit("Runs "), s.cast("string"), F.lit(" to "), e.cast("string"))).when(k == 1, F.concat(F.date_format(s, "MMMM d, yyyy"), F.lit(" – "), F.date_format(e, "MMM d, yyyy")))
        .when(k == 2, F.concat(F.lit("on "), F.date_format(s, "MMM. d, yyyy"))).otherwise(F.concat(F.date_format(s, "MMMM d"), F.lit("th through "), F.date_format(e, "MMMM d, yyyy")))
    )
    r = table(spark, d, "orders").select("o_orderkey", F.explode(F.array_compact(F.array(normalize.date_range(text)))).alias("r"))  # a condition would read each text a second time
    return r.select("o_orderkey", F.col("r.start").alias("start_day"), F.col("r.end").alias("end_day"), "r.confidence")


@_query("""SELECT p_partkey, CAST(h * 60 + m AS INT) AS start_minute, CAST(CASE WHEN e > 12 THEN e ELSE e + 12 END * 60 AS INT) AS end_minute, CAST(floor((p_retailprice * 100) + 0.5) AS BIGINT) AS cents, CASE p_partkey % 3 WHEN 0 THEN 'per_week' WHEN 1 THEN 'per_day' END AS unit, p_partkey % 2 = 0 AS tax_extra
FROM (SELECT *, 7 + p_size % 4 AS h, 7 + 2 * (p_size % 4) AS e, 5 * (p_size % 12) AS m FROM part)""")
def free_text_cells(spark, d):
    """Clock ranges and prices written as text, read back."""
    size, k = F.col("p_size"), F.col("p_partkey")
    hour, end = 7 + size % 4, 7 + size % 4 * 2
    clock = F.concat(F.format_string("%d:%02d a.m. until ", hour, 5 * (size % 12)), F.format_string("%d pm", F.when(end > 12, end - 12).otherwise(end)))
    cell = F.concat(F.lit("from $"), F.format_number("p_retailprice", 2), F.when(k % 3 == 0, " a week").when(k % 3 == 1, " / day").otherwise(""), F.when(k % 2 == 0, " + HST").otherwise(""))
    p = table(spark, d, "part").select("p_partkey", normalize.time_range(clock).alias("t"), normalize.price(cell).alias("c"))
    return p.select("p_partkey", F.col("t.start").alias("start_minute"), F.col("t.end").alias("end_minute"), "c.cents", "c.unit", "c.tax_extra")


@_query("""WITH d AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'rejected' WHEN l_tax > 0.05 THEN 'needs_followup' ELSE 'approved' END AS v FROM lineitem)
SELECT l_orderkey, CASE WHEN bool_and(v = 'approved') THEN 'fully_approved' WHEN bool_and(v = 'rejected') THEN 'rejected' WHEN bool_or(v = 'rejected') THEN 'partially_approved' ELSE 'needs_followup' END AS outcome, CASE WHEN bool_and(v = 'approved') THEN 'approved' WHEN bool_and(v = 'rejected') THEN 'rejected' ELSE 'needs_review' END AS status FROM d GROUP BY l_orderkey""")
def review_outcomes(spark, d):
    """How reviews end, from their field decisions."""
    v = F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_tax") > 0.05, "needs_followup").otherwise("approved")
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(review.review_outcome(v).alias("outcome"))
    return g.withColumn("status", review.queue_status(F.col("outcome")))


@_query("""WITH x AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'not_modified' WHEN 'click' THEN 'blocked' ELSE 'success' END AS s, event_id % 6 <> 0 AS has, CASE WHEN event_id % 4 <> 0 THEN user_id % 3 END AS o, user_id % 2 AS n, event_id % 5 = 0 AS older FROM events)
SELECT event_id, CASE WHEN s = 'blocked' THEN 'fetch_blocked' WHEN s = 'error' THEN 'fetch_error' WHEN s = 'not_modified' AND has AND older THEN 'fingerprint_rebaseline' WHEN s = 'not_modified' THEN 'fetch_not_modified' WHEN NOT has THEN 'no_content' WHEN o IS NULL THEN 'no_previous_hash'
 WHEN o = n AND older THEN 'fingerprint_rebaseline' WHEN o = n THEN 'content_unchanged' ELSE 'content_changed' END AS reason FROM x""")
def extraction_gate(spark, d):
    """Why a fetched snapshot is extracted or not."""
    kind, k = F.col("event_type"), F.col("event_id")
    s = F.when(kind == "error", "error").when(kind == "view", "not_modified").when(kind == "click", "blocked").otherwise("success")
    g = review.extraction_decision(s, k % 6 != 0, F.when(k % 4 != 0, (F.col("user_id") % 3).cast("string")), (F.col("user_id") % 2).cast("string"), F.when(k % 5 == 0, "v1:sha256:0").otherwise("v2:sha256:0"))
    return table(spark, d, "events").select("event_id", g["reason"].alias("reason"))


@_query("""WITH x AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS nd, o_orderkey % 5 = 0 AS np, o_orderkey % 7 = 0 AS na, o_orderkey % 11 = 0 AS nl, o_orderkey % 2 = 0 AS onl, o_orderstatus = 'P' AS gone, o_orderkey % 4 AS c FROM orders)
SELECT o_orderkey, concat_ws('|', CASE WHEN nd THEN 'missing_dates' END, CASE WHEN np THEN 'missing_price' END, CASE WHEN na THEN 'missing_age' END, CASE WHEN nl AND NOT onl THEN 'missing_location' END, CASE WHEN c > 1 THEN 'ambiguous_match' END, CASE WHEN gone THEN 'possible_removed_session' END) AS flags,
 CASE WHEN c > 1 THEN 'AMBIGUOUS' WHEN c = 0 THEN 'NEW' WHEN gone OR o_orderkey % 13 = 0 THEN 'MATCHED_CHANGED' ELSE 'MATCHED_UNCHANGED' END AS outcome FROM x""")
def candidate_flags(spark, d):
    """Flags of records and matches in one order, and what they lead to."""
    k = F.col("o_orderkey")
    one = F.lit("x")
    fields = review.field_flags(one, F.when(k % 3 != 0, one), F.when(k % 5 != 0, 9), F.lit(1), F.when(k % 7 != 0, 2), F.when(k % 11 != 0, one), k % 2 == 0, one, F.when(F.col("o_orderstatus") == "P", "Cancelled"))
    match = F.when(k % 4 != 0, "m")
    flags = review.merge_flags(review.match_flags(match, F.lit(0.9), k % 4, F.lit(1), F.lit(0)), fields)
    t = table(spark, d, "orders").select("o_orderkey", flags.alias("f"), match.alias("m"))
    return t.select("o_orderkey", F.array_join("f", "|").alias("flags"), review.candidate_resolution(F.col("m"), k % 13 == 0, F.col("f"))["outcome"].alias("outcome"))


@_query("""WITH o AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS b, p_type AS t FROM part WHERE p_partkey % 5 <> 0), n AS (SELECT p_partkey, p_brand AS b, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'new' END AS t, p_size / 50.0 AS c FROM part),
j AS (SELECT n.p_partkey, c, CASE WHEN o.b IS NULL THEN 1 WHEN o.b <> n.b THEN 1 ELSE 0 END + CASE WHEN o.t <> n.t THEN 1 ELSE 0 END AS k FROM n JOIN o USING (p_partkey)) SELECT p_partkey, CAST(k AS BIGINT) AS changes, CASE WHEN k > 0 THEN c ELSE 1 END::DOUBLE AS confidence FROM j""")
def change_sets(spark, d):
    """Material changes of matched records and the weakest confidence among them."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    k = F.col("p_partkey")
    old = p.where("p_partkey % 5 <> 0").select("p_partkey", F.when(k % 3 != 0, F.col("p_brand")).alias("p_brand"), "p_type")
    new = p.select("p_partkey", "p_brand", F.when(k % 2 == 0, F.col("p_type")).otherwise("new").alias("p_type"), (F.col("p_size") / F.lit(50.0)).alias("confidence"))
    return review.change_set_confidence(review.change_set(old, new, "p_partkey", ["p_brand", "p_type"]), "p_partkey")


@_query("""WITH x AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN NOT c_acctbal > 0 THEN 'no balance' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'not a camp' END AS r FROM customer)
SELECT c_custkey, coalesce(r, CASE WHEN c_custkey > min(CASE WHEN r IS NULL THEN c_custkey END) OVER (PARTITION BY c_nationkey) THEN 'duplicate' END) AS reject FROM x""")
def intake_rows(spark, d):
    """Rows of an import, each kept or with the first reason why not."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return review.import_rows(c, "c_nationkey", "c_custkey", [("no balance", F.col("c_acctbal") > 0), ("not a camp", F.col("c_mktsegment") != "HOUSEHOLD")]).select("c_custkey", "reject")


_TICKETS = [("baby", 0, 2, 0, 0), ("toddler", 2, 4, 1200, 1), ("child", 3, 17, 1900, 1), ("teen", 13, 17, 2100, 0)]
_TICKET_SQL = "(VALUES " + ", ".join(map(str, _TICKETS)) + ") AS t(band, low, high, cost, inc)"


@_query(f"""WITH k AS (SELECT l_orderkey, row_number() OVER () AS id, CAST(l_quantity AS INT) % 20 AS age FROM lineitem), m AS (SELECT k.*, band, cost, inc FROM k LEFT JOIN {_TICKET_SQL} ON age BETWEEN low AND high QUALIFY row_number() OVER (PARTITION BY id ORDER BY high - low, cost, band) = 1),
g AS (SELECT l_orderkey, count(*) AS children, count(*) FILTER (band IS NULL) AS unmatched, count(*) FILTER (cost > 0) AS paying, CAST(coalesce(sum(cost), 0) AS BIGINT) AS tickets, CAST(coalesce(sum(inc), 0) AS BIGINT) AS covered, l_orderkey % 5 AS adults FROM m GROUP BY l_orderkey),
f AS (SELECT *, greatest(adults - covered, 0) AS extra_adults, tickets + greatest(adults - covered, 0) * 900 AS total FROM g),
o AS (SELECT *, CASE WHEN paying BETWEEN 1 AND 2 AND unmatched = 0 AND 3000 + greatest(adults - 2, 0) * 900 < total THEN 3000 + greatest(adults - 2, 0) * 900 END AS a, CASE WHEN paying BETWEEN 1 AND 4 AND unmatched = 0 AND 5500 + greatest(adults - 2, 0) * 900 < total THEN 5500 + greatest(adults - 2, 0) * 900 END AS b FROM f),
r AS (SELECT *, CASE WHEN a IS NOT NULL AND a <= coalesce(b, a) THEN 'small' WHEN b IS NOT NULL THEN 'large' END AS best_label, CAST(coalesce(least(a, b), total) AS BIGINT) AS best_total FROM o)
SELECT l_orderkey, children, unmatched, tickets, CAST(extra_adults AS BIGINT) AS extra_adults, CAST(total AS BIGINT) AS total, best_label, best_total, CAST(floor((best_total * 113 + 50) / 100) AS BIGINT) AS best_with_tax FROM r""")
def family_packages(spark, d):
    """Tickets by age, extra adults, and a package that must be strictly cheaper."""
    kids = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity").cast("int") % 20).alias("age"))
    families = kids.select("l_orderkey").distinct().withColumn("adults", F.col("l_orderkey") % 5)
    tickets = spark.createDataFrame(_TICKETS, "band string, low int, high int, cost int, adults_included int")
    return costs.family_price(kids, families, tickets, 900, [costs.Package("small", 2, 2, 3000), costs.Package("large", 4, 2, 5500)], "l_orderkey")


@_query("""WITH k AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) % 20 AS age FROM lineitem), f AS (SELECT *, (age + 1) * 12 > 18 AND age <= 15 AS fits FROM k), p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, fits ORDER BY age DESC, l_linenumber) AS place FROM f)
SELECT l_orderkey, count(*) FILTER (fits) AS eligible, count(*) FILTER (NOT fits) AS refused, CAST(sum(CASE WHEN NOT fits THEN 0 WHEN place = 1 THEN 2000 WHEN age <= 2 THEN 500 ELSE 1500 END) AS BIGINT) AS total FROM p GROUP BY l_orderkey""")
def sibling_rates(spark, d):
    """The eldest pays in full, siblings less."""
    kids = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 20).alias("age"))
    return costs.session_price(kids, 2000, 1500, 500, 2, 18, 15, "l_orderkey", "age", "l_linenumber")


@_query("""WITH x AS (SELECT p_partkey, ['child', 'adult', 'non_participant', 'any'][CAST(p_partkey % 4 AS INT) + 1] AS a, ['per_child', 'per_participant', 'per_person', 'per_booking', 'other'][CAST(p_partkey % 5 AS INT) + 1] AS b, p_size % 4 AS c, p_size % 3 AS p, p_size % 2 AS w FROM part)
SELECT p_partkey, CAST(CASE b WHEN 'per_child' THEN c WHEN 'per_participant' THEN CASE a WHEN 'child' THEN c WHEN 'adult' THEN p WHEN 'non_participant' THEN 0 ELSE c + p END WHEN 'per_person' THEN CASE a WHEN 'child' THEN c WHEN 'adult' THEN p + w WHEN 'non_participant' THEN w ELSE c + p + w END
 WHEN 'per_booking' THEN CASE WHEN c + p + w > 0 THEN 1 ELSE 0 END ELSE 0 END AS INT) AS quantity FROM x""")
def addon_quantities(spark, d):
    """How many of a required extra groups need."""
    k, size = F.col("p_partkey"), F.col("p_size")
    a = F.get(F.array(*map(F.lit, ("child", "adult", "non_participant", "any"))), (k % 4).cast("int"))
    b = F.get(F.array(*map(F.lit, ("per_child", "per_participant", "per_person", "per_booking", "other"))), (k % 5).cast("int"))
    return table(spark, d, "part").select("p_partkey", costs.addon_quantity(a, b, size % 4, size % 3, size % 2).cast("int").alias("quantity"))


@_query("""SELECT n_nationkey, CAST(CASE WHEN lower(n_name) LIKE 'a%' THEN 0 WHEN lower(r_name) LIKE 'a%' THEN 2 END AS INT) AS rank FROM nation JOIN region ON n_regionkey = r_regionkey WHERE lower(n_name) LIKE 'a%' OR lower(r_name) LIKE 'a%' OR lower(n_name) LIKE '% a%' """)
def location_search(spark, d):
    """Places ranked by how their name or region holds the query."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", views.location_rank(F.col("n_name"), F.col("r_name"), "A", F.col("r_regionkey").cast("string")).alias("rank")).where("rank IS NOT NULL")


@_query("""SELECT o_custkey, date_trunc('day', o_orderdate) AS start, count(*) AS orders, max(o_totalprice) AS top FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL""")
def daily_windows(spark, d):
    """Tumbling windows of a day, as the stream of the same rows gives them."""
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_custkey", "o_orderdate", "o_totalprice")
    return o.groupBy("o_custkey", F.window("o_orderdate", "1 day").alias("w")).agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("top")).select("o_custkey", F.col("w.start").alias("start"), "orders", "top")


@_query("""SELECT p_partkey, p_name FROM part WHERE lower(p_name || ' ' || p_brand || ' ' || p_type) LIKE '%red%' AND lower(p_name || ' ' || p_brand || ' ' || p_type) LIKE '%brand%'""")
def keyword_search(spark, d):
    """All words of a query, somewhere in a record's texts."""
    return table(spark, d, "part").where(search.keyword_match(["p_name", "p_brand", "p_type"], "Red brand")).select("p_partkey", "p_name")
