"""Queries on page facts, reviews and ingestion cycles, each with its SQL; cells are derived from columns by plain arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from sorrel.functions import pages
from sorrel.operators import ingest
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


@_query("""WITH x AS (SELECT o_orderkey, o_orderkey % 9 AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CASE WHEN d < DATE '1995-01-01' AND k IN (0, 1) THEN 'deadline_passed' WHEN k = 2 THEN 'closed' WHEN k = 3 OR d > DATE '1997-01-01' THEN 'not_yet_open' WHEN k = 4 THEN 'read' WHEN k IN (5, 6) THEN 'full' WHEN k = 7 THEN 'available' WHEN k = 8 THEN 'open' ELSE 'ask' END AS spots FROM x""")
def spots_shown(spark, d):
    """Which fact about a session's places a page shows."""
    k, day = F.col("o_orderkey") % 9, F.to_date("o_orderdate")
    status = F.when(k == 2, "registration_closed").when(k == 3, "not_yet_open").when(k == 5, "waitlist").when(k == 8, "registration_open")
    seat = F.when(k == 6, "confirmed_full").when(k == 7, "confirmed_available")
    today = F.lit("1997-01-01").cast("date")
    deadline = F.when(k < 2, F.date_add(day, 731))  # 1995-01-01 and two years
    return table(spark, d, "orders").select("o_orderkey", pages.spots_state(status, seat, day, deadline, today, F.when(k == 4, "3 spots left")).alias("spots"))


@_query("""WITH s AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'pending' ELSE 'approved' END AS status, CASE WHEN c_custkey % 6 = 1 THEN DATE '1997-05-05' END AS pub FROM customer WHERE c_acctbal < 8000),
n AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'fix' WHEN 1 THEN 'declined' ELSE 'approved' END AS status, CASE WHEN c_custkey % 8 < 2 THEN 'why' ELSE ' ' END AS note FROM customer WHERE c_acctbal > 0),
j AS (SELECT coalesce(s.k, n.k) AS k, s.status AS old, n.status AS new, n.note, pub, coalesce(n.status IN ('fix', 'declined') AND trim(n.note) = '', FALSE) AS refused FROM s FULL JOIN n ON s.k = n.k),
u AS (SELECT k, refused, pub, coalesce(CASE WHEN new IS NOT NULL AND NOT refused THEN new ELSE old END, 'pending') AS status FROM j)
SELECT k AS c_custkey, status, refused, CASE WHEN status = 'approved' AND pub IS NULL AND k % 2 = 0 THEN DATE '1998-01-01' ELSE pub END AS published_on FROM u""")
def review_decisions(spark, d):
    """Review decisions merged into their state, then a batch published."""
    k, c = F.col("c_custkey"), table(spark, d, "customer").select("c_custkey", "c_acctbal")
    none = F.lit(None).cast("string")
    state = c.where("c_acctbal < 8000").select("c_custkey", F.when(k % 3 == 0, "pending").otherwise("approved").alias("status"), none.alias("note"), F.lit(None).cast("date").alias("decided_on"), F.when(k % 6 == 1, F.lit("1997-05-05").cast("date")).alias("published_on"))
    new = c.where("c_acctbal > 0").select("c_custkey", F.when(k % 4 == 0, "fix").when(k % 4 == 1, "declined").otherwise("approved").alias("status"), F.when(k % 8 < 2, "why").otherwise(" ").alias("note"), F.lit("1998-01-01").cast("date").alias("decided_on"))
    merged = ingest.decide_review(state, new, "c_custkey")
    return ingest.publish_batch(merged, c.where("c_custkey % 2 = 0"), "c_custkey", F.lit("1998-01-01").cast("date")).select("c_custkey", "status", "refused", "published_on")


@_query("""SELECT r_regionkey, n_nationkey, s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 0 AND r_name <> 'AFRICA'""")
def live_place_types(spark, d):
    """Live place types of categories that aren't parked."""
    categories = table(spark, d, "region").select("r_regionkey", F.when(F.col("r_name") == "AFRICA", "parked").otherwise("live").alias("status"))
    subcategories = table(spark, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey")
    types = table(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("n_nationkey"), F.when(F.col("s_acctbal") > 0, "Live").otherwise("Draft").alias("discover_status"))
    return ingest.live_types(categories, subcategories, types, "r_regionkey", "n_nationkey").select("r_regionkey", "n_nationkey", "s_suppkey", "s_name")


@_query("""WITH t AS (SELECT user_id, event_type AS item, count(*) % 2 = 1 AS saved, max(ts) AS ts FROM events GROUP BY ALL), m AS (SELECT user_id, event_type AS item, max(ts) AS seen, arg_max(value < 70, (ts, value < 70)) AS marked FROM events WHERE value > 30 GROUP BY ALL)
SELECT user_id, item, CASE WHEN marked THEN seen END AS registered_at FROM t LEFT JOIN m USING (user_id, item) WHERE saved""")
def registered_marks(spark, d):
    """Toggled items that are saved, with the parent's own mark that the child is registered."""
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("item"), "ts", "value")
    saved = ingest.toggled(e, "user_id", "item", "ts").where("saved").select("user_id", "item")
    return ingest.marked_registered(saved, e.where("value > 30").select("user_id", "item", "ts", (F.col("value") < 70).alias("marked")), "user_id", "item", "ts")


@_query("""SELECT l_returnflag, l_orderkey, l_linenumber, place FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber) AS place FROM lineitem WHERE l_linestatus = 'F') WHERE place <= 25""")
def reviewed_latest(spark, d):
    """The candidates of each kind that were reviewed last (the limit is the feature)."""
    li = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"))
    return ingest.reviewed_latest(li, "l_returnflag", "at", "key", 25).select("l_returnflag", "l_orderkey", "l_linenumber", "place")


@_query()
def watched_pages(spark, d):
    """The text of pages that a watch compares, without navigation (tested against a plain version)."""
    return table(spark, d, "pages").select("page_id", pages.watch_text(F.col("html")).alias("watched"))
