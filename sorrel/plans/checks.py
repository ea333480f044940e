"""Queries on single rules (enums, ages, hours, links, gates, agreement), each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sorrel.functions import ages, dates, logic, registration
from sorrel.operators import cycles, summaries
from sorrel.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


@_query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'unknown' END AS segment,
 CASE WHEN c_custkey % 3 = 0 THEN 'unknown' WHEN c_custkey % 3 = 1 THEN 'yes' ELSE 'no' END AS fact FROM customer""")
def enum_values(spark, d):
    """Listed values stay, others are unknown, null stays null; nullable flags are yes, no or unknown."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", logic.enum_or_null(F.when(k % 5 != 0, F.col("c_mktsegment")), ("BUILDING", "MACHINERY")).alias("segment"), logic.tri_of(F.when(k % 3 != 0, k % 3 == 1)).alias("fact"))


@_query("""WITH x AS (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_size % 6 END AS lo, CASE WHEN p_size % 5 <> 0 THEN p_size % 6 + p_size % 9 END AS hi FROM part),
y AS (SELECT p_partkey, lo IS NULL AND hi IS NULL OR coalesce(lo > hi, FALSE) AS unknown, coalesce(lo > 4, FALSE) OR coalesce(hi < 4, FALSE) AS no4, coalesce(lo > 9, FALSE) OR coalesce(hi < 9, FALSE) AS no9 FROM x)
SELECT p_partkey, CASE WHEN unknown THEN 'unknown' WHEN no4 OR no9 THEN 'no' ELSE 'yes' END AS fit, CASE WHEN unknown THEN 'unknown' WHEN no4 THEN 'no' WHEN no9 THEN 'no' ELSE 'yes' END AS worst FROM y""")
def family_fits(spark, d):
    """Whether all children of a family fit a session's ages, and the worst of their fits."""
    z = F.col("p_size")
    lo, hi = F.when(z % 7 != 0, z % 6), F.when(z % 5 != 0, z % 6 + z % 9)
    each = F.array(*[ages.age_fits(F.lit(a), lo, hi) for a in (4, 9)])
    return table(spark, d, "part").select("p_partkey", ages.family_fits([4, 9], lo, hi).alias("fit"), logic.worst(each).alias("worst"))


@_query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE (o_orderkey % 24) * 60 + o_orderkey % 60 END AS o, (o_custkey % 24) * 60 + o_custkey % 60 AS c, o_custkey % 2 = 0 AS nd FROM orders)
SELECT o_orderkey, CAST(o AS INT) AS opens, coalesce(o < 1050 AND c + CASE WHEN nd THEN 1440 ELSE 0 END > 930, FALSE) AS after_school, coalesce(o <= 540 AND c >= 960, FALSE) AS core FROM x""")
def hours_windows(spark, d):
    """Clock texts as minutes, against a window and against the hours that a family needs."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    opens = dates.clock_minutes(F.when(k % 6 == 5, "25:00").otherwise(F.format_string("%d:%02d", k % 24, k % 60)))
    closes = dates.clock_minutes(F.format_string("%02d:%02d", c % 24, c % 60))
    return table(spark, d, "orders").select("o_orderkey", opens.alias("opens"), dates.clock_overlaps(opens, closes, c % 2 == 0, 930, 1050).alias("after_school"), F.coalesce((opens <= 540) & (closes >= 960), F.lit(False)).alias("core"))


@_query("""WITH n AS (SELECT CAST(timezone('America/Toronto', timezone('UTC', max(ts))) AS DATE) AS today FROM events), s AS (SELECT DISTINCT user_id % 211 AS system FROM events, n WHERE CAST(timezone('America/Toronto', timezone('UTC', ts)) AS DATE) = today AND event_type IN ('error', 'click'))
SELECT c_custkey, CAST(c_custkey % 211 AS BIGINT) AS booking_system FROM customer WHERE c_custkey % 211 NOT IN (SELECT system FROM s)""")
def running_systems(spark, d):
    """References of booking systems that haven't refused a reading today."""
    e = table(spark, d, "events")
    now = F.lit(e.agg(F.max("ts").alias("now")).first()["now"])  # one instant
    runs = e.select((F.col("user_id") % 211).alias("booking_system"), F.col("ts").alias("ran_at"), F.when(F.col("event_type") == "error", "stopped:403").when(F.col("event_type") == "click", "stopped:429 slow down").otherwise("ok").alias("outcome"))
    return cycles.without_stopped(table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 211).alias("booking_system")), runs, now).select("c_custkey", F.col("booking_system").cast("long"))


@_query("""WITH i AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_returnflag = 'N' OR l_suppkey % 3 = 0), r AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber IN (SELECT id FROM i) AS seen FROM lineitem), s AS (SELECT l_suppkey, avg(CASE WHEN seen THEN 1.0 ELSE 0 END) AS share FROM r GROUP BY 1)
SELECT l_suppkey, count(*) AS removed FROM r JOIN s USING (l_suppkey) WHERE NOT seen AND share >= 0.5 GROUP BY 1""")
def removed_sessions(spark, d):
    """Catalog rows that a source stopped showing, where it still shows half of its rows."""
    li = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_returnflag")
    seen = li.where((F.col("l_returnflag") == "N") | (F.col("l_suppkey") % 3 == 0)).select("id")
    return cycles.removed_candidates(li.select("l_suppkey", "id"), seen, "l_suppkey", "id").groupBy("l_suppkey").agg(F.count("*").alias("removed"))


@_query("""WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE o_orderkey % 4 WHEN 0 THEN 'sent' WHEN 1 THEN 'opted_out' WHEN 2 THEN 'reviewed' ELSE 'sent' END AS s, o_custkey % 3 AS n FROM orders)
SELECT o_orderkey, CASE WHEN s IN ('opted_out', 'reviewed') THEN s WHEN d + 60 < DATE '1996-01-01' THEN 'expired' ELSE 'ok' END AS link, s = 'sent' AND n = 1 AND DATE '1996-01-01' - d >= 7 AS reminder FROM x""")
def invitations(spark, d):
    """What an invitation's link does, and whether a reminder is due."""
    k, day, today = F.col("o_orderkey") % 4, F.to_date("o_orderdate"), F.lit("1996-01-01").cast("date")
    status = F.when(k == 1, "opted_out").when(k == 2, "reviewed").otherwise("sent")
    return table(spark, d, "orders").select("o_orderkey", registration.link_status(status, F.date_add(day, 60), today).alias("link"), registration.reminder_due(status, F.col("o_custkey") % 3, day, today).alias("reminder"))


@_query("""SELECT l_orderkey, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS flag, CASE WHEN min(l_tax) = max(l_tax) THEN min(l_tax) END AS tax FROM lineitem GROUP BY l_orderkey""")
def agreed_values(spark, d):
    """A value that all of a group's rows state."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(summaries.agreed("l_returnflag").alias("flag"), summaries.agreed("l_tax").alias("tax"))


@_query("""WITH x AS (SELECT event_id, date_trunc('second', ts) AS ts, event_type = 'view' AS weekly, event_type <> 'error' AS active FROM events), n AS (SELECT max(ts) AS now FROM x)
SELECT event_id, active AND CASE WHEN weekly THEN epoch(now) - epoch(ts) >= 604800 ELSE CAST(timezone('America/Toronto', timezone('UTC', ts)) AS DATE) <> CAST(timezone('America/Toronto', timezone('UTC', now)) AS DATE) END AS due,
 hour(timezone('America/Toronto', timezone('UTC', ts))) = 7 AS digest FROM x, n""")
def watch_due(spark, d):
    """Watched sources that are due by their rhythm, and the hour of the digest."""
    e = table(spark, d, "events").select("event_id", "event_type", F.date_trunc("second", "ts").alias("ts"))
    now = F.lit(e.agg(F.max("ts").alias("now")).first()["now"])  # one instant
    return e.select("event_id", cycles.watch_due(F.col("event_type") != "error", F.when(F.col("event_type") == "view", "weekly").otherwise("daily"), F.col("ts"), now).alias("due"), cycles.digest_hour(F.col("ts")).alias("digest"))
