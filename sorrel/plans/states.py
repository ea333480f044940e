"""Queries on the states of sources, reviews, proposed fields, opening hours and siblings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sorrel.operators import records
from sorrel.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


@_query("""WITH l AS (SELECT user_id, max({'t': ts, 'e': event_id}) AS m, max(ts) FILTER (event_type = 'error') AS bad, max(ts) FILTER (event_type IN ('view', 'purchase')) AS good, max(ts) FILTER (event_type = 'signup') AS changed FROM events GROUP BY 1), x AS (SELECT l.user_id, event_type, value, bad, good, changed, m.t AS t FROM l JOIN events e ON e.event_id = m.e)
SELECT user_id, CASE WHEN event_type = 'click' AND value > 60 THEN 'Blocked' WHEN event_type = 'error' OR (bad IS NOT NULL AND (good IS NULL OR bad > good)) THEN 'Failed' WHEN CASE WHEN changed IS NOT NULL THEN changed >= t ELSE event_type <> 'click' AND value > 10 END THEN 'Changed' ELSE 'Healthy' END AS health FROM x""")
def source_states(spark, d):
    """How each user as a source stands: its last event is the last snapshot, errors, visits and sign-ups its times."""
    e = table(spark, d, "events")
    kind, value = F.col("event_type"), F.col("value")
    fetched = F.when((kind == "click") & (value > 60), "blocked").when(kind == "error", "error").when(kind == "click", "not_modified").otherwise("success")
    shots = e.select("user_id", F.col("ts").alias("taken_at"), F.col("event_id").alias("snapshot"), fetched.alias("fetched"), F.when(value > 10, F.col("event_id") - 1).alias("previous"))
    last = lambda *kinds: F.max(F.when(kind.isin(*kinds), F.col("ts")))
    s = e.groupBy("user_id").agg(F.lit("page").alias("strategy"), last("signup").alias("changed_at"), F.max("ts").alias("checked_at"), last("error").alias("error_at"), last("view", "purchase").alias("success_at"))
    return records.source_health(s, shots, "user_id")


_ACTIONS = """WITH a AS (SELECT l_partkey AS k, l_returnflag AS f, l_orderkey * 10 + l_linenumber AS t, CASE WHEN l_quantity > 5 THEN 'r' || l_suppkey ELSE ' ' END AS who, CASE WHEN l_tax > 0.04 THEN l_linestatus ELSE ' ' END AS note, l_discount AS d FROM lineitem),
x AS (SELECT *, CASE WHEN f = 'A' AND d < 0.03 THEN NULL WHEN f = 'A' THEN 'approved' WHEN f = 'R' THEN 'rejected' ELSE 'needs_review' END AS decision, k IN (SELECT p_partkey FROM part WHERE p_size > 5) AS known FROM a)"""


@_query(_ACTIONS + """, l AS (SELECT k, max({'t': t, 'd': decision, 'who': who, 'note': CASE WHEN trim(note) <> '' THEN note END}) AS m FROM x WHERE decision IS NOT NULL AND trim(who) <> '' AND known GROUP BY k),
c AS (SELECT p_partkey, coalesce(m.d, 'new') AS status, m.who AS reviewed_by, m.t AS reviewed_at, m.note AS note FROM part LEFT JOIN l ON k = p_partkey WHERE p_size > 5), b AS (SELECT k, CASE WHEN decision IS NULL THEN 'invalid_action' WHEN trim(who) = '' THEN 'missing_reviewer' ELSE 'candidate_not_found' END AS reason FROM x WHERE decision IS NULL OR trim(who) = '' OR NOT known)
SELECT p_partkey AS part, status, reviewed_by, reviewed_at, note, 1 AS n FROM c UNION ALL SELECT NULL, reason, NULL, NULL, NULL, CAST(count(*) AS INTEGER) FROM b GROUP BY reason""")
def recorded_reviews(spark, d):
    """Parts as candidates with the last review that could be recorded, and how many couldn't for each reason."""
    li, flag = table(spark, d, "lineitem"), F.col("l_returnflag")
    action = F.when((flag == "A") & (F.col("l_discount") < 0.03), "publish").when(flag == "A", "approve").when(flag == "R", "reject").otherwise("needs_review")
    actions = li.select(
        F.col("l_partkey").alias("part"), action.alias("action"), F.when(F.col("l_quantity") > 5, F.concat(F.lit("r"), "l_suppkey")).otherwise(" ").alias("reviewed_by"), F.when(F.col("l_tax") > 0.04, F.col("l_linestatus")).otherwise(" ").alias("note"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"),
    )
    none = F.lit(None)
    cands = table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("part"), F.lit("new").alias("status"), none.cast("string").alias("reviewed_by"), none.cast("long").alias("reviewed_at"), none.cast("string").alias("note"))
    kept, refused = records.recorded_reviews(cands, actions, "part")
    why = refused.groupBy("reason").agg(F.count("*").cast("int").alias("n"))
    return kept.withColumn("n", F.lit(1)).unionByName(why.select(none.cast("long").alias("part"), F.col("reason").alias("status"), none.cast("string").alias("reviewed_by"), none.cast("long").alias("reviewed_at"), none.cast("string").alias("note"), "n"))


@_query("""WITH p AS (SELECT o_orderkey, o_custkey + CASE WHEN o_orderstatus = 'P' THEN 1000000 ELSE 0 END AS rec, CASE o_orderpriority WHEN '1-URGENT' THEN 'c_name' WHEN '2-HIGH' THEN 'c_mktsegment' WHEN '3-MEDIUM' THEN 'c_nationkey' ELSE 'colour' END AS field FROM orders)
SELECT o_orderkey, field, c_custkey IS NOT NULL AS known, CASE field WHEN 'c_name' THEN c_name WHEN 'c_mktsegment' THEN c_mktsegment WHEN 'c_nationkey' THEN CAST(c_nationkey AS VARCHAR) END AS current FROM p LEFT JOIN customer ON c_custkey = rec""")
def proposed_fields(spark, d):
    """What the catalog of customers has of the field that each order proposes to change."""
    kind = F.col("o_orderpriority")
    field = F.when(kind == "1-URGENT", "c_name").when(kind == "2-HIGH", "c_mktsegment").when(kind == "3-MEDIUM", "c_nationkey").otherwise("colour")
    p = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") + F.when(F.col("o_orderstatus") == "P", 1_000_000).otherwise(0)).alias("c_custkey"), field.alias("field"))
    return records.current_fields(p, table(spark, d, "customer"), "c_custkey", "field", ["c_name", "c_mktsegment", "c_nationkey"]).drop("c_custkey")


@_query("""WITH h AS (SELECT l_suppkey, l_linenumber AS w, lpad(CAST(l_quantity % 24 AS INTEGER)::VARCHAR, 2, '0') || ':00' AS o, lpad((l_partkey % 24)::VARCHAR, 2, '0') || ':30' AS c, l_returnflag = 'R' AS season, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_orderkey % 100 = l_suppkey % 100 OR l_quantity > 48), f AS (SELECT * FROM h WHERE w BETWEEN 1 AND 7 AND o < c),
g AS (SELECT l_suppkey, w, string_agg(o || '–' || c, ', ' ORDER BY o || '–' || c) AS r FROM f WHERE NOT season GROUP BY ALL), n AS (SELECT l_suppkey, count_if(season) AS seasonal, max(day) AS day FROM f GROUP BY 1),
s AS (SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'varies' WHEN s_acctbal > 9000 THEN 'odd' ELSE 'fixed' END AS kind FROM supplier), d AS (SELECT s_suppkey, string_agg(coalesce(r, ''), '|' ORDER BY day) AS rows FROM (SELECT s_suppkey, unnest(range(1, 8)) AS day FROM supplier) LEFT JOIN g ON l_suppkey = s_suppkey AND w = day GROUP BY 1)
SELECT s.s_suppkey, CASE WHEN kind = 'varies' THEN 'statement' WHEN kind = 'fixed' AND n.l_suppkey IS NOT NULL THEN 'weekly' ELSE 'unknown' END AS kind, CASE WHEN kind = 'fixed' AND n.l_suppkey IS NOT NULL THEN rows END AS rows, CASE WHEN kind = 'fixed' THEN seasonal END AS seasonal, CASE WHEN kind = 'varies' THEN DATE '1999-09-09' WHEN kind = 'fixed' THEN day END AS checked FROM s LEFT JOIN n ON n.l_suppkey = s_suppkey LEFT JOIN d ON d.s_suppkey = s.s_suppkey""")
def weekly_hours(spark, d):
    """How suppliers as places are open, from their items' numbers as ranges of hours."""
    hour = lambda c, end: F.concat(F.lpad(c.cast("int").cast("string"), 2, "0"), F.lit(end))
    li = table(spark, d, "lineitem").where("l_orderkey % 100 = l_suppkey % 100 OR l_quantity > 48")
    season = F.when(F.col("l_returnflag") == "R", F.to_date("l_shipdate"))
    h = li.select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_linenumber").alias("weekday"), hour(F.col("l_quantity") % 24, ":00").alias("opens"), hour(F.col("l_partkey") % 24, ":30").alias("closes"), season.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.to_date("l_shipdate").alias("checked"))
    bal = F.col("s_acctbal")
    places = table(spark, d, "supplier").select("s_suppkey", F.when(bal < 0, "varies").when(bal > 9000, "odd").otherwise("fixed").alias("hours_kind"), F.lit("1999-09-09").cast("date").alias("checked"))
    return records.weekly_hours(places, h, "s_suppkey").withColumn("rows", F.array_join("rows", "|"))


@_query("""WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) = DATE '1997-03-03' OR o_orderpriority = '1-URGENT' AS same, CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice / 50000) AS INTEGER) END AS lo, CAST(floor(o_totalprice / 40000) AS INTEGER) + 1 AS hi, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus = 'O' END AS inc FROM orders)
SELECT o_orderkey, """ + " || '|' || ".join(f"CASE WHEN NOT same OR (lo IS NOT NULL AND inc IS NULL) OR lo > hi OR (lo = hi AND NOT inc) THEN 'unknown' WHEN {a} < lo OR ({a} = lo AND NOT inc) OR {a} > hi THEN 'no' ELSE 'fit' END" for a in (3, 6, 9)) + " AS cells FROM x")
def sibling_cells(spark, d):
    """Three siblings against each order as a session, by the ages stated for one day."""
    price = F.col("o_totalprice")
    s = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("1997-03-03").cast("date")).otherwise(F.to_date("o_orderdate")).alias("day"), F.when(F.col("o_orderstatus") != "P", F.floor(price / 50_000).cast("int")).alias("lo"),
        (F.floor(price / 40_000).cast("int") + 1).alias("hi"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus") == "O").alias("lo_in"), F.lit(True).alias("hi_in"),
    )
    cells = records.age_cells(s, [3, 6, 9], F.lit("1997-03-03").cast("date"), "lo", "hi", "lo_in", "hi_in", F.col("day"))
    return s.select("o_orderkey", F.array_join(cells, "|").alias("cells"))
