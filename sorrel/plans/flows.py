"""Queries on streams, folds over lines and JSON of unknown shape, each over whole tables with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sorrel.functions.jsons import strict_json
from sorrel.functions.sections import fold_lines, matched
from sorrel.sources import variants
from sorrel.sources.tables import table
from sorrel.sources.work import work_path
from sorrel.streaming import deltas, outcomes, watch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


_H = 3_600_000_000
_READINGS = """SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS "at", event_id AS reading,
 CASE WHEN event_type <> 'error' THEN 'ok' WHEN value < 20 THEN 'error' WHEN value < 60 THEN 'unreachable' ELSE 'blocked' END AS status, event_type || CAST(floor(value / 50) AS BIGINT) AS content FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL"""
_OUTCOMES = f"""WITH r AS ({_READINGS}), g AS (SELECT *, lag("at") OVER w AS before, lead("at") OVER w AS after FROM r WINDOW w AS (PARTITION BY key ORDER BY "at", reading)),
p AS (SELECT *, sum(CASE WHEN "at" - before > {72 * _H} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY "at", reading) AS part FROM g),
s AS (SELECT *, lag(status) OVER (PARTITION BY key, part ORDER BY "at", reading) AS old, last_value(CASE WHEN status = 'ok' THEN content END IGNORE NULLS) OVER (PARTITION BY key, part ORDER BY "at", reading ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known, (SELECT max("at") - {_H} FROM r) AS stop FROM p)
SELECT key, "at", 'unreachable' AS field, old AS old_value, status AS new_value FROM s WHERE status IN ('unreachable', 'blocked') AND old IN ('unreachable', 'blocked')
UNION ALL SELECT key, "at", 'content', known, content FROM s WHERE status = 'ok' AND known <> content
UNION ALL SELECT key, "at" + {6 * _H}, 'overdue', status, NULL FROM s WHERE CASE WHEN after IS NULL THEN ceil(("at" + {6 * _H}) / 1000) <= floor(stop / 1000) ELSE after - "at" > {6 * _H} END"""


def _readings(e):
    status = F.when(F.col("event_type") != "error", "ok").when(F.col("value") < 20, "error").when(F.col("value") < 60, "unreachable").otherwise("blocked")
    content = F.concat("event_type", F.floor(F.col("value") / 50).cast("string"))
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("reading"), status.alias("status"), content.alias("content"))


@_query(_OUTCOMES)
def watch_outcomes(spark, d):
    """What each reading of a source means: the second failure in a row, changed content, a reading that is overdue."""
    return outcomes.watch_table(_readings(table(spark, d, "events")))


def _stream(spark, d):
    # A pattern, as a stream takes a path without one for a folder.
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")


@_query(_OUTCOMES)
def watch_outcomes_stream(spark, d):
    """The same from a stream of the readings, by a state machine for each source."""
    out = work_path(spark, "watched")
    before = spark.conf.get(outcomes.STATE_STORE[0])
    spark.conf.set(*outcomes.STATE_STORE)
    try:
        watch.run_available(outcomes.watch_stream(_readings(_stream(spark, d))), lambda b, n: b.write.mode("overwrite").parquet(f"{out}/rows/batch={n}"), f"{out}/checkpoint")
    finally:
        spark.conf.set(outcomes.STATE_STORE[0], before)
    return spark.read.schema(outcomes.OUTCOME).parquet(f"{out}/rows").select("key", "at", "field", "old_value", "new_value")


@_query("SELECT user_id, epoch_us(max(ts)) AS last_us, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def latest_by_deltas(spark, d):
    """Each user's last event, kept up by a stream of upserts into bucketed deltas."""
    rows = lambda e: e.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("last_us"), "event_id", "value")
    schema, path = rows(table(spark, d, "events")).schema, work_path(spark, "latest")
    kept = deltas.DeltaTable(spark, f"{path}/table", schema, "user_id", "last_us")
    watch.run_available(rows(_stream(spark, d)), kept.sink(compact_every=1), f"{path}/checkpoint")
    return kept.read()


@_query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, CAST(line AS INTEGER) AS line, CASE WHEN length(x) BETWEEN 1 AND 120 THEN trim(x, ' ') END AS heading, CASE WHEN regexp_matches(x, '[0-9]+[.][0-9]+') THEN regexp_extract(x, '[0-9]+[.][0-9]+') END AS value, CASE WHEN regexp_matches(x, '[A-Za-z0-9.]+@[a-z0-9.]+') THEN regexp_extract(x, '[A-Za-z0-9.]+@[a-z0-9.]+') END AS item FROM l),
h AS (SELECT *, last_value(heading IGNORE NULLS) OVER w AS open_heading, count(heading) OVER w AS part FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
v AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY doc_id, part ORDER BY line) AS open_value FROM h)
SELECT doc_id, line, open_heading AS heading, open_value AS value, item FROM v WHERE item IS NOT NULL""")
def section_items(spark, d):
    """Addresses for mail in documents, each with the short line and the number that are open where it stands."""
    short = lambda x: F.when(F.char_length(x).between(1, 120), F.trim(x))
    found = fold_lines(F.split("text", "\n"), short, matched("[0-9]+[.][0-9]+"), matched("[A-Za-z0-9.]+@[a-z0-9.]+"))
    return table(spark, d, "documents").select("doc_id", F.inline(found))


@_query("""WITH p AS (SELECT user_id, event_id, event_type, json_extract(props, '$.k') AS k FROM events)
SELECT event_type, count(*) AS events, CAST(count(TRY_CAST(k AS DOUBLE)) AS BIGINT) AS numbers, CAST(sum(TRY_CAST(k AS BIGINT)) AS BIGINT) AS total, CAST(count(DISTINCT TRY_CAST(k AS BIGINT)) AS BIGINT) AS kinds FROM p GROUP BY event_type""")
def props_by_type(spark, d):
    """What the events' properties hold, read as VARIANT, which is kept through a shuffle by event type."""
    e = table(spark, d, "events").select("event_type", strict_json(F.col("props")).alias("p")).repartition("event_type")
    k = variants.number_at(F.col("p"), "$.k")
    return e.select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("*").alias("events"), F.count("k").alias("numbers"), F.sum(F.col("k").cast("long")).alias("total"), F.count_distinct(F.col("k").cast("long")).alias("kinds"))


@_query("""SELECT user_id, arg_max(CAST(json_extract(props, '$.k') AS DOUBLE), event_id) AS k, json_type(arg_max(props, event_id), '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS is_number FROM events GROUP BY user_id""")
def latest_props(spark, d):
    """Each user's last properties, whatever their shape, and one number in them."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max_by(strict_json(F.col("props")), "event_id").alias("p"))
    k = variants.number_at(F.col("p"), "$.k")
    return last.select("user_id", k.alias("k"), k.isNotNull().alias("is_number"))
