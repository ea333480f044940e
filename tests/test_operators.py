from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sorrel.operators import changes, cycles, intervals, joins, search, summaries
from sorrel.sources import tables
from sorrel.streaming import watch


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_no_stitching_of_two_sessions(spark):
    programs = spark.createDataFrame([(1, 10), (2, 10), (3, 99)], "program long, provider long")
    providers = spark.createDataFrame([(10, "P")], "provider long, name string")
    sessions = spark.createDataFrame([(1, 5, "open"), (1, 9, "full"), (2, 9, "open"), (3, 9, "open"), (2, None, "open")], "program long, age int, state string")
    f = search.Filters(session=[F.col("age") == 9, F.col("state") == "open"])
    assert [r.program for r in search.matching_sessions(programs, providers, sessions, f, "program", "provider").collect()] == [2]
    assert search.programs_without_sessions(programs, sessions, f, "program").count() == 0
    more = programs.union(spark.createDataFrame([(4, 10)], programs.schema))
    assert rows(search.programs_without_sessions(more, sessions, search.Filters(), "program")) == [(4, 10)]


def test_incomplete_read_removes_nothing(spark):
    old, new = (spark.createDataFrame(x, "k long, a string, b string") for x in ([(1, "x", None), (2, "y", "q")], [(1, "x", "n"), (3, "z", "z")]))
    assert rows(changes.snapshot_diff(old, new, "k", ["a", "b"])) == [(1, "changed", "b"), (2, "removed", ""), (3, "added", "")]
    assert rows(changes.snapshot_diff(old, new, "k", ["a", "b"], complete=False))[1] == (2, "unseen", "")
    assert rows(changes.field_changes(old, new, "k", ["a", "b"])) == [(1, "b", None, "n", "filled")]
    catalog = spark.createDataFrame([(i, "s1" if i < 4 else "s2") for i in range(8)], "k long, src string")
    seen = spark.createDataFrame([(0,), (1,), (2,), (4,)], "k long")
    assert rows(cycles.removed_candidates(catalog, seen, "src", "k")) == [(3, "s1")]


def test_ambiguous_match_stays_unmatched(spark):
    rec = spark.createDataFrame([(1, "a", "n"), (2, "b", "m"), (3, None, "m"), (4, "", "zz")], "r long, x string, y string")
    cat = spark.createDataFrame([(10, "a", "n"), (11, "b", "m"), (12, "b", "m"), (13, "c", "n")], "e long, x string, y string")
    rules = [("exact", 0.96, F.col("x"), F.col("x")), ("name", 0.75, F.col("y"), F.col("y"))]
    assert rows(changes.match_entities(rec, cat, "r", "e", rules)) == [(1, "exact", 0.96, 1, "10"), (2, "exact", 0.96, 2, None), (3, "name", 0.75, 2, None), (4, "none", 0.0, 0, None)]


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "y", 2)], "k long, a string, b int")
    same = summaries.set_fingerprint(a.orderBy(F.desc("a")), "k", ["a", "b"]).collect()
    assert summaries.set_fingerprint(a, "k", ["a", "b"]).collect() == same
    assert summaries.set_fingerprint(a.distinct(), "k", ["a", "b"]).collect() != same


def test_decisions(spark):
    df = spark.createDataFrame([("ok", None, "h"), ("ok", "h", "h"), ("ok", "g", "h"), ("blocked", "g", "h"), ("not_modified", "g", None)], "s string, o string, n string")
    assert [r[0] for r in df.select(changes.fetch_decision(F.col("s"), F.col("o"), F.col("n"))).collect()] == ["first", "unchanged", "extract", "failed", "unchanged"]
    df = spark.createDataFrame([("session", "open", "full", "a", "b"), ("spots", "open", "open", "a", "b"), ("page", None, None, "x" * 30, "x" * 29 + "y"), ("page", None, None, "x" * 50, "y" * 50)], "k string, o string, n string, a string, b string")
    assert [r[0] for r in df.select(cycles.alert(*map(F.col, "konab"))).collect()] == ["urgent", "none", "logged", "normal"]


def test_sources(spark, tmp_path):
    assert [tables.content_range_total(h) for h in ("0-24/25", "*/0", "0-24/*", None, "x")] == [25, 0, None, None, None]
    (tmp_path / "a.csv").write_text('﻿name,ages\n"A, ""b""\nline","5–9"\n,\n', encoding="utf-8")
    assert rows(tables.read_csv(spark, str(tmp_path / "a.csv"), ["name"])) == [('A, "b"\nline', "5–9")]
    with pytest.raises(ValueError, match="price"):
        tables.read_csv(spark, str(tmp_path / "a.csv"), ["price"])
    feeds = spark.createDataFrame([("s", '[{"id":1,"name":"a"},{"name":"no id"}]'), ("t", '{"rows":[{"id":2,"name":"b"}]}'), ("u", "broken"), ("v", None)], "source string, body string")
    assert rows(tables.parse_feed(feeds, "body", "struct<id:long,name:string>")) == [("s", 1, "a"), ("t", 2, "b")]
    assert spark.createDataFrame([("a=1; b = x=y;bare",)], "p string").select(tables.parse_params("p")).first()[0] == {"a": "1", "b": "x=y"}
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert [tables.read_state(df, 2), tables.read_state(df, 3), tables.read_state(df.limit(0), 0), tables.read_state(df, None)] == ["ready", "failed", "empty", "failed"]


def test_due(spark):
    now = F.lit("2026-03-10 12:00:00").cast("timestamp")
    df = spark.createDataFrame([(True, "daily", datetime(2026, 3, 10, 5)), (True, "daily", datetime(2026, 3, 10, 3)), (True, "weekly", datetime(2026, 3, 4)), (True, "weekly", datetime(2026, 3, 3)), (False, "daily", None), (True, "daily", None)], "a boolean, e string, l timestamp")
    assert [r[0] for r in df.select(cycles.watch_due(F.col("a"), F.col("e"), F.col("l"), now)).collect()] == [False, True, False, True, False, True]


def test_stream_of_changes(spark, tmp_path):
    schema = "url string, at timestamp, body string"
    batches = [[("u", datetime(2026, 1, 1), "a"), ("v", datetime(2026, 1, 1), "x")], [("u", datetime(2026, 1, 2), "a"), ("v", datetime(2026, 1, 2), None)], [("u", datetime(2026, 1, 3), "b"), ("v", datetime(2026, 1, 3), "x")]]
    found = []
    for rows_ in batches:
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = watch.content_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "url", "at", "body")
        watch.run_available(stream, lambda df, n: found.extend((r.key, r.change) for r in df.collect()), str(tmp_path / "cp"))
    assert sorted(found) == [("u", "changed"), ("u", "first"), ("v", "first")]


def test_latest_values_survive_a_repeated_batch(spark, tmp_path):
    schema = "k long, ts timestamp, v string"
    sink = watch.latest_value_sink(str(tmp_path / "out"), "k", "ts")
    a = spark.createDataFrame([(1, datetime(2026, 1, 1), "a"), (2, datetime(2026, 1, 5), "b")], schema)
    b = spark.createDataFrame([(1, datetime(2026, 1, 2), "c"), (2, datetime(2026, 1, 4), "late")], schema)
    for n, df in ((0, a), (1, b), (1, b)):
        sink(df, n)
    assert [(r.k, r.v) for r in watch.read_latest(spark, str(tmp_path / "out"), a.schema).orderBy("k").collect()] == [(1, "c"), (2, "b")]


def test_windowed_counts_equal_batch(spark, sf_dir, tmp_path):
    src = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(str(tmp_path / "in"))
    out = []
    stream = watch.windowed_counts(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), "ts", "event_type")
    watch.run_available(stream, lambda df, n: out.extend(map(tuple, df.collect())), str(tmp_path / "cp"), "update")
    want = src.groupBy(F.window("ts", "1 day").start.alias("s"), "event_type").count()
    assert sorted(out) == sorted(map(tuple, want.collect()))


def test_joins(spark):
    bands = spark.createDataFrame([("w", 0, 20, 5), ("n", 3, 6, 9), ("m", 4, 7, 8)], "band string, low int, high int, cost int")
    got = intervals.band_join(spark.createDataFrame([(5,), (3,), (15,), (99,), (None,)], "a int"), "a", bands).collect()
    assert [r.band for r in got] == ["m", "n", "w", None, None]
    e = spark.createDataFrame([("a", 1, "error"), ("a", 2, "ok"), ("a", 3, "error"), ("a", 4, "error"), ("b", 1, "error")], "k string, i int, s string")
    assert rows(joins.consecutive_failures(e, "k", F.col("i"), F.col("s") == "error")) == [("a", 2), ("b", 1)]
