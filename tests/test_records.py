"""States, reviews, fields and hours on small cases."""

import datetime as dt

from pyspark.sql import functions as F

from sorrel.operators import records


def test_source_health(spark):
    t = lambda n: dt.datetime(2026, 1, n)
    s = spark.createDataFrame([("a", "unsupported", None, None, None, None), ("b", "page", None, None, None, None), ("c", "page", None, None, t(3), t(2)), ("d", "page", t(2), t(2), t(1), t(2)), ("e", "page", t(1), t(2), None, None), ("f", "page", None, t(1), None, None), ("g", "page", None, None, None, None), ("h", "page", None, None, t(1), None)], "k string, strategy string, changed_at timestamp, checked_at timestamp, error_at timestamp, success_at timestamp")
    shots = spark.createDataFrame([("b", t(1), 1, "success", None), ("b", t(2), 2, "blocked", 1), ("f", t(1), 1, "success", 0), ("g", t(1), 1, "success", None), ("e", t(1), 1, "success", 0)], "k string, taken_at timestamp, snapshot int, fetched string, previous int")
    assert dict(map(tuple, records.source_health(s, shots, "k").collect())) == {"a": "Unsupported", "b": "Blocked", "c": "Failed", "d": "Changed", "e": "Healthy", "f": "Changed", "g": "Healthy", "h": "Failed"}


def test_reviews(spark):
    c = spark.createDataFrame([(1, "new", None, None, None), (2, "changed", "old", 1, "why")], "k int, status string, reviewed_by string, reviewed_at int, note string")
    a = spark.createDataFrame([(1, "approve", " ann ", " ", 5), (1, "reject", "bob", "no", 4), (2, "publish", "ann", "", 9), (2, "ignore", " ", "", 9), (3, "ignore", "ann", "", 9), (3, "odd", "", "", 1), (None, "approve", "ann", "", 1)], "k int, action string, reviewed_by string, note string, at int")
    kept, refused = records.recorded_reviews(c, a, "k")
    assert sorted(map(tuple, kept.collect())) == [(1, "approved", "ann", 5, None), (2, "changed", "old", 1, "why")]
    assert sorted((str(r.k), r.reason) for r in refused.collect()) == [("2", "invalid_action"), ("2", "missing_reviewer"), ("3", "candidate_not_found"), ("3", "invalid_action"), ("None", "candidate_not_found")]


def test_hours(spark):
    d = dt.date(2026, 1, 1)
    p = spark.createDataFrame([("a", "fixed", None), ("b", "fixed", d), ("c", "varies", d), ("d", None, d)], "k string, hours_kind string, checked date")
    h = spark.createDataFrame([("a", 1, "13:00", "17:00", None, None, d), ("a", 1, "09:00", "12:00", None, None, None), ("a", 2, "10:00", "09:00", None, None, d), ("a", 8, "09:00", "10:00", None, None, d), ("a", 3, "09:00", "10:00", d, None, None), ("b", 0, "09:00", "10:00", None, None, d)], "k string, weekday int, opens string, closes string, valid_from date, valid_to date, checked date")
    got = {r.k: (r.kind, r.rows, r.seasonal, r.checked) for r in records.weekly_hours(p, h, "k").collect()}
    assert got == {"a": ("weekly", ["09:00–12:00, 13:00–17:00", *[""] * 6], 1, d), "b": ("unknown", None, None, None), "c": ("statement", None, None, d), "d": ("unknown", None, None, None)}


def test_fields_and_cells(spark):
    p = spark.createDataFrame([(1, "name"), (1, "colour"), (2, "name"), (None, "name")], "k int, field string")
    got = sorted(map(tuple, records.current_fields(p, spark.createDataFrame([(1, None, 3)], "k int, name string, n int"), "k", "field", ["name", "n"]).collect()), key=str)
    assert got == sorted([(1, "name", True, None), (1, "colour", True, None), (2, "name", False, None), (None, "name", False, None)], key=str)
    day = dt.date(2026, 7, 1)
    s = spark.createDataFrame([(5, 8, True, True, day), (5, 8, None, True, day), (5, 8, True, True, None)], "lo int, hi int, li boolean, hin boolean, day date")
    cells = records.age_cells(s, [4, 8], F.lit(day), "lo", "hi", "li", "hin", F.col("day"))
    assert [r[0] for r in s.select(cells).collect()] == [["no", "fit"], ["unknown", "unknown"], ["unknown", "unknown"]]
