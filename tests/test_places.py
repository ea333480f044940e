from datetime import date, datetime

from pyspark.sql import functions as F

from sorrel.functions import normalize, registration, venues
from sorrel.operators import costs, review, views


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_venue_ages(spark):
    got = values(spark, [(36, 5, None), (None, None, 3), (None, 2, None), (0, 12, 6), (200, 3, None)], "m int, y int, h int", venues.age_groups(F.col("m"), F.col("y"), F.col("h")))
    assert [g[0] for g in got] == [["toddlers", "preschool", "kids"], [], ["babies", "toddlers"], ["kids", "big_kids", "tweens_teens"], []]


def test_dates_in_text(spark):
    cells = ["June 29 – August 28, 2026", "July 6 - 10", "Dec 29 to Jan 2, 2027", "Feb 30, 2026", "Aug 7, 2026 to Aug 3, 2026", "2026-07-06", "", None]
    got = values(spark, [(c,) for c in cells], "t string", normalize.date_range(F.col("t")))
    assert [None if g[0] is None else (g[0].start, g[0].end) for g in got] == [
        (date(2026, 6, 29), date(2026, 8, 28)), None, (date(2026, 12, 29), date(2027, 1, 2)), None, None, (date(2026, 7, 6), None), None, None,
    ]
    got = values(spark, [(c,) for c in ("13/05/2026", "05/13/2026", "05/06/2026", "May 3, 2026", "3 may 2026", "2026/2/30")], "t string", normalize.checked_date(F.col("t")))
    assert [g[0] for g in got] == [date(2026, 5, 13), date(2026, 5, 13), None, date(2026, 5, 3), date(2026, 5, 3), None]


def test_times_and_prices_in_text(spark):
    got = values(spark, [("9:00 - 3:30",), ("noon to 4 pm",), ("room 12",), ("8:30",), (None,)], "t string", normalize.time_range(F.col("t")))
    assert [None if g[0] is None else (g[0].start, g[0].end, g[0].inferred) for g in got] == [(540, 930, True), (720, 960, False), None, (510, None, True), None]
    got = values(spark, [("$1,250.50 per week + HST",), ("free",), ("in 2026",), ("fee 40 a day",)], "t string", normalize.price(F.col("t")))
    assert [None if g[0] is None else tuple(g[0])[:4] for g in got] == [(125050, "CAD", "per_week", True), (0, "CAD", None, False), None, (4000, "unknown", None, False)]


def test_registration(spark):
    a = registration.registration_action(F.col("s"), F.col("r"), F.col("u"), F.col("w"))
    got = values(spark, [("confirmed_full", "registration_open", "u", None), (None, "registration_open", " ", None), (None, "waitlist", "u", "w"), (None, None, "u", None)], "s string, r string, u string, w string", a)
    assert [tuple(g[0]) for g in got] == [("full_or_closed", None), ("registration_open", None), ("waitlist", "w"), ("availability_unknown", "u")]
    now = F.lit(datetime(2026, 3, 10, 12))
    line = registration.seat_line(F.col("s"), F.col("n"), F.col("c"), F.lit(None).cast("date"), now)
    got = values(spark, [("available", 1, datetime(2026, 3, 10, 11)), ("available", 9, datetime(2026, 3, 9)), ("full", 0, datetime(2026, 3, 1)), ("available", -1, datetime(2026, 3, 10, 11))], "s string, n int, c timestamp", line)
    assert [None if g[0] is None else tuple(g[0]) for g in got] == [("1 spot left · checked 7:00 am", "warning"), ("Spots available · checked Mar 8", "open"), None, None]
    got = values(spark, [("10.1.2.3",), ("example.org",), ("localhost",), ("[::1]",), ("172.32.0.1",)], "h string", registration.unsafe_host(F.col("h")))
    assert [g[0] for g in got] == ["private_ip", None, "blocked_name", "private_ip", None]


def test_reviews(spark):
    df = spark.createDataFrame([(1, "approved"), (1, "approved"), (2, "rejected"), (2, "approved"), (3, "needs_followup"), (3, "approved"), (4, None)], "k int, d string")
    assert dict(df.groupBy("k").agg(review.review_outcome(F.col("d"))).collect()) == {1: "fully_approved", 2: "partially_approved", 3: "needs_followup", 4: None}
    got = values(spark, [(["b", "missing_price"], ["missing_dates", "b"]), (None, None)], "x array<string>, y array<string>", review.merge_flags(F.col("x"), F.col("y")))
    assert [g[0] for g in got] == [["missing_dates", "missing_price", "b"], []]
    got = values(spark, [("v1:s:0", "v1:s:0"), ("v1:s:0", "v2:s:0"), (None, "v1:s:0"), ("v1:s:0", "v1:s:1")], "a string, b string", review.fingerprint_change(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == ["unchanged", "version_mismatch", "baseline", "changed"]


def test_package_must_be_cheaper(spark):
    tickets = spark.createDataFrame([("child", 0, 17, 1000, 1)], "band string, low int, high int, cost int, adults_included int")
    kids = spark.createDataFrame([("a", 5), ("a", 7), ("b", 5), ("b", 30)], "family string, age int")
    families = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "family string, adults int")
    for cents, best in ((2000, None), (1999, "p")):
        got = {r.family: r for r in costs.family_price(kids, families, tickets, 500, [costs.Package("p", 2, 2, cents)]).collect()}
        assert (got["a"].total, got["a"].best_label, got["b"].unmatched, got["b"].best_label, got["c"].total) == (2000, best, 1, None, 500)


def test_runs_of_days(spark):
    df = spark.createDataFrame([(1, d, s) for d, s in ((1, "9-5"), (2, "9-5"), (4, "9-5"), (5, "x"), (6, None))], "k int, weekday int, slot string")
    assert sorted(tuple(r) for r in views.weekly_hours(df, "k").collect()) == [(1, 1, 2, "9-5"), (1, 4, 4, "9-5"), (1, 5, 5, "x")]
