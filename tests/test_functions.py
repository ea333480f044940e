from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sorrel.functions import ages, dates, logic, money, text


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_three_values(spark):
    got = values(spark, [("yes",), (" NO ",), ("maybe",), (None,)], "v string", logic.tri(F.col("v")), logic.enum_or_null(F.col("v"), ["yes"]))
    assert got == [("yes", "yes"), ("no", "unknown"), ("unknown", "unknown"), ("unknown", None)]
    got = values(spark, [(["yes", "yes"],), (["yes", "unknown"],), (["unknown", "no"],), ([],), (["yes", None],)], "v array<string>", logic.all_of(F.col("v")))
    assert [g[0] for g in got] == ["yes", "unknown", "no", "unknown", "unknown"]
    got = values(spark, [(0.95,), (0.7,), (float("nan"),), (7.0,), (None,)], "v double", logic.confidence_band(F.col("v")), logic.clamp_confidence(F.col("v")))
    assert got == [("HIGH", 0.95), ("MEDIUM", 0.7), ("LOW", 0.0), ("HIGH", 1.0), ("LOW", 0.0)]


def test_ages(spark):
    fit = ages.age_fits(F.col("a"), F.col("lo"), F.col("hi"), F.lit(True), F.lit(False))
    got = values(spark, [(5, 5, 9), (9, 5, 9), (4, 5, None), (7, None, None), (None, 5, 9), (7, 9, 5), (30, 5, None)], "a int, lo int, hi int", fit)
    assert [g[0] for g in got] == ["yes", "no", "no", "unknown", "unknown", "unknown", "yes"]
    got = values(spark, [("Ages 5–9",), ("6 to 8 years",), ("12+",), ("grade 3-4",), ("age 7",), ("18-40",), ("none",)], "t string", ages.age_range(F.col("t")))
    assert [None if g[0] is None else tuple(g[0]) for g in got] == [(5, 9), (6, 8), (12, None), None, (7, 7), None, None]


def test_money(spark):
    got = values(spark, [(1.005,), (14.999,), (15.0,), (35.0,), (0.0,), (None,)], "v double", money.cents(F.col("v")), money.price_band(F.col("v")))
    assert got == [(100, "under_15"), (1500, "under_15"), (1500, "15_25"), (3500, "35_plus"), (0, "free"), (None, "call_for_price")]
    assert values(spark, [("from $1,250.50 per week, $9 a day",), ("free",)], "t string", money.first_price(F.col("t")), money.price_unit(F.col("t"))) == [(125050, "week"), (None, "unknown")]
    assert values(spark, [(1000,), (1005,)], "c long", money.with_tax(F.col("c"))) == [(1130,), (1136,)]


def test_dates(spark):
    got = values(spark, [("9:30",), ("23:59",), ("24:00",), ("9h",)], "t string", dates.clock_minutes(F.col("t")))
    assert [g[0] for g in got] == [570, 1439, None, None]
    got = values(spark, [(datetime(2026, 1, 1, 4, 59),), (datetime(2026, 7, 1, 4, 0),)], "t timestamp", dates.local_day(F.col("t")), dates.local_hour(F.col("t")))
    assert got == [(date(2025, 12, 31), 23), (date(2026, 7, 1), 0)]
    got = values(spark, [(12, 11, 3), (6, 11, 3), (6, 5, 7), (6, None, 7)], "m int, a int, b int", dates.in_season(F.col("m"), F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [True, False, True, True]
    got = values(spark, [("on 2026-02-28 or later",), ("2026-02-30",), ("none",)], "t string", dates.iso_date(F.col("t")))
    assert [g[0] for g in got] == [date(2026, 2, 28), None, None]
    got = values(spark, [(1320, 120, True), (540, 720, False), (720, 900, False)], "o int, c int, n boolean", dates.clock_overlaps(F.col("o"), F.col("c"), F.col("n"), 1380, 1440), dates.clock_overlaps(F.col("o"), F.col("c"), F.col("n"), 540, 720))
    assert got == [(True, False), (False, True), (False, False)]


def test_text(spark):
    got = values(spark, [("Café & Bar (new)",), ("  A--B ",)], "t string", text.match_key(F.col("t")), text.slug(F.col("t")))
    assert got == [("cafe and bar", "cafe-and-bar"), ("a b", "a-b")]
    got = values(spark, [("a  \r\nb\r\n\r\n\r\n\r\nc ",), ("a\nb\n\nc",)], "t string", text.hash_form(F.col("t")), text.content_hash(F.col("t")))
    assert got[0] == got[1]
    html = "<html><head><title> T &amp; U </title><style>p{}</style><script>var t='</p>';</script></head><body><p>One<b> two</b></p><!-- x --><div>A &lt;b&gt; &amp;lt;</div><a class=q href='/x?y=1'>l</a><h2>He<i>ad</i></h2></body>"
    body, title, links, heads = values(spark, [(html,)], "h string", text.html_text(F.col("h")), text.html_title(F.col("h")), text.html_links(F.col("h")), text.headings(F.col("h")))[0]
    assert body == "T & U\nOne two\nA <b> &lt;\nl\nHe ad" and title == "T &amp; U" and links == ["/x?y=1"] and heads == ["Head"]
    got = values(spark, [("HTTP://www.Example.com:80/a/?utm_source=x&b=2&a=1#top",), ("ftp://x/y",), (None,)], "u string", text.canonical_url(F.col("u")), text.host(F.col("u")))
    assert got == [("http://www.example.com/a?a=1&b=2", "example.com"), ("ftp://x/y", None), (None, None)]
    forms = {
        "https://www.example.com/summer-camp?utm_source=n&utm_medium=e&gclid=abc#pricing": "https://www.example.com/summer-camp", "https://example.com/reg?activityId=884&week=3&hsa_cam=1&utm_id=2": "https://example.com/reg?activityId=884&week=3",
        "https://example.com/camps?ref=partner": "https://example.com/camps?ref=partner", "HTTPS://WWW.Example.COM:443/Summer-Camp/": "https://www.example.com/Summer-Camp",
        "http://example.com:80/camps//summer/": "http://example.com/camps/summer", "https://example.com/": "https://example.com/", "https://example.com/r?week=2&session=a": "https://example.com/r?session=a&week=2", "no url": None,
    }
    assert [g[0] for g in values(spark, [(u,) for u in forms], "u string", text.canonical_url(F.col("u")))] == list(forms.values())
    entities = {"Kids&#39; Camp &rsquo;": "Kids' Camp ’", "&#x1F600;&NDASH;&#8212;": "😀–—", "&nope; &amp;amp; &#0;": "&nope; &amp; &#0;", "a & b": "a & b", "": ""}
    assert [g[0] for g in values(spark, [(u,) for u in entities], "u string", text.decode_entities(F.col("u")))] == list(entities.values())
    got = values(spark, [("abcdef", "abXYef"), ("same", "same"), ("", "abc"), ("aa", "aaa"), ("abc", "xyz"), ("x" * 5000, "x" * 2000 + "y" + "x" * 3000)], "a string, b string", text.changed_span(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [4, 0, 3, 1, 6, 1]
