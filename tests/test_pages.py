"""Page facts, venues and identities on small examples."""

import datetime as dt
import html as H
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sorrel.functions import addresses, ages, facts, pages
from sorrel.operators import reconcile, venue_facts


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_metadata_and_links(spark):
    page = """<head><META NAME="Description" content='A &amp; B'><meta property=og:title content=Title><meta name="description" content="again"><meta charset="utf-8"><link rel="canonical" href=" https://x.example/a "></head>"""
    got = values(spark, [(page,), ("<p>none</p>",)], "h string", pages.metadata(F.col("h")), pages.canonical_link(F.col("h")))
    assert got == [({"description": "A & B", "og:title": "Title"}, "https://x.example/a"), ({}, None)]
    urls = [("/a/b", "https://x.example/c/d?e"), ("f", "https://x.example/c/d"), ("f", "https://x.example"), ("//y.example/z", "https://x.example/c"), ("https://z.example", "https://x.example"), ("#top", "https://x.example"), ("javascript:x()", "https://x.example"), ("mailto:a@b.c", "https://x.example"), (" ", None)]
    got = values(spark, urls, "u string, b string", pages.absolute_url(F.col("u"), F.col("b")), pages.link_problem(F.col("u")))
    assert [g[0] for g in got] == ["https://x.example/a/b", "https://x.example/c/f", "https://x.example/f", "https://y.example/z", "https://z.example/", None, None, None, None]
    assert [g[1] for g in got] == [None] * 5 + ["url_is_fragment_only", "unsupported_url_scheme", "non_http_url", "url_not_stated"]


def test_watch_text_equals_a_plain_version(spark):
    def plain(h):
        h = re.sub(r"(?is)<(nav|header|footer)\b[^>]*>.*?</\1\s*>", " ", h)
        h = re.sub(r"(?s)<!--.*?-->", " ", h)
        h = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", h)
        h = re.sub(r"(?i)<\s*/?\s*(?:p|div|section|article|li|ul|h[1-6]|br|table|tr|td)\b[^>]*>", "\x01", h)
        t = re.sub(r"\s+", " ", H.unescape(re.sub(r"<[^>]*>", " ", h)))
        lines = [x.strip() for x in t.split("\x01")]
        return "\n".join(x for x in lines if x and (len(x) > 180 or not re.search(r"(?i)\b(cookies?|consent|accept all)\b", x))).strip()

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html", pages.watch_text(F.col("html")).alias("w")).collect()
    assert rows and all(r.w == plain(r.html) for r in rows)
    got = values(spark, [("<nav>Jan 1</nav><p>Week 1</p><div>We use cookies</div><FOOTER>x</FOOTER>",)], "h string", pages.watch_text(F.col("h")))
    assert got == [("Week 1",)]


def test_small_page_facts(spark):
    one = spark.range(1).select(
        pages.name_of_location(F.lit("st-george-brant--r13a")), pages.region_order(F.lit("13a")), pages.region_order(F.lit("5")), pages.plus_tax(F.lit("$40 + HST")), pages.plus_tax(F.lit("tax included")),
        pages.care_text("Before", facts.care_window(F.lit("yes"), F.lit("07:30:00"), F.lit("09:00:00"), F.lit("yes"))), pages.care_text("After", facts.care_window(F.lit("no"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))),
        pages.stated_year(F.array(F.lit("Camp 12026"), F.lit("Summer 2026"), F.lit("2027"))), pages.line_window(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")), F.lit(1)),
        F.size(pages.days_listed(F.lit(dt.date(2026, 1, 1)), F.lit(dt.date(2027, 1, 1)))), pages.days_listed(F.lit(dt.date(2026, 1, 2)), F.lit(dt.date(2026, 1, 1))),
        pages.span_days(F.lit(dt.date(2026, 1, 1)), F.lit(dt.date(2026, 1, 8))),
    ).first()
    assert tuple(one) == ("St George Brant", 131, 50, True, False, "Before care 07:30–09:00 (extra fee)", "No after care", 2026, "b c d", 62, [], 7)
    got = values(spark, [("2026-01-15 12:00:00",), ("2026-07-15 02:00:00",)], "t string", pages.day_start(F.col("t").cast("timestamp")).cast("string"))
    assert got == [("2026-01-15 05:00:00",), ("2026-07-14 04:00:00",)]


def test_age_bands(spark):
    rows = [(5, 8, True, True), (5, 8, True, False), (5, 8, None, True), (8, 5, True, True), (5, 5, True, False), (None, None, True, True), (5, None, True, None), (5, None, False, None), (None, 8, None, True), (None, 8, None, False)]
    b = (F.col("lo"), F.col("hi"), F.col("li"), F.col("hin"))
    got = values(spark, rows, "lo int, hi int, li boolean, hin boolean", ages.age_fits(F.lit(8), *b), ages.band_label(*b))
    assert got == [("yes", "Ages 5–8"), ("no", "Ages 5–<8"), ("unknown", None), ("unknown", None), ("unknown", None), ("unknown", None), ("yes", "Ages 5+"), ("yes", "Ages >5"), ("yes", "Ages up to 8"), ("no", "Ages <8")]


def test_canonical_facts(spark):
    kind = T.StructType([T.StructField("b", T.ArrayType(T.IntegerType())), T.StructField("a", T.StructType([T.StructField("value", T.StringType()), T.StructField("observedAt", T.StringType())])), T.StructField("m", T.MapType(T.StringType(), T.IntegerType()))])
    df = spark.createDataFrame([(([3, 1, 2], ("x \"q\"", "now"), {"z": 1, "y": 2}),), (([2, 3, 1], ("x \"q\"", "later"), {"y": 2, "z": 1}),), ((None, (None, "now"), None),)], T.StructType([T.StructField("r", kind)]))
    got = [r[0] for r in df.select(facts.canonical(F.col("r"), kind)).collect()]
    assert got[0] == got[1] == '{"a":"x \\"q\\"","b":[1,2,3],"m":{"y":2,"z":1}}' and got[2] == '{"a":null,"b":null,"m":null}'
    prints = [("v1:sha256:AB", "v1:sha256:ab"), ("v1:sha256:ab", "v2:sha256:ab"), ("sha256:ab", "v2:sha256:ab"), (None, "v2:sha256:ab"), ("odd", "v2:sha256:ab"), ("v2:sha256:ab", "v2:sha256:ac")]
    got = values(spark, prints, "a string, b string", facts.compare_fingerprints(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == ["unchanged", "version_mismatch", "version_mismatch", "baseline", "version_mismatch", "changed"]
    pairs = [("A  b", "a b"), ("", None), ("1", "1.0"), (None, "x"), (None, None), ("x", "x"), ("Camp A", "camp  a")]
    same = values(spark, pairs, "a string, b string", facts.values_equal(F.col("a"), F.col("b")), facts.same_words(F.col("a"), F.col("b")))
    assert same == [(False, True), (False, True), (False, False), (False, False), (True, True), (True, True), (False, True)]
    loose = ["5d", "5f", "0x10", "0o17", "0b101", " 2.50 ", "1e3", ".5", "5.", "+7", "-3", "1e400", "Infinity", "NaN", "1_0", "", None, "12 3", "0x", "1e", "12345678901234567890"]
    got = [g[0] for g in values(spark, [(x,) for x in loose], "t string", facts.number(F.col("t")))]
    assert got == [None, None, 16.0, 15.0, 5.0, 2.5, 1000.0, 0.5, 5.0, 7.0, -3.0, *[None] * 8, None, 12345678901234567890.0][: len(loose)]
    assert [g[0] for g in values(spark, [("4.0",), ("4.5",), ("1e30",)], "t string", facts.whole(F.col("t")))] == [4, None, None]
    ids = values(spark, [("b, a,,b,z",), (None,)], "t string", facts.known_ids(F.col("t"), F.array(F.lit("a"), F.lit("b"))))
    assert ids == [(["b", "a"],), (None,)]
    fam = values(spark, [('{"ages":[5,2.5,19,5,3],"asOfDate":"2026-01-01"}',), ("junk",), (None,)], "t string", facts.family_ages(F.col("t"))["ages"], facts.family_ages(F.col("t"))["as_of"])
    assert fam == [([3, 5], "2026-01-01"), ([], None), ([], None)]


def test_identity_cases(spark):
    catalog = spark.createDataFrame([("s1", "p1", "2026-07-06", "A", 5), ("s2", "p1", "2026-07-13", "A", 5), ("s3", "p2", "2026-07-06", "A", 5), ("s4", "p3", "2026-08-01", None, 5), ("s5", "p4", "2026-08-08", "C", 5), ("s6", "p4", "2026-08-08", "D", 5)], "id string, program string, start string, theme string, age int")
    records = spark.createDataFrame([("r1", "p1", "2026-07-06", "a", "5.0"), ("r2", "p1", "2026-07-06", "B", "5"), ("r3", None, "2026-07-06", "A", "5"), ("r4", "p3", "2026-08-01", "X", "5"), ("r5", "p4", "2026-08-08", "E", "5"), ("r6", "p1", None, "A", "5"), ("r7", "p9", "2026-07-06", "A", "5")], "rec string, program string, r_start string, r_theme string, r_age string")
    start, theme, age = reconcile.Dimension("start", "r_start", "start"), reconcile.Dimension("theme", "r_theme", "theme", "text"), reconcile.Dimension("age", "r_age", "age", "number")
    got = {r.rec: (r.kind, r.match_id, r.candidates, r.changed) for r in reconcile.reconcile(records, catalog, "rec", "id", "program", [start, theme, age], [start]).collect()}
    assert got == {
        "r1": ("EXACT_IDENTITY", "s1", 1, None), "r2": ("IDENTITY_CHANGED", None, 1, "theme"), "r3": ("AMBIGUOUS", None, 2, None), "r4": ("NO_MATCH", None, 1, None),
        "r5": ("AMBIGUOUS", None, 2, None), "r6": ("NO_MATCH", None, 0, None), "r7": ("NO_MATCH", None, 0, None),
    }


def test_venue_gates(spark):
    rows = [("first_hand_visit", None, None, "2026-01-01", "verified", None), ("reviewer_reported", None, "https://x", "2026-01-01", "verified", None), ("reviewer_reported", "r", "https://x", "2026-01-01", "conflicting", " "), ("other", None, "https://x", "2026-01-01", "conflicting", "why")]
    got = values(spark, rows, "b string, s string, u string, c string, st string, n string", venue_facts.public_theme(*[F.col(c) for c in ("b", "s", "u", "c", "st", "n")]))
    assert [g[0] for g in got] == [True, False, False, True]
    rows = [("published", "2026", "open", "https://x", "2026-01-01"), ("draft", "2026", "open", "https://x", "2026-01-01"), ("published", "2026", "closed", "https://x", "2026-01-01"), ("published", None, "open", "https://x", "2026-01-01"), ("published", "2026", "open", "http://x", "2026-01-01"), ("published", "2026", "open", "https://x", "2026-02-30")]
    got = values(spark, rows, "a string, b string, c string, d string, e string", venue_facts.viewable(*map(F.col, "abcde")))
    assert [g[0] for g in got] == [True, False, False, False, False, False]
    prices = spark.createDataFrame([(1, "admission", "child", False, 24.95, False, True), (1, "admission", "child", True, 9.0, False, None), (1, "addon", "child", False, 3.0, False, None), (2, "admission", "child", None, 0.0, True, None), (3, "admission", "adult", False, 5.0, False, None)], "v int, kind string, who string, sib boolean, amount double, free boolean, tax boolean")
    got = {r.v: (r.from_cents, r.tax, r.free) for r in venue_facts.child_price_from(prices, "v", "kind", "who", "sib", "amount", "free", "tax").collect()}
    assert got == {1: (2495, True, False), 2: (None, False, True)}
    got = values(spark, [(2,), (6,), (12,)], "a int", venue_facts.age_verdict(F.col("a"), F.lit(3), F.lit(8)), venue_facts.age_verdict(F.col("a"), F.lit(None).cast("int"), F.lit(None).cast("int")))
    assert got == [("too_young", "no_age_info"), ("fits", "no_age_info"), ("too_old", "no_age_info")]


def test_links_are_resolved_as_addresses(spark):
    base = "https://H.example:443/x/y?q=1#f"
    cases = {
        "../a": "https://h.example/a", "?p=2": "https://h.example/x/y?p=2", "a b": "https://h.example/x/a%20b", "./": "https://h.example/x/", "..": "https://h.example/", "../../../z/": "https://h.example/z/",
        "/a/./b/../c": "https://h.example/a/c", "//O.example/p": "https://o.example/p", "HTTP://o.example:80": "http://o.example/", "http://o.example:8080/a": "http://o.example:8080/a", "é/\"q": "https://h.example/x/%C3%A9/%22q",
        "a\\b": "https://h.example/x/a/b", " z\n": "https://h.example/x/z", "a?b=c d'": "https://h.example/x/a?b=c%20d%27", "c#d": "https://h.example/x/c#d", "😀": "https://h.example/x/%F0%9F%98%80", "...": "https://h.example/x/...",
    }
    got = values(spark, [(u,) for u in cases], "u string", pages.absolute_url(F.col("u"), F.lit(base)))
    assert [g[0] for g in got] == list(cases.values())
    odd = values(spark, [("",), ("#x",), ("javascript:x",), ("mailto:a@b",), (None,)], "u string", pages.absolute_url(F.col("u"), F.lit(base)))
    assert odd == [(None,)] * 5 and values(spark, [("a",)], "u string", pages.absolute_url(F.col("u"), F.lit("https://h.example"))) == [("https://h.example/a",)]


def test_addresses_are_read_part_by_part(spark):
    cases = {
        "At 12 King St W, St. John's, NL A1B 2C3": ("12 King St W", "St. John's", "NL", "A1B 2C3"), "5 Elm Rd, Guelph, Ontario, n1h3a1": ("5 Elm Rd", "Guelph", "ON", "N1H3A1"), "5 Elm Rd, Guelph, on.": ("5 Elm Rd", "Guelph", "ON", None),
        "Camps, food, 123456 Elm Rd, Guelph, Quebec J4B 1A1": ("123456 Elm Rd", "Guelph", "QC", "J4B 1A1"), "12 a, Guelph, ON": None, "12 Elm, Guelph, Texas": None, "12 Elm, G9, ON": None, "Elm Rd, Guelph, ON": None, "Open, 9 Long Road, Oakville, on canada L6H 1A1": ("9 Long Road", "Oakville", "ON", None),
        "": None, "3 Elm St, Only, Onward": None,
    }
    got = values(spark, [(x,) for x in cases], "l string", addresses.address(F.col("l")))
    assert [tuple(g[0]) if g[0] else None for g in got] == list(cases.values())
    assert values(spark, [(None,)], "l string", addresses.address(F.col("l"))) == [(None,)]


def test_feed_readings_are_facts(spark):
    a = '[{"id":"2","name":"B","price":10.0},{"id":"1","name":"A","spots":3}]'
    b = ' { "rows" : [ {"spots":3, "id":"1","name":"A","extra":1}, {"price": 10,"id":"2","name":"B"} ] } '
    c = '[{"id":"1","name":"A","spots":4},{"id":"2","name":"B","price":10.0}]'
    rows = [(a, 200, None), (b, 200, None), (c, 200, None), ("[1", 200, None), ("<html>Captcha</html>", 200, None), ("", 0, "timeout"), ("", 0, "bad url"), ("", 503, "x"), ("", 429, "x"), ("", 404, "x")]
    r = pages.reading(F.col("code") == 200, F.col("code"), F.col("error"), F.col("body"), F.lit("feed"))
    got = values(spark, rows, "body string, code int, error string", r["status"], r["content_hash"])
    assert [g[0] for g in got] == ["ok", "ok", "ok", "error", "blocked", "unreachable", "error", "unreachable", "blocked", "error"]
    assert got[0][1] == got[1][1] != got[2][1] and all(g[1] is None for g in got[3:])
    kept = pages.reading(F.lit(True), F.lit(200), F.lit(None).cast("string"), F.col("body"), F.lit("feed"), keep=lambda x: x["name"] == "A")
    assert len({g[0] for g in values(spark, [(a,), (b,)], "body string", kept["content_hash"])}) == 1
    assert values(spark, [(a,)], "body string", pages.feed_facts(F.col("body"), lambda x: x["name"] == "C")) == [("[]",)]


def test_registration_links_by_rank(spark):
    schema = "links array<struct<href:string,text:string>>"
    rows = [
        ([("https://x.example/a", "Register today"), ("https://App.Active.com/z", "go")],), ([("mailto:a@b", "Register"), ("https://x.example/signup", "go")],), ([("https://x.example/b", "We registered"), ("https://x.example/c", "Enrolment")],),
        ([("/plain", "about")],), ([],), ([("https://x.example/book", "Book  now"), ("https://x.example/d", "book now!")],),
    ]
    got = values(spark, rows, schema, pages.registration_link(F.col("links"), r"active\.com$")["href"])
    assert [g[0] for g in got] == ["https://App.Active.com/z", "https://x.example/signup", "https://x.example/c", None, None, "https://x.example/d"]


def test_stated_ages(spark):
    d = dt.date(2026, 7, 1)
    rows = [(6, d, d), (6, dt.date(2026, 6, 30), d), (4, d, d), (6, None, d), (6, d, None), (6.5, d, d), (None, d, d), (-1, d, d)]
    got = values(spark, [(None if a is None else float(a), x, y) for a, x, y in rows], "a double, x date, y date", ages.stated_age_fits(F.col("a"), F.col("x"), F.col("y"), F.lit(5), F.lit(8)))
    assert [g[0] for g in got] == ["yes", "unknown", "no", *["unknown"] * 5]


def test_cycles_take_the_stated_branches(spark):
    from sorrel.operators import ingest

    v1, v2 = "camp-facts-v1:sha256:aa", "camp-facts-v2:sha256:aa"
    s = spark.createDataFrame([("same", "static_html", "h", v2), ("old", "static_html", "h", v1), ("moved", "static_html", "g", v1), ("equal", "static_html", "g", v2), ("new", "static_html", None, None), ("bad", "static_html", "g", v2), ("changed", "static_html", "g", "camp-facts-v2:sha256:bb"), ("call", "manual", None, None), ("gone", "static_html", None, None)], "k string, strategy string, last_hash string, last_print string").withColumn("hours", F.lit(24))
    shots = spark.createDataFrame([(k, "success", "h", True) for k in ("same", "old", "moved", "equal", "new", "bad", "changed")], "k string, status string, content_hash string, has_content boolean")
    facts_ = spark.createDataFrame([(k, v2, 0 if k == "bad" else 2) for k in ("same", "old", "moved", "equal", "new", "bad", "changed")], "k string, fact_print string, n_records int")
    now = F.lit("2026-01-01").cast("timestamp")
    got = {r.k: (r.outcome, r.changed, r.successful, r.candidates, r.error) for r in ingest.process_sources(s, shots, facts_, "k", now).collect()}
    assert got == {
        "same": ("UNCHANGED_SOURCE", False, True, False, None), "old": ("REBASELINED", False, True, False, None), "moved": ("CHANGED_VERSION", True, True, True, None), "equal": ("UNCHANGED_FACTS", False, True, False, None),
        "new": ("BASELINE", True, True, True, None), "bad": ("EXTRACTION_FAILED", True, False, False, "extraction_failed"), "changed": ("CHANGED_FACTS", True, True, True, None),
        "call": ("UNSUPPORTED", False, False, False, "crawl_strategy_not_fetchable:manual"), "gone": ("FAILED", False, False, False, "not_fetched"),
    }
    forced = {r.k: (r.outcome, r.candidates) for r in ingest.process_sources(s, shots, facts_, "k", now, force=True).collect()}
    assert forced["same"] == forced["equal"] == ("FORCED", True) and forced["old"] == ("CHANGED_VERSION", True)


def test_age_bands_and_price_options_have_their_own_form(spark):
    schema = "bands array<struct<ageMax:int,ageMin:int,copy:string,hoursStart:string>>, named array<struct<label:string,ageMin:int>>, options array<struct<role:string,amount:double,label:string>>, keyed array<struct<key:string,role:string>>, id string"
    rows = [([(9, 6, "big", "09:00"), (5, None, "small", None)], [("Kits", 3)], [("day", 50.0, "Day"), ("week", 200.0, None)], [(None, "r"), ("k", "s")], "x"), ([(5, None, "tiny", None), (9, 6, "BIG", "09:00")], [("Kits", 3)], [("week", 200.0, None), ("day", 50.0, "Day")], [("k", "q"), (None, "r")], "y"), (None, None, None, None, "z")]
    df = spark.createDataFrame(rows, schema)
    f = {c: (F.col(c), df.schema[c].dataType) for c in df.columns}
    one = facts.fact_payload("session", {"ageBands": f["bands"], "priceOptions": f["options"], "externalId": f["id"], "colour": f["id"]})
    two = facts.fact_payload("odd", {"ageBands": f["named"], "priceOptions": f["keyed"], "externalId": f["id"], "colour": f["id"]})
    got = [tuple(r) for r in df.select(one, two).collect()]
    bands = '[{"ageMax":9,"ageMin":6,"hoursEnd":null,"hoursStart":"09:00"},{"ageMax":5,"ageMin":null,"hoursEnd":null,"hoursStart":null}]'
    assert got[0][0] == got[1][0]
    want = '{"type":"session","fields":{"ageBands":%s,"priceOptions":[{"amount":50.0,"currency":null,"key":"day","label":"Day","unit":null},{"amount":200.0,"currency":null,"key":"week","label":null,"unit":null}]}}'
    assert got[0][0] in (want % bands, want % ("[" + ",".join(reversed(["{" + x.strip("[]{}") + "}" for x in bands.strip("[]").split("},{")])) + "]"))
    assert got[2][0] == '{"type":"session","fields":{"ageBands":null,"priceOptions":null}}'
    assert got[0][1] == '{"type":"odd","fields":{"ageBands":[{"ageMax":null,"ageMin":3,"hoursEnd":null,"hoursStart":null,"label":"Kits"}],"colour":"x","priceOptions":[{"amount":null,"currency":null,"key":"k","label":null,"unit":null},{"amount":null,"currency":null,"key":"r","label":null,"unit":null}]}}'
