"""Folds over lines and JSON of unknown shape against plain versions."""

import json
import random
import re

from pyspark.sql import functions as F

from sorrel.functions import sections
from sorrel.functions.jsons import strict_json
from sorrel.sources import variants


def fold(lines):
    head = val = None
    out = []
    for i, x in enumerate(lines or []):
        if x is None:
            continue
        if re.search(sections.WEEK, x):
            head, val = " ".join(x.split()), None
        if m := re.search(sections.PRICE, x):
            val = m[1]
        if m := re.search("(full|half) day", x):
            out.append((i, head, val, m[0]))
    return out


def test_schedules_are_folded_in_order(spark):
    rng = random.Random(4)
    bits = ["Week 1   July 6-10  Space", "  week 2 July 13-17: $310 full day", "$250.50 a week", "half day", "full day camp", "weekly news", "", "Care $15", None, "Week  3"]
    pages = [[rng.choice(bits) for _ in range(rng.randrange(30))] for _ in range(40)] + [None, [], [rng.choice(bits) for _ in range(1500)], ["half day"] * 600]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, lines array<string>")
    for i, got in df.select("i", sections.schedule_rows(F.col("lines"), "(full|half) day")).collect():
        assert [tuple(r) for r in got] == fold(pages[i])


def test_blocks_pass_the_open_state_on(spark, monkeypatch):
    lines = ["Week 1", "$5"] + [f"half day {i}" for i in range(20)]
    for size in (1, 2, 7, 22, 23):
        monkeypatch.setattr(sections, "BLOCK", size)
        (got,) = spark.createDataFrame([(lines,)], "l array<string>").select(sections.schedule_rows(F.col("l"), r"half day \d+")).first()
        assert [tuple(r) for r in got] == [(i + 2, "Week 1", "5", f"half day {i}") for i in range(20)]


def test_variants(spark):
    texts = ['{"a": 1}', '{"a": "2.50"}', '{"a": "x1"}', '{"a": "0x10"}', '{"a": "5d"}', '{"a": true}', '{"a": null}', '{"a": [1]}', '{"a": {"b": 1}}', "[1, 2]", "3", '"s"', "null", "{bad", "", "  ", None, '{"a": 1e400}', '{"a": 12345678901234567890.5}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, j string").repartition(3, "i").select("i", strict_json(F.col("j")).alias("v")).repartition(2, "i")
    a = F.col("v")
    got = {r.i: (r.n, r.t, r.f) for r in df.select("i", variants.number_at(a, "$.a").alias("n"), variants.text_at(a, "$.a").alias("t"), variants.flag_at(a, "$.a").alias("f")).collect()}
    want = {0: (1.0, None, None), 1: (2.5, "2.50", None), 2: (None, "x1", None), 3: (16.0, "0x10", None), 4: (None, "5d", None), 5: (None, None, True), 18: (12345678901234567890.5, None, None)}
    assert got == {i: want.get(i, (None, None, None)) for i in range(len(texts))}
    rows = spark.createDataFrame([(1, '[{"a": 1}, 2, null, "x"]'), (2, '{"a": 1}'), (3, "[1"), (4, None), (5, "[]")], "i int, j string")
    out = variants.elements(rows.select("i", strict_json(F.col("j")).alias("v")), "v").select("i", "pos", variants.number_at(F.col("element"), "$.a").alias("a"))
    assert sorted(map(tuple, out.collect())) == [(1, 0, 1.0), (1, 1, None), (1, 2, None), (1, 3, None)]


def test_variations_in_markup(spark):
    rows = [
        {"attributes": {"attribute_pa_player_type": "Goalie"}, "display_price": 399.5, "availability_html": "<p>In   stock</p>", "variation_description": "Week &amp; more", "is_in_stock": True},
        {"attributes": {"attribute_pa_player-type": "player"}, "display_price": "250", "availability_html": None, "is_in_stock": "yes"},
        {"attributes": {"attribute_pa_player_type": "coach"}, "display_price": "call us"}, 7, {},
    ]
    attr = json.dumps(rows).replace("&", "&amp;").replace('"', "&quot;")
    pages = [(1, f'<form class="x" data-product_variations="{attr}">'), (2, "<form data-product_variations='[{&quot;display_price&quot;: 1}]'>"), (3, '<form data-product_variations="[{bad">'), (4, '<form data-product_variations="{}">'), (5, "<p>none</p>"), (6, None)]
    got = variants.product_variations(spark.createDataFrame(pages, "id int, html string"), "html").orderBy("id", "pos").collect()
    assert [(r.id, r.pos, r.kind, r.price, r.availability, r.description, r.in_stock) for r in got] == [
        (1, 0, "goalie", 399.5, "In stock", "Week & more", True), (1, 1, "player", 250.0, None, None, None), (1, 2, None, None, None, None, None), (1, 3, None, None, None, None, None), (1, 4, None, None, None, None, None), (2, 0, None, 1.0, None, None, None),
    ]


def test_past_items(spark):
    t = "2025-02-03T04:05:06.000Z"
    items = [
        {"ref": {"kind": "camp_session", "programId": "p", "sessionId": "s"}, "reason": "removed", "savedAt": t, "movedAt": "bad", "registeredMarkedAt": t},
        {"ref": {"kind": "camp_program", "programId": "p"}, "reason": "unavailable", "savedAt": "2025-99-99T00:00:00Z"},
        {"ref": {"kind": "discover_listing", "listingId": "l"}, "reason": "sold"}, {"ref": {"kind": "camp_session", "programId": "p"}, "reason": "removed"},
        {"ref": {"kind": "camp_program", "programId": "//x"}, "reason": "removed"}, {"ref": "x", "reason": "removed"}, 5,
    ]
    got = variants.past_items(spark.createDataFrame([(1, json.dumps(items)), (2, "[]"), (3, "x"), (4, None)], "u int, raw string"), "raw").orderBy("pos").collect()
    epoch = "1970-01-01T00:00:00.000Z"
    assert [tuple(r) for r in got] == [(1, 0, "camp_session:p:s", "removed", t, t, t), (1, 1, "camp_program:p", "unavailable", epoch, epoch, None)]


def test_json_is_strict(spark):
    texts = ["{}", " [1, 2] ", "1", "null", "{} x", "[1]}", "1, 2", "1],[2", '1},{"v":2', '1,"w":2', "[1", "", " ", None, '{"a":1}{"a":2}', "tru", '"x"']
    fine = ["{}", " [1, 2] ", "1", "null", '"x"']
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strict_json(F.col("t")).isNotNull().alias("ok")).collect()
    assert [r.t for r in got if r.ok] == fine
