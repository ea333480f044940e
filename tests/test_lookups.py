"""Each lookup operator against a plain version, with nulls, ties, repeats, hot keys and empty tables."""

import random
import statistics
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sorrel.operators import asof, candidates, intervals, medians, names, substrings


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


BAND = "band long, low long, high long, cost long, note string"


def band_lists():
    rng = random.Random(7)
    wide = [(i, a := rng.randrange(-900, 900), a + rng.choice((0, 1, 5, 60, 2000)), rng.randrange(4), f"n{i}") for i in range(300)]
    return [wide, [*wide, (900, None, 5, 1, "x"), (901, 40, None, 0, "y"), (902, None, None, 0, "z"), (903, 9, 3, 0, "backwards")], [(1, 5, 5, 1, "a"), (2, 5, 5, 1, "b")], []]


def best_band(v, bands):
    fits = [b for b in bands if v is not None and (b[1] is None or b[1] <= v) and (b[2] is None or v <= b[2])]
    if not fits:
        return (None, None, None)
    b = min(fits, key=lambda b: (b[1] is None or b[2] is None, 0 if b[1] is None or b[2] is None else b[2] - b[1], b[3], b[0]))
    return b[0], b[3], b[4]


@pytest.mark.parametrize("k", range(4))
def test_bands_by_search_and_by_blocks(spark, k, monkeypatch):
    bands = band_lists()[k]
    vs = [(i, v) for i, v in enumerate([None, *range(-1000, 3000, 7), 5, 5, 6, 40, *[b[c] for b in bands for c in (1, 2)]])]
    values, table = spark.createDataFrame(vs, "i long, v long"), spark.createDataFrame(bands, BAND)
    want = sorted(((i, v, *best_band(v, bands)) for i, v in vs), key=str)
    assert rows(intervals.band_join(values, "v", table, also=("note",))) == want
    monkeypatch.setattr(intervals, "MOST_BANDS", 0)
    assert not bands or rows(intervals.band_join(values, "v", table, also=("note",))) == want
    assert bands or rows(intervals.dyadic_band_join(values, "v", table, intervals.Bands()).select("i", "v", "band_found.band")) == sorted(((i, v, None) for i, v in vs), key=str)


def test_bands_of_doubles_and_long_lists(spark, monkeypatch):
    bands = spark.createDataFrame([("a", 0.5, 2.5, 1), ("b", 1.0, 1.5, 1)], "band string, low double, high double, cost int")
    values = spark.createDataFrame([(x,) for x in (0.4, 0.5, 0.99, 1.0, 1.25, 1.5, 1.51, 2.5, 2.6)], "v double")
    assert [r.band for r in intervals.band_join(values, "v", bands).orderBy("v").collect()] == [None, "a", "a", "b", "b", "b", "a", "a", None]
    monkeypatch.setattr(intervals, "MOST_BANDS", 1)
    with pytest.raises(TypeError):
        intervals.band_join(values, "v", bands)
    # Twenty thousand bands on one point, and a third of all values there: no row is repeated for them.
    many = spark.range(20_000).selectExpr("id AS band", "1000 - id AS low", "1000 + id AS high", "id AS cost")
    hot = spark.range(3000).selectExpr("IF(id % 3 = 0, 1000, id * 20) AS v")
    got = intervals.band_join(hot, "v", many).where("v = 1000")
    assert got.count() == 1000 + hot.where("v = 1000").count() - 1000 and {r.band for r in got.collect()} == {0}


def test_a_value_meets_one_row_for_each_size(spark):
    cut = intervals.dyadic_band_join(spark.range(10).selectExpr("id AS v"), "v", spark.createDataFrame([(1, 0, 1 << 40, 1, "")], BAND), intervals.Bands())
    assert "CartesianProduct" not in cut._jdf.queryExecution().toString() and "NestedLoop" not in cut._jdf.queryExecution().toString()
    assert cut.where("band_found.band = 1").count() == 10


def test_covered_days(spark):
    rng = random.Random(3)
    d0 = date(2024, 1, 1)
    own = [(k, d0 + timedelta(a), d0 + timedelta(a + rng.randrange(-1, 6))) for k in "abc" for a in [rng.randrange(90) for _ in range(40)]]
    own += [("d", None, d0), ("d", d0, None), ("e", d0, d0), ("e", d0, d0), (None, d0, d0 + timedelta(1))]
    got = rows(intervals.covered_days(spark.createDataFrame(own, "k string, s date, e date"), ["k"], "s", "e"))
    days = {}
    for k, s, e in own:
        if s and e:
            days.setdefault(k, set()).update(s + timedelta(i) for i in range((e - s).days + 1))
    want = []
    for k, ds in days.items():
        starts = [d for d in sorted(ds) if d - timedelta(1) not in ds]
        for s in starts:
            n = next(i for i in range(999) if s + timedelta(i) not in ds)
            want.append((k, s, s + timedelta(n - 1), n))
    assert got == sorted(want, key=str)
    assert intervals.covered_days(spark.createDataFrame([], "k string, s date, e date"), ["k"], "s", "e").count() == 0


@pytest.mark.parametrize("slice_seconds", [50, 86_400, 10**9])
def test_asof(spark, slice_seconds):
    rng = random.Random(slice_seconds)
    t0 = datetime(2024, 3, 1)
    at = lambda: t0 + timedelta(seconds=rng.randrange(400)) if rng.random() > 0.03 else None
    left = [(i, rng.choice(["hot", "hot", "b", "c", None]), at(), "x") for i in range(300)]
    right = [(rng.choice(["hot", "b", None]), at(), rng.randrange(9), rng.choice([None, "p", "q"])) for _ in range(80)]
    a, b = spark.createDataFrame([*left, left[0]], "i long, k string, ts timestamp, passed string"), spark.createDataFrame(right, "k string, ts timestamp, v long, w string")

    def last(k, t):
        fits = [(r[1], r[2], (r[3] is not None, r[3] or ""), r) for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and r[1] <= t]
        r = max(fits)[3] if fits else None
        return (r[1], r[2], r[3]) if r else (None, None, None)

    want = sorted(((*r, *last(r[1], r[2])) for r in [*left, left[0]]), key=str)
    assert rows(asof.asof_join(a, b, "k", "ts", ["v", "w"], slice_seconds)) == want
    assert rows(asof.asof_join(a, b.limit(0), "k", "ts", ["v", "w"])) == sorted(((*r, None, None, None) for r in [*left, left[0]]), key=str)


def test_names(spark):
    left = ["Camp Alpha (East) & Co.", "camp", "YMCA", "ymca of town", "a b", "Día", None, "", "Camp Alpha", "camp alpha"]
    right = ["CAMP alpha and co west", "Camp", "Y M C A", "YMCA", "a b c", "alpha", "d", "camp alpha  "]
    a, b = spark.createDataFrame([(x,) for x in left], "n string"), spark.createDataFrame([(x,) for x in right], "n string")
    plain = {n: r.p for n in {*left, *right} - {None} for r in spark.createDataFrame([(n,)], "n string").select(names.plain_name(F.col("n")).alias("p")).collect()}

    def match(x, y):
        s, t = sorted((x, y), key=len)
        return bool(x and y) and (x == y or len(s) >= 4 and t.startswith(s + " "))

    want = {(plain[x], plain[y]) for x in left if x for y in right if match(plain[x], plain[y])}
    assert sorted(map(tuple, names.name_matches(a, "n", b, "n").collect())) == sorted(want) and ("camp", "camp alpha and co west") in want and ("a b", "a b c") not in want


def test_substrings(spark, monkeypatch):
    rng = random.Random(2)
    bits = ["abc", "Bcd", "x", " ", "été", "zz", "😀q", "the"]
    texts = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for i in range(200)] + [(900, None), (901, "")]
    asked = [(i, q) for i, q in enumerate(["abc", "ABCB", "x zz", "é", "😀", "tex", "nowhere", "", None, "  ", "bcdbcd the", "abc nowhere", "ab ab", "thethethe"])]
    t, q = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(asked, "q long, words string")
    want = sorted(((i, d) for i, w in asked if w and w.split() for d, x in texts if all(p in (x or "").lower() for p in w.lower().split())), key=str)
    assert rows(substrings.substring_search(t, "id", "text", q, "q", "words")) == want
    monkeypatch.setattr(substrings, "SENT", 3)  # more queries than are sent
    assert rows(substrings.substring_search(t, "id", "text", q, "q", "words")) == want
    monkeypatch.setattr(substrings, "SENT", 100)
    kept = substrings.gram_index(t, "id", "text")
    assert rows(substrings.substring_search(t, "id", "text", q, "q", "words", kept)) == want
    assert substrings.substring_search(t.limit(0), "id", "text", q, "q", "words").count() == 0


@pytest.mark.parametrize("few", [1, 8, 4096])
def test_medians(spark, few):
    rng = random.Random(few)
    own = [("hot", rng.choice((rng.random() * 1e6, 5.0, 7.0))) for _ in range(901)] + [("even", x) for x in (1.0, 2.0, 4.0, 100.0)] + [("same", 3.0)] * 50
    own += [("wide", x) for x in (-1.7e308, 1.7e308, 0.0, 1e-300, -1e-300, 5e-324)] + [(None, 2.0), (None, None), ("none", None), ("nan", float("nan")), ("one", -4.5)]
    got = {r.g: (r.n, r.median) for r in medians.exact_medians(spark.createDataFrame(own, "g string, v double"), "g", "v", few=few).collect()}
    per = {}
    for g, v in own:
        if v is not None and v == v:
            per.setdefault(g, []).append(v)
    assert got == {g: (len(vs), statistics.median(vs)) for g, vs in per.items()}
    assert medians.exact_medians(spark.createDataFrame([], "g string, v double"), "g", "v").count() == 0


def test_candidates(spark):
    rng = random.Random(9)
    pick = lambda *xs: rng.choice(xs)
    records = [(i, pick("a", "b", None), pick(1, 2, None), pick("u", "v", None)) for i in range(60)]
    catalog = [(100 + i, pick("a", "b", None), pick(1, 2, None), pick("u", "v", "w", None)) for i in range(40)]
    schema = "id long, x string, y int, ident string"

    def plain(r, rows_):
        stated = [d for d in (1, 2) if r[d] is not None]
        hits = [c for c in rows_ if stated and all(c[d] == r[d] for d in stated)]
        left = [c for c in hits if r[3] is None or c[3] is None or r[3] == c[3]]
        return (r[0], ["", "x", "y"][1:][: 0] or [n for d, n in ((1, "x"), (2, "y")) if d in stated], len(hits), len(left), len(hits) - len(left), left[0][0] if len(left) == 1 else None, "MATCH" if len(left) == 1 else "AMBIGUOUS" if left else "NO_MATCH")

    a = spark.createDataFrame(records, schema)
    for rows_ in (catalog, catalog[:3], []):
        got = candidates.candidate_counts(a, "id", spark.createDataFrame(rows_, schema), "id", ["x", "y"], "ident")
        assert rows(got) == sorted((plain(r, rows_) for r in records), key=str)
    assert candidates.candidate_counts(a.limit(0), "id", a, "id", ["x", "y"], "ident").count() == 0
    with pytest.raises(ValueError):
        candidates.candidate_counts(a, "id", a, "id", ["x"] * 13, "ident")
