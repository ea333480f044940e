"""Which bands of a long list are cut into blocks."""

from sorrel.operators import intervals


def test_bands_of_equal_bounds_are_cut_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(intervals, "written", lambda df, name: kept.append(df.count()) or df)
    bands = spark.createDataFrame([(i % 3 * 10, i % 3 * 10 + 15, 100 - i % 50, i) for i in range(300)] + [(5, 1, 0, 999)], "low long, high long, cost long, band long")
    out = intervals.dyadic_band_join(spark.createDataFrame([(3,), (12,), (34,), (36,), (None,)], "v long"), "v", bands, intervals.Bands())
    assert {r.v: r.band_found and r.band_found.band for r in out.collect()} == {3: 99, 12: 49, 34: 149, 36: None, None: None} and kept == [3]
