import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sorrel.llm import crosspolytope as C
from sorrel.llm import itq as I
from sorrel.llm.vectors import products

SF = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>, label int, links string, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(i, e if e is None else [None if x is None else float(x) for x in e], l, "x", 3) for i, e, l in rows], SCHEMA)


def odd_rows():
    return [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [float("nan")] * 8, 1), (904, [1.0, None] * 4, 1), (905, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (906, [1.0, 2.0], 1)]


def clustered(n=500, seed=0, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    out = []
    for i in range(n):
        x = centres[rng.integers(40)] + rng.normal(size=dim) * 0.12 * rng.integers(0, 2)
        out.append((i, (x * rng.choice([1, 2])).astype(np.float32).tolist(), int(rng.integers(0, 2)) if i % 17 else None))
    return out


def brute_links(rows, cosine=0.93):
    ok = {}
    for k, (i, e, l) in enumerate(rows):
        if i is not None and e and len(e) == 8 and all(x is not None and math.isfinite(x) for x in e) and any(e) and l is not None:
            ok[k] = np.array(e, float)
    keys = list(ok)
    x = np.array([ok[k] for k in keys])
    s = (x @ x.T) / np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1)))
    near = (s >= cosine) & np.array([[rows[a][2] == rows[b][2] for b in keys] for a in keys]) & ~np.eye(len(keys), dtype=bool)
    root = {k: k for k in range(len(rows))}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in zip(*np.nonzero(near)):
        root[find(keys[a])] = find(keys[b])
    n = {keys[a]: int(near[a].sum()) for a in range(len(keys))}
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if k in ok:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(rows[k][0], n.get(k, 0), least[find(k)] if k in ok else rows[k][0]) for k in range(len(rows))]


@pytest.mark.parametrize("cap", [2048, 7])
def test_near_vectors_equal_brute_force(spark, monkeypatch, cap):
    monkeypatch.setattr(I, "CAP", cap)
    rows = clustered() + [(700 + i, [1.0, 2, 3, 4, 5, 6, 7, 8], 1) for i in range(30)] + odd_rows()
    got = I.near_vectors(spark, frame(spark, rows)).collect()
    want = brute_links(rows)
    found, all_links = sum(r.n_links for r in got), sum(n for _, n, _ in want)
    assert len(got) == len(rows) and found >= 0.98 * all_links
    got, want = ({r[0]: tuple(r)[1:3] for r in x} for x in (got, want))
    assert all(got[k][0] <= n for k, (n, _) in want.items()) and np.mean([got[k] == want[k] for k in want]) > 0.95
    assert got[None] == (0, None) and got[902] == (0, 902)


def test_different_vectors_of_one_id(spark):
    a, b = [1.0, 0, 0, 0, 0, 0, 0, 0], [0, 1.0, 0, 0, 0, 0, 0, 0]
    near_a, near_b = [1.0, 0.1, 0, 0, 0, 0, 0, 0], [0.1, 1.0, 0, 0, 0, 0, 0, 0]
    rows = [(1, a, 1), (1, b, 1), (2, near_a, 1), (3, near_b, 1), (4, a, 2), (4, b, 3), (5, near_a, 2)]
    got = sorted(tuple(r) for r in I.near_vectors(spark, frame(spark, rows)).collect())
    assert got == sorted((i, n, c, i == c) for i, n, c in brute_links(rows)) and [g[1] for g in got] == [1, 1, 1, 1, 0, 1, 1]


def test_lengths_are_compared_apart(spark):
    rows = [(i, [1.0, 2.0, 0.01 * i], 1) for i in range(25)] + [(40 + i, [1.0, 2.0, 0.0, 0.01 * i], 1) for i in range(3)]
    links = {r.vec_id: (r.n_links, r.component_id) for r in I.near_vectors(spark, frame(spark, rows)).collect()}
    assert links[0] == (24, 0) and links[41] == (2, 40)
    got = C.nearest(spark, frame(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert {r.vec_id for r in got if r.query_id == 40} == {41, 42} and len([r for r in got if r.query_id == 20]) == 20


def test_near_vectors_odd_tables(spark):
    assert I.near_vectors(spark, frame(spark, [])).count() == 0
    got = I.near_vectors(spark, frame(spark, odd_rows() + odd_rows())).collect()
    assert len(got) == 2 * len(odd_rows())
    same = I.near_vectors(spark, frame(spark, [(5, [1.0] * 8, 1)] * 3 + [(4, [1.0] * 8, 1), (6, [1.0] * 8, 2), (3, [1.0] * 8, None)])).collect()
    assert sorted(tuple(r) for r in same) == [(3, 0, 3, True), (4, 3, 4, True), (5, 3, 4, False), (5, 3, 4, False), (5, 3, 4, False), (6, 0, 6, True)]


def test_codes_are_balanced_and_close():
    x = np.random.default_rng(0).normal(size=(2000, 32))
    q = I.Quantizer.fit(x, 4, 12)
    bits = x @ q.planes >= 0
    assert abs(bits.mean(0) - 0.5).max() < 0.1
    tables, width = I.plan_tables(100_000, 0.93)
    assert 1 - (1 - (1 - math.acos(0.93) / math.pi) ** width) ** tables >= I.RECALL - 1e-9


def exact_nearest(rows, k, dim=8):
    ok = [(i, np.array(e, float)) for i, e, _ in rows if i is not None and e and len(e) == dim and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    ids, x = np.array([i for i, _ in ok]), np.array([e for _, e in ok])
    out = {}
    for i, e in ok:
        if i % 20 == 0:
            s = products(np.repeat(e[None], len(x), 0), x)
            order = [o for o in np.lexsort((ids, -s)) if ids[o] != i][:k]
            out[i] = [(int(ids[o]), float(s[o])) for o in order]
    return out


def check_nearest(got, want, recall):
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == set(want) and sorted({r.rank for r in got}) == list(range(1, max(map(len, want.values())) + 1))
    for v in by.values():
        assert v == sorted(v, key=lambda x: (-x[1], x[0]))
    hits = [len(set(by[i]) & set(want[i])) / max(1, len(want[i])) for i in want]
    assert np.mean(hits) >= recall, np.mean(hits)


@pytest.mark.parametrize("caps", [(4096, 2048), (16, 4)])
def test_nearest_with_ties_norms_and_odd_rows(spark, monkeypatch, caps):
    monkeypatch.setattr(C, "INDEX_CAP", caps[0]), monkeypatch.setattr(C, "QUERY_CAP", caps[1])
    rows = clustered() + [(1000 + i, clustered()[0][1], 1) for i in range(60)] + odd_rows()
    got = C.nearest(spark, frame(spark, rows), F.col("vec_id") % 20 == 0).collect()
    check_nearest(got, exact_nearest(rows, 20), 0.95)


def test_nearest_of_few(spark):
    rows = clustered(12)
    check_nearest(C.nearest(spark, frame(spark, rows), F.col("vec_id") % 20 == 0).collect(), exact_nearest(rows, 20), 1.0)
    assert C.nearest(spark, frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert C.nearest(spark, frame(spark, [(20, [1.0] * 8, 1)]), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_on_the_given_vectors(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in t.collect()]
    check_nearest(C.nearest(spark, t, F.col("vec_id") % 20 == 0).collect(), exact_nearest(rows, 20, 64), 0.95)


@pytest.mark.parametrize("norms", ["outlier", "lognormal"])
def test_recall_with_unequal_norms(spark, norms):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 64))
    x = centres[rng.integers(60, size=1500)] + rng.normal(size=(1500, 64)) * 0.7
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= np.exp(0.5 * rng.normal(size=(1500, 1))) if norms == "lognormal" else np.where(np.arange(1500) == 7, 100, 1)[:, None]
    rows = [(i, e.astype(np.float32).tolist(), 1) for i, e in enumerate(x)]
    got = C.nearest(spark, frame(spark, rows), F.col("vec_id") % 20 == 0).collect()
    check_nearest(got, exact_nearest(rows, 20, 64), 0.95)
    assert len(got) == 75 * 20


def test_queries_left_with_few_candidates_are_swept(spark):
    rows = clustered(500, 2)
    got = C.nearest(spark, frame(spark, rows), F.col("vec_id") % 20 == 0, tables=1, recall=0.0).collect()
    assert len(got) == 25 * 20


@pytest.mark.parametrize("dim", [512, 768])
def test_recall_in_many_dimensions(spark, dim):
    x = np.random.default_rng(dim).normal(size=(1500, dim)).astype(np.float32)
    rows = [(i, e.tolist(), 1) for i, e in enumerate(x)]
    check_nearest(C.nearest(spark, frame(spark, rows), F.col("vec_id") % 20 == 0).collect(), exact_nearest(rows, 20, dim), 0.9)


def test_buckets_of_several_axes(spark):
    rows = clustered(3000, 5, 16)
    got = C.nearest(spark, frame(spark, rows), F.col("vec_id") % 20 == 0, bucket_rows=40).collect()
    check_nearest(got, exact_nearest(rows, 20, 16), 0.9)
    x = np.random.default_rng(1).normal(size=(50, 16))
    h = C.CrossPolytope(16, 2, 2)
    d = h.directions(x)
    depth = h.depths(d[:25], d[25:])
    for t in range(2):
        for i in range(25):
            near = set(h.buckets(d[i : i + 1], t, int(depth[i, t]))[0].tolist())
            assert h.buckets(d[25 + i : 26 + i], t)[0, 0] in near and h.buckets(d[25 + i : 26 + i], t)[0, 0] not in set(h.buckets(d[i : i + 1], t, int(depth[i, t]) - 1)[0].tolist() if depth[i, t] > 1 else [])


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(20, [1.0] * 8, 1), (20, [-1.0] * 8, 1), (3, [2.0] * 8, 1), (3, [2.0] * 8, 1), (4, [-3.0] * 8, 1)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in C.nearest(spark, frame(spark, rows), F.col("vec_id") % 20 == 0).collect())
    assert got == sorted([(20, 1, 3, 16.0), (20, 2, 3, 16.0), (20, 3, 20, -8.0), (20, 4, 4, -24.0), (20, 1, 4, 24.0), (20, 2, 20, -8.0), (20, 3, 3, -16.0), (20, 4, 3, -16.0)])


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(C.hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(C.hadamard(C.hadamard(x)), x)
