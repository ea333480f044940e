import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cases import documents, texts
from sorrel.llm import simhash as S
from sorrel.llm.components import components
from sorrel.llm.workspace import Workspace


def plain_fingerprint(text):
    import re

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(root)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(b)] = find(a)
    return {f: find(f) for f in fs}


def test_fingerprint():
    for _, t in texts():
        assert S.fingerprint((t or "").encode()) == plain_fingerprint(t)


def test_spark_hash_is_the_same(spark):
    h = spark.sql("SELECT xxhash64('the cat sat') AS h").first().h
    assert h % 2**64 == xxhash.xxh64_intdigest("the cat sat", 42)


@pytest.mark.parametrize("leaf, home, visitors", [(1024, 2048, 4096), (8, 4, 6)])
def test_query_equals_brute_force(spark, monkeypatch, leaf, home, visitors):
    monkeypatch.setattr(S, "LEAF", leaf), monkeypatch.setattr(S, "HOME_CAP", home), monkeypatch.setattr(S, "VISITOR_CAP", visitors)
    rng = random.Random(4)
    rows = list(texts())
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(120)) for _ in range(25)]
    for i in range(400):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "x" + str(rng.randint(0, 9))
        rows.append((100 + i, " ".join(w)))
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in S.near_duplicates(spark, documents(spark, rows)).collect()]
    fp = [(d, plain_fingerprint(t)) for d, t in rows]
    root = groups({f for _, f in fp})
    least = {}
    for d, f in fp:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    assert sorted(got, key=str) == sorted(((d, f, least.get(root[f])) for d, f in fp), key=str)
    kept = S.one_of_each_group(spark, documents(spark, rows)).collect()
    # One row for each component: its smallest doc_id; the row without one only where the component has no other.
    assert sorted(root[plain_fingerprint(r.text)] for r in kept) == sorted(set(root.values()))
    assert all(r.doc_id == least.get(root[plain_fingerprint(r.text)]) for r in kept) and [r.text for r in kept if r.doc_id is None] == ["no id at all"]


def test_visits_cover_all_close_pairs():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = a.copy()
    for k in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, len(b)).astype(np.uint64)
    trees = S.VantageTrees(a[::3], 7, 3)
    tree, leaf, at, home = trees.visits(np.concatenate([a, b]))
    where = {}
    for t, x, i, h in zip(tree, leaf, at, home):
        where.setdefault(int(i), {}).setdefault((int(t), int(x)), bool(h))
    for i in range(len(a)):
        assert any(h and k in where[i + len(a)] for k, h in where[i].items())
        assert sum(where[i].values()) == 2


def test_empty(spark):
    assert S.near_duplicates(spark, documents(spark, [])).count() == 0


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5000, i) for i in range(1000, 1200)] + [(7, 7), (None, 3), (9, 8), (8, 9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    want = {i: 100 for i in range(101, 161)} | {i: 1000 for i in [*range(1001, 1200), 5000]} | {9: 8}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0


def test_texts_are_not_shuffled(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = S.one_of_each_group(spark, documents(spark, [(i, f"w{i % 700} x{i % 700} y{i % 700}") for i in range(1000)]).repartition(3))
        plan = out._jdf.queryExecution().executedPlan().toString()
        kept = sorted(r.doc_id for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    root = groups({f for f in map(plain_fingerprint, (f"w{i} x{i} y{i}" for i in range(700)))})
    least = {}
    for i in range(700):
        least.setdefault(root[plain_fingerprint(f"w{i} x{i} y{i}")], i)
    assert kept == sorted(least.values())
