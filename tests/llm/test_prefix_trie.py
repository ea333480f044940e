import hashlib
import random
import zlib

import pytest

from sorrel.llm import prefix_trie as P
from sorrel.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth string, sizes int, id string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", "d", 3, "i") for r in rows], SCHEMA)


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest[:32], role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
    return out


def brute(rows):
    members = {}
    for c, ts in rebuilt(rows).items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append((c, len(ts) == d))
    out = []
    for p, ms in members.items():
        under = [q for q in members if q[: len(p)] == p]
        parent = min(c for c, _ in members[p[:-1]]) if p else None
        children = sum(len(q) == len(p) + 1 for q in under)
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in under) for q in under)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        ends = hashlib.sha256(",".join(str(c) for c in sorted(c for c, e in ms if e)).encode()).hexdigest()
        out.append((min(c for c, _ in ms), len(p), parent, len(ms), children, leaves, saved, ends))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


def samples(n, seed):
    rng = random.Random(seed)
    texts = ["", "a", "bb 😀", "ccc", None, "é漢字"]
    rows = []
    for c in range(n):
        c = c * rng.choice((1, 1, 7)) if seed % 2 else c
        for t in range(rng.choice((1, 2, 3, 6, 9))):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(("user", "assistant", None)) if rng.random() < 0.3 else "user", rng.choice(texts[: 2 if t < 3 else 6])))
    return rows + [(None, 1, "user", "no conversation"), rows[0], rows[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    rows = samples(260, seed)
    assert result(P.prefix_trie(spark, table(spark, rows))) == brute(rows)


def test_edges(spark):
    assert result(P.prefix_trie(spark, table(spark, []))) == []
    assert result(P.prefix_trie(spark, table(spark, [(None, 1, "user", "x")]))) == []
    turnless = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(turnless, 0, None, None)]  # its only turn goes and conversation 0 is absent
    assert result(P.prefix_trie(spark, table(spark, rows))) == brute(rows) and brute(rows)[0][1] == 0
    copies = [(c, t, "user", f"t{t}") for c in range(300, 700) for t in range(7)]
    assert result(P.prefix_trie(spark, table(spark, copies))) == brute(copies)
    long = [(c, t, "user", f"t{t}") for c in (100, 101, 102) for t in range(400 - c)]
    assert result(P.prefix_trie(spark, table(spark, long))) == brute(long)


def local_sequences(rng, n):
    keys = {b"".join(bytes([rng.choice((1, 2))]) * P.WIDTH for _ in range(rng.randint(0, 9))) for _ in range(n)}
    return [P.Sequence(k, 0, [1] * (len(k) // P.WIDTH), 1, i, "e") for i, k in enumerate(sorted(keys, key=lambda _: rng.random()))]


def test_runs_merge_in_order_and_compare_each_shared_turn_once(tmp_path, monkeypatch):
    rows = local_sequences(random.Random(3), 600)
    for run_rows, memory in ((7, 1 << 30), (7, 4000), (1 << 30, 3000), (1, 1 << 30)):
        monkeypatch.setattr(P, "RUN_ROWS", run_rows)
        monkeypatch.setattr(P, "MEMORY", memory)
        got = list(P.external_sort(iter(rows), f"file://{tmp_path}"))
        assert [r.key for r in got] == sorted(r.key for r in rows)
        assert all(r.lcp == (P.common_turns(got[i - 1].key, r.key) if i else 0) for i, r in enumerate(got))
    assert list(tmp_path.iterdir())
    deep = [P.Sequence(b"x" * P.WIDTH * 1000 + bytes([i]) * P.WIDTH, 0, [1] * 1001, 1, i, "e") for i in range(64)]
    tree = P.LoserTree([iter(P.sorted_run(deep[k::8])) for k in range(8)])
    assert [r.least for r in tree] == list(range(64)) and tree.compared < 8 * 1001 + 64 * 8


def test_tasks_nodes_are_put_together(monkeypatch, spark):
    rng = random.Random(5)
    wide = {bytes([rng.randrange(1, 4)]) * P.WIDTH + bytes([rng.randrange(1, 90)]) * P.WIDTH + bytes([rng.randrange(1, 4)]) * P.WIDTH * rng.randrange(3) for _ in range(300)}
    ordered = P.sorted_run([P.Sequence(k, 0, [3, 5, 7, 7][: len(k) // P.WIDTH], 1 + i % 3, 10 * i, f"e{i}") for i, k in enumerate(sorted(wide, key=lambda _: rng.random()))])
    results = []
    for waiting, cuts in ((10**9, [0, 10**9]), (3, [0, 50, 51, 120, 10**9]), (10**9, [0, 1, 2, 100, 10**9])):
        monkeypatch.setattr(P, "WAITING", waiting)
        rows = [n for a, b in zip(cuts, cuts[1:]) for n in P.nodes(P.sorted_run(ordered[a:b]))]
        results.append(result(P.assembled(spark.createDataFrame(rows, P.NODE), P.Workspace(spark, "trie-test"))))
        assert len({r[:2] for r in results[-1]}) <= len(results[-1]) == len({k[: d * P.WIDTH] for k in wide for d in range(len(k) // P.WIDTH + 1)})
    assert results[0] == results[1] == results[2]
    root = next(r for r in results[0] if r[1] == 0)
    assert root[3] == sum(r.n for r in ordered) and root[4] == 3


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert result(queries.queries()["op12_conversation_trie"](spark, sf_dir)) == brute(rows)
