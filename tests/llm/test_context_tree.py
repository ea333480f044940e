import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cases import documents, texts
from sorrel.llm import context_tree as C
from sorrel.llm import queries
from sorrel.llm.workspace import Workspace

D = C.DEPTH


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


class Plain:
    """The weighted tree as nested recursions over one dictionary, bit by bit."""

    def __init__(self, training):
        self.n, self.below = defaultdict(lambda: [0, 0]), defaultdict(set)
        for t in training:
            s = b"\xff" * D + t + b"\xff"
            for i in range(D, len(s)):
                for k in range(8):
                    j, bit = 1 << k | s[i] >> (8 - k), s[i] >> (7 - k) & 1
                    for d in range(D + 1):
                        self.n[s[i - d : i], j][bit] += 1
                        if d:
                            self.below[s[i - d + 1 : i], j].add(s[i - d : i])
        self.known = {}

    def kt(self, c, j):
        a, b = self.n[c, j]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, c, j):
        if (c, j) not in self.known:
            own = self.kt(c, j)
            if len(c) < D:
                rest = sum(self.weighted(x, j) for x in self.below[c, j])
                top = max(own, rest)
                own = top + math.log(0.5 * math.exp(own - top) + 0.5 * math.exp(rest - top))
            self.known[c, j] = own
        return self.known[c, j]

    def one(self, c, j, d=0):
        at = c[len(c) - d :]
        if (at, j) not in self.n:
            return 0.5
        a, b = self.n[at, j]
        est = (b + 0.5) / (a + b + 1)
        if d == D or (c[len(c) - d - 1 :], j) not in self.n:
            return est
        w = 0.5 * math.exp(self.kt(at, j) - self.weighted(at, j))
        return w * est + (1 - w) * self.one(c, j, d + 1)

    def score(self, t):
        s = b"\xff" * D + t + b"\xff"
        total = 0.0
        for i in range(D, len(s)):
            for k in range(8):
                p = self.one(s[i - D : i], 1 << k | s[i] >> (8 - k))
                total += math.log10(p if s[i] >> (7 - k) & 1 else 1 - p)
        return total


def brute(rows):
    body = [(i, (t or "").encode()) for i, t in rows]
    lower = [(i, re.findall(rb"[^\x20\x09-\x0D]+", t.lower())) for i, t in body]
    c = Counter(w for i, ws in lower if not held(i) for w in ws)
    ends = sum(not held(i) for i, _ in rows)
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    model = Plain([t for i, t in body if not held(i)])
    out = []
    for (i, t), (_, ws) in zip(body, lower):
        counts = [*(c[w] for w in ws), ends]
        out.append((i, held(i), len(counts), sum(x > 0 for x in counts), n, sum(math.log10((x + 1) / (n + v + 1)) for x in counts), model.score(t)))
    return out


def compare(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2:5], round(r[5], 6))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], rel=1e-7, abs=1e-6)


def test_equals_a_plain_context_tree(spark):
    rng = random.Random(8)
    pool = ["the cat", "sat on", "a mat. ", "été\n", "😀", "Cats", "zz9", "\x00"]
    rows = [(i, " ".join(rng.choice(pool[: 5 if i % 5 else 8]) for _ in range(rng.randrange(9)))) for i in range(60)]
    rows += [r for r in texts() if r[0] != 8]
    compare(C.score_texts(spark, documents(spark, rows)).collect(), brute(rows))


def test_edges(spark):
    assert C.score_texts(spark, documents(spark, [])).count() == 0
    untrained = [(i, "some text") for i in range(80) if held(i)]
    for r in C.score_texts(spark, documents(spark, untrained)).collect():
        assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score == pytest.approx(10 * 8 * math.log10(0.5))
    empty = [(None, None), (1, ""), (1, "")]
    compare(C.score_texts(spark, documents(spark, empty)).collect(), brute(empty))


def test_bytes_behind_a_context_sum_to_one(spark):
    ws = Workspace(spark, "lm-test")
    grams = C.Counts()
    for g, _ in C.pieces([b"the theme of the then", b"other bother", b""]):
        grams.add(g, True)
    seen = list(zip(*(x.tolist() for x in grams.merge())))
    contexts = {g >> 8 for g, _ in seen} | {int.from_bytes(b"qqqqq"), int.from_bytes(b"xxthe"), int.from_bytes(b"o the")}
    known = dict(seen)
    asked = [(c << 8 | x, known.get(c << 8 | x, 0)) for c in contexts for x in range(256)]
    df = ws.table(spark.createDataFrame(asked, "gram long, n long"), "grams")
    total = defaultdict(float)
    for r in C.code_lengths(df, C.tree(df, ws), ws).collect():
        total[r.gram >> 8] += 10**r.lp
    assert len(total) == len(contexts) and all(v == pytest.approx(1, abs=1e-9) for v in total.values())


def test_small_pieces_are_the_same_grams(monkeypatch):
    ts = [b"", b"abc", b"a longer text with words", b"\xc3\xa9" * 40]
    whole = [(int(g), int(i)) for gs, ds in C.pieces(ts) for g, i in zip(gs, ds)]
    assert whole == [(int(g), int(i)) for gs, ds in C.pieces(ts, 7) for g, i in zip(gs, ds)] and len(whole) == sum(map(len, ts)) + len(ts)
    assert whole[0] == (int.from_bytes(b"\xff" * 6), 0)
    monkeypatch.setattr(C, "PIECE", 9)
    assert [w for own in C.words_of(b"Some words\x0bAND  " + b"x" * 50 + b" more") for w in own] == [b"some", b"words", b"and", b"x" * 50, b"more"]
    counts = C.Counts()
    monkeypatch.setattr(C, "MERGED", 3)
    for gs, ds in C.pieces([b"abcabc", b"abc"], 4):
        counts.add(gs, True)
    keys, n = counts.merge()
    want = Counter(g for gs, _ in C.pieces([b"abcabc", b"abc"]) for g in gs.tolist())
    assert dict(zip(keys.tolist(), n.tolist())) == want


def test_query_learns_more_than_words(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.queries()["op13_context_tree"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    out = [r for r in got if r.held_out]
    assert all(r.score < 0 for r in out)
    bits = -sum(r.score for r in out) * math.log2(10) / sum(r.n_bytes + 1 for r in out)
    assert bits < 3.5, bits
    c = Counter(w for i, t in rows if not held(i) for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()))
    assert {r.train_tokens for r in got} == {sum(c.values()) + sum(not held(i) for i, _ in rows)}
