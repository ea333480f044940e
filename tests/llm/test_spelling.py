import random
import re
import zlib
from collections import Counter

from cases import documents, texts
from sorrel.llm import queries
from sorrel.llm import spelling as S


def words_of(rows):
    n = Counter()
    for doc_id, text in rows:
        for m in re.finditer("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[0])
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                i = h % len(w)
                w = w[:i] + w[i + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = words_of(rows)
    close = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in close.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), k, len(close[w]), n[form[w]] if w in form else None) for w, k in n.items())


def result(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_equals_brute_force(spark):
    rng = random.Random(4)
    stems = ["abcde", "abcdf", "aabbcc", "été-naïveté".replace("-", ""), "÷×letters", "x" * 63, "y" * 64, "ab" * 33, "z" * 65 + "q", "mississippi"]
    pool = []
    for s in stems:
        for _ in range(12):
            t, i = list(s), rng.randrange(len(s))
            kind = rng.randrange(3)
            t[i : i + (kind != 1)] = [] if kind == 0 else [rng.choice("abÀÿz")]
            pool += [s, "".join(t)] * rng.choice((1, 1, 3, 9))
    rows = [(rng.randrange(50), " ".join(rng.choice(pool).swapcase() if rng.random() < 0.2 else rng.choice(pool) for _ in range(60)) + rng.choice((".", "\n", "1"))) for _ in range(120)]
    rows += [(None, "abcde abcdx abcdx"), *texts()]
    got = result(S.spelling_variants(spark, documents(spark, rows)))
    assert got == brute(rows)
    assert len({g[2] for g in got}) < len(got) and any(g[1] and g[2] != g[1] for g in got)  # some chains have two links


def test_very_long_words_and_texts(spark, monkeypatch):
    big = "ab" * 1500 + "c" * 500
    rows = [(i, f"{big} {big} {big[:700]}x{big[700:]} {big[:9]}{big[10:]} ") for i in range(4)]
    assert result(S.spelling_variants(spark, documents(spark, rows))) == brute(rows)
    monkeypatch.setattr(S, "PIECE", 10)
    assert S.runs(rows[0][1]) == Counter(re.findall("[A-Za-zÀ-ÿ]+", rows[0][1]))


def test_edges(spark):
    assert result(S.spelling_variants(spark, documents(spark, []))) == []
    assert result(S.spelling_variants(spark, documents(spark, [(1, None), (2, ""), (None, None)]))) == []
    chain = "wordsa " * 3 + "wordsb " * 6 + "wordsbc " * 12 + "wordsbcd " * 24
    rows = [(9, chain)]
    want = brute(rows)
    assert result(S.spelling_variants(spark, documents(spark, rows))) == want and {w[2] for w in want} == {"wordsbcd"}


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    n = words_of(rows)
    got = result(queries.queries()["op11_spelling_variants"](spark, sf_dir))
    assert [(g[0], g[3]) for g in got] == sorted(n.items())
    sample = random.Random(1).sample(got, 60)
    for w, form, _, k, count, form_n in sample:
        close = [v for v in n if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v)) if close else None
        assert count == len(close) and form == (best if best and n[best] >= 2 * k else None) and form_n == (n[form] if form else None)
