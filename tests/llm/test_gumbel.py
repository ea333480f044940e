import math
from collections import Counter

import numpy as np
import pytest

from cases import documents, texts
from sorrel.llm import gumbel as G


@pytest.fixture(scope="module")
def lat():
    return G.Lattices(G.piece_bpe_path())


def everything(lat, text):
    """All segmentations of a short text with their probabilities, by trying every cut."""
    pieces = {p: v for p, v in lat.weight.items() if v[0] >= 0}
    known = {c for c in text if c in pieces}

    def cut(s):
        if not s:
            return [((), 1.0)]
        out = [((pieces[s[:n]][0], *rest), w * pieces[s[:n]][1]) for n in range(1, len(s) + 1) if s[:n] in pieces for rest, w in cut(s[n:])]
        if s[0] not in known:
            codes = tuple(lat.bytes[b] for b in s[0].encode())
            out += [((*codes, *rest), w * 1e-5) for rest, w in cut(s[1:])]
        return out

    ways = cut(text)
    total = sum(w for _, w in ways)
    return {ids: w / total for ids, w in ways}


@pytest.mark.parametrize("text", ["a", "the cat", "in, on", "é漢!", "ab  c"])
def test_probabilities_equal_enumeration(lat, text):
    norm = lat.sp.normalize(text)
    want = everything(lat, norm)
    got = G.sample_segmentations(lat, [norm], [3], 10_000 if len(want) < 3000 else 50)[0]
    assert len({tuple(ids.tolist()) for *_, ids in got}) == len(got) == min(len(want), len(got))
    for _, lp, inclusion, ids in got:
        assert math.exp(lp) == pytest.approx(want[tuple(ids.tolist())], rel=1e-6) and 0 < inclusion <= 1
    if len(want) < 3000:
        assert {tuple(ids.tolist()) for *_, ids in got} == set(want)
    values = [v for v, *_ in got]
    assert values == sorted(values, reverse=True)


def test_first_draws_and_pairs_follow_the_law(lat):
    norm = lat.sp.normalize("then")
    p = everything(lat, norm)
    n, k = 4000, 2
    first, both = Counter(), Counter()
    estimate = Counter()
    for key in range(n):
        got = [(tuple(ids.tolist()), lp, inc) for _, lp, inc, ids in G.sample_segmentations(lat, [norm], [key], k)[0]]
        first[got[0][0]] += 1
        both.update(ids for ids, *_ in got)
        for ids, lp, inc in got:
            estimate[ids] += math.exp(lp) / inc
    for ids, q in p.items():
        assert abs(first[ids] / n - q) < 4 * math.sqrt(q * (1 - q) / n) + 1e-3
        # Without replacement: the chance to be first or second.
        second = sum(r * q / (1 - r) for o, r in p.items() if o != ids)
        assert abs(both[ids] / n - (q + second)) < 4 * math.sqrt(max(q + second, 1e-4) / n) + 1e-3
    assert sum(estimate.values()) / n == pytest.approx(1, abs=0.05)  # weighting by inclusion is unbiased


def test_samples_do_not_depend_on_the_batch(lat):
    some = [lat.sp.normalize(t) for _, t in texts() if t]
    together = G.sample_segmentations(lat, some, list(range(len(some))), 3)
    for i, t in enumerate(some):
        alone = G.sample_segmentations(lat, [t], [i], 3)[0]
        assert [(a[1], a[3].tolist()) for a in alone] == [(b[1], b[3].tolist()) for b in together[i]]


def test_query(spark, lat):
    got = G.segmentations(spark, documents(spark)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for doc, text in texts():
        if doc is not None:
            rows = [r.pieces for r in by[doc]]
            assert all(lat.sp.decode(p) == (text or "") for p in rows if text not in (None, "")) and len(rows) >= 1
    assert len(by[8]) == 3 and len({tuple(r.pieces) for r in by[8]}) == 3 and [tuple(r.pieces) for r in by[3]] == [()]
    assert G.segmentations(spark, documents(spark, [])).count() == 0
    assert np.isfinite([r.log_prob for r in got]).all()


def test_draws_decode_to_their_texts(spark):
    rows = [(1, "the cat, in"), (2, None), (3, ""), (4, "\U0001f9ff漢 ꙮ é!"), (5, "many words " * 3000 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    report = G.segmentation_report(spark, docs).collect()
    assert all(r.decodes for r in report) and {r.doc_id for r in report} == {1, 2, 3, 4, 5}
    decoded = G.decode_segmentations(G.segmentations(spark, docs)).collect()
    assert len(decoded) == len(report) and all(r.text == (dict(rows)[r.doc_id] or "") for r in decoded)


def test_wrong_ids_do_not_decode(lat):
    ids = G.sample_segmentations(lat, [lat.sp.normalize("the cat")], [1], 1)[0][0][3].tolist()
    assert lat.spell(ids) == lat.sp.normalize("the cat").encode() != lat.spell(ids[:-1])


@pytest.mark.parametrize("text", ["abcdefghij" * 20_000, "漢字仮名交" * 40_000])
def test_long_texts_without_spaces_take_little_memory(lat, text):
    import tracemalloc

    norm = lat.sp.normalize(text)
    tracemalloc.start()
    found = G.sample_segmentations(lat, [norm], [7], 2)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    lat._clear()
    assert peak < 600 << 20 and len(found) >= 1 and all(lat.spell(ids) == norm.encode() for *_, ids in found)
