import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import documents, texts
from sorrel.llm import quality as Q
from sorrel.llm import toxicity as T

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def held_out(spark, scored, column):
    rows = scored.join(table(spark, "labels"), "doc_id").where("held_out").select("doc_id", "score", "predicted", column).collect()
    return np.array([(r.score, r.predicted, r[column]) for r in rows])


def test_quality_on_held_out_rows(spark):
    r = held_out(spark, Q.score_quality(spark, table(spark, "documents"), table(spark, "labels")), "quality")
    assert len(r) > 300 and (r[:, 1] == r[:, 2]).mean() > 0.97 and r[r[:, 2] == 1, 1].mean() > 0.98


def test_toxicity_on_held_out_rows(spark):
    r = held_out(spark, T.score_toxicity(spark, table(spark, "documents"), table(spark, "labels")), "toxic")
    assert len(r) > 300 and (r[:, 1] == r[:, 2]).mean() > 0.98 and r[r[:, 2] == 1, 1].mean() > 0.9 and r[r[:, 2] == 0, 1].mean() < 0.01


@pytest.mark.parametrize("score", [Q.score_quality, T.score_toxicity])
def test_edge_rows(spark, score):
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(1, 13)] + [(None, 1, 1), (3, None, None), (1, 1, 1)], LABELS)
    for known in (labels, spark.createDataFrame([], LABELS), spark.createDataFrame([(2, 1, 1), (5, 1, 1)], LABELS)):
        got = score(spark, documents(spark), known).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in texts())
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        folds, held = (5, 0) if score is Q.score_quality else (3, 1)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in got)
        assert score(spark, documents(spark, []), known).count() == 0


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(1)
    fm = Q.FactorizationMachine(0.3, rng.normal(size=Q.SIZE), rng.normal(size=(Q.SIZE, Q.FACTORS)))
    i, x = Q.features("Some words here, and SOME more words!")
    pairs = sum(fm.v[i[a]] @ fm.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
    assert fm.margin(i, x) == pytest.approx(fm.w0 + fm.w[i] @ x + pairs)


def test_machine_learns_a_product():
    """Labels that no single feature tells: the exclusive or of two bins."""
    rng = random.Random(0)
    base = Q.WORD_BUCKETS
    rows, labels = [], []
    for _ in range(600):
        a, b = rng.randint(0, 1), rng.randint(0, 1)
        rows.append((np.array([base + a, base + Q.BINS + b]), np.array([1.0, 1.0])))
        labels.append(a ^ b)
    fm = Q.FactorizationMachine.fit(rows, np.array(labels, float))
    assert np.mean([(fm.score(*r) >= 0.5) == y for r, y in zip(rows, labels)]) > 0.95


@pytest.mark.parametrize("score, column, folds, fold", [(Q.score_quality, "quality", 5, 0), (T.score_toxicity, "toxic", 3, 1)])
def test_labels_of_the_held_fold_change_nothing(spark, score, column, folds, fold):
    docs = table(spark, "documents", "/root/testdata/sf0.01")
    labels = table(spark, "labels", "/root/testdata/sf0.01").toPandas()
    other = labels.copy()
    held = [zlib.crc32(str(d).encode()) % folds == fold for d in other.doc_id]
    other.loc[held, column] = 1 - other.loc[held, column]
    a, b = (dict(score(spark, docs, spark.createDataFrame(x)).select("doc_id", "score").collect()) for x in (labels, other))
    assert a == b and len(set(a.values())) > 1


def test_parts_of_the_labels_do_not_overlap(spark):
    ids = spark.range(3000).select(F.col("id").alias("fit_id"))
    parts = ids.select(*[T.part_of(F.col("fit_id"), p).cast("int").alias(p) for p in T.PARTS]).collect()
    assert all(sum(r) == 1 for r in parts) and all(sum(r[p] for r in parts) > 500 for p in T.PARTS)


def test_scores_are_the_isotonic_fit_of_the_trees_margins(spark):
    """The scores against a plain pool-adjacent-violators fit of the calibration rows' margins."""
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=18).tolist(), i) for i in range(600)]
    truth = {i: int(x[0] + x[3] + 0.5 * rng.normal() > 0.8) for i, x, _ in rows}
    docs = spark.createDataFrame([((i,), x) for i, x, _ in rows], "row struct<doc_id: long>, features array<double>")
    labels = spark.createDataFrame([(i, 0, y) for i, y in truth.items()], LABELS)
    scored = {r.row.doc_id: (r.margin, r.gbt_score) for r in T.fit_and_score(docs, labels, keep_margin=True).collect()}
    own = [r.fit_id for r in spark.range(600).select(F.col("id").alias("fit_id")).where(T.part_of(F.col("fit_id"), "calibration")).collect() if zlib.crc32(str(r.fit_id).encode()) % 3 != 1]
    points = {}
    for i in own:
        points.setdefault(scored[i][0], []).append(truth[i])
    blocks = []
    for m in sorted(points):
        blocks.append([sum(points[m]), len(points[m]), [m]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, ms = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][2] += ms
    for s, n, ms in blocks:
        for m in ms:
            assert all(abs(score - s / n) < 1e-9 for x, score in scored.values() if x == m)


def test_obfuscated_and_stretched_words_count():
    lex = T.Lexicon(frozenset({"idiot", "scumm*"}), frozenset())
    f = dict(zip(T.NAMES, T.dense_features("you 1d1ot, you idiooooot!", lex)))
    assert f["obfuscated_hits"] > 0 and f["strong"] == 0
    f = dict(zip(T.NAMES, T.dense_features("you are an IDIOT, soooo so", lex)))
    assert f["near_second_person"] > 0 and f["hits_in_capitals"] > 0 and f["stretched"] > 0 and f["strong"] > 0
    assert T.dense_features("", lex)[:6] == [0] * 6


@pytest.mark.parametrize("text, rate", [("Abcd " * 40, 0.2), ("abcD " * 40, 0.2), ("aÉb", 1 / 3), ("abc", 0.0)])
def test_capitals_are_counted_over_the_whole_text(text, rate):
    f = dict(zip(T.NAMES, T.dense_features(text, T.Lexicon(frozenset(), frozenset()))))
    assert f["capitals"] == pytest.approx(rate)


@pytest.mark.parametrize("text, share", [("a1b2c3d" * 30, 3 / 7), ("1abcdef" * 30, 1 / 7), ("no digit", 0.0)])
def test_digits_are_counted_over_the_whole_text(text, share):
    assert Q.structure(text, text.split())[16] == pytest.approx(share * 4)
