"""Document quality by a factorisation machine over hashed words, structure and size."""

from __future__ import annotations

import math
import operator
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on, at most; taken in the order of a hash of their doc_id.
FIT_ROWS = 6_000
WORD_BUCKETS, BINS, FACTORS = 1 << 15, 12, 8
_MARKS = "!?.,;:|*#%&$@~^_=+<>/\\{}[]()\"'-"
_LINE = re.compile(r"[^\n]+")
#: Texts whose rows are in the fold that a model never learns from.
FOLDS = 5


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def structure(text: str, words: list[str]) -> list[float]:
    """Shares and sizes that describe a text's form, each from 0 to about 1."""
    n, chars = max(1, len(words)), max(1, len(text))
    lines = _LINE.findall(text)
    distinct = len(set(words))
    marks = [text.count(c) for c in _MARKS]
    pieces = [words[i : i + 50] for i in range(0, len(words), 50)]
    same = [sum(map(operator.eq, p, p[1:])) / len(p) for p in pieces] or [0.0]
    ends = [sum(1 for w in p if not w[-1].isalnum()) / len(p) for p in pieces] or [0.0]
    upper = [sum(map(str.isupper, p)) / len(p) for p in pieces] or [0.0]
    return [
        math.log1p(len(words)) / 12, math.log1p(len(text)) / 14, distinct / n, distinct / (n ** 0.8), sum(map(len, words)) / n / 16,
        sum(marks) / chars * 3, (sum(marks) - marks[2] - marks[3]) / chars * 5, max(same), sum(same) / len(same), max(ends), sum(ends) / len(ends), min(ends),
        max(upper), sum(upper) / len(upper), sum(map(str.isalpha, words)) / n, sum(map(str.istitle, words)) / n,
        sum(map(str.isdigit, text)) / chars * 4, marks[0] / n, marks[2] / n * 4, marks[6] / n, sum(marks[7:13]) / n / 2,
        len(set(lines)) / max(1, len(lines)), math.log1p(len(lines)) / 8, max(map(len, lines), default=0) / chars,
    ]


N_STRUCTURE = len(structure("", []))
SIZE = WORD_BUCKETS + N_STRUCTURE * BINS + N_STRUCTURE


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted indices and values of a text's features. Only the text is read.

    Words: each distinct one hashed to a bucket, with length one in all. Structure: every measure
    as itself and as one of twelve bins, so that products of bins can stand for joint conditions.
    The size in words and characters is among them as the text's metadata.
    """
    text = text or ""
    words = text.split()
    shape = structure(text, words)
    hashed = np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) & (WORD_BUCKETS - 1) for w in {w.lower() for w in words}), np.int64))
    dense = np.clip(np.array(shape), 0, 1.5)
    bins = np.minimum((np.sqrt(dense / 1.5) * BINS).astype(np.int64), BINS - 1) + np.arange(N_STRUCTURE) * BINS + WORD_BUCKETS
    index = np.concatenate([hashed, bins, np.arange(N_STRUCTURE) + WORD_BUCKETS + N_STRUCTURE * BINS])
    value = np.concatenate([np.full(len(hashed), 1 / math.sqrt(max(1, len(hashed)))), np.full(N_STRUCTURE, 0.5), dense])
    return index, value.astype(np.float64)


@dataclass
class FactorizationMachine:
    """w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, through a logistic link.

    The pairs are scored in time linear in the text's features: half of the squared sum of
    v_i x_i less the sum of their squares, over the factors.
    """

    w0: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        vx = self.v[index] * value[:, None]
        s = vx.sum(axis=0)
        return float(self.w0 + self.w[index] @ value + 0.5 * (s @ s - (vx * vx).sum()))

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return 1 / (1 + math.exp(-min(max(self.margin(index, value), -30), 30)))

    @staticmethod
    def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.08, decay: float = 2e-5, min_rows: int = 5, seed: int = 3) -> FactorizationMachine:
        """Adagrad on the log loss. Word buckets in fewer than ``min_rows`` rows keep no weight; without rows of both labels the score is their share."""
        rng = np.random.default_rng(seed)
        fm = FactorizationMachine(0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, FACTORS)))
        if not len(labels) or labels.min() == labels.max():
            return FactorizationMachine(0.0 if not len(labels) else (4.0 if labels[0] else -4.0), np.zeros(SIZE), np.zeros((SIZE, FACTORS)))
        seen = np.bincount(np.concatenate([i for i, _ in rows]), minlength=SIZE)
        known = seen >= min_rows
        known[WORD_BUCKETS:] = True
        rows = [(i[known[i]], x[known[i]]) for i, x in rows]
        fm.v[~known] = 0
        fm.w0 = math.log(labels.mean() / (1 - labels.mean()))
        epochs = max(epochs, min(150, 1000 * batch // len(rows)))  # a thousand steps on a small sample
        g0, gw, gv = 1.0, np.full(SIZE, 0.1), np.full((SIZE, FACTORS), 0.1)
        for epoch in range(epochs):
            step = rate / (1 + 2 * epoch / epochs)
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                own = [rows[k] for k in order[at : at + batch]]
                starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in own])[:-1]])
                index, value = np.concatenate([i for i, _ in own]), np.concatenate([x for _, x in own])
                row = np.repeat(np.arange(len(own)), [len(i) for i, _ in own])
                vx = fm.v[index] * value[:, None]
                s = np.add.reduceat(vx, starts)
                margin = fm.w0 + np.add.reduceat(fm.w[index] * value, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
                err = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[order[at : at + batch]]
                used, place = np.unique(index, return_inverse=True)
                dw = np.bincount(place, err[row] * value, len(used)) / len(own) + decay * fm.w[used]
                each = (err[row] * value)[:, None] * (s[row] - vx)
                dv = np.stack([np.bincount(place, each[:, f], len(used)) for f in range(FACTORS)], 1) / len(own) + decay * fm.v[used]
                g0 += float(err.mean()) ** 2
                fm.w0 -= step * float(err.mean()) / math.sqrt(g0)
                gw[used] += dw * dw
                gv[used] += dv * dv
                fm.w[used] -= step * dw / np.sqrt(gw[used])
                fm.v[used] -= step * dv / np.sqrt(gv[used])
        return fm


def labelled_sample(labels: DataFrame, column: str, folds: int, held: int, rows: int) -> DataFrame:
    """(fit_id, label): at most ``rows`` labelled doc_ids outside the held fold, in hash order; one label for each doc_id (the largest)."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != held))
    return known.groupBy(F.col("doc_id").cast("long").alias("fit_id")).agg(F.max(F.col(column).cast("int")).alias("label")).orderBy(F.xxhash64("fit_id"), "fit_id").limit(rows)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> FactorizationMachine:
    """Fit on at most ``rows`` labelled rows, whose features (never their texts) come to the driver."""
    sample = F.broadcast(labelled_sample(labels, "quality", FOLDS, 0, rows))  # at most ``rows`` pairs of numbers

    def run(frames):
        import pandas as pd

        for f in frames:
            found = [features(t) for t in f["text"]]
            yield pd.DataFrame({"fit_id": f["fit_id"], "label": f["label"], "index": [i.astype(np.int32) for i, _ in found], "value": [x.astype(np.float32) for _, x in found]})

    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, F.col("doc_id") == F.col("fit_id"))
    got = table.select("fit_id", "label", "text").dropDuplicates(["fit_id"]).mapInPandas(run, "fit_id long, label int, index array<int>, value array<float>").orderBy("fit_id").toArrow()
    pairs = [(np.asarray(i.values, np.int64), np.asarray(x.values, np.float64)) for i, x in zip(got.column("index"), got.column("value"))]
    return FactorizationMachine.fit(pairs, np.array(got.column("label").to_pylist(), np.float64))


def apply_quality(docs: DataFrame, fm: FactorizationMachine, carried: Column) -> DataFrame:
    """(row, score): ``carried`` (a struct of columns of ``docs``) and the score of the row's whole text, null as empty."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = [fm.score(*features(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["row", "score"])

    src = docs.select(carried.alias("row"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, src.drop("text").schema.add("score", "double"))


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Null and empty texts are scored by their form. A null doc_id is scored and isn't held out.
    Repeated rows get the same score, a row each. Without labels of both kinds the score is constant.
    An empty table gives no rows. Of further columns, none is read.
    """
    scored = apply_quality(docs, fit_quality(docs, labels, rows), F.struct(F.col("doc_id").cast("long").alias("doc_id")))
    return scored.select("row.doc_id", F.coalesce(remainder(F.col("row.doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns, whatever they are named.

    Null and empty texts and null doc_ids are judged like others, each row by itself; repeated rows
    stay or go together. An empty table gives an empty one.
    """
    return apply_quality(docs, fit_quality(docs, labels), F.struct("*")).where(F.col("score") >= threshold).select("row.*")
