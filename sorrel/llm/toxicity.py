"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from sorrel.llm.quality import labelled_sample, remainder
from sorrel.llm.workspace import Workspace

FOLDS, HELD = 3, 1
#: Labelled rows that lexicons are learned from, and that trees and calibration are fitted on, at most.
LEXICON_ROWS, FIT_ROWS = 12_000, 60_000
#: Terms of a lexicon, at most, and the rows that a term must stand in.
TERMS, MIN_ROWS = 4000, 3
PREFIXES = (4, 5, 6)
#: Parts of the labelled rows, by a hash of their doc_id, and their shares: lexicon and trees learn from one, the calibration from the other.
PARTS = {"learning": 3, "calibration": 1}
#: Second-person words of the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te ti toi ton ta tes vous votre vos usted ustedes vosotros tus su du dich dir dein deine deinen ihr euch euer sie".split())
_WORD = re.compile(r"[^\W\d_]+")
_LEET = str.maketrans("013457@$!", "oieastasi")
_OBFUSCATED = re.compile(r"(?=\S*[^\W\d_])\S*[0-9@$*!][^\W\d_]\S*")
_RUN = re.compile(r"(.)\1{2,}")
NAMES = (
    "strong", "strong_log", "strong_kinds", "weak", "weak_log", "near_second_person", "second_person", "capitals", "capital_words", "hits_in_capitals",
    "exclamations", "questions", "marks", "obfuscated", "obfuscated_hits", "stretched", "words_log", "word_length",
)


@dataclass
class Lexicon:
    """Terms learned from labels: whole words, and beginnings of words (ending in *). Strong terms stand almost only in toxic rows."""

    strong: frozenset[str]
    weak: frozenset[str]

    def hits(self, words: set[str], terms: frozenset[str]) -> set[str]:
        found = words & terms
        for n in PREFIXES:
            found |= {w for w in words if len(w) > n and w[:n] + "*" in terms}
        return found


def part_of(fit_id: Column, part: str) -> Column:
    """Whether a labelled row belongs to a part."""
    names = list(PARTS)
    low = sum(PARTS[p] for p in names[: names.index(part)])
    return F.pmod(F.xxhash64(fit_id, F.lit(7)), F.lit(sum(PARTS.values()))).between(low, low + PARTS[part] - 1)


def learn_lexicon(docs: DataFrame, labels: DataFrame, rows: int = LEXICON_ROWS) -> Lexicon:
    """Count, for each word and word beginning, the toxic and other rows of a bounded labelled sample that hold it.

    The lexicon holds the TERMS best by their count and ratio."""
    own = labels.where(part_of(F.col("doc_id").cast("long"), "learning"))
    sample = F.broadcast(labelled_sample(own, "toxic", FOLDS, HELD, rows))  # at most ``rows`` pairs of numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text")).join(sample, F.col("doc_id") == F.col("fit_id"))
    words = F.array_distinct(F.filter(F.split("text", r"[^\p{L}]+"), lambda w: F.length(w) >= 3))
    starts = [F.transform(F.filter("words", _longer(n)), _start(n)) for n in PREFIXES]
    terms = texts.select("label", words.alias("words")).select("label", F.explode(F.array_distinct(F.concat("words", *starts))).alias("term"))
    # Most words stand in one row only, so the toxic rows' terms are counted first and the rest looked up by them.
    toxic = terms.where("label = 1").groupBy("term").agg(F.count("*").alias("pos")).where(F.col("pos") >= MIN_ROWS)
    other = terms.where("label = 0").join(toxic.select("term"), "term", "left_semi").groupBy("term").agg(F.count("*").alias("neg"))
    total = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not total.get(1) or not total.get(0):
        return Lexicon(frozenset(), frozenset())
    ratio = ((F.col("pos") + 0.5) / total[1]) / ((F.coalesce("neg", F.lit(0)) + 0.5) / total[0])
    ranked = toxic.join(other, "term", "left").select("term", "pos", ratio.alias("ratio")).where("ratio >= 4").orderBy(F.desc(F.col("pos") * F.log("ratio")), "term").limit(TERMS).collect()
    strong = frozenset(r["term"] for r in ranked if r["ratio"] >= 30)
    return Lexicon(strong, frozenset(r["term"] for r in ranked) - strong)


def _longer(n: int):
    return lambda w: F.length(w) > n


def _start(n: int):
    return lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))


def dense_features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The features in NAMES; all are rates or logarithms, and zero for an empty text."""
    text = text or ""
    low = text.lower()
    words = _WORD.findall(low)
    kinds, n, chars = set(words), max(1, len(words)), max(1, len(text))
    strong, weak = lexicon.hits(kinds, lexicon.strong), lexicon.hits(kinds, lexicon.weak)
    n_strong = n_weak = near = capital_hits = 0
    second = kinds & SECOND_PERSON
    if strong or weak:
        at = [i for i, w in enumerate(words) if w in strong]
        n_strong, n_weak = len(at), sum(1 for w in words if w in weak)
        near = sum(1 for i in at if any(w in SECOND_PERSON for w in words[max(0, i - 5) : i + 6])) if second else 0
        capital_hits = sum(1 for w in _WORD.findall(text) if len(w) > 1 and w.isupper() and w.lower() in strong) if n_strong else 0
    odd, odd_hits = [], 0
    if any(c in low for c in "0134579@$*!"):
        odd = [m[0] for m in _OBFUSCATED.finditer(low)]
        plain = {x for w in odd for x in _WORD.findall(w.translate(_LEET))}
        odd_hits = len(lexicon.hits(plain, lexicon.strong) - strong)
    stretched = [w for w in kinds if _RUN.search(w)]
    odd_hits += len(lexicon.hits({_RUN.sub(r"\1", w) for w in stretched}, lexicon.strong) - strong)
    pieces = text.split()
    return [
        n_strong / n, np.log1p(n_strong), np.log1p(len(strong)), n_weak / n, np.log1p(n_weak), np.log1p(near), sum(1 for w in words if w in second) / n if second else 0.0,
        sum(map(str.isupper, text)) / chars, sum(map(str.isupper, pieces)) / max(1, len(pieces)), np.log1p(capital_hits),
        text.count("!") / n, text.count("?") / n, sum(map(text.count, ".,;:!?")) / chars, len(odd) / n, np.log1p(odd_hits), len(stretched) / n, np.log1p(len(words)), chars / n,
    ]


def feature_table(docs: DataFrame, lexicon: Lexicon, carried: Column) -> DataFrame:
    """(row, features array<double>) for each row of ``docs``; ``carried`` is a struct that holds its doc_id."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [dense_features(t.as_py(), lexicon) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["row", "features"])

    src = docs.select(carried.alias("row"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, src.drop("text").schema.add("features", ArrayType(DoubleType())))


def _margin(frame: DataFrame) -> DataFrame:
    return frame.withColumn("margin", F.element_at(vector_to_array("rawPrediction"), 2))


def fit_and_score(table: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, trees: int = 12, depth: int = 3, keep_margin: bool = False, learn_from: DataFrame | None = None) -> DataFrame:
    """(row, features, gbt_score) of ``table`` (row, features): boosted trees, calibrated on rows they weren't fitted on.

    ``learn_from`` (``table`` itself if it's written) holds the features of the labelled rows at least.

    Trees learn from the labelled rows outside the held fold that the lexicon is learned from, the
    calibration from others, which neither has seen. If either part lacks a label, the score is the
    smoothed share of toxic rows. Rows of one margin are one weighted point of the calibration.
    """
    sample = labelled_sample(labels, "toxic", FOLDS, HELD, rows)
    known = (table if learn_from is None else learn_from).join(F.broadcast(sample), F.col("row.doc_id").cast("long") == F.col("fit_id")).dropDuplicates(["fit_id"])
    known = known.select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"), part_of(F.col("fit_id"), "calibration").alias("calibrates")).repartition(8).cache()
    counts = {(r["calibrates"], r["label"]): r["n"] for r in known.groupBy("calibrates", "label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 4:
        toxic, n = sum(v for (_, y), v in counts.items() if y), sum(counts.values())
        known.unpersist()
        return table.withColumn("gbt_score", F.lit((toxic + 0.5) / (n + 1.0)))
    gbt = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, minInstancesPerNode=5, seed=5, checkpointInterval=-1).fit(known.where("NOT calibrates"))
    margins = _margin(gbt.transform(known.where("calibrates"))).groupBy("margin").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    isotonic = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight", predictionCol="gbt_score").fit(margins)
    known.unpersist()
    out = _margin(gbt.transform(table.withColumn("plain", F.col("features")).withColumn("features", array_to_vector("features"))))
    return isotonic.transform(out).select("row", F.col("plain").alias("features"), *(["margin"] if keep_margin else []), F.least(F.lit(1.0), F.greatest(F.lit(0.0), "gbt_score")).alias("gbt_score"))


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Null and empty texts have features of zero and are scored by them. A null doc_id is scored and
    isn't held out. Repeated rows get the same score, a row each. An empty table gives no rows. Of
    further columns, none is read.
    """
    ws = Workspace(spark, "toxicity")
    table = ws.table(feature_table(docs, learn_lexicon(docs, labels), F.struct(F.col("doc_id").cast("long").alias("doc_id"))), "features")
    scored = fit_and_score(table, labels)
    return scored.select("row.doc_id", F.coalesce(remainder(F.col("row.doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), F.col("gbt_score").alias("score"), (F.col("gbt_score") >= threshold).cast("int").alias("predicted"))


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns, whatever they are named.

    Null and empty texts and null doc_ids are judged like others, each row by itself; repeated rows
    stay or go together. An empty table gives an empty one.
    """
    lexicon, ids = learn_lexicon(docs, labels), labelled_sample(labels, "toxic", FOLDS, HELD, FIT_ROWS)
    # Only the labelled rows' features are written; all texts are scored as they are read.
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids.select("fit_id")), F.col("doc_id") == F.col("fit_id"), "left_semi")
    known = Workspace(spark, "toxicity").table(feature_table(labelled, lexicon, F.struct("doc_id")), "labelled")
    return fit_and_score(feature_table(docs, lexicon, F.struct("*")), labels, learn_from=known).where(F.col("gbt_score") < threshold).select("row.*")
