"""Rows that every operator on documents must take: nulls, empty and long texts, repeats, clashing columns."""

from pyspark.sql import types as T

#: Names that operators use inside.
INTERNAL = ("row", "fp", "at", "keep_at", "key", "least", "features", "gbt_score", "fm_score", "fm_text", "keep_id", "keep_rows", "toxic_id", "fit_id", "label", "tie", "words")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("score", T.StringType()), T.StructField("fingerprint", T.LongType()), T.StructField("start", T.StringType()), T.StructField("secret_spans", T.StringType()),
    *[T.StructField(name, T.StringType()) for name in INTERNAL],
])
LONG = " ".join(f"word{i % 977} of{i}" for i in range(60_000))


def texts():
    return [
        (1, "The cat sat on the mat, and the dog  sat\non the log."), (2, ""), (3, None), (None, "no id at all"), (5, "  \n\t "),
        (6, "same text here for all of us"), (6, "same text here for all of us"), (7, "same text here for all of us"),
        (8, LONG), (9, "é漢字 Ünïcode 😀 text with 😀 marks"), (10, "<|endoftext|> as text"), (None, None), (11, "a"), (12, "\x00\x01 odd   marks"),
    ]


def documents(spark, rows=None):
    return spark.createDataFrame([(i, t, "en" if i else None, None, len(t) if t is not None else None, "x", 7, "y", "z", *INTERNAL) for i, t in (texts() if rows is None else rows)], SCHEMA)
