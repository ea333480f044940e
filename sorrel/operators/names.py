"""Names of two whole tables matched by equality or by a prefix of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain_name(name: Column) -> Column:
    """Lower case without remarks in brackets, & as and, all else than a-z and 0-9 as one space."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), r"\([^)]*\)", " "), "&", " and ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def word_prefixes(plain: Column) -> Column:
    """All prefixes of a plain name that end at a word's end, itself included; of prefixes that aren't the whole name those of four letters or more."""
    words = F.split(plain, " ")
    cut = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    return F.filter(cut, lambda p: (F.char_length(p) >= 4) | (p == plain))


def name_matches(left: DataFrame, left_name: str, right: DataFrame, right_name: str) -> DataFrame:
    """(left_plain, right_plain): the distinct plain names that match: equal, or one of four letters or more that starts the other at a word's end.

    Each distinct name is listed under its prefixes, and the other side's whole names are looked up in that
    list: two equi-joins, whatever the tables' size. A short common prefix is listed once for each name that
    it starts, and those are the results. Null and empty names match nothing.
    """

    def plain(df: DataFrame, name: str, out: str) -> DataFrame:
        return df.select(plain_name(F.col(name).cast("string")).alias(out)).where(F.col(out) != "").distinct()

    a, b = plain(left, left_name, "left_plain"), plain(right, right_name, "right_plain")
    longer_left = a.select("left_plain", F.explode(word_prefixes(F.col("left_plain"))).alias("p")).join(b, F.col("p") == F.col("right_plain"))
    longer_right = b.select("right_plain", F.explode(word_prefixes(F.col("right_plain"))).alias("p")).join(a, F.col("p") == F.col("left_plain")).where("left_plain <> right_plain")
    return longer_left.select("left_plain", "right_plain").unionByName(longer_right.select("left_plain", "right_plain"))
