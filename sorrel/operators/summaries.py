"""Grouped summaries in one pass: prices, dates, states, agreement, medians and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.operators.medians import exact_medians


def price_summary(price_cents: str, unit: str) -> list[Column]:
    """min, max, and the kind: none, mixed (several units), single or range."""
    lo, hi, units = F.min(price_cents), F.max(price_cents), F.count_distinct(F.when(F.col(price_cents).isNotNull(), F.col(unit)))
    kind = F.when(lo.isNull(), "none").when(units > 1, "mixed").when(lo == hi, "single").otherwise("range")
    return [lo.alias("min_cents"), hi.alias("max_cents"), kind.alias("price_kind")]


def status_summary(state: str, open_value: str) -> list[Column]:
    return [F.count_distinct(state).alias("states"), F.count_if(F.col(state) == open_value).alias("open_sessions"), F.count("*").alias("sessions")]


def distinct_labels(column: str, most: int = 4) -> Column:
    """The first distinct values in order, joined; exact, as a set per group of short labels."""
    return F.array_join(F.slice(F.array_sort(F.collect_set(column)), 1, most), "|")


def agreed(column: str) -> Column:
    """The value if all non-null rows of the group have the same, else null."""
    return F.when(F.min(column) == F.max(column), F.min(column))


def disagreeing(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, field, kinds) for columns that have more than one value within a group."""
    counts = df.groupBy(*keys).agg(*[F.count_distinct(c).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("kinds")) for c in columns])
    return counts.select(*keys, F.inline(pairs)).where("kinds > 1")


def median_outliers(df: DataFrame, group: str, value: str, factor: float = 2.0) -> DataFrame:
    """Per group the exact median and how many values lie over ``factor`` times it or under its part."""
    mid = exact_medians(df, group, value).select(F.col(group).alias("mid_group"), "median")
    joined = df.join(mid, F.col(group) == F.col("mid_group"))
    return joined.groupBy(group).agg(F.first("median").alias("median"), F.count_if((F.col(value) > factor * F.col("median")) | (F.col(value) * factor < F.col("median"))).alias("outliers"), F.count("*").alias("rows"))


def pivot_sums(df: DataFrame, rows: list[str], column: str, values: list[str], amount: str) -> DataFrame:
    """One column per listed value; with the values given, Spark needs no pass to find them."""
    return df.groupBy(*rows).pivot(column, values).agg(F.sum(amount))


def set_fingerprint(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, records, fingerprint): a digest of a group's records that doesn't depend on their order.

    Each record is hashed, and the hashes' halves are summed modulo 2**32 in a partial aggregate: no
    group is gathered, however large. Repeated records count as often as they stand.
    """
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    parts = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    sums = [F.pmod(F.sum(p), F.lit(2**32)) for p in parts]
    return df.groupBy(key).agg(F.count("*").alias("records"), F.concat_ws("-", *[s.cast("string") for s in sums]).alias("fingerprint"))
