"""Range, overlap and lookup joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], l_range: tuple[str, str], r_range: tuple[str, str]) -> DataFrame:
    """Pairs with equal keys whose inclusive ranges overlap."""
    both = left.join(right, keys)
    return both.where((F.col(l_range[0]) <= F.col(r_range[1])) & (F.col(l_range[1]) >= F.col(r_range[0])))


def binned_overlap_join(left: DataFrame, right: DataFrame, l_range: tuple[str, str], r_range: tuple[str, str], width: int) -> DataFrame:
    """Pairs of integer ranges that overlap, without a key: rows meet in bins of ``width``, and a pair counts in its first common bin."""
    def bins(df: DataFrame, r: tuple[str, str], name: str) -> DataFrame:
        return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(r[0]) / width), F.floor(F.col(r[1]) / width))))

    a, b = bins(left, l_range, "bin_l"), bins(right, r_range, "bin_r")
    first = F.floor(F.greatest(F.col(l_range[0]), F.col(r_range[0])) / width)
    hit = a.join(b, (F.col("bin_l") == F.col("bin_r")) & (F.col(l_range[0]) <= F.col(r_range[1])) & (F.col(l_range[1]) >= F.col(r_range[0])))
    return hit.where(F.col("bin_l") == first).drop("bin_l", "bin_r")


def latest_per_key(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last row of each key in one partial aggregate."""
    last = F.max(F.struct(order, *columns))
    return df.groupBy(key).agg(last.alias("last")).select(key, "last.*")


def split_available(saved: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Saved rows with ``available``: whether the catalog still has their key."""
    have = catalog.select(F.col(key).alias("have_key")).distinct()
    return saved.join(have, saved[key] == have.have_key, "left").withColumn("available", F.col("have_key").isNotNull()).drop("have_key")


def priority_lookup(rows: DataFrame, choices: DataFrame, key: str, exact: str, value: str) -> DataFrame:
    """The choice with the row's key and ``exact`` column, else the least choice with the key alone."""
    one = choices.groupBy(key, exact).agg(F.min(value).alias("exact_value"))
    any_ = choices.groupBy(key).agg(F.min(value).alias("any_value"))
    return rows.join(one, [key, exact], "left").join(any_, key, "left").withColumn(value, F.coalesce("exact_value", "any_value")).drop("exact_value", "any_value")


def consecutive_failures(df: DataFrame, key: str, order: Column, failed: Column) -> DataFrame:
    """Per key the failures since its last success."""
    last_good = F.max(F.when(~failed, order)).over(Window.partitionBy(key))
    return df.withColumn("last_good", last_good).groupBy(key).agg(F.count_if(failed & (F.col("last_good").isNull() | (order > F.col("last_good")))).alias("failures"))
