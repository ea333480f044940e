"""Catalog search: same-row predicates on sessions, grouped by program, with summaries of what matched."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Filters:
    """Conditions on a program's columns and on a session's. Sessions must pass all of theirs on one row."""

    program: list[Column] = field(default_factory=list)
    session: list[Column] = field(default_factory=list)

    @staticmethod
    def fold(conditions: list[Column]) -> Column:
        """The conjunction; null counts as not passed, so unknown facts never match."""
        return F.coalesce(reduce(lambda a, b: a & b, conditions, F.lit(True)), F.lit(False))


def matching_sessions(programs: DataFrame, providers: DataFrame, sessions: DataFrame, filters: Filters, program_id: str, provider_id: str) -> DataFrame:
    """Sessions that pass, with their program and provider; a program without its provider is dropped.

    Filters stand below the joins, so they reach the scans; Spark broadcasts a side only if its size allows.
    """
    own = programs.where(Filters.fold(filters.program))
    return sessions.where(Filters.fold(filters.session)).join(own, program_id).join(providers, provider_id)


def programs_without_sessions(programs: DataFrame, sessions: DataFrame, filters: Filters, program_id: str) -> DataFrame:
    """Programs that have no session at all; only while no condition on sessions is set."""
    if filters.session:
        return programs.limit(0)
    return programs.where(Filters.fold(filters.program)).join(sessions.select(program_id).distinct(), program_id, "left_anti")


def visible_children(parents: DataFrame, children: DataFrame, key: str, gate: Column) -> DataFrame:
    """Children whose parent passes the gate."""
    return children.join(parents.where(gate).select(key), key, "left_semi")


def ranked(df: DataFrame, by: list[str], order: list[Column], most: int | None = None, name: str = "rank") -> DataFrame:
    """``name`` within each group; at most ``most`` rows of it, which Spark also applies before the shuffle."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if most is None else out.where(F.col(name) <= most)


def prefix_search(df: DataFrame, column: str, query: str, most: int, key: str) -> DataFrame:
    """Rows whose text holds the query, best first: equal, begins with it, a word begins with it, elsewhere; then shorter, then by text and key."""
    q, text = query.lower().strip(), F.lower(F.trim(F.col(column)))
    tier = F.when(text == q, 0).when(text.startswith(q), 1).when(text.contains(" " + q), 2).when(text.contains(q), 3)
    hits = df.withColumn("tier", tier).where(F.col("tier").isNotNull())
    return hits.orderBy("tier", F.length(column), column, key).limit(most)


def keyword_match(columns: list[str], query: str) -> Column:
    """All words of the query stand somewhere in the columns' texts."""
    hay = F.lower(F.concat_ws(" ", *columns))
    return reduce(lambda a, w: a & hay.contains(w), query.lower().split(), F.lit(True))


def facet_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, rows) of several columns, read once; nulls aren't values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("facet", "value").agg(F.count("*").alias("rows"))


def fact_rows(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Wide rows as (key, label, value) facts; missing facts give no row."""
    pairs = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(key, F.inline(pairs)).where("value IS NOT NULL AND trim(value) <> ''")


def union_items(parts: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """UNION ALL of tables as (kind, item_id, label); parts: (table, kind, id column, label column)."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), F.col(i).cast("string").alias("item_id"), F.col(label).alias("label")) for df, kind, i, label in parts])
