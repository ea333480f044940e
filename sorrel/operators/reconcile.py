"""Identity of extracted offerings: which catalog session a record is, by the dimensions that its source declares."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.functions.facts import number
from sorrel.functions.text import match_key


@dataclass
class Dimension:
    """A fact that tells offerings apart: where a record and a catalog row state it, and how values compare (exact, number or text)."""

    name: str
    extracted: str
    catalog: str
    compare: str = "exact"

    def value(self, column: str) -> Column:
        """The comparable form; null if nothing is stated."""
        text = F.trim(F.col(column).cast("string"))
        stated = number(text).cast("string") if self.compare == "number" else match_key(text) if self.compare == "text" else text
        return F.when(stated != "", stated)


def _key(dimensions: list[Dimension], of: str) -> Column:
    """All dimensions as one struct; null if one of them isn't stated."""
    values = [d.value(getattr(d, of)) for d in dimensions]
    return F.when(reduce(lambda a, v: a & v.isNotNull(), values, F.lit(True)), F.struct(*[v.alias(d.name) for d, v in zip(dimensions, values)]))


def reconcile(records: DataFrame, catalog: DataFrame, record: str, session: str, program: str, identity: list[Dimension], reconciliation: list[Dimension]) -> DataFrame:
    """(record, kind, match_id, candidates, changed) for each record.

    EXACT_IDENTITY: one session states the same identity. Else the reconciliation dimensions are
    looked up: SAFE_RECONCILIATION if the one session found states the same identity, IDENTITY_CHANGED
    (with the names that differ) if another. AMBIGUOUS: several sessions; NO_MATCH otherwise, or if a
    record lacks a part of its identity. A record that states its program is compared within it only.
    The catalog is grouped by its dimensions before the equi-joins, so a value that many sessions
    share adds a row, not pairs.
    """
    own = records.select(F.col(record), F.col(program).alias("of_program"), _key(identity, "extracted").alias("own_identity"), _key(reconciliation, "extracted").alias("own_rest"))
    rows = catalog.select(F.col(session).alias("id"), F.col(program).alias("in_program"), _key(identity, "catalog").alias("its_identity"), _key(reconciliation, "catalog").alias("its_rest"), *[d.value(d.catalog).alias(f"its_{d.name}") for d in identity])
    parts = [f"its_{d.name}" for d in identity]

    def candidates(key: str, name: str) -> DataFrame:
        hit = [F.count("*").alias("n"), F.min(F.struct("id", *parts)).alias("one")]
        known = rows.where(F.col(key).isNotNull())
        within = known.groupBy(F.col(key).alias("k1"), "in_program").agg(*hit).select("k1", "in_program", F.struct("n", "one").alias("within"))
        anywhere = known.groupBy(F.col(key).alias("k2")).agg(*hit).select("k2", F.struct("n", "one").alias("anywhere"))
        left = F.col("own_identity" if key == "its_identity" else "own_rest")
        return lambda df: df.join(within, (left == F.col("k1")) & (F.col("of_program") == F.col("in_program")), "left").join(anywhere, left == F.col("k2"), "left").withColumn(
            name, F.when(F.col("of_program").isNotNull(), F.col("within")).otherwise(F.col("anywhere"))
        ).drop("k1", "k2", "in_program", "within", "anywhere")

    found = candidates("its_rest", "rest")(candidates("its_identity", "exact")(own))
    exact, rest = F.col("exact"), F.col("rest")
    changed = F.array_compact(F.array(*[F.when(F.col(f"own_identity.{d.name}") != rest["one"][f"its_{d.name}"], d.name) for d in identity]))
    stated = reduce(lambda a, d: a & rest["one"][f"its_{d.name}"].isNotNull(), identity, F.lit(True))
    kind = (
        F.when(F.col("own_identity").isNull(), "NO_MATCH").when(exact["n"] == 1, "EXACT_IDENTITY").when(exact["n"] > 1, "AMBIGUOUS")
        .when(rest.isNull(), "NO_MATCH").when(rest["n"] > 1, "AMBIGUOUS").when(~stated, "NO_MATCH").when(F.size(changed) == 0, "SAFE_RECONCILIATION").otherwise("IDENTITY_CHANGED")
    )
    match = F.when(kind == "EXACT_IDENTITY", exact["one"]["id"]).when(kind == "SAFE_RECONCILIATION", rest["one"]["id"])
    return found.select(
        record, kind.alias("kind"), match.alias("match_id"), F.coalesce(exact["n"], rest["n"], F.lit(0)).alias("candidates"),
        F.when(kind == "IDENTITY_CHANGED", F.array_join(changed, "|")).alias("changed"),
    )


def new_session(kind: Column, program: Column, start: Column, external_id: Column) -> Column:
    """A record that matched nothing and states enough to be reviewed as an addition: its program and start, or an id of its own."""
    unmatched = ~kind.isin("EXACT_IDENTITY", "SAFE_RECONCILIATION", "AMBIGUOUS")
    return F.coalesce(unmatched & ((program.isNotNull() & start.isNotNull()) | external_id.isNotNull()), F.lit(False))
