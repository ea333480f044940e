"""Catalog candidates of extracted records: equal in all that a record states, without those whose identity contradicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dimensions that a record may state, at most: there is a pass for each combination that occurs.
MOST_DIMENSIONS = 12


def candidate_counts(records: DataFrame, record_id: str, catalog: DataFrame, catalog_id: str, dimensions: list[str], identity: str) -> DataFrame:
    """(record_id, stated, blocked, candidates, conflicting, match, outcome) for each record.

    A candidate equals the record in every dimension that the record states; a catalog row that lacks one
    isn't equal. Candidates whose ``identity`` differs from the record's conflict and go, if both state one;
    a record or row without identity conflicts with nothing. One candidate left is a MATCH, several are
    AMBIGUOUS, none is NO_MATCH; a record that states nothing is NO_MATCH too.

    There is one pass for each combination of stated dimensions, and each is an equi-join with counts of the
    catalog by these dimensions and by identity. A block's rows are counted, never paired, so a block that
    holds a third of the catalog is one row. Repeated catalog rows count each time. An empty catalog
    leaves all records without candidates.
    """
    if len(dimensions) > MOST_DIMENSIONS:
        raise ValueError(f"over {MOST_DIMENSIONS} dimensions")
    mask = reduce(lambda a, b: a + b, [F.col(d).isNotNull().cast("int") * (1 << i) for i, d in enumerate(dimensions)])
    own = records.select(F.col(record_id).alias("r_id"), *[F.col(d).alias(f"r_{d}") for d in dimensions], F.col(identity).alias("r_identity"), mask.alias("mask"))
    passes = []
    for (m,) in own.select("mask").distinct().collect():
        stated = [d for i, d in enumerate(dimensions) if m >> i & 1]
        part = own.where(F.col("mask") == m)
        if not stated:
            passes.append(part.select("r_id", F.array().cast("array<string>").alias("stated"), *[F.lit(0).cast("long").alias(c) for c in ("blocked", "candidates")], F.lit(None).cast(catalog.schema[catalog_id].dataType).alias("least")))
            continue
        rows = catalog.select(*[F.col(d).alias(f"c_{d}") for d in stated], F.col(identity).alias("c_identity"), F.col(catalog_id).alias("c_id")).where(" AND ".join(f"`c_{d}` IS NOT NULL" for d in stated))
        keys = [f"c_{d}" for d in stated]
        by_identity = rows.groupBy(*keys, "c_identity").agg(F.count("*").alias("n"), F.min("c_id").alias("least"))
        none = F.col("c_identity").isNull()
        blocks = by_identity.groupBy(*keys).agg(F.sum("n").alias("n_all"), F.min("least").alias("least_all"), F.sum(F.when(none, F.col("n"))).alias("n_none"), F.min(F.when(none, F.col("least"))).alias("least_none"))
        same = by_identity.where(~none).select(*[F.col(k).alias(f"s{k}") for k in keys], F.col("c_identity").alias("s_identity"), F.col("n").alias("n_same"), F.col("least").alias("least_same"))
        found = part.join(blocks, [F.col(f"r_{d}") == F.col(f"c_{d}") for d in stated], "left")
        found = found.join(same, [*[F.col(f"r_{d}") == F.col(f"sc_{d}") for d in stated], F.col("r_identity") == F.col("s_identity")], "left")
        zero = F.lit(0).cast("long")
        free = F.col("r_identity").isNull()
        kept = F.when(free, F.coalesce("n_all", zero)).otherwise(F.coalesce("n_none", zero) + F.coalesce("n_same", zero))
        least = F.when(free, F.col("least_all")).otherwise(F.least("least_none", "least_same"))
        passes.append(found.select("r_id", F.array(*map(F.lit, stated)).alias("stated"), F.coalesce("n_all", zero).alias("blocked"), kept.alias("candidates"), least.alias("least")))
    if not passes:
        passes = [own.where("false").select("r_id", F.array().cast("array<string>").alias("stated"), F.lit(0).cast("long").alias("blocked"), F.lit(0).cast("long").alias("candidates"), F.lit(None).cast(catalog.schema[catalog_id].dataType).alias("least"))]
    n = F.col("candidates")
    return reduce(DataFrame.unionByName, passes).select(
        F.col("r_id").alias(record_id), "stated", "blocked", "candidates", (F.col("blocked") - n).alias("conflicting"), F.when(n == 1, F.col("least")).alias("match"),
        F.when(n == 1, "MATCH").when(n > 1, "AMBIGUOUS").otherwise("NO_MATCH").alias("outcome"),
    )
