"""Comparing the rows of a bucket in bounded blocks, however large the bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.llm.workspace import Workspace

SIDE_A, SIDE_B, BOTH = 0, 1, 2


def bucket_blocks(rows: DataFrame, keys: list[str], ws: Workspace, name: str, salt: Column, cap_a: int, cap_b: int) -> DataFrame:
    """``rows`` (a written table with boolean in_a, in_b) with ``role``, ``block_a`` and ``block_b`` added.

    Within a bucket (equal ``keys``) every row of side A meets every row of side B in exactly one
    block, keyed (keys, block_a, block_b), which holds about ``cap_a`` and ``cap_b`` rows at most.
    A bucket within the caps is one block, and a row on both sides comes once (role BOTH). A larger
    one is cut by ``salt`` into parts of A and parts of B, each row repeated for the parts that it
    meets: no row is dropped and no task gets a whole bucket. Only larger buckets are looked up, in
    a table with a row for each of them.
    """
    sizes = rows.groupBy(*keys).agg(F.sum(F.col("in_a").cast("long")).alias("na"), F.sum(F.col("in_b").cast("long")).alias("nb"))
    large = sizes.where((F.col("na") > cap_a) | (F.col("nb") > cap_b)).select(
        *[F.col(k).alias(f"large_{k}") for k in keys],
        F.greatest(F.lit(1), F.ceil(F.col("na") / cap_a)).cast("int").alias("ka"), F.greatest(F.lit(1), F.ceil(F.col("nb") / cap_b)).cast("int").alias("kb"),
    )
    large = ws.table(large, name)
    cond = F.lit(True)
    for k in keys:
        cond = cond & (rows[k] == large[f"large_{k}"])
    part = F.struct(F.lit(0).alias("role"), F.lit(0).alias("block_a"), F.lit(0).alias("block_b"))
    none = F.expr("CAST(array() AS array<struct<role:int,block_a:int,block_b:int>>)")

    def parts(role: int, own: Column, others: Column) -> Column:
        mine = F.pmod(salt, own.cast("long")).cast("int")
        return F.transform(F.sequence(F.lit(0), others - 1), lambda o: F.struct(F.lit(role).alias("role"), *((mine.alias("block_a"), o.alias("block_b")) if role == SIDE_A else (o.alias("block_a"), mine.alias("block_b")))))

    whole = F.array(F.struct(F.when(F.col("in_a") & F.col("in_b"), BOTH).when(F.col("in_a"), SIDE_A).otherwise(SIDE_B).alias("role"), part["block_a"].alias("block_a"), part["block_b"].alias("block_b")))
    cut = F.concat(F.when(F.col("in_a"), parts(SIDE_A, F.col("ka"), F.col("kb"))).otherwise(none), F.when(F.col("in_b"), parts(SIDE_B, F.col("kb"), F.col("ka"))).otherwise(none))
    out = rows.join(large, cond, "left").withColumn("part", F.explode(F.when(F.col("ka").isNull(), whole).otherwise(cut)))
    return out.drop("ka", "kb", *[f"large_{k}" for k in keys]).select("*", "part.role", "part.block_a", "part.block_b").drop("part", "in_a", "in_b")


class Forest:
    """Smallest member of each group of linked rows, of rows 0..n-1 that are in ascending order of their keys."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up
