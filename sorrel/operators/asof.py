"""As-of lookups: the last version of a key at or before each row's time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(rows: DataFrame, versions: DataFrame, key: str, ts: str, columns: list[str], slice_seconds: int = 86_400) -> DataFrame:
    """``rows`` with the ``columns`` of the last of ``versions`` of the same key whose ``ts`` isn't later, and its time (version_ts).

    Both tables have ``key`` and ``ts``. They are put under each other once and the versions are carried
    down in time order. A key is cut into slices of time; each slice's last version is found by a partial
    aggregate and passed on to the slices behind it, so a key with a third of all rows is spread over as
    many tasks as it has slices, and nothing of it is gathered.

    Of versions of equal time the largest wins (by ``columns``). Rows without a version before them, with
    a null key or a null time keep nulls; null keys and times of versions never match. Repeated rows stay.
    """
    carried = F.struct(F.col(ts).alias("version_ts"), *[F.col(c) for c in columns])
    own = rows.select(F.col(key).alias("asof_key"), F.col(ts).alias("asof_ts"), F.struct(*rows.columns).alias("asof_row"))
    old = versions.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("asof_key"), F.col(ts).alias("asof_ts"), carried.alias("asof_version"))
    both = own.unionByName(old, allowMissingColumns=True)
    both = both.withColumn("asof_slice", F.floor(F.unix_seconds(F.col("asof_ts").cast("timestamp")) / slice_seconds))
    last = both.where("asof_version IS NOT NULL").groupBy("asof_key", "asof_slice").agg(F.max("asof_version").alias("slice_last"))
    slices = both.groupBy("asof_key", "asof_slice").agg(F.count("*").alias("n")).drop("n")
    slices = slices.join(last, ["asof_key", "asof_slice"], "left")
    before = Window.partitionBy("asof_key").orderBy("asof_slice").rowsBetween(Window.unboundedPreceding, -1)
    passed = slices.select(F.col("asof_key").alias("p_key"), F.col("asof_slice").alias("p_slice"), F.last("slice_last", ignorenulls=True).over(before).alias("passed"))
    # Versions come before rows of the same time, the largest of them last.
    order = [F.col("asof_ts"), F.col("asof_row").isNotNull().cast("int"), F.col("asof_version")]
    within = Window.partitionBy("asof_key", "asof_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("in_slice", F.last("asof_version", ignorenulls=True).over(within)).where("asof_row IS NOT NULL")
    found = found.join(passed.where("passed IS NOT NULL"), (F.col("asof_key") == F.col("p_key")) & (F.col("asof_slice") == F.col("p_slice")), "left")
    known: Column = F.when(F.col("asof_key").isNotNull() & F.col("asof_ts").isNotNull(), F.coalesce("in_slice", "passed"))
    return found.withColumn("asof_found", known).select("asof_row.*", "asof_found.*")
