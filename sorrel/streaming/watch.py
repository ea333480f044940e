"""Watching sources as streams: change detection against kept state, and keyed upserts of the latest values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

_CHANGES = "key string, ts timestamp, change string, old_hash string, new_hash string"


def content_changes(stream: DataFrame, key: str, ts: str, content: str) -> DataFrame:
    """(key, ts, change, old_hash, new_hash) for readings whose content differs from the key's last.

    State is one hash and one time for each key. A reading older than the last, a null content
    (a failed read) and an equal hash change nothing: a failed read is never a change.
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.when(F.col(content).isNotNull(), F.sha2(F.col(content).cast("string").cast("binary"), 256)).alias("hash")).where("hash IS NOT NULL AND key IS NOT NULL")

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (None, 0)
        out = []
        for ts_, now in sorted((t.value, h) for f in frames for t, h in zip(f["ts"], f["hash"])):
            if ts_ < at or now == last:
                continue
            out.append((keys[0], pd.Timestamp(ts_), "first" if last is None else "changed", last, now))
            last, at = now, ts_
        if last is not None:
            state.update((last, at))
        if out:
            yield pd.DataFrame(out, columns=["key", "ts", "change", "old_hash", "new_hash"])

    return rows.groupBy("key").applyInPandasWithState(step, _CHANGES, "hash string, at long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, ts: str, kind: str, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts by window and kind; rows later than the watermark are dropped, which bounds the state."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), kind, "events")


def first_per_key(stream: DataFrame, key: str, ts: str, late: str = "2 hours") -> DataFrame:
    """Each key's first row within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def latest_value_sink(path: str, key: str, ts: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps each key's latest row in versioned tables under ``path``.

    Version n holds the merge of version n-1 and batch n, and is written before the old one is
    ignored, so a batch that is run again gives the same table. Only rows that say something newer win.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark, rows = batch.sparkSession, batch
        if (old := read_latest(spark, path, batch.schema, before=n)) is not None:
            rows = old.unionByName(batch)
        best = rows.groupBy(key).agg(F.max(F.struct(ts, *[c for c in batch.columns if c not in (key, ts)])).alias("v")).select(key, "v.*").select(*batch.columns)
        best.write.mode("overwrite").parquet(f"{path}/version={n}")

    return write


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root)]
    return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_latest(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame | None:
    """The newest whole version, of those before a batch."""
    found = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.schema(schema).parquet(f"{path}/version={found[-1]}") if found else None


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived and stop, as a scheduled poll does; the checkpoint remembers what was read."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
