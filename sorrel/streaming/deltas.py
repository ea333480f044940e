"""Latest values as bucketed deltas: a batch writes what it says, readers merge, and compaction commits a manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass
class Manifest:
    """What a reader needs: all batches up to ``through`` are in the base folders, one for each bucket."""

    through: int = -1
    base: dict[int, str] = field(default_factory=dict)


class DeltaTable:
    """The latest row of each key, under ``path``; ``ts`` decides, of equal times the larger row.

    ``append`` writes a batch's own latest rows, dealt to buckets by key, and nothing else: its cost doesn't
    grow with the table. ``read`` puts base and newer deltas together. ``compact`` rewrites only the buckets
    that deltas have touched, and one small manifest, written last and moved to its name, makes the new base
    valid: a reader sees the old state or the new one. Batches that run again overwrite themselves, or are
    behind the manifest and change nothing. ``vacuum`` deletes what the newest manifest doesn't name.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, ts: str, buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.ts, self.buckets = spark, path.rstrip("/"), schema, key, ts, buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(folder))) if self._fs.exists(self._at(folder)) else []

    def manifest(self) -> Manifest:
        """The newest one."""
        found = [n for n in self._names("manifest") if n.endswith(".json")]
        if not found:
            return Manifest()
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.path}/manifest/{found[-1]}").collect())
        kept = json.loads(text)
        return Manifest(kept["through"], {int(b): n for b, n in kept["base"].items()})

    def _batches(self, after: int) -> list[int]:
        """Whole batches behind the manifest."""
        found = (n.removeprefix("batch=") for n in self._names("deltas"))
        return sorted(int(n) for n in found if n.isdigit() and int(n) > after and self._fs.exists(self._at(f"deltas/batch={n}/_SUCCESS")))

    def latest(self, rows: DataFrame) -> DataFrame:
        """One row a key, by a partial aggregate."""
        rest = [c for c in self.schema.names if c not in (self.key, self.ts)]
        return rows.groupBy(self.key).agg(F.max(F.struct(self.ts, *rest)).alias("v")).select(self.key, "v.*").select(*self.schema.names)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def append(self, batch: DataFrame, n: int) -> None:
        """Batch ``n``; rows without key or time say nothing."""
        if n <= self.manifest().through:
            return
        rows = self._bucketed(self.latest(batch.where(F.col(self.key).isNotNull() & F.col(self.ts).isNotNull())))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/deltas/batch={n}")

    def sink(self, compact_every: int = 0) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function; compacts once in so many batches."""

        def write(batch: DataFrame, n: int) -> None:
            self.append(batch, n)
            if compact_every and n % compact_every == compact_every - 1:
                self.compact()

        return write

    def _read(self, paths: list[str]) -> DataFrame:
        kept = self.schema.add("bucket", "int") if "bucket" not in self.schema.names else self.schema
        parts = [self.spark.read.schema(StructType(kept.fields)).parquet(p) for p in paths]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _sources(self, manifest: Manifest, batches: list[int], touched: set[int] | None = None) -> DataFrame | None:
        """Base folders and deltas as one table; of buckets in ``touched`` only, if given."""
        fields = StructType([f for f in self.schema.fields])
        base = [f"{self.path}/base/{name}/bucket={b}" for b, name in sorted(manifest.base.items()) if touched is None or b in touched]
        deltas = [f"{self.path}/deltas/batch={n}/{b}" for n in batches for b in self._names(f"deltas/batch={n}") if b.startswith("bucket=") and (touched is None or int(b[7:]) in touched)]
        return self.spark.read.schema(fields).parquet(*base, *deltas) if base or deltas else None

    def read(self) -> DataFrame:
        """The latest row of each key: the base and what came after it."""
        m = self.manifest()
        found = self._sources(m, self._batches(m.through))
        return self.spark.createDataFrame([], self.schema) if found is None else self.latest(found)

    def compact(self) -> Manifest:
        """Merge the deltas into the buckets that they touch."""
        old = self.manifest()
        batches = self._batches(old.through)
        if not batches:
            return old
        touched = {int(b[7:]) for n in batches for b in self._names(f"deltas/batch={n}") if b.startswith("bucket=")}
        new = Manifest(batches[-1], dict(old.base))
        if touched:
            name = f"through-{batches[-1]:012d}-{uuid.uuid4().hex[:8]}"
            merged = self._bucketed(self.latest(self._sources(old, batches, touched)))
            merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/base/{name}")
            new.base |= dict.fromkeys(touched, name)
        self._commit(new)
        return new

    def _commit(self, m: Manifest) -> None:
        text = json.dumps({"through": m.through, "base": m.base})
        draft = self._at(f"manifest/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(draft, self._at(f"manifest/{m.through:012d}.json")):
            raise RuntimeError(f"a manifest through batch {m.through} is there already")

    def vacuum(self) -> None:
        """Delete deltas that the base holds, and bases and manifests that aren't the newest."""
        m = self.manifest()
        for n in self._names("deltas"):
            if n.removeprefix("batch=").isdigit() and int(n.removeprefix("batch=")) <= m.through:
                self._fs.delete(self._at(f"deltas/{n}"), True)
        for name in self._names("base"):
            if name not in m.base.values() and name.startswith("through-") and int(name.split("-")[1]) <= m.through:
                self._fs.delete(self._at(f"base/{name}"), True)
        for name in self._names("manifest")[:-1]:
            if name.endswith(".json"):
                self._fs.delete(self._at(f"manifest/{name}"), False)
