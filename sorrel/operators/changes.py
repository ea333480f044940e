"""Change detection: snapshot differences, field changes, content gates and entity matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.operators.names import plain_name


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str], complete: bool = True) -> DataFrame:
    """(key, change, changed) for keys of either snapshot; change: added, removed, changed or same.

    An incomplete read removes nothing: with ``complete`` false, keys only in the old snapshot are
    ``unseen``. Keys are distinct within a snapshot.
    """
    o = old.select(F.col(key).alias("old_key"), *[F.col(c).alias(f"old_{c}") for c in columns])
    n = new.select(F.col(key).alias("new_key"), *[F.col(c).alias(f"new_{c}") for c in columns])
    differs = [F.when(~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")), F.lit(c)) for c in columns]
    both = o.join(n, F.col("old_key") == F.col("new_key"), "full_outer")
    changed = F.array_join(F.array_compact(F.array(*differs)), ",")
    kind = F.when(F.col("old_key").isNull(), "added").when(F.col("new_key").isNull(), "removed" if complete else "unseen").when(changed != "", "changed").otherwise("same")
    return both.select(F.coalesce("old_key", "new_key").alias(key), kind.alias("change"), F.when(kind == "changed", changed).otherwise("").alias("changed"))


def field_changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, change, old_value, new_value) of the fields that differ; null never equals a value."""
    o = old.select(key, *[F.col(c).cast("string").alias(f"old_{c}") for c in columns])
    n = new.select(key, *[F.col(c).cast("string").alias(f"new_{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"old_{c}").alias("old_value"), F.col(f"new_{c}").alias("new_value")) for c in columns])
    kind = F.when(F.col("old_value").isNull(), "filled").when(F.col("new_value").isNull(), "cleared").otherwise("replaced")
    return o.join(n, key).select(key, F.inline(rows)).where("NOT old_value <=> new_value").withColumn("change", kind)


def keep_first_by_hash(df: DataFrame, digest: Column, order: str, columns: list[str]) -> DataFrame:
    """The first row of each digest and how many rows share it, without gathering a group."""
    return df.groupBy(digest.alias("digest")).agg(F.min(F.struct(order, *columns)).alias("first"), F.count("*").alias("copies")).select("digest", "first.*", "copies")


def fetch_decision(status: Column, old_hash: Column, new_hash: Column) -> Column:
    """What to do with a fetched page: nothing unless it was read whole and its content differs."""
    return F.when(status.isin("blocked", "error", "unsupported"), "failed").when(status == "not_modified", "unchanged").when(old_hash.isNull(), "first").when(old_hash == new_hash, "unchanged").otherwise("extract")


def match_entities(records: DataFrame, catalog: DataFrame, record_id: str, entity_id: str, rules: list[tuple[str, float, Column, Column]]) -> DataFrame:
    """(record_id, rule, confidence, candidates, match_id): the first rule with any candidate decides.

    rules: (name, confidence, key of a record, key of an entity), strongest first. A rule with
    one candidate matches; with several the record is ambiguous and stays unmatched. Each rule is an
    equi-join against counts per key, so no pairs of ambiguous candidates are made. Null and blank
    keys never match.
    """
    out = records.select(record_id, F.array().cast("array<struct<rank:int,rule:string,confidence:double,candidates:long,match_id:string>>").alias("found"), *[r[2].alias(f"key_{i}") for i, r in enumerate(rules)])
    for i, (name, confidence, _, entity_key) in enumerate(rules):
        keys = catalog.select(entity_key.alias(f"entity_{i}"), F.col(entity_id).cast("string").alias("entity")).where((F.col(f"entity_{i}") != ""))
        keys = keys.groupBy(f"entity_{i}").agg(F.count("*").alias("n"), F.min("entity").alias("least"))
        hit = F.struct(F.lit(i).alias("rank"), F.lit(name).alias("rule"), F.lit(confidence).alias("confidence"), F.col("n").alias("candidates"), F.when(F.col("n") == 1, F.col("least")).alias("match_id"))
        out = out.join(keys, F.col(f"key_{i}") == F.col(f"entity_{i}"), "left").withColumn("found", F.when(F.col("n").isNotNull(), F.concat("found", F.array(hit))).otherwise(F.col("found"))).drop("n", "least", f"entity_{i}")
    first = F.get("found", F.lit(0))
    none = F.size("found") == 0
    return out.select(record_id, F.when(none, "none").otherwise(first["rule"]).alias("rule"), F.when(none, 0.0).otherwise(first["confidence"]).alias("confidence"), F.coalesce(first["candidates"], F.lit(0).cast("long")).alias("candidates"), first["match_id"].alias("match_id"))


def names_match(a: Column, b: Column) -> Column:
    """Equal plain names, or one of four letters or more that begins the other at a word's end; empty names match nothing."""
    x, y = plain_name(a), plain_name(b)
    return (x != "") & (y != "") & ((x == y) | ((F.length(x) >= 4) & y.startswith(F.concat(x, F.lit(" ")))) | ((F.length(y) >= 4) & x.startswith(F.concat(y, F.lit(" ")))))


def upsert(old: DataFrame, new: DataFrame, key: str, policies: dict[str, str]) -> DataFrame:
    """``old`` with ``new`` merged by key. Policies by column: set (new, null too), keep (old), coalesce (new unless null), tri (new unless unknown)."""
    o = old.select(F.col(key).alias("old_key"), *[F.col(c).alias(f"old_{c}") for c in policies])
    n = new.select(F.col(key).alias("new_key"), *[F.col(c).alias(f"new_{c}") for c in policies])

    def merged(c: str, how: str) -> Column:
        was, now, fresh, gone = F.col(f"old_{c}"), F.col(f"new_{c}"), F.col("old_key").isNull(), F.col("new_key").isNull()
        kept = {"set": now, "keep": was, "coalesce": F.coalesce(now, was), "tri": F.coalesce(F.when(now != "unknown", now), was, now)}[how]
        return F.when(gone, was).when(fresh, now).otherwise(kept).alias(c)

    return o.join(n, F.col("old_key") == F.col("new_key"), "full_outer").select(F.coalesce("old_key", "new_key").alias(key), *[merged(c, h) for c, h in policies.items()])
