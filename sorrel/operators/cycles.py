"""Batch cycles over sources: which are due, what a fetch means, stops, alerts and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.functions.dates import local_day, local_hour
from sorrel.functions.text import changed_span


def is_due(active: Column, next_at: Column, now: Column) -> Column:
    """Active, and never scheduled or scheduled by now."""
    return F.coalesce(active, F.lit(False)) & (next_at.isNull() | (next_at <= now))


def watch_due(active: Column, every: Column, last_at: Column, now: Column) -> Column:
    """Weekly sources after seven days, others once a local day."""
    weekly = F.unix_timestamp(now) - F.unix_timestamp(last_at) >= 7 * 86400
    return F.coalesce(active, F.lit(False)) & (last_at.isNull() | F.when(every == "weekly", weekly).otherwise(local_day(last_at) != local_day(now)))


def next_check(last_at: Column, hours: Column) -> Column:
    """The last check plus the interval, a day if there is none."""
    return F.timestamp_seconds(F.unix_timestamp(last_at) + F.coalesce(hours, F.lit(24)) * 3600)


def digest_hour(now: Column, hour: int = 7) -> Column:
    """Whether it's the local hour of the digest, whatever the season's offset."""
    return local_hour(now) == hour


def without_stopped(refs: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """References of systems that didn't answer 403 or 429 today."""
    stopped = runs.where((local_day(F.col("ran_at")) == local_day(now)) & F.col("outcome").rlike("^stopped:(403|429)")).select("booking_system").distinct()
    return refs.join(stopped, "booking_system", "left_anti")


def candidate_outcome(ambiguous: Column, new: Column, missing: Column, changed: Column) -> Column:
    """Ambiguous before new before possibly removed before changed."""
    return F.when(ambiguous, "AMBIGUOUS").when(new, "NEW").when(missing, "POSSIBLY_REMOVED").when(changed, "CHANGED").otherwise("UNCHANGED")


def alert(kind: Column, old_state: Column, new_state: Column, old_text: Column, new_text: Column, least: int = 20) -> Column:
    """urgent for open to full or back, logged for small edits of a page, none for what says nothing new, else normal."""
    crossed = ((old_state == "open") & (new_state == "full")) | ((old_state == "full") & (new_state == "open"))
    return F.when(F.coalesce(crossed, F.lit(False)), "urgent").when(kind == "spots", "none").when((kind == "page") & (changed_span(old_text, new_text) < least), "logged").otherwise("normal")


def removed_candidates(catalog: DataFrame, matched: DataFrame, source: str, key: str, least_share: float = 0.5) -> DataFrame:
    """Catalog rows that a source no longer shows, only where it still shows ``least_share`` of its rows: an incomplete read removes nothing."""
    seen = matched.select(F.col(key).alias("seen_key")).distinct()
    rows = catalog.join(seen, catalog[key] == seen.seen_key, "left")
    share = rows.groupBy(F.col(source).alias("share_source")).agg((F.count("seen_key") / F.count("*")).alias("share")).where(F.col("share") >= least_share)
    return rows.where("seen_key IS NULL").join(share, rows[source] == share.share_source).select(*[catalog[c] for c in catalog.columns])
