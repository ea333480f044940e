"""One cycle over sources as a batch plan: what was fetched decides what is extracted, and each source is marked as checked once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sorrel.functions.facts import compare_fingerprints
from sorrel.operators.cycles import next_check
from sorrel.operators.review import extraction_decision

FETCHABLE = ("static_html", "feed", "pdf")


def process_sources(sources: DataFrame, snapshots: DataFrame, records: DataFrame, source: str, now: Column, fetchable: tuple[str, ...] = FETCHABLE, force: bool = False) -> DataFrame:
    """(source, outcome, reason, changed, successful, candidates, error, next_check_at) for each due source.

    ``sources``: strategy, hours, last_hash, last_print. ``snapshots``: one row a source: status,
    content_hash, has_content. ``records``: one row a source that was extracted: fact_print and
    n_records. A source whose strategy can't be fetched, or that has no snapshot, is marked as failed
    and keeps its place in time. An extraction without records has failed, on a page that has changed:
    it is tried again. A fingerprint of another version over an unchanged page is only renewed; equal
    facts under a changed page are unchanged; both make no candidates. Else there are candidates: of a
    first reading, of changed facts, or of another version over a changed page. With ``force`` neither
    short cut is taken. All is joined by source, so a cycle of any size is two shuffles.
    """
    s = sources.join(snapshots.select(F.col(source).alias("shot_source"), "status", "content_hash", "has_content"), F.col(source) == F.col("shot_source"), "left")
    s = s.join(records.select(F.col(source).alias("fact_source"), "fact_print", "n_records"), F.col(source) == F.col("fact_source"), "left")
    ready = F.col("strategy").isin(*fetchable)
    decision = extraction_decision(F.col("status"), F.col("has_content"), F.col("last_hash"), F.col("content_hash"), F.col("last_print"), "camp-facts-v2", F.lit(force))
    s = s.withColumn("decision", F.when(ready & F.col("status").isNotNull(), decision)).withColumn("compared", compare_fingerprints(F.col("last_print"), F.col("fact_print")))
    extract = F.coalesce(F.col("decision.extract"), F.lit(False))
    failed = extract & (F.coalesce(F.col("n_records"), F.lit(0)) == 0)
    same_page = F.coalesce(F.col("last_hash") == F.col("content_hash"), F.lit(False))
    outcome = F.when(~ready, "UNSUPPORTED").when(F.col("status").isNull(), "FAILED").when(~extract, F.col("decision.outcome")).when(failed, "EXTRACTION_FAILED")
    if not force:
        outcome = outcome.when((F.col("compared") == "version_mismatch") & same_page, "REBASELINED").when(F.col("compared") == "unchanged", "UNCHANGED_FACTS")
    outcome = outcome.when(F.col("compared") == "baseline", "BASELINE").when(F.col("compared") == "version_mismatch", "CHANGED_VERSION").when(F.col("compared") == "unchanged", "FORCED").otherwise("CHANGED_FACTS")
    error = (
        F.when(~ready, F.concat(F.lit("crawl_strategy_not_fetchable:"), F.col("strategy"))).when(F.col("status").isNull(), "not_fetched")
        .when(failed, "extraction_failed").when(outcome == "FAILED", F.col("decision.reason"))
    )
    new = outcome.isin("BASELINE", "CHANGED_FACTS", "CHANGED_VERSION", "FORCED")
    good = new | outcome.isin("UNCHANGED_SOURCE", "UNCHANGED_FACTS", "REBASELINED")
    return s.select(
        source, outcome.alias("outcome"), F.col("decision.reason").alias("reason"), (new | (outcome == "EXTRACTION_FAILED")).alias("changed"), good.alias("successful"), new.alias("candidates"),
        error.alias("error"), next_check(now, F.col("hours")).alias("next_check_at"),
    )


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Counts of a cycle by outcome."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("sources"))


def field_confidence(fields: DataFrame, record: str, field: str, confidence: str) -> DataFrame:
    """(record, field, confidence): the least confidence that a record's observations of a field have."""
    return fields.where(F.col(confidence).isNotNull()).groupBy(record, field).agg(F.min(confidence).alias("confidence"))


def choose_extractor(sources: DataFrame, extractors: list[tuple[str, Column]], fallback: str = "generic") -> DataFrame:
    """``sources`` with ``extractor``: the first of the ordered (name, condition) list that supports the source."""
    out = F.lit(fallback)
    for name, supports in reversed(extractors):
        out = F.when(F.coalesce(supports, F.lit(False)), name).otherwise(out)
    return sources.withColumn("extractor", out)


def decide_review(state: DataFrame, decisions: DataFrame, item: str) -> DataFrame:
    """(item, status, note, decided_on, published_on, refused): a fix or a refusal needs a note, and without one the old decision stands; a publication day is never lost."""
    new = decisions.select(F.col(item).alias("new_item"), F.col("status").alias("new_status"), F.nullif(F.trim("note"), F.lit("")).alias("new_note"), F.col("decided_on").alias("new_day"))
    both = state.join(new, F.col(item) == F.col("new_item"), "full_outer")
    refused = F.col("new_status").isin("fix", "declined") & F.col("new_note").isNull()
    use = F.col("new_item").isNotNull() & ~F.coalesce(refused, F.lit(False))
    return both.select(
        F.coalesce(item, "new_item").alias(item), F.coalesce(F.when(use, F.col("new_status")).otherwise(F.col("status")), F.lit("pending")).alias("status"), F.when(use, F.col("new_note")).otherwise(F.col("note")).alias("note"),
        F.when(use, F.col("new_day")).otherwise(F.col("decided_on")).alias("decided_on"), "published_on", F.coalesce(refused, F.lit(False)).alias("refused"),
    )


def publish_batch(state: DataFrame, batch: DataFrame, item: str, today: Column) -> DataFrame:
    """``state`` with the batch's approved items that have no publication day published today."""
    chosen = batch.select(F.col(item).alias("chosen_item")).distinct()
    fresh = F.col("chosen_item").isNotNull() & (F.col("status") == "approved") & F.col("published_on").isNull()
    return state.join(chosen, F.col(item) == F.col("chosen_item"), "left").withColumn("published_on", F.when(fresh, today).otherwise(F.col("published_on"))).drop("chosen_item")


def reviewed_latest(candidates: DataFrame, group: str, at: str, key: str, most: int) -> DataFrame:
    """The ``most`` candidates of each group that were reviewed last (the limit is the feature)."""
    order = Window.partitionBy(group).orderBy(F.desc(at), key)
    return candidates.where(F.col(at).isNotNull()).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def season_order(rows: DataFrame, in_season: Column, order: str, key: str) -> DataFrame:
    """Rows in season first, then by their own order."""
    return rows.orderBy(F.when(in_season, 0).otherwise(1), order, key)


def live_types(categories: DataFrame, subcategories: DataFrame, types: DataFrame, category: str, subcategory: str) -> DataFrame:
    """(category, subcategory, the live place types' columns) of categories that aren't parked."""
    shown = categories.where("status <> 'parked'").select(category)
    return types.where("discover_status = 'Live'").join(subcategories.select(category, subcategory), subcategory).join(shown, category, "left_semi")


def toggled(actions: DataFrame, owner: str, item: str, at: str) -> DataFrame:
    """(owner, item, saved, at): an item that was toggled an odd number of times is saved."""
    return actions.groupBy(owner, item).agg((F.count("*") % 2 == 1).alias("saved"), F.max(at).alias(at))


def marked_registered(saved: DataFrame, marks: DataFrame, owner: str, item: str, at: str) -> DataFrame:
    """``saved`` with ``registered_at``: the time of the last mark, null if that took it back or there is none. Only a parent's mark counts."""
    last = marks.groupBy(F.col(owner).alias("mark_owner"), F.col(item).alias("mark_item")).agg(F.max(F.struct(F.col(at).alias("at"), F.col("marked"))).alias("last"))
    joined = saved.join(last, (F.col(owner) == F.col("mark_owner")) & (F.col(item) == F.col("mark_item")), "left")
    return joined.select(*[F.col(c) for c in saved.columns], F.when(F.col("last.marked"), F.col("last.at")).alias("registered_at"))
