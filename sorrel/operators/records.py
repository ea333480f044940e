"""States of sources, decisions on candidates, what a catalog has of proposed fields, opening hours by weekday, ages of siblings against sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.functions.ages import stated_age_fits
from sorrel.functions.text import let

#: What a reviewer may do, and the decision that it records; fixed values of the stored form.
DECISIONS = {"approve": "approved", "reject": "rejected", "ignore": "ignored", "needs_review": "needs_review"}


def changed_on_last_check(changed_at: Column, checked_at: Column, previous: Column, fetched: Column) -> Column:
    """Whether a source's last check found a change: by its times if both are known, else a successful snapshot that has one before it."""
    return F.when(changed_at.isNotNull() & checked_at.isNotNull(), changed_at >= checked_at).otherwise(F.coalesce(previous.isNotNull() & (fetched == "success"), F.lit(False)))


def source_health(sources: DataFrame, snapshots: DataFrame, source: str) -> DataFrame:
    """(source, health): Unsupported, Blocked, Failed, Changed or Healthy, the first that holds.

    ``sources``: strategy, changed_at, checked_at, error_at, success_at. ``snapshots``: taken_at, snapshot,
    fetched, previous; each source's last one counts (ties: the larger snapshot), found by a partial aggregate.
    """
    last = snapshots.groupBy(F.col(source).alias("of_source")).agg(F.max(F.struct("taken_at", "snapshot", "fetched", "previous")).alias("last"))
    s = sources.join(last, F.col(source) == F.col("of_source"), "left")
    fetched = F.col("last.fetched")
    failing = F.col("error_at").isNotNull() & (F.col("success_at").isNull() | (F.col("error_at") > F.col("success_at")))
    health = (
        F.when((F.col("strategy") == "unsupported") | (fetched == "unsupported"), "Unsupported").when(fetched == "blocked", "Blocked").when((fetched == "error") | failing, "Failed")
        .when(changed_on_last_check(F.col("changed_at"), F.col("checked_at"), F.col("last.previous"), fetched), "Changed").otherwise("Healthy")
    )
    return s.select(source, health.alias("health"))


def recorded_reviews(candidates: DataFrame, actions: DataFrame, candidate: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, refused): each candidate with status, reviewed_by, reviewed_at and note of its last valid action, and the actions that can't be recorded, with a reason.

    ``candidates``: status, reviewed_by, reviewed_at, note. ``actions``: action, reviewed_by, note, at. An
    unknown action is refused before a missing reviewer, that before an unknown candidate. A blank note is
    none. Nothing is published by a review. Of actions of equal time the larger wins.
    """
    codes = F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv])
    who = F.nullif(F.trim("reviewed_by"), F.lit(""))
    known = candidates.select(F.col(candidate).alias("known_candidate")).distinct()
    each = actions.select(F.col(candidate).alias("candidate"), "action", F.try_element_at(codes, F.col("action")).alias("decision"), who.alias("who"), F.nullif(F.trim("note"), F.lit("")).alias("note"), "at")
    each = each.join(known, F.col("candidate") == F.col("known_candidate"), "left")
    reason = F.when(F.col("decision").isNull(), "invalid_action").when(F.col("who").isNull(), "missing_reviewer").when(F.col("known_candidate").isNull(), "candidate_not_found")
    each = each.withColumn("reason", reason)
    last = each.where("reason IS NULL").groupBy("candidate").agg(F.max(F.struct("at", "decision", "who", "note")).alias("last"))
    both = candidates.join(last, F.col(candidate) == F.col("candidate"), "left")
    new = F.col("last").isNotNull()

    def either(theirs: str, own: str) -> Column:
        return F.when(new, F.col(f"last.{theirs}")).otherwise(F.col(own)).alias(own)

    kept = both.select(F.col(candidate), either("decision", "status"), either("who", "reviewed_by"), either("at", "reviewed_at"), either("note", "note"))
    return kept, each.where("reason IS NOT NULL").select(F.col("candidate").alias(candidate), "action", "at", "reason")


def current_fields(proposals: DataFrame, catalog: DataFrame, record: str, field: str, fields: list[str]) -> DataFrame:
    """``proposals`` with ``known`` (whether the catalog has the record) and ``current`` (its text of the field, null if it has no such field)."""
    have = catalog.select(F.col(record).cast("string").alias("have_record"), F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]).alias("have"))
    both = proposals.join(have, F.col(record).cast("string") == F.col("have_record"), "left")
    return both.select(*proposals.columns, F.col("have_record").isNotNull().alias("known"), F.try_element_at("have", F.col(field)).alias("current"))


def weekly_hours(places: DataFrame, hours: DataFrame, place: str) -> DataFrame:
    """(place, kind, rows, seasonal, checked): how a place is open.

    ``places``: hours_kind, checked. ``hours``: weekday (1 to 7), opens, closes (HH:MM), valid_from, valid_to,
    checked. Ranges of other weekdays or that don't end after they begin don't count. rows has the ranges of
    each weekday that hold all year, in order; seasonal counts the others. A place with fixed hours but no
    range is unknown; statements (dawn_to_dusk, always_open, varies) have neither rows nor seasons. checked is
    the hours' last day of checking, else the place's.
    """
    fine = hours.where(F.col("weekday").between(1, 7) & (F.col("opens") < F.col("closes")))
    all_year = F.col("valid_from").isNull() & F.col("valid_to").isNull()
    span = F.struct(F.col("weekday").cast("int").alias("weekday"), F.concat("opens", F.lit("–"), "closes").alias("range"))
    per = fine.groupBy(F.col(place).alias("of_place")).agg(F.array_sort(F.collect_list(F.when(all_year, span))).alias("spans"), F.count_if(~all_year).alias("n_seasonal"), F.max("checked").alias("hours_checked"))  # a place's own ranges
    p = places.join(per, F.col(place) == F.col("of_place"), "left")
    fixed = (F.col("hours_kind") == "fixed") & F.col("of_place").isNotNull()
    rows = let(F.col("spans"), lambda xs: F.transform(F.sequence(F.lit(1), F.lit(7)), lambda d: F.array_join(F.transform(F.filter(xs, lambda x: x["weekday"] == d), lambda x: x["range"]), ", ")))
    kind = F.when(F.col("hours_kind").isin("dawn_to_dusk", "always_open", "varies"), "statement").when(fixed, "weekly").otherwise("unknown")
    checked = F.when(fixed, F.coalesce("hours_checked", F.col("checked"))).when(kind == "statement", F.col("checked"))
    return p.select(place, kind.alias("kind"), F.when(fixed, rows).alias("rows"), F.when(fixed, F.col("n_seasonal")).alias("seasonal"), checked.alias("checked"))


def age_cells(sessions: DataFrame, ages: list[int], as_of: Column, low: str, high: str, low_inclusive: str, high_inclusive: str, assessed: Column) -> Column:
    """fit, no or unknown of each sibling's age for a session; ages count on the day for which they are stated only."""
    def cell(age: int) -> Column:
        fit = stated_age_fits(F.lit(age), as_of, assessed, *[sessions[c] for c in (low, high, low_inclusive, high_inclusive)])
        return F.when(fit == "yes", "fit").otherwise(fit)

    return F.array(*map(cell, ages))
