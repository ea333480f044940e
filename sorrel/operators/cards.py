"""A program's card: what its matching sessions say about venues, dates, hours, care, ages and evidence, in one grouped pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.functions.ages import band_label


def short_day(day: Column) -> Column:
    """Mon D."""
    return F.date_format(day, "MMM d")


def hours_summary(start: Column, end: Column) -> Column:
    """Aggregate struct<kind, label>: known if every session has the same hours, vary if they differ or some have none, else unknown."""
    both = F.when((start != "") & (end != ""), F.concat(start, F.lit("–"), end))
    known, least, most = F.count(both), F.min(both), F.max(both)
    kind = F.when(known == 0, "unknown").when((known < F.count("*")) | (least != most), "vary").otherwise("known")
    return F.struct(kind.alias("kind"), F.when(kind == "unknown", "Hours to confirm").when(kind == "vary", "Hours vary by session").otherwise(least).alias("label"))


def care_label(name: str, window: Column) -> Column:
    """What a care window says: nothing if it isn't offered, its hours if they are known; ``window`` as of facts.care_window."""
    hours = F.when(window["start"].isNotNull() & window["end"].isNotNull(), F.concat(F.lit(f"{name} "), window["start"], F.lit("–"), window["end"])).otherwise(f"{name} (times to confirm)")
    extra = F.when(window["separate"] == "yes", " · advance request; additional fee").otherwise("")
    return F.when(window["offered"] == "unknown", f"{name} to confirm").when(window["offered"] == "yes", F.concat(hours, extra))


def care_note(before: Column, after: Column) -> Column:
    """Aggregate: the sessions' care if all say the same, else that it varies; null if none is offered."""
    note = F.concat_ws(" · ", care_label("before care", before), care_label("after care", after))
    return F.when(F.min(note) != F.max(note), "care hours vary by session").otherwise(F.nullif(F.min(note), F.lit("")))


def venue_label(name: Column, neighbourhood: Column, city: Column) -> Column:
    place = F.concat_ws(", ", F.nullif(neighbourhood, F.lit("")), F.nullif(city, F.lit("")))
    return F.when(name.isNotNull(), F.concat_ws(" · ", name, F.nullif(place, F.lit(""))))


def venues_summary(label: Column) -> Column:
    """Aggregate struct<kind, label>: the one venue, or how many."""
    n = F.count_distinct(label)
    kind = F.when(n == 0, "unknown").when(n == 1, "known").otherwise("multi")
    return F.struct(kind.alias("kind"), F.when(n == 0, "Venue to confirm").when(n == 1, F.min(label)).otherwise(F.concat(n.cast("string"), F.lit(" venues"))).alias("label"))


def dates_summary(start: Column, end: Column) -> Column:
    """Aggregate struct<kind, label>: the first start to the last end; unverified without a start."""
    first, last, n = short_day(F.min(start)), short_day(F.coalesce(F.max(end), F.min(start))), F.count("*")
    span = F.when(first == last, first).otherwise(F.concat(first, F.lit(" – "), last))
    return F.struct(
        F.when(F.min(start).isNull(), "unverified").otherwise("range").alias("kind"),
        F.when(F.min(start).isNull(), "Upcoming dates not yet verified").when(n == 1, span).otherwise(F.concat(n.cast("string"), F.lit(" sessions · "), span)).alias("label"),
    )


def evidence_summary(checked: Column, confirmed: Column) -> Column:
    """Aggregate struct<kind, label, confirmed>: the days of the checks, and whether the provider confirmed all, some or none."""
    first, last, n = F.min(checked), F.max(checked), F.count("*")
    days = F.concat(F.lit("Checked "), first.cast("string"), F.when(first == last, "").otherwise(F.concat(F.lit("–"), last.cast("string"))))
    yes, no = F.count_if(confirmed), F.count_if(~confirmed)
    said = F.when(yes == n, "provider confirmed").when(yes > 0, "some sessions provider-confirmed").when(no == n, "source-checked (not provider-confirmed)").otherwise("confirmation status unknown")
    return F.struct(
        F.when(first.isNull(), "unknown").otherwise("checked").alias("kind"), F.when(first.isNull(), "Evidence unknown").otherwise(F.concat(days, F.lit(" · "), said)).alias("label"),
        F.when(first.isNotNull() & (yes == n), True).when(first.isNotNull() & (yes == 0) & (no == n), False).alias("confirmed"),
    )


def ages_summary(sessions: DataFrame, key: str, order: str, low: str, high: str, low_inclusive: str, high_inclusive: str) -> DataFrame:
    """(key, ages_kind, ages_label, unknown_ages): the distinct known bands of a program's sessions, the earliest first; bands are never merged.

    Equal bands are grouped first, so what comes together is a program's few different bands.
    """
    band = band_label(F.col(low), F.col(high), F.col(low_inclusive), F.col(high_inclusive))
    each = sessions.groupBy(key, band.alias("band")).agg(F.min(order).alias("first"), F.count("*").alias("n"))
    known = F.collect_list(F.when(F.col("band").isNotNull(), F.struct("first", "band")))
    g = each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(known), lambda x: x["band"]), " · ").alias("bands"), F.coalesce(F.sum(F.when(F.col("band").isNull(), F.col("n"))), F.lit(0)).alias("unknown_ages"))
    kind = F.when(F.col("bands") == "", "unknown").when(F.col("unknown_ages") == 0, "known").otherwise("mixed")
    label = F.when(kind == "known", F.col("bands")).when(kind == "mixed", F.concat("bands", F.lit(" · some session ages to confirm")))
    return g.select(key, kind.alias("ages_kind"), label.alias("ages_label"), "unknown_ages")


def card(sessions: DataFrame, key: str, **columns: Column) -> DataFrame:
    """(key, venue, dates, hours, care, evidence) of each program's sessions: one scan and one shuffle.

    Columns: venue (a label), start, end (dates), opens, closes (texts), before, after (care windows), checked, confirmed.
    """
    c = columns
    return sessions.groupBy(key).agg(
        venues_summary(c["venue"]).alias("venue"), dates_summary(c["start"], c["end"]).alias("dates"), hours_summary(c["opens"], c["closes"]).alias("hours"),
        care_note(c["before"], c["after"]).alias("care"), evidence_summary(c["checked"], c["confirmed"]).alias("evidence"),
    )
