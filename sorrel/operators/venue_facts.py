"""What may be shown of a venue, its prices by section and the gaps in its record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.functions.money import cents
from sorrel.operators.views import public_fact


def is_https(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https://\S+$"), F.lit(False))


def is_day(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(value, "yyyy-MM-dd").isNotNull(), F.lit(False))


def public_theme(basis: Column, source_id: Column, url: Column, checked: Column, status: Column, note: Column) -> Column:
    """A first-hand visit needs a day and no web source; what reviewers report needs its review source; all else is as ``public_fact``."""
    stated = F.coalesce((status == "verified") | ((status == "conflicting") & (F.trim(note) != "")), F.lit(False))
    return F.when(basis == "first_hand_visit", is_day(checked) & stated).when((basis == "reviewer_reported") & F.coalesce(source_id == "", F.lit(True)), False).otherwise(public_fact(url, checked, status, note))


def viewable(state: Column, published_at: Column, operating: Column, url: Column, checked: Column) -> Column:
    """A published, open venue with a source and the day of its check."""
    return F.coalesce((state == "published") & (published_at.cast("string") != "") & (operating == "open"), F.lit(False)) & is_https(url) & is_day(checked)


def review_source_shown(fact: Column, note: Column, kind: Column, platform: Column, rating: Column, ratings: Column, attributions: Column, items: Column, disclosure: Column, most_items: int = 5) -> Column:
    """``fact``: whether it's a public fact. A coverage note; editorial if and only if it's a blog or guide, and then without a rating; of map platforms, attributions (and few items, or a disclosure)."""
    editorial = (kind == "editorial")
    fine = fact & (F.trim(note) != "") & (editorial == (platform == "blog_or_guide")) & ~(editorial & (rating.isNotNull() | ratings.isNotNull()))
    attributed = F.coalesce(F.size(attributions) > 0, F.lit(False))
    listed = F.when(platform == "google_places_reviews", attributed & F.coalesce(items <= most_items, F.lit(True))).when(platform == "google_review_summary", attributed & (F.trim(disclosure) != "")).otherwise(True)
    return F.coalesce(fine & listed, F.lit(False))


def latest_day(days: Column) -> Column:
    """The last valid day of an array of texts."""
    return F.array_max(F.filter(days, is_day))


def live_price(fact: Column, kind: Column, valid_to: Column, today: Column) -> Column:
    """A public price that isn't a promotion without a valid end or past it."""
    return fact & F.coalesce((kind != "promotion") | (is_day(valid_to) & (valid_to >= today)), F.lit(False))


def price_sections(prices: DataFrame, venue: str, kind: str, amount: str, live: Column) -> DataFrame:
    """(venue, kind, lines, least_cents, most_cents): a venue's live prices by section; a section without lines isn't there."""
    c = cents(F.col(amount))
    return prices.where(live).groupBy(venue, kind).agg(F.count("*").alias("lines"), F.min(c).alias("least_cents"), F.max(c).alias("most_cents"))


def cost_options(prices: DataFrame, venue: str, section: str, audience: str, required: str, basis: str) -> DataFrame:
    """(venue, child, adult, watching, required, unpriced): what an estimate can use; a venue without a price for a child has none.

    Admission serves a child (child, infant, other), an adult who takes part (adult, other) or one who
    watches; required extras count if it's stated whom they are charged for, and are named if not.
    """
    kind, who = F.col(section), F.col(audience)
    def of(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    extra = (kind == "addon") & F.col(required)
    g = prices.groupBy(venue).agg(
        of((kind == "admission") & who.isin("child", "infant", "other"), "child"), of((kind == "admission") & who.isin("adult", "other"), "adult"),
        of((kind == "admission") & (who == "non_participant"), "watching"), of(extra & (F.col(basis) != "unknown"), "required"), of(extra & (F.col(basis) == "unknown"), "unpriced"),
    )
    return g.where("child > 0")


def everyday_child_price(prices: DataFrame, venue: str, label: str, amount: str, low: str, high: str, order: str, audience: str = "audience", free: str = "free", sibling: str = "sibling") -> DataFrame:
    """(venue, label, least, most): of a child's paid admission prices that aren't for siblings those of the label whose ticket spans most ages; ties to the first.

    A price that doesn't say whether it is free or for siblings is neither. A venue without such a price has no row.
    """
    paid = prices.where((F.col(audience) == "child") & ~F.coalesce(F.col(free), F.lit(False)) & ~F.coalesce(F.col(sibling), F.lit(False)))
    width = F.coalesce(F.col(high), F.lit(17)) - F.coalesce(F.col(low), F.lit(0))
    widest = paid.groupBy(F.col(venue).alias("of_venue")).agg(F.max(F.struct(width.alias("w"), (-F.col(order)).alias("o"), F.col(label).alias("l"))).alias("best"))
    same = paid.join(widest, (F.col(venue) == F.col("of_venue")) & (F.col(label) == F.col("best.l")))
    return same.groupBy(venue, label).agg(F.min(amount).alias("least"), F.max(amount).alias("most"))


def age_verdict(age: Column, low: Column, high: Column) -> Column:
    """fits, too_young, too_old or no_age_info of a whole age for an activity."""
    whole = F.floor(age)
    return F.when(low.isNull() & high.isNull(), "no_age_info").when(whole < low, "too_young").when(whole > high, "too_old").otherwise("fits")


def ages_gap(all_ages: Column, low: Column, high: Column) -> Column:
    """What is missing of a place's ages, or null."""
    return (
        F.when(F.coalesce(all_ages, F.lit(False)), F.when(high.isNotNull(), "all_ages_with_limit")).when(low.isNull() & high.isNull(), "no_ages")
        .when(low.isNull(), "no_minimum").when(high.isNull(), "no_maximum").when(low > high, "crossed")
    )


def hours_gap(kind: Column, rows: Column) -> Column:
    return F.when(F.coalesce(kind, F.lit("unknown")) == "unknown", "kind_unknown").when((kind == "fixed") & F.coalesce(rows == 0, F.lit(True)), "no_hours")


def verification_gap(url: Column, checked: Column) -> Column:
    has_url, has_day = F.coalesce(F.trim(url) != "", F.lit(False)), is_day(checked)
    return F.when(~has_url & ~has_day, "neither").when(~has_url, "no_source").when(~has_day, "no_date")


def stroller_friendly(own: Column, venue: Column) -> Column:
    """The place's fact; the venue's only if the place's is unknown."""
    return F.when(own.isin("yes", "no"), own).otherwise(F.coalesce(venue, F.lit("unknown")))


def routine(checked: Column, page_checked: Column, conflict: Column) -> Column:
    """A fact that was checked with its page and doesn't conflict needs no word of its own."""
    return F.coalesce((checked == page_checked) & (F.coalesce(F.trim(conflict), F.lit("")) == ""), F.lit(False))


def child_price_from(prices: DataFrame, venue: str, kind: str, audience: str, sibling: str, amount: str, free: str, plus_tax: str) -> DataFrame:
    """(venue, from_cents, tax, free): the least paid regular admission of a child; free if all are; neither promotions, sibling rates nor add-ons count."""
    regular = prices.where((F.col(kind) == "admission") & (F.col(audience) == "child") & ~F.coalesce(F.col(sibling), F.lit(False)))
    paid = F.min(F.when(F.col(amount) > 0, cents(F.col(amount))))
    return regular.groupBy(venue).agg(paid.alias("from_cents"), (paid.isNotNull() & F.coalesce(F.bool_or(plus_tax), F.lit(False))).alias("tax"), (paid.isNull() & F.coalesce(F.every(free), F.lit(False))).alias("free"))
