"""Facets of venues, derived from published facts: what isn't stated is never guessed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sorrel.functions.dates import clock_overlaps

#: Age groups in whole years; fixed values of the catalog. Touching edges overlap.
AGE_GROUPS = (("babies", 0, 1), ("toddlers", 1, 3), ("preschool", 3, 5), ("kids", 5, 8), ("big_kids", 8, 12), ("tweens_teens", 12, None))
OLDER = ("kids", "big_kids", "tweens_teens")
#: Minutes of the day; fixed values of the catalog.
MORNING_BEFORE, AFTER_SCHOOL, EVENING_AFTER = 12 * 60, (15 * 60 + 30, 17 * 60 + 30), 19 * 60


def age_groups(min_months: Column, max_years: Column, hard_minimum: Column | None = None, override: Column | None = None) -> Column:
    """Names of the groups that a venue's ages overlap; none if no bound is known or the bounds cross."""
    low = F.coalesce(min_months / 12, F.lit(0.0))
    if hard_minimum is not None:
        low = F.greatest(low, F.coalesce(hard_minimum.cast("double"), F.lit(0.0)))
    known = (min_months.isNotNull() | max_years.isNotNull()) & F.coalesce(low <= max_years, F.lit(True))

    def group(name: str, lo: int, hi: int | None) -> Column:
        inside = F.coalesce(max_years >= lo, F.lit(True))
        return F.when(known & inside & ((low <= hi) if hi is not None else F.lit(True)), name)

    found = F.array_compact(F.array(*[group(*g) for g in AGE_GROUPS]))
    return found if override is None else F.when(F.size(override) > 0, override).otherwise(found)


def when_windows(rows: Column, holidays: Column | None = None) -> Column:
    """Names of the times at which a venue is open; rows: array<struct<weekday, opens, closes, next_day>>, minutes of the day."""
    morning = F.exists(rows, lambda r: (r["weekday"] <= 5) & (r["opens"] < MORNING_BEFORE))
    school = F.exists(rows, lambda r: (r["weekday"] <= 5) & clock_overlaps(r["opens"], r["closes"], r["next_day"], *AFTER_SCHOOL))
    weekend = F.exists(rows, lambda r: r["weekday"] >= 6)
    evening = F.exists(rows, lambda r: F.coalesce(r["next_day"], F.lit(False)) | (r["closes"] > EVENING_AFTER))
    names = [("weekday_mornings", morning), ("after_school", school), ("weekends", weekend), ("evenings", evening)]
    if holidays is not None:
        names.append(("pa_days", holidays))
    return F.array_compact(F.array(*[F.when(c, name) for name, c in names]))


def adults_fact(amount: Column, free: Column, included: Column) -> Column:
    """adult_free, adult_pays or null: an unknown price isn't "pays"."""
    return F.when(F.coalesce(included, F.lit(False)) | F.coalesce(free, F.lit(False)) | (amount == 0), "adult_free").when(amount > 0, "adult_pays")


def good_for_toddlers(zone: Column, time: Column) -> Column:
    """A confirmed zone or time."""
    return zone.eqNullSafe(True) | time.eqNullSafe(True)


def mixed_ages(groups: Column) -> Column:
    """Toddlers and one of the older groups."""
    return F.array_contains(groups, "toddlers") & F.arrays_overlap(groups, F.array(*map(F.lit, OLDER)))


def rainy_weekday_morning(windows: Column, price_band: Column) -> Column:
    return F.array_contains(windows, "weekday_mornings") & price_band.isin("free", "under_15")


def included(status: Column, published: Column) -> Column:
    """Closed venues never; those to be checked only if published."""
    return F.coalesce((status != "closed") & ((status != "needs_check") | published.eqNullSafe(True)), F.lit(False))


def facet_filter(any_of: dict[str, list[str]], equal: dict[str, str], confirmed: list[str]) -> Column:
    """Every active facet passes. any_of: array columns that share a value; equal: exact values; confirmed: flags that are known to be true."""
    own = [F.arrays_overlap(F.col(c), F.array(*map(F.lit, v))) for c, v in any_of.items() if v]
    own += [F.col(c) == v for c, v in equal.items()] + [F.col(c).eqNullSafe(True) for c in confirmed]
    return F.coalesce(reduce(lambda a, b: a & b, own, F.lit(True)), F.lit(False))


def usable_coordinates(latitude: Column, longitude: Column, box: tuple[float, float, float, float] = (-90.0, 90.0, -180.0, 180.0)) -> Column:
    """struct<lat, lng> if both are finite and within the box (south, north, west, east), else null."""
    fine = latitude.between(box[0], box[1]) & longitude.between(box[2], box[3])
    return F.when(fine, F.struct(latitude.alias("lat"), longitude.alias("lng")))
