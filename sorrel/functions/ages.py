"""Age bands and the three-valued test of an age against them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sorrel.functions.logic import all_of


def band_known(low: Column, high: Column, low_inclusive: Column, high_inclusive: Column) -> Column:
    """A band is known if it has a bound, says of each bound whether it's included, and isn't empty."""
    stated = (low.isNotNull() | high.isNotNull()) & (low.isNull() | low_inclusive.isNotNull()) & (high.isNull() | high_inclusive.isNotNull())
    empty = (low > high) | ((low == high) & ~(low_inclusive & high_inclusive))
    return F.coalesce(stated & ~F.coalesce(empty, F.lit(False)), F.lit(False))


def age_fits(age: Column, low: Column, high: Column, low_inclusive: Column | None = None, high_inclusive: Column | None = None) -> Column:
    """yes, no or unknown. An unknown age or band (see ``band_known``) is unknown; without the last two arguments bounds are included."""
    lo_in = F.lit(True) if low_inclusive is None else low_inclusive
    hi_in = F.lit(True) if high_inclusive is None else high_inclusive
    below = (age < low) | ((age == low) & ~lo_in)
    above = (age > high) | ((age == high) & ~hi_in)
    refused = F.coalesce(below, F.lit(False)) | F.coalesce(above, F.lit(False))
    return F.when(age.isNull() | ~band_known(low, high, lo_in, hi_in), "unknown").when(refused, "no").otherwise("yes")


def assessment_date(rule: Column, assessed_at: Column, start: Column) -> Column:
    """The day on which a session counts ages: a stated day, the session's start, or unknown."""
    return F.when(rule == "as_of_date", assessed_at).when(rule == "as_of_session_start", start)


def stated_age_fits(age: Column, as_of: Column, assessed: Column, low: Column, high: Column, low_inclusive: Column | None = None, high_inclusive: Column | None = None) -> Column:
    """yes, no or unknown of an age in whole years that was stated for the day ``as_of``.

    It counts only if that is the day on which the session assesses ages: an age is never carried to another
    day, as that would need a birthday that nobody has stated.
    """
    same = (age == F.floor(age)) & (age >= 0) & (as_of == assessed)
    return F.when(F.coalesce(same, F.lit(False)), age_fits(age, low, high, low_inclusive, high_inclusive)).otherwise("unknown")


def band_label(low: Column, high: Column, low_inclusive: Column, high_inclusive: Column) -> Column:
    """Ages of a known band as text: a–b, a+ or up to b, with < and > at bounds that aren't included; null if unknown."""
    lo, hi = F.concat(F.when(low_inclusive, "").otherwise(">"), low.cast("string")), F.concat(F.when(high_inclusive, "").otherwise("<"), high.cast("string"))
    one = F.when(high.isNull(), F.concat(lo, F.when(low_inclusive, "+").otherwise(""))).otherwise(F.concat(F.when(high_inclusive, "up to ").otherwise(""), hi))
    return F.when(band_known(low, high, low_inclusive, high_inclusive), F.concat(F.lit("Ages "), F.when(low.isNotNull() & high.isNotNull(), F.concat(lo, F.lit("–"), hi)).otherwise(one)))


def family_fits(ages: list[int], low: Column, high: Column) -> Column:
    """Kleene AND of the children's tests."""
    return all_of(F.array(*[age_fits(F.lit(a), low, high) for a in ages]))


def age_range(text: Column) -> Column:
    """struct<low int, high int> of the first 'a-b', 'a to b', 'a+' or 'age a' in a text; null if refused.

    Grades and months aren't years; an age over 21 is implausible.
    """
    t = F.lower(F.translate(text, "–—", "--"))
    pair_lo, pair_hi = F.regexp_extract(t, r"([0-9]{1,2}) ?(-|to) ?([0-9]{1,2})", 1), F.regexp_extract(t, r"([0-9]{1,2}) ?(-|to) ?([0-9]{1,2})", 3)
    plus = F.regexp_extract(t, r"([0-9]{1,2}) ?(\+|and up|and over)", 1)
    one = F.regexp_extract(t, r"ages? ([0-9]{1,2})", 1)
    lo = F.when(pair_lo != "", pair_lo).when(plus != "", plus).when(one != "", one).cast("int")
    hi = F.when(pair_lo != "", pair_hi).when(plus != "", None).when(one != "", one).cast("int")
    ok = lo.isNotNull() & ~t.rlike("grade|month") & (F.coalesce(hi, lo) <= 21) & (F.coalesce(hi, lo) >= lo)
    return F.when(ok, F.struct(lo.alias("low"), hi.alias("high")))
