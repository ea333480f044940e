"""Free text to typed facts: date ranges, clock ranges, prices, care and check dates. JVM-side; what isn't stated stays null."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sorrel.functions.money import cents

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Words that state a fact; fixed values, which must be understood as they stand. In one, a space is any white space, and a slash may be followed by some.
TO = ("-", "–", "—", "to", "through", "until", "thru")
UNITS = {
    "per_week": ("per week", "/week", "/wk", "weekly", "full week", "per wk", "a week"),
    "per_day": ("per day", "/day", "daily", "single day", "day rate"),
    "per_session": ("per session", "/session", "each session"),
    "full_program": ("full program", "full summer", "full season", "entire program", "entire summer", "entire season", "whole summer"),
}
PRICE_WORDS, TAXES = ("price", "cost", "fee", "tuition", "rate", "dollar"), ("tax", "hst", "gst")
FREE = ("free", "no cost", "no charge", "no fee")
CURRENCIES = {"CAD": ("cad", "c$", "cdn"), "USD": ("usd", "us$", "u.s. dollar")}
CARE_NO, CARE_YES = ("no", "n", "none", "not offered"), ("yes", "y", "offered", "available")
CARE_INCLUDED, CARE_EXTRA = ("included", "included in price", "included in the price"), ("extra", "additional fee", "additional cost")


def _any_of(words, whole: bool = False) -> str:
    """A pattern for one of the words; ``whole``: not within another word."""
    parts = [r"(?<!\w)" * (whole and w[0].isalnum()) + re.escape(w).replace(r"\ ", r"\s+").replace("/", r"/\s*") for w in words]
    return "(?:" + "|".join(parts) + ")"


_MONTH = "(" + "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 3 else m for m in MONTHS).replace("sep(?:tember)?", "sep(?:t(?:ember)?)?") + ")"
_DAY, _YEAR, _TO = r"(\d\d?)(?:[a-z]{2}(?![a-z]))?", r"(\d{4})", rf"\s*{_any_of(TO)}\s*"
_ISO = rf"{_YEAR}-(\d\d)-(\d\d)"
_TIME = r"(\d\d?)(?::(\d\d))?\s*([ap]\.?m\.?)?(?![\d:])"
_AMOUNT = r"(?:\$|(?<!\w)(?:cad|usd)(?!\w))?\s*(\d[\d,]*)(?:\.(\d\d?))?(?!\d)"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _part(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def month_number(name: Column) -> Column:
    return ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.substring(name, 1, 3)) + 2) / 3).cast("int")


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if it isn't on the calendar."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def date_range(text: Column, context_year: int | None = None) -> Column:
    """struct<start date, end date, year_inferred boolean, confidence double> of the first range or date in a text.

    Null without one, or if it isn't on the calendar, runs backwards, or no year is stated or given
    as context: a year is never invented. A range whose start borrows the end's year and would run
    backwards over the months crosses New Year.
    """
    return let(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), ",", " "), r"\s+", " ")), lambda t: _date_range(t, context_year))


def _date_range(t: Column, context_year: int | None) -> Column:
    """``date_range`` of a text in small letters, which is a variable: all patterns look at it, and it is made once."""
    none = F.lit(None).cast("int")

    def parts(pattern: str, start: tuple, end: tuple | None) -> Column:
        def number(group: int | None, month: bool = False) -> Column:
            if group is None:
                return none
            found = _part(t, pattern, group)
            return month_number(found) if month else found.cast("int")

        named = pattern.startswith("(jan")
        fields = [number(start[0]), number(start[1], named), number(start[2])] + ([number(end[0]), number(end[1], named), number(end[2])] if end else [none] * 3)
        return F.when(t.rlike(pattern), F.struct(*[c.alias(n) for c, n in zip(fields, ("sy", "sm", "sd", "ey", "em", "ed"))], F.lit(end is not None).alias("two")))

    found = F.coalesce(
        parts(_ISO + _TO + _ISO, (1, 2, 3), (4, 5, 6)),
        parts(rf"^{_ISO}$", (1, 2, 3), None),
        parts(rf"{_MONTH}\.?\s+{_DAY}(?:\s+{_YEAR})?{_TO}{_MONTH}\.?\s+{_DAY}(?:\s+{_YEAR})?", (3, 1, 2), (6, 4, 5)),
        parts(rf"{_MONTH}\.?\s+{_DAY}{_TO}{_DAY}(?:\s+{_YEAR})?", (4, 1, 2), (4, 1, 3)),
        parts(rf"{_MONTH}\.?\s+{_DAY}(?:\s+{_YEAR})?", (3, 1, 2), None),
    )

    def dated(p: Column) -> Column:
        stated = F.coalesce(p["sy"], p["ey"], F.lit(context_year).cast("int"))
        crosses = p["two"] & p["sy"].isNull() & p["ey"].isNotNull() & (p["sm"] > p["em"])
        start = calendar_date(F.coalesce(p["sy"], stated) - F.when(crosses, 1).otherwise(0), p["sm"], p["sd"])
        end = F.when(p["two"], calendar_date(F.coalesce(p["ey"], stated), p["em"], p["ed"]))
        inferred = p["sy"].isNull() | (p["two"] & p["ey"].isNull())
        return F.struct(start.alias("start"), end.alias("end"), inferred.alias("year_inferred"), F.when(~p["two"], 0.7).when(inferred, 0.9).otherwise(0.97).alias("confidence"), p["two"].alias("two"), stated.isNotNull().alias("known"))

    def checked(r: Column) -> Column:
        fine = r["known"] & r["start"].isNotNull() & (~r["two"] | (r["end"] >= r["start"]))
        return F.when(fine, F.struct(r["start"].alias("start"), r["end"].alias("end"), r["year_inferred"].alias("year_inferred"), r["confidence"].alias("confidence")))

    return let(let(found, lambda p: F.when(p.isNotNull(), dated(p))), checked)


def time_range(text: Column) -> Column:
    """struct<start int, end int, inferred boolean> in minutes of the day; null if no time is stated.

    A number counts as a time only with minutes or am/pm. Hours 1 to 6 without either are afternoon
    hours, and an end that isn't after the start is moved to the afternoon if it has neither.
    """
    t = F.regexp_replace(F.regexp_replace(_spaces(text), r"\bnoon\b", "12:00 pm"), r"\bmidnight\b", "12:00 am")
    stated = F.filter(F.regexp_extract_all(t, F.lit(_TIME), 0), lambda m: m.rlike(r":\d|[ap]\.?m") & (F.regexp_extract(m, r"(\d+)", 1).cast("int") <= 24) & (F.coalesce(_part(m, r":(\d+)", 1), F.lit("0")).cast("int") <= 59))

    def parsed(m: Column) -> Column:
        hour, half = F.regexp_extract(m, r"(\d+)", 1).cast("int"), F.regexp_extract(m, r"([ap])\.?m", 1)
        full = F.when(half == "p", F.when(hour == 12, 12).otherwise(hour + 12)).when(half == "a", F.when(hour == 12, 0).otherwise(hour)).when(hour.between(1, 6), hour + 12).otherwise(hour)
        return F.struct((F.pmod(full, F.lit(24)) * 60 + F.coalesce(_part(m, r":(\d+)", 1), F.lit("0")).cast("int")).alias("at"), (half == "").alias("bare"))

    def both(ts: Column) -> Column:
        a, b = F.get(ts, F.lit(0)), F.get(ts, F.lit(1))
        end = F.when((b["at"] <= a["at"]) & b["bare"] & (b["at"] < 720), b["at"] + 720).otherwise(b["at"])
        return F.when(F.size(ts) > 0, F.struct(a["at"].alias("start"), end.alias("end"), (a["bare"] | F.coalesce(b["bare"], F.lit(False))).alias("inferred")))

    return let(F.transform(stated, parsed), both)


def price_unit(text: Column) -> Column:
    """The first unit of UNITS that a text states, or null."""
    t, out = _spaces(text), F.lit(None).cast("string")
    for unit, words in reversed(UNITS.items()):
        out = F.when(t.rlike(_any_of(words)), unit).otherwise(out)
    return out


def price(text: Column, most: int = 100_000) -> Column:
    """struct<cents long, currency, unit, tax_extra boolean, amounts int> of the first monetary amount; null without one.

    A bare number counts only in a text with price wording. A dollar sign alone is taken as CAD; no
    sign leaves the currency unknown. Amounts over ``most`` are refused.
    """
    t = _spaces(text)
    worded = t.rlike(_any_of(PRICE_WORDS, whole=True))
    amounts = F.filter(F.regexp_extract_all(t, F.lit(_AMOUNT), 0), lambda m: m.rlike(_any_of(("$", *(c.lower() for c in CURRENCIES)))) | worded)
    tax = t.rlike(rf"(?:\+|plus)\s*{_any_of(TAXES)}|tax(?:es)?\s+extra")
    named = F.lit(None).cast("string")
    for code, words in reversed(CURRENCIES.items()):
        named = F.when(t.rlike(_any_of(words, whole=True)), code).otherwise(named)
    currency = F.coalesce(named, F.when(t.contains("$"), "CAD"), F.lit("unknown"))

    def of(found: Column) -> Column:
        value = F.regexp_replace(F.regexp_extract(F.get(found, F.lit(0)), r"(\d[\d,]*(?:\.\d{1,2})?)", 1), ",", "").cast("double")
        free = t.rlike(rf"{_any_of(FREE, whole=True)}(?!\w)|\$0(?:\.00)?(?![\d.])")
        zero = F.struct(F.lit(0).cast("long").alias("cents"), F.lit("CAD").alias("currency"), price_unit(text).alias("unit"), F.lit(False).alias("tax_extra"), F.lit(1).alias("amounts"))
        return F.when(free, zero).when((F.size(found) > 0) & (value <= most), F.struct(cents(value).alias("cents"), currency.alias("currency"), price_unit(text).alias("unit"), tax.alias("tax_extra"), F.size(found).alias("amounts")))

    return let(amounts, of)


def checked_date(text: Column) -> Column:
    """The date of a cell in five spellings; null for others, and for a day and month that could be exchanged."""
    t = F.lower(F.trim(F.translate(text, "–—", "--")))

    def dated(pattern: str, y: int, m: int, d: int, named: bool = False) -> Column:
        month = _part(t, pattern, m)
        return F.when(t.rlike(pattern), calendar_date(_part(t, pattern, y).cast("int"), month_number(month) if named else month.cast("int"), _part(t, pattern, d).cast("int")))

    slash = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    a, b = _part(t, slash, 1).cast("int"), _part(t, slash, 2).cast("int")
    return F.coalesce(
        dated(r"^(\d{4})-(\d{2})-(\d{2})(?:[t\s]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?)?$", 1, 2, 3), dated(r"^(\d{4})/(\d{1,2})/(\d{1,2})$", 1, 2, 3),
        dated(rf"^{_MONTH}\s+(\d{{1,2}}),\s*(\d{{4}})$", 3, 1, 2, True), dated(rf"^(\d{{1,2}})\s+{_MONTH}\s+(\d{{4}})$", 3, 2, 1, True),
        F.when((a > 12) & (b <= 12), dated(slash, 3, 2, 1)).when((b > 12) & (a <= 12), dated(slash, 3, 1, 2)),
    )


def care(text: Column) -> Column:
    """struct<offered, separate> of a care cell, each yes, no or unknown. A clock range that fills the cell means offered; so does one with what it costs after a comma."""
    t = F.trim(F.lower(text))
    cost = F.regexp_extract(t, r"^.+?\s*,\s*(.+)$", 1)
    clocks = F.regexp_replace(t, r"\s*,[^,]*$", "")
    clock = rf"^{_TIME}{_TO}{_TIME}$"
    range_alone, range_noted = t.rlike(clock), clocks.rlike(clock) & cost.isin("included", "extra", "additional fee")
    said = F.when(range_noted, cost).otherwise(t)
    offered = F.when(t.isin(*CARE_NO), "no").when(t.isin(*CARE_YES, *CARE_INCLUDED, *CARE_EXTRA) | range_alone | range_noted, "yes")
    separate = F.when(said.isin(*CARE_INCLUDED), "no").when(said.isin(*CARE_EXTRA), "yes")
    return F.struct(F.coalesce(offered, F.lit("unknown")).alias("offered"), F.coalesce(separate, F.lit("unknown")).alias("separate"))


def month_day_windows(text: Column) -> Column:
    """Tokens MM-DD_MM-DD of all yearless ranges in a text: identities of weeks whose year isn't stated."""
    t = _spaces(text)
    pattern = rf"{_MONTH}\.?\s+{_DAY}{_TO}(?:{_MONTH}\.?\s+)?{_DAY}"

    def token(m: Column) -> Column:
        first, second = month_number(F.regexp_extract(m, pattern, 1)), _part(m, pattern, 3)
        return F.format_string("%02d-%02d_%02d-%02d", first, F.regexp_extract(m, pattern, 2).cast("int"), F.when(second.isNull(), first).otherwise(month_number(second)), F.regexp_extract(m, pattern, 4).cast("int"))

    return F.transform(F.regexp_extract_all(t, F.lit(pattern), 0), token)


def sentences(text: Column) -> Column:
    """Trimmed sentences; a mark ends one only before white space."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: s != "")


def lines(text: Column) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda s: s != "")
