"""Money in whole cents, price bands and prices in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    """Whole cents, half up, of a double amount: sums of cents don't depend on their order."""
    return F.floor(amount * 100 + 0.5).cast("long")


def price_band(amount: Column, edges: tuple[int, ...] = (15, 25, 35)) -> Column:
    """free, under_15, 15_25, 25_35, 35_plus, or call_for_price for a missing price; lower edges belong to their band."""
    out = F.when(amount.isNull(), "call_for_price").when(amount <= 0, "free").when(amount < edges[0], f"under_{edges[0]}")
    for lo, hi in zip(edges, edges[1:]):
        out = out.when(amount < hi, f"{lo}_{hi}")
    return out.otherwise(f"{edges[-1]}_plus")


def first_price(text: Column) -> Column:
    """The first amount in dollars in a text, as cents; null without one."""
    found = F.regexp_extract(text, r"\$\s?([0-9][0-9,]*(\.[0-9]{1,2})?)", 1)
    return F.when(found != "", cents(F.regexp_replace(found, ",", "").cast("double")))


def price_unit(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike(r"per day|/ ?day|daily"), "day").when(t.rlike(r"per week|/ ?week|weekly"), "week").when(t.rlike(r"per hour|/ ?h(ou)?r"), "hour").when(t.rlike(r"per session|/ ?session"), "session").otherwise("unknown")


def with_tax(amount_cents: Column, percent: int = 13) -> Column:
    """Cents with a percentage of tax, half up."""
    return F.floor((amount_cents * (100 + percent) + 50) / 100).cast("long")
