"""Three-valued facts: yes, no, unknown. Unknown never passes a positive filter, and is never no."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def tri(value: Column) -> Column:
    """yes and no stay; anything else, null too, is unknown."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("yes", "no"), v).otherwise("unknown")


def tri_of(flag: Column) -> Column:
    """A nullable boolean as yes, no or unknown."""
    return F.when(flag.isNull(), "unknown").when(flag, "yes").otherwise("no")


def all_of(values: Column) -> Column:
    """Kleene AND over an array of yes/no/unknown: any no is no, else any unknown is unknown. Empty is unknown."""
    return F.when(F.exists(values, lambda x: x == "no"), "no").when((F.size(values) == 0) | F.exists(values, lambda x: (x != "yes") | x.isNull()), "unknown").otherwise("yes")


def enum_or_null(value: Column, allowed: Iterable[str], unknown: str = "unknown") -> Column:
    """Null stays null, a listed value itself, any other the unknown member."""
    return F.when(value.isNull(), None).when(value.isin(*allowed), value).otherwise(unknown)


def worst(values: Column, order: tuple[str, ...] = ("no", "unknown", "yes")) -> Column:
    """The value of an array that stands first in ``order``; unknown for an empty array."""
    out = F.lit("unknown")
    for v in reversed(order):
        out = F.when(F.array_contains(values, v), v).otherwise(out)
    return out


def clamp_confidence(value: Column) -> Column:
    """Between 0 and 1; null, NaN and infinities are 0."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def confidence_band(value: Column) -> Column:
    c = clamp_confidence(value)
    return F.when(c >= 0.9, "HIGH").when(c >= 0.7, "MEDIUM").otherwise("LOW")
