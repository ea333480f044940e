"""What a visit costs: tickets by age, extra adults, packages, sibling rates, required extras and tax, in whole cents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sorrel.functions.money import with_tax
from sorrel.operators.intervals import band_join


@dataclass(frozen=True)
class Package:
    label: str
    children: int
    adults: int
    cents: int


def family_price(children: DataFrame, families: DataFrame, tickets: DataFrame, extra_adult: int, packages: list[Package], family: str = "family", age: str = "age") -> DataFrame:
    """(family, children, unmatched, tickets, extra_adults, total, best_label, best_total, best_with_tax) for each family.

    ``children`` has a row a child, ``families`` the number of ``adults``; ``tickets`` is a short list
    (band, low, high, cost, adults_included). A child gets the narrowest ticket that holds the age,
    ties to the cheaper. Adults beyond those that the tickets include pay ``extra_adult``. A package
    replaces all of it only if it is strictly cheaper, holds all paying children, and no child lacks
    a ticket; its further adults pay too.
    """
    own = band_join(children.select(family, age), age, tickets, also=("adults_included",))
    sums = own.groupBy(F.col(family).alias("key")).agg(
        F.count("*").alias("children"), F.count_if(F.col("band").isNull()).alias("unmatched"), F.count_if(F.col("band_cost") > 0).alias("paying"),
        F.coalesce(F.sum("band_cost"), F.lit(0)).cast("long").alias("ticket_cents"), F.coalesce(F.sum("adults_included"), F.lit(0)).alias("covered"),
    )
    f = families.select(family, "adults").join(sums, F.col(family) == F.col("key"), "left").na.fill(0, ["children", "unmatched", "paying", "ticket_cents", "covered"])
    f = f.withColumn("extra_adults", F.greatest(F.col("adults") - F.col("covered"), F.lit(0))).withColumn("total", F.col("ticket_cents") + F.col("extra_adults") * extra_adult)

    def offer(p: Package) -> Column:
        cost = F.lit(p.cents) + F.greatest(F.col("adults") - p.adults, F.lit(0)) * extra_adult
        holds = F.col("paying").between(1, p.children) & (F.col("unmatched") == 0) & (cost < F.col("total"))
        return F.when(holds, F.struct(cost.cast("long").alias("cents"), F.lit(p.label).alias("label")))

    best = F.array_min(F.array_compact(F.array(*map(offer, packages)))) if packages else F.lit(None).cast("struct<cents:long,label:string>")
    f = f.withColumn("best", best).withColumn("best_total", F.coalesce("best.cents", F.col("total")).cast("long"))
    return f.select(family, "children", "unmatched", F.col("ticket_cents").alias("tickets"), "extra_adults", "total", F.col("best.label").alias("best_label"), "best_total", with_tax(F.col("best_total")).alias("best_with_tax"))


def session_price(children: DataFrame, base: int, sibling: int, baby: int | None = None, baby_max: int = 1, min_months: int = 0, max_age: int = 17, family: str = "family", age: str = "age", child: str = "child") -> DataFrame:
    """(family, eligible, refused, total): the eldest pays the base, siblings less, babies among them the baby rate.

    A child is refused if the whole year of its age ends before ``min_months`` or it is over ``max_age``.
    """
    fits = ((F.col(age) + 1) * 12 > min_months) & (F.col(age) <= max_age)
    c = children.select(family, age, child, fits.alias("fits"))
    place = F.row_number().over(Window.partitionBy(family, "fits").orderBy(F.desc(age), child))
    small = (F.col(age) <= baby_max) if baby is not None else F.lit(False)
    pay = F.when(~F.col("fits"), 0).when(F.col("place") == 1, base).when(small, F.lit(baby)).otherwise(sibling)
    return c.withColumn("place", place).groupBy(family).agg(F.count_if("fits").alias("eligible"), F.count_if(~F.col("fits")).alias("refused"), F.sum(pay).cast("long").alias("total"))


def addon_quantity(audience: Column, basis: Column, children: Column, playing: Column, watching: Column) -> Column:
    """How many of a required extra a group needs: the basis says who counts, the audience narrows it; an unknown basis counts nobody."""
    people, child_only = children + playing + watching, audience.isin("child", "infant")
    return (
        F.when(basis == "per_child", children)
        .when(basis == "per_participant", F.when(child_only, children).when(audience == "adult", playing).when(audience == "non_participant", 0).otherwise(children + playing))
        .when(basis == "per_person", F.when(child_only, children).when(audience == "adult", playing + watching).when(audience == "non_participant", watching).otherwise(people))
        .when(basis == "per_booking", F.when(people > 0, 1).otherwise(0)).otherwise(0)
    )


def camp_cost(price: Column, units: Column, children: Column, plus_tax: Column) -> Column:
    """Cents for all units and children, with tax where it is added."""
    plain = price * units * children
    return F.when(plus_tax.eqNullSafe(True), with_tax(plain)).otherwise(plain)
