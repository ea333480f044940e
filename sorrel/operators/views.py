"""Views of places and plans: weekly hours, fixed checklists, sources, headings carried down, saved items and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weekly_hours(rows: DataFrame, key: str, weekday: str = "weekday", slot: str = "slot") -> DataFrame:
    """(key, first_day, last_day, slots): runs of consecutive weekdays with equal slots (gaps and islands).

    A day's slots are joined in order. A week has seven days, so every group is small.
    """
    days = rows.where(F.col(slot).isNotNull()).groupBy(key, weekday).agg(F.array_join(F.array_sort(F.collect_set(slot)), ", ").alias("slots"))
    w = Window.partitionBy(key).orderBy(weekday)
    starts = ~((F.lag(weekday).over(w) == F.col(weekday) - 1) & (F.lag("slots").over(w) == F.col("slots")))
    runs = days.withColumn("island", F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(w))
    return runs.groupBy(key, "island").agg(F.min(weekday).alias("first_day"), F.max(weekday).alias("last_day"), F.min("slots").alias("slots")).drop("island")


def carry_down(rows: DataFrame, by: list[str], order: list[Column], heading: Column, name: str = "heading") -> DataFrame:
    """Each row with the last heading at or above it in its document; null before the first."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(heading, ignorenulls=True).over(w))


def checklist(owners: DataFrame, facts: DataFrame, key: str, item: str, value: str, items: list[str]) -> DataFrame:
    """(key, item, value, listed): every listed item for every owner, ``unknown`` without a fact, then the facts on other items.

    The list is short and made on each row, so no cross join is needed; of several facts on an item the least stands.
    """
    one = facts.groupBy(F.col(key).alias("fact_key"), F.col(item).alias("fact_item")).agg(F.min(value).alias("fact_value"))
    dense = owners.select(key, F.explode(F.array(*map(F.lit, items))).alias(item))
    known = dense.join(one, (F.col(key) == F.col("fact_key")) & (F.col(item) == F.col("fact_item")), "left").select(key, item, F.coalesce("fact_value", F.lit("unknown")).alias(value), F.lit(True).alias("listed"))
    extra = one.where(~F.col("fact_item").isin(*items)).join(owners.select(key), F.col("fact_key") == F.col(key), "left_semi")
    return known.unionByName(extra.select(F.col("fact_key").alias(key), F.col("fact_item").alias(item), F.col("fact_value").alias(value), F.lit(False).alias("listed")))


def public_fact(url: Column, checked: Column, status: Column, note: Column) -> Column:
    """An https source, a valid date, and either verified or conflicting with a note."""
    stated = (status == "verified") | ((status == "conflicting") & (F.trim(note) != ""))
    return F.coalesce(url.startswith("https://") & F.try_to_date(checked, "yyyy-MM-dd").isNotNull() & stated, F.lit(False))


def sources(facts: DataFrame, url: str, label: str, checked: str, owner: str) -> DataFrame:
    """(owner, url, labels, latest): what each source of an owner backs."""
    return facts.groupBy(owner, url).agg(F.array_join(F.array_sort(F.collect_set(label)), "|").alias("labels"), F.max(checked).alias("latest"))


def experience(themes: DataFrame, usable: DataFrame, owner: str, theme: str, source: str, sentiment: str) -> DataFrame:
    """(owner, theme, sources, verdict): shown with two sources or more that agree, mixed if they don't, else thin; unusable sources don't count."""
    own = themes.join(usable.select(source).distinct(), source, "left_semi")
    g = own.groupBy(owner, theme).agg(F.count_distinct(source).alias("sources"), F.min(sentiment).alias("least"), F.max(sentiment).alias("most"))
    return g.select(owner, theme, "sources", F.when(F.col("least") != F.col("most"), "mixed").when(F.col("sources") >= 2, F.col("most")).otherwise("thin").alias("verdict"))


def breaks_with_programs(calendar: DataFrame, sessions: DataFrame, day: str, fits: Column) -> tuple[DataFrame, DataFrame]:
    """(sessions on a break's day that fit, counts (fit, sessions) of all on those days): an equi-join on the day."""
    on = sessions.join(calendar, day)
    verdict = F.when(fits.isNull(), "unknown").when(fits, "fits").otherwise("refused")
    return on.where(F.coalesce(fits, F.lit(False))), on.groupBy(verdict.alias("fit")).agg(F.count("*").alias("sessions"))


def saved_state(actions: DataFrame, owner: str, item: str, at: str, kind: str, most_past: int = 40) -> DataFrame:
    """(owner, item, state, at): the last action on each item decides, save or remove; of removed ones the newest ``most_past`` stay (the cap is the feature)."""
    last = actions.groupBy(owner, item).agg(F.max(F.struct(at, kind)).alias("v")).select(owner, item, F.col(f"v.{at}").alias(at), F.when(F.col(f"v.{kind}") == "save", "active").otherwise("past").alias("state"))
    place = F.row_number().over(Window.partitionBy(owner, "state").orderBy(F.desc(at), item))
    return last.withColumn("place", place).where((F.col("state") == "active") | (F.col("place") <= most_past)).drop("place")


def compare_columns(asked: DataFrame, catalog: DataFrame, owner: str, ids: str, key: str, columns: list[str]) -> DataFrame:
    """(owner, position, key, found, columns) in the order asked, each id once; misses have found = false."""
    each = asked.select(owner, F.posexplode(F.array_distinct(F.filter(F.transform(F.split(ids, ","), lambda x: F.trim(x)), lambda x: x != ""))).alias("position", "asked_id"))
    have = catalog.select(F.col(key).cast("string").alias("have_id"), *columns)
    return each.join(have, F.col("asked_id") == F.col("have_id"), "left").select(owner, "position", F.col("asked_id").alias(key), F.col("have_id").isNotNull().alias("found"), *columns)


def shred(records: DataFrame, key: str, lists: dict[str, str]) -> dict[str, DataFrame]:
    """A table of rows for each list of structs in a nested record: (key, position, the struct's fields)."""
    return {name: records.select(key, F.posexplode(column).alias("position", "item")).select(key, "position", "item.*") for name, column in lists.items()}


def location_rank(name: Column, region: Column, query: str, code: Column | None = None) -> Column:
    """0 the name begins with the query, 1 each word of it begins a word of the name, 2 the region does so or the query is its code (5, r5 or region 5), 3 the name holds it (three characters or more); null for no hit."""
    q, words = query.lower().strip(), query.lower().split()
    low, area = F.lower(name), F.lower(region)

    def begins(text: Column) -> Column:
        return F.forall(F.array(*map(F.lit, words)), lambda w: F.exists(F.split(text, r"[^\p{L}\p{N}]+"), lambda x: x.startswith(w))) if words else F.lit(False)

    coded = F.lit(q).isin(code, F.concat(F.lit("r"), code), F.concat(F.lit("region "), code)) if code is not None else F.lit(False)
    return F.when(low.startswith(q), 0).when(begins(low), 1).when(area.startswith(q) | begins(area) | F.coalesce(coded, F.lit(False)), 2).when(F.lit(len(q) >= 3) & low.contains(q), 3)
