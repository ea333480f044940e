"""Lookups of values in ranges, and ranges put together."""

from __future__ import annotations

import heapq
import json
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegralType, LongType, StructType

from sorrel.sources.work import written

#: Bands of a list that becomes constants of the plan, at most; longer lists are joined.
MOST_BANDS = 10_000
#: Bands that a task cuts into blocks.
BANDS_A_TASK = 50_000


class Bands(NamedTuple):
    """The columns of a price list: inclusive bounds (null: open), what a band costs, and its key."""

    low: str = "low"
    high: str = "high"
    cost: str = "cost"
    key: str = "band"
    also: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [self.low, self.high, self.key, self.cost, *self.also]


def sweep(rows: list[Row], names: Bands) -> tuple[list[Any], list[int | None]]:
    """(bounds, best): the sorted bounds, and for each elementary interval the place of its best band.

    n bounds cut the line into 2n + 1 intervals: what is below the first, then for each bound the bound
    itself and the gap behind it. One pass over the bounds keeps the bands that are open in a heap, narrowest
    first, ties to the cheaper and the smaller key; a band whose end is behind leaves when it comes up.
    """
    bounds = sorted({r[c] for r in rows for c in (names.low, names.high) if r[c] is not None})
    starts: dict[Any, list[int]] = {}
    for i, r in enumerate(rows):
        if r[names.low] is None or r[names.high] is None or r[names.low] <= r[names.high]:
            starts.setdefault(r[names.low], []).append(i)
    heap: list[tuple] = []

    def enter(at: Any) -> None:
        for i in starts.get(at, ()):
            r = rows[i]
            open_ended = r[names.low] is None or r[names.high] is None
            heapq.heappush(heap, ((open_ended, 0 if open_ended else r[names.high] - r[names.low], r[names.cost], r[names.key]), i))

    def best(ended: Any) -> int | None:
        while heap and rows[heap[0][1]][names.high] is not None and ended is not None and rows[heap[0][1]][names.high] <= ended:
            heapq.heappop(heap)
        return heap[0][1] if heap else None

    enter(None)
    out = [best(None)]
    for i, b in enumerate(bounds):
        enter(b)
        out += [best(bounds[i - 1] if i else None), best(b)]
    return bounds, out


def _found(value: Column, kind: DataType, bands: DataFrame, rows: list[Row], names: Bands) -> Column:
    """The struct of the value's best band, by binary search in constant arrays."""
    bounds, best = sweep(rows, names)
    listed = F.from_json(F.lit(json.dumps([r.asDict() for r in rows], default=str)), ArrayType(bands.select(*names.columns).schema))
    if not bounds:
        place = F.lit(best[0])
    else:
        wall = F.from_json(F.lit(json.dumps(bounds, default=str)), ArrayType(kind))
        steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
        last = F.aggregate(steps, F.lit(-1), lambda at, s: F.when(F.get(wall, at + s) <= value, at + s).otherwise(at))
        slots = F.from_json(F.lit(json.dumps(best)), ArrayType(LongType()))
        place = F.element_at(F.transform(F.array(last), lambda at: F.get(slots, F.when(at < 0, 0).when(F.get(wall, at) == value, 2 * at + 1).otherwise(2 * at + 2))), 1)
    return F.when(value.isNotNull(), F.get(listed, place.cast("int")))


def dyadic_band_join(values: DataFrame, value: str, bands: DataFrame, names: Bands) -> DataFrame:
    """``band_join`` for lists of any length, of integer bounds and values.

    A band is cut into the aligned blocks of 2**k integers that make it up, at most two of a size; of all
    bands that hold a block only the best is kept. A value lies in one block of each size, so it meets at
    most one row for each size that occurs: no bin fills up, however many bands share it. Distinct values
    are looked up, and the rows then joined to what was found. Of bands with equal bounds the best is kept
    first; the rest are cut in tasks of at most about BANDS_A_TASK, as a band may have over a hundred blocks.
    """
    kind = values.schema[value].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"a list of over {MOST_BANDS} bands needs integer values, not {kind.simpleString()}")
    low, high = (F.coalesce(F.col(c).cast("long"), F.lit(open_)) for c, open_ in ((names.low, -(1 << 61)), (names.high, (1 << 61) - 1)))
    width = F.when(F.col(names.low).isNull() | F.col(names.high).isNull(), F.lit((1 << 63) - 1)).otherwise(high - low)
    rank = F.struct(width.alias("w"), *[F.col(c) for c in (names.cost, names.key, *names.also)])
    best = bands.where(low <= high).groupBy(low.alias("a"), (high + 1).alias("b")).agg(F.min(rank).alias("band_found"))
    best = written(best, "bands")
    n, longest = best.agg(F.count("*"), F.max(F.col("b") - F.col("a"))).first()
    cut = best.repartition(n // BANDS_A_TASK + 1).withColumn("k", F.explode(F.expr("sequence(0, CAST(floor(log2(b - a)) AS int))")))
    l, r = F.expr("-shiftright(-a, k)"), F.expr("shiftright(b, k)")
    inner = l + l.bitwiseAND(F.lit(1))
    blocks = F.array_compact(F.array(F.when((l < r) & (l.bitwiseAND(F.lit(1)) == 1), l), F.when((inner < r) & (r.bitwiseAND(F.lit(1)) == 1), r - 1)))
    held = cut.select("band_found", F.col("k").alias("size"), F.explode(blocks).alias("block")).groupBy("size", "block").agg(F.min("band_found").alias("band_found"))
    asked = values.select(F.col(value).cast("long").alias("asked")).where("asked IS NOT NULL").distinct()
    sizes = F.explode(F.sequence(F.lit(0), F.lit(max(0, (longest or 1).bit_length() - 1))))
    met = asked.select("asked", sizes.alias("size")).withColumn("block", F.expr("shiftright(asked, size)")).join(held, ["size", "block"])
    found = met.groupBy("asked").agg(F.min("band_found").alias("band_found"))
    return values.join(found, F.col(value).cast("long") == F.col("asked"), "left").drop("asked")


def band_join(values: DataFrame, value: str, bands: DataFrame, low: str = "low", high: str = "high", cost: str = "cost", key: str = "band", also: tuple[str, ...] = ()) -> DataFrame:
    """Each row with the narrowest band that holds its value (band, band_cost and the columns ``also``); ties to the cheaper, then the smaller key; none gives nulls.

    A list of up to MOST_BANDS bands becomes sorted constant arrays: a row finds its elementary interval by
    binary search, without a join or a shuffle. A longer list is joined, see ``dyadic_band_join``; bounds
    and values must then be integers. A null bound is open, and an open band is wider than any other; a null
    value finds nothing; bands with low over high hold nothing.
    """
    names = Bands(low, high, cost, key, also)
    rows = bands.select(*names.columns).limit(MOST_BANDS + 1).collect()
    if len(rows) > MOST_BANDS:
        out = dyadic_band_join(values, value, bands, names)
    else:
        out = values.withColumn("band_found", _found(F.col(value), _common(values, value, bands, names), bands, rows, names) if rows else F.lit(None).cast(bands.select(*names.columns).schema))
    return out.select(*values.columns, F.col(f"band_found.{key}").alias("band"), F.col(f"band_found.{cost}").alias("band_cost"), *[f"band_found.{c}" for c in also])


def _common(values: DataFrame, value: str, bands: DataFrame, names: Bands) -> DataType:
    """The type in which the bounds are kept: the bands' own."""
    kinds: StructType = bands.select(F.coalesce(names.low, names.high).alias("x")).schema
    return kinds["x"].dataType


def covered_days(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, start, end, days): the maximal runs of days that a key's ranges cover, each day counted once.

    Ranges that overlap or touch are one run. A range with a null bound, or one that ends before it starts,
    covers nothing. Of the ranges of a key that start on one day only the longest is kept before rows are
    brought together, so a key has no more rows there than there are days.
    """
    s, e = F.col(start).cast("date"), F.col(end).cast("date")
    longest = df.where(s <= e).groupBy(*keys, s.alias("run_start")).agg(F.max(e).alias("run_end"))
    by_start = Window.partitionBy(*keys).orderBy("run_start")
    before = F.max("run_end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col("run_start") > F.date_add(before, 1))).cast("int")
    runs = longest.withColumn("new_run", new).withColumn("run", F.sum("new_run").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*keys, "run").agg(F.min("run_start").alias("start"), F.max("run_end").alias("end"))
    return out.select(*keys, "start", "end", (F.date_diff("end", "start") + 1).cast("long").alias("days"))
