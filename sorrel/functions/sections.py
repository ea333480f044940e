"""Schedules and other pages of lines: headings and values that hold until the next, folded over the lines in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines that are folded at once; rows of a block are joined after it, as appending to one long array would copy it each time.
BLOCK = 256

Rule = Callable[[Column], Column]

_ROW = "struct<line:int,heading:string,value:string,item:string>"


def fold_lines(lines: Column, heading: Rule, value: Rule, item: Rule) -> Column:
    """array<struct<line int, heading, value, item string>>: each item of an array of lines with the heading and the value open at its line.

    Each rule gives what a line states, or null. A heading closes the value before it; a line that states a
    heading and a value opens both; an item on the line that opens them has them. The fold keeps the open
    heading and value and the rows so far, block by block, in the JVM; a null array has no rows.
    """
    none = F.expr(f"CAST(array() AS array<{_ROW}>)")
    null = F.lit(None).cast("string")
    stated = F.transform(lines, lambda x, i: F.struct(i.alias("line"), heading(x).alias("heading"), value(x).alias("value"), item(x).alias("item")))
    some = F.filter(stated, lambda s: s["heading"].isNotNull() | s["value"].isNotNull() | s["item"].isNotNull())

    def step(state: Column, s: Column) -> Column:
        opened = s["heading"].isNotNull()
        head, val = F.coalesce(s["heading"], state["heading"]), F.coalesce(s["value"], F.when(~opened, state["value"]))
        row = F.struct(s["line"].alias("line"), head.alias("heading"), val.alias("value"), s["item"].alias("item"))
        return F.struct(head.alias("heading"), val.alias("value"), F.when(s["item"].isNotNull(), F.concat(state["rows"], F.array(row))).otherwise(state["rows"]).alias("rows"))

    def block(all_: Column, b: Column, head: Column, val: Column) -> Column:
        return F.aggregate(F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)), F.struct(head.alias("heading"), val.alias("value"), none.alias("rows")), step)

    def run(all_: Column) -> Column:
        start = F.struct(null.alias("heading"), null.alias("value"), F.expr(f"CAST(array() AS array<array<{_ROW}>>)").alias("blocks"))

        def over(state: Column, b: Column) -> Column:
            return F.element_at(F.transform(F.array(block(all_, b, state["heading"], state["value"])), lambda r: F.struct(r["heading"].alias("heading"), r["value"].alias("value"), F.concat(state["blocks"], F.array(r["rows"])).alias("blocks"))), 1)

        return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(all_) / BLOCK).cast("int")), start, over, lambda s: F.flatten(s["blocks"]))

    return F.when(lines.isNotNull(), F.element_at(F.transform(F.array(some), run), 1)).otherwise(none)


def matched(pattern: str, group: int = 0) -> Rule:
    """A rule: what the pattern finds in a line, with single spaces; null without a match."""
    return lambda line: F.when(line.rlike(pattern), F.trim(F.regexp_replace(F.regexp_extract(line, pattern, group), r"\s+", " ")))


#: How a numbered week begins a line of a schedule, and how a price stands in one.
WEEK, PRICE = r"(?i)^\s*week\s+\d+\b", r"\$\s*(\d{1,5}(?:\.\d{1,2})?)"


def schedule_rows(lines: Column, offered: str) -> Column:
    """The rows of a page of weeks: a line that matches ``offered`` is offered in the open week at the open price.

    A week's line opens the week; a price holds for the lines behind it until the next price or week.
    """
    return fold_lines(lines, lambda x: F.when(x.rlike(WEEK), F.trim(F.regexp_replace(x, r"\s+", " "))), matched(PRICE, 1), matched(offered))
