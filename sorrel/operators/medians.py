"""Exact medians of all groups at once, by histograms that close in on the middle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.sources.work import written

#: Parts of a range that a round counts, and values that are few enough to be sorted as one array.
PARTS, FEW = 256, 4096


def exact_medians(df: DataFrame, group: str, value: str, parts: int = PARTS, few: int = FEW, max_rounds: int = 64) -> DataFrame:
    """(group, n, median) of the non-null, non-NaN values of each group, exact: the middle value, or half the sum of both.

    Each group looks for one or two ranks. A round counts, in partial sums, how many values fall into each
    of ``parts`` equal parts of the range that still holds a rank, and goes on with the part that holds it,
    narrowed to its smallest and largest value. A rank is settled when one value is left, or when so few
    are left that they fit an array. So a group of any size is never held together; each round reads
    the values within the ranges that are left only. A null group is a group.
    """
    src = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    whole = src.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    state = written(whole.select("g", "n", "lo", "hi", F.col("n").alias("left"), F.explode(ranks).alias("k")).withColumn("rank", F.col("k")), "medians")
    sizes, settled = state.select("g", "n").distinct(), None
    for _ in range(max_rounds):
        done = state.where((F.col("lo") == F.col("hi")) | (F.col("left") <= few))
        settled = done if settled is None else settled.unionByName(done)
        state = state.where((F.col("lo") < F.col("hi")) & (F.col("left") > few))
        if state.isEmpty():
            break
        # Halves, as the width of a range may be beyond the largest double; between the smallest doubles it is zero.
        width = F.col("hi") / 2 - F.col("lo") / 2
        inner = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / width * parts), F.lit(parts - 1))
        part = F.when(width > 0, inner).otherwise(F.when(F.col("v") > F.col("lo"), parts - 1).otherwise(0))
        s = state.select(F.col("g").alias("sg"), "k", "rank", "lo", "hi")
        inside = src.join(s, F.col("g").eqNullSafe(F.col("sg")) & F.col("v").between(F.col("lo"), F.col("hi")))
        counts = inside.groupBy("sg", "k", "rank", part.alias("part")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        # At most ``parts`` rows for each rank.
        per = counts.groupBy("sg", "k", "rank").agg(F.array_sort(F.collect_list(F.struct("part", "c", "a", "b"))).alias("bins"))
        hit = F.expr("""aggregate(bins, named_struct('r', rank, 'hit', CAST(NULL AS struct<part:bigint,c:bigint,a:double,b:double>)),
          (s, x) -> if(s.hit IS NOT NULL, s, if(s.r < x.c, named_struct('r', s.r, 'hit', x), named_struct('r', s.r - x.c, 'hit', s.hit))))""")
        nxt = per.withColumn("h", hit).select(F.col("sg").alias("g"), "k", F.col("h.hit.a").alias("lo"), F.col("h.hit.b").alias("hi"), F.col("h.hit.c").alias("left"), F.col("h.r").alias("rank"))
        state = written(nxt.join(sizes.select(F.col("g").alias("zg"), "n"), F.col("g").eqNullSafe(F.col("zg"))).select("g", "n", "lo", "hi", "left", "k", "rank"), "medians")
    else:
        raise RuntimeError(f"medians did not settle in {max_rounds} rounds")
    one = settled.where("lo = hi").select("g", "n", "k", F.col("lo").alias("x"))
    s = settled.where("lo < hi").select(F.col("g").alias("sg"), "n", "k", "rank", "lo", "hi")
    rest = src.join(s, F.col("g").eqNullSafe(F.col("sg")) & F.col("v").between(F.col("lo"), F.col("hi"))).groupBy("sg", "n", "k", "rank").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    rest = rest.select(F.col("sg").alias("g"), "n", "k", F.get("vs", F.col("rank").cast("int")).alias("x"))
    return one.unionByName(rest).groupBy("g", "n").agg(F.when(F.count("*") == 1, F.min("x")).otherwise((F.min("x") + F.max("x")) / 2).alias("median")).select(F.col("g").alias(group), "n", "median")
