"""Substring search by an index of short grams: rare grams first, then the texts themselves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from sorrel.sources.work import written

#: Code points of an index gram; shorter words are looked up as they are.
GRAM = 3
#: How many of a query's rarest grams are intersected before texts are read.
RAREST = 3
#: Queries that are sent to the tasks, at most (some hundred bytes each); more are joined to an index of the texts.
SENT = 100_000


def grams(text: str, lengths: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """The distinct runs of so many code points of a text as numbers of 63 bits, ascending."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1  # 0: no code point
    found = []
    for n in lengths:
        if len(c) >= n:
            key = c[: len(c) - n + 1] << 42
            for k in range(1, n):
                key = key | c[k : len(c) - n + 1 + k] << (42 - 21 * k)
            found.append(key)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _over_texts(texts: DataFrame, id_: str, text: str, use: Callable, schema: str) -> DataFrame:
    """``use`` of an iterator of (id, lower-cased text)."""
    src = texts.select(F.col(id_).alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = []

        def rows() -> Iterator:
            for batch in batches:
                kinds[:] = [batch.schema.field(0).type]
                yield from zip(batch.column(0).to_pylist(), map(lambda t: t.as_py(), batch.column(1)))

        for grams_, other in use(rows()):
            yield pa.RecordBatch.from_arrays([pa.array(grams_, pa.int64()), pa.array(other, pa.int64() if schema == "n" else kinds[0])], ["gram", schema])

    return src.mapInArrow(run, f"gram long, {schema} {'long' if schema == 'n' else src.schema['id'].dataType.simpleString()}")


def gram_index(texts: DataFrame, id_: str, text: str, lengths: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(gram, id): the distinct grams of each lower-cased text. A null text has none."""

    def use(rows: Iterator) -> Iterator:
        ids, found, size = [], [], 0
        for i, t in rows:
            g = grams(t, lengths)
            found.append(g)
            ids += [i] * len(g)
            size += len(g)
            if size > 100_000:
                yield np.concatenate(found), ids
                ids, found, size = [], [], 0
        if size:
            yield np.concatenate(found), ids

    return _over_texts(texts, id_, text, use, "id")


def gram_counts(texts: DataFrame, id_: str, text: str, lengths: tuple[int, ...]) -> DataFrame:
    """(gram, df): how many texts have each gram. A task adds up its own texts first."""

    def use(rows: Iterator) -> Iterator:
        keys, counts, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, n = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(k, kind="stable")
            k, n = k[order], n[order]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
            return k[first], np.add.reduceat(n, first) if len(first) else n

        for _, t in rows:
            g = grams(t, lengths)
            keys.append(g)
            counts.append(np.ones(len(g), np.int64))
            size += len(g)
            if size > 2_000_000:
                k, n = merged()
                keys, counts, size = [k], [n], 0
                if len(k) > 1_000_000:
                    yield k, n
                    keys, counts = [k[:0]], [n[:0]]
        k, n = merged()
        for at in range(0, len(k), 100_000):
            yield k[at : at + 100_000], n[at : at + 100_000]

    return _over_texts(texts, id_, text, use, "n").groupBy("gram").agg(F.sum("n").alias("df"))


def query_words(query: Column) -> Column:
    """The distinct words of a query, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), r"\s+"), lambda w: w != ""))


def query_grams(asked: DataFrame) -> DataFrame:
    """(q, gram) of (q, words): the grams of GRAM code points of a query's words; of a query that has none, its words themselves."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            qs, found = [], []
            for q, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = [g for w in words if len(w) >= GRAM for g in grams(w, (GRAM,)).tolist()] or [g for w in words for g in grams(w, (len(w),)).tolist()]
                qs += [q] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(qs, batch.schema.field(0).type), pa.array(found, pa.int64())], ["q", "gram"])

    return asked.mapInArrow(run, f"q {asked.schema['q'].dataType.simpleString()}, gram long").distinct()


def _walk(texts: DataFrame, id_: str, text: str, asked: list, lengths: tuple[int, ...], query_id: str, kinds: tuple[DataType, DataType]) -> DataFrame:
    """(query_id, id): each text against the queries (q, words, their rarest grams in order) that a task holds.

    What a text has of the queries' grams is one array of flags. The queries whose rarest gram it has are
    looked at for the next, and of those that have all the words are looked for in the text itself.
    """
    known = np.unique(np.array([g for _, _, gs in asked for g in gs] or [0], np.int64))
    # The last place is a gram that every text has, for queries with fewer grams.
    places = np.array([[*np.searchsorted(known, gs).tolist(), *[len(known)] * (RAREST - len(gs))] for _, _, gs in asked] or np.zeros((0, RAREST)), np.int64).T
    names, words = [q for q, _, _ in asked], [w for _, w, _ in asked]
    src = texts.select(F.col(id_).alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    q_type = to_arrow_type(kinds[0])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        has = np.zeros(len(known) + 1, bool)
        has[-1] = True
        for batch in batches:
            qs, ids = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                g = grams(t, lengths)
                at = np.searchsorted(known, g).clip(max=len(known) - 1)
                at = at[known[at] == g]
                has[at] = True
                left = np.flatnonzero(has[places[0]])
                for more in places[1:]:
                    left = left[has[more[left]]]
                has[at] = False
                found = [names[k] for k in left.tolist() if all(w in t for w in words[k])]
                qs += found
                ids += [i] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(qs, q_type), pa.array(ids, batch.schema.field(0).type)], [query_id, id_])

    return src.mapInArrow(run, f"`{query_id}` {kinds[0].simpleString()}, `{id_}` {kinds[1].simpleString()}")


def substring_search(texts: DataFrame, id_: str, text: str, queries: DataFrame, query_id: str, query: str, index: DataFrame | None = None) -> DataFrame:
    """(query_id, id): the texts that contain every word of the query somewhere, without regard to case.

    Of a query's grams the RAREST rarest are intersected, rarest first; a gram that no text has ends the
    query. Only texts that have all of them are searched for the words, so results are exact. How rare a gram
    is, is counted over all texts, in the tasks first. Up to SENT queries are sent to the tasks, and each text
    is walked once, where it lies. More queries, or those against a kept ``index`` (the texts' ``gram_index``),
    are joined to the places of their grams. A query of words of one or two code points only is looked up by
    these. A query without words finds nothing; ids must be unique on both sides.
    """
    asked = queries.select(F.col(query_id).alias("q"), query_words(F.col(query)).alias("words")).where(F.size("words") > 0)
    long = F.exists("words", lambda w: F.char_length(w) >= GRAM)
    lengths = (GRAM,) if asked.where(~long).isEmpty() else tuple(range(1, GRAM + 1))
    counts = gram_counts(texts, id_, text, lengths) if index is None else index.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = query_grams(asked).join(counts, "gram", "left").groupBy("q").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("g"))
    chosen = ranked.where(F.col("g")[0]["df"] > 0).select("q", F.slice("g", 1, RAREST)["gram"].alias("g")).join(asked, "q").select("q", "words", "g")
    chosen = written(chosen, "chosen")
    if index is None:
        few = chosen.limit(SENT + 1).collect()
        if len(few) <= SENT:
            kinds = chosen.schema["q"].dataType, texts.schema[id_].dataType
            return _walk(texts, id_, text, [tuple(r) for r in few], lengths, query_id, kinds)
        index = gram_index(texts, id_, text, lengths)
    met = chosen.select("q", F.size("g").alias("need"), F.explode("g").alias("gram")).join(index, "gram").groupBy("q", "id").agg(F.count("*").alias("have"), F.first("need").alias("need")).where("have = need")
    low = texts.select(F.col(id_).alias("id"), F.lower(F.col(text)).alias("low"))
    return met.join(low, "id").join(chosen.select("q", "words"), "q").where(F.forall("words", lambda w: F.col("low").contains(w))).select(F.col("q").alias(query_id), F.col("id").alias(id_))
