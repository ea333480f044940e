"""Spelling variants: words one code point apart, found through wildcard groups and deletions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.llm.workspace import Workspace

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One in so many runs, by checksum, loses a code point: the misspellings that the operator is to find.
PERTURBED = 97
#: Longer words name their affixes by digests, so that a word costs a row of fixed size a position.
LONG = 64
#: Distinct words that a task holds before it passes them on, and code points of a text that are read at once.
HELD, PIECE = 400_000, 1 << 22


def runs(text: str) -> Counter[str]:
    """How often each maximal run of letters occurs; a very long text is walked without a list of its runs."""
    return Counter(RUN.findall(text) if len(text) <= PIECE else (m[0] for m in RUN.finditer(text)))


def perturb(doc_id: str, word: bytes) -> bytes:
    """``word``, without code point h % length if ``PERTURBED`` divides h, the checksum of ``doc_id:word``."""
    h = zlib.crc32(word, zlib.crc32(f"{doc_id}:".encode()))
    if h % PERTURBED:
        return word
    s = word.decode()
    i = h % len(s)
    return (s[:i] + s[i + 1 :]).encode()


def count_words(docs: DataFrame, min_length: int = 5) -> DataFrame:
    """(word, n): the words of at least ``min_length`` code points of all whole texts.

    Runs are lower-cased in A-Z only and then perturbed by their document. A null text has no words
    and a null doc_id counts as an empty one. A task adds up its own words before the shuffle, so a
    word that fills a third of the corpus is one row a task.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def told(totals: dict[bytes, int]):
            return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.binary()).cast(pa.string()), pa.array(list(totals.values()), pa.int64())], ["word", "n"])

        totals: dict[bytes, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                base, crc, get = zlib.crc32(f"{doc_id.as_py()}:".encode()), zlib.crc32, totals.get
                for w, n in runs(text.as_py()).items():
                    b = w.encode().lower()
                    if crc(b, base) % PERTURBED == 0:
                        b = perturb(doc_id.as_py(), b)
                    if len(b) >= min_length:
                        totals[b] = get(b, 0) + n
                if len(totals) >= HELD:
                    yield told(totals)
                    totals.clear()
        yield told(totals)

    src = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = src.mapInArrow(run, "word string, n long").where(F.char_length("word") >= min_length)
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def long_keys(word: str) -> Iterator[tuple[str, str]]:
    """(kind, key) of a long word: its wildcards, its deletions (one for each run of equal letters) and its gaps.

    A key is the place and the digests of what stands before and behind; digests of all prefixes come
    from one running hash, so the cost is linear in the word.
    """

    def running(s: str) -> list[str]:
        h, out = hashlib.blake2b(digest_size=16), [hashlib.blake2b(digest_size=16).hexdigest()]
        for c in s:
            h.update(c.encode())
            out.append(h.copy().hexdigest())
        return out

    before, behind, n = running(word), running(word[::-1])[::-1], len(word)
    for i in range(n + 1):
        yield "gap", f"#{i}:{before[i]}:{behind[i]}"
        if i < n and n > LONG:
            key = f"#{i}:{before[i]}:{behind[i + 1]}"
            yield "wild", key
            if not i or word[i] != word[i - 1]:
                yield "deleted", key


def _long(frames: Iterator) -> Iterator:
    import pandas as pd

    for f in frames:
        for i, word, n in zip(f["id"], f["word"], f["n"]):
            kinds, keys = zip(*long_keys(word))
            yield pd.DataFrame({"id": i, "n": n, "kind": kinds, "key": keys})


def keys_of(vocabulary: DataFrame, kind: str) -> DataFrame:
    """(key, id, neg): the keys of one kind of all words; ``neg`` is -n, so that the smallest (neg, id) is the best word.

    wild: one group for each (position, prefix, suffix), written prefix*suffix. deleted: the word less
    one code point. gap: what a deletion can meet, a short word itself.
    """
    i, word = F.col("i"), F.col("word")
    short = vocabulary.where(F.char_length("word") <= LONG)
    if kind == "gap":
        short = short.withColumn("key", word)
    else:
        short = short.withColumn("i", F.explode(F.sequence(F.lit(1), F.char_length("word"))))
        if kind == "deleted":
            short = short.where((i == 1) | (F.substring(word, i, F.lit(1)) != F.substring(word, i - 1, F.lit(1))))
        short = short.withColumn("key", F.concat(F.substring(word, F.lit(1), i - 1), F.lit("*" if kind == "wild" else ""), F.substring(word, i + 1, F.lit(LONG))))
    long = vocabulary.where(F.char_length("word") >= LONG).mapInPandas(_long, "id long, n long, kind string, key string").where(F.col("kind") == kind)
    return short.select("key", "id", "n").unionByName(long.select("key", "id", "n")).select("key", "id", (-F.col("n")).alias("neg"))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words are near each word that has any, and the best of them as (neg, id).

    A wildcard group has at most as many words as there are letters (90). Each word of a group counts
    the others and takes the group's best, the best word itself the second: no pair is made. A deletion
    that is a word links two words, at most one row for each letter.
    """
    wild = keys_of(vocabulary, "wild").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("neg", "id"))).alias("members")).where(F.size("members") > 1)
    groups = wild.select(F.size("members").alias("size"), F.slice("members", 1, 2).alias("top"), F.explode("members").alias("own"))
    replaced = groups.select(F.col("own.id").alias("id"), (F.col("size") - 1).cast("long").alias("n"), F.when(F.col("own.id") == F.col("top")[0]["id"], F.col("top")[1]).otherwise(F.col("top")[0]).alias("other"))

    def end(side: str) -> Column:
        return F.struct(F.col(f"{side}.neg").alias("neg"), F.col(f"{side}.id").alias("id"))

    met = keys_of(vocabulary, "deleted").alias("a").join(keys_of(vocabulary, "gap").alias("b"), F.col("a.key") == F.col("b.key"))
    sides = met.select(F.explode(F.array(*[F.struct(F.col(f"{x}.id").alias("id"), F.lit(1).cast("long").alias("n"), end(y).alias("other")) for x, y in ("ab", "ba")])).alias("e")).select("e.*")
    return replaced.unionByName(sides).groupBy("id").agg(F.sum("n").alias("n_near"), F.min("other").alias("best"))


def roots(forms: DataFrame, ws: Workspace, max_rounds: int = 40) -> DataFrame:
    """(id, root) for every word that has a form, by doubling the pointers (id, form).

    A form is at least twice as frequent as its word, so a chain has at most log2(n) links and the
    rounds are their logarithm.
    """
    at = ws.table(forms.select("id", F.col("form").alias("root")), "roots-0")
    for k in range(1, max_rounds + 1):
        step = at.alias("a").join(at.select(F.col("id").alias("via"), F.col("root").alias("next")).alias("b"), F.col("a.root") == F.col("b.via"), "left")
        nxt = ws.table(step.select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{k}")
        ws.drop(f"roots-{k - 1}")
        at = nxt.select("id", "root")
        if nxt.where("moved").isEmpty():
            return at
    raise RuntimeError(f"chains of forms did not settle in {max_rounds} rounds")


def spelling_variants(spark: SparkSession, docs: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the vocabulary of ``docs`` (doc_id, text).

    Words have ``min_length`` code points and ``min_count`` occurrences or more. Near words differ by one
    inserted, deleted or replaced code point. A word's form is its most frequent near word (ties: the
    smallest in code-point order), if that is at least ``ratio`` times as frequent; root follows the
    forms. Ids given in code-point order stand for the words meanwhile, so ties are exact and rows short.

    Null and empty texts have no words; a null doc_id counts as an empty one; repeated rows count each
    time; texts and words of any length are taken whole; an empty table gives no rows. Further columns
    aren't read.
    """
    ws = Workspace(spark, "spelling")
    counted = count_words(docs, min_length).where(F.col("n") >= min_count)
    vocabulary = ws.table(counted.orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")
    near = ws.table(near_words(vocabulary).select("id", "n_near", F.col("best.id").alias("best"), (-F.col("best.neg")).alias("best_n")), "near")
    own = vocabulary.select("id", "n").join(near, "id").withColumn("has_form", F.col("best_n") >= ratio * F.col("n"))
    own = ws.table(own.select("id", "n_near", F.when(F.col("has_form"), F.col("best")).alias("form"), F.when(F.col("has_form"), F.col("best_n")).alias("form_n")), "forms")
    ends = roots(own.where("form IS NOT NULL"), ws)

    def names(key: str) -> DataFrame:
        return vocabulary.select(F.col("id").alias(key), F.col("word").alias(f"{key}_word"))

    named = own.join(ends, "id", "left").join(names("form"), "form", "left").join(names("root"), "root", "left").select("id", "n_near", "form_n", "form_word", "root_word")
    return vocabulary.join(named, "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n",
    )
