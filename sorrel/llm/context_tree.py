"""Language-model scores by context-tree weighting over bytes, each byte decomposed into eight binary choices."""

from __future__ import annotations

import ctypes
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.llm.quality import remainder
from sorrel.llm.workspace import Workspace

#: Bytes of the longest context. With the byte that follows, a context is a number of 48 bits (a gram).
DEPTH = 5
#: Every seventh document or so is held out of training.
FOLDS, HELD_OUT = 7, 2
#: UTF-8 never has this byte: it ends a text, and stands before its beginning as context.
END = b"\xff"
#: Bytes of texts in a block; distinct words and grams that end one sooner; bytes worked on at once, and grams in pieces that are merged.
BLOCK, BLOCK_WORDS, BLOCK_GRAMS, PIECE, MERGED = 48 << 20, 700_000, 3_000_000, 1 << 20, 1_000_000
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def give_back() -> None:
    """At a task's end: what its arrays have left free in a worker that lives on goes back to the machine."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def pieces(texts: Iterable[bytes], size: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, text): the grams that end at each byte of the texts and at their ends, in pieces of about ``size`` of them.

    A text longer than a piece is walked in parts that overlap by a context.
    """
    size = size or PIECE
    own: list[tuple[int, bytes]] = []
    total = 0
    for i, t in enumerate(texts):
        s = END * DEPTH + t + END
        for at in range(0, len(s) - DEPTH, size):
            part = s[at : at + size + DEPTH]
            own.append((i, part))
            total += len(part)
            if total >= size or len(own) >= 60_000:
                yield _grams(own)
                own, total = [], 0
    if own:
        yield _grams(own)


def _grams(own: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(p for _, p in own), np.uint8)
    n = len(raw) - DEPTH
    g = raw[:n].astype(np.int64)
    for k in range(1, DEPTH + 1):
        g <<= 8
        g |= raw[k : n + k]
    lengths = np.array([len(p) for _, p in own])
    keep = np.ones(n, bool)
    borders = np.cumsum(lengths)[:-1]
    keep[(borders[:, None] - 1 - np.arange(DEPTH)).ravel()] = False
    return g[keep], np.repeat([i for i, _ in own], lengths - DEPTH)


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased in A-Z; a long text's in several lists."""
    at = 0
    while len(text) - at > PIECE:
        cut = SPACE.search(text, at + PIECE)
        if not cut:
            break
        yield text[at : cut.end()].lower().split()
        at = cut.end()
    yield text[at:].lower().split()


class Counts:
    """Counts of grams: sorted pieces, merged when they are many."""

    def __init__(self):
        self.keys, self.counts, self.size, self.merged = [], [], 0, 0

    def add(self, grams: np.ndarray, counted: bool) -> None:
        grams.sort()
        first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
        self.keys.append(grams[first])
        self.counts.append(np.diff(np.r_[first, len(grams)]) * counted)
        self.size += len(first)
        if self.size > self.merged + MERGED:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate([np.zeros(0, np.int64), *self.keys]), np.concatenate([np.zeros(0, np.int64), *self.counts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.keys, self.counts, self.size, self.merged = [keys], [counts], len(keys), len(keys)
        return keys, counts


GATHERED = "kind string, block long, chunk binary, gram long, word binary, n long"
#: Bytes of texts in a chunk: a compressed Arrow stream of (doc_id, held_out, body), which is stored and sent as it is.
CHUNK = 1 << 20


#: While tables are written: a job's shuffle files go when its table is there, not when the driver next collects garbage, and Arrow batches stay small.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def job_settings(spark: SparkSession) -> Iterator[None]:
    """SETTINGS hold within, and what held before holds again behind."""
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def packed(batch) -> Iterator[tuple]:
    """The rows of an Arrow batch in slices of about CHUNK bytes of texts, at least one row each, and each slice as a compressed stream."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.binary_length(batch.column(2)).to_numpy())
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK, "right")))
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(batch.slice(at, end - at))
        yield batch.slice(at, end - at), out.getvalue().to_pybytes()
        at = end


def gather(docs: DataFrame, ws: Workspace) -> DataFrame:
    """One written table of three kinds of rows: the texts of blocks in chunks, and each block's distinct grams and words.

    A block is what one task has read of the texts, up to BLOCK bytes. Its grams and words hold how often
    the block's training texts have them, 0 if only held-out texts do: so the rows are both what a model
    is made of and all that scoring the block will ask for.
    """
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, seq, taken = TaskContext.get().partitionId(), 0, 0
        grams, words = Counts(), Counter()

        def rows(kind: str, **given):
            n = len(next(iter(given.values())))
            cols = {"kind": pa.array([kind] * n), "block": pa.array(np.full(n, (part << 24) + seq)), "chunk": pa.nulls(n, pa.binary()), "gram": pa.nulls(n, pa.int64()), "word": pa.nulls(n, pa.binary()), "n": pa.nulls(n, pa.int64())} | given
            return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

        def lists() -> Iterator:
            keys, counts = grams.merge()
            for at in range(0, len(keys), 100_000):
                yield rows("gram", gram=pa.array(keys[at : at + 100_000]), n=pa.array(counts[at : at + 100_000]))
            names, counts = list(words), list(words.values())
            for at in range(0, len(names), 50_000):
                yield rows("word", word=pa.array(names[at : at + 50_000], pa.binary()), n=pa.array(counts[at : at + 50_000], pa.int64()))

        for batch in batches:
            for part_of, chunk in packed(batch):
                held, bodies = part_of.column(1), part_of.column(2)
                trained = [b.as_py() for b in bodies.filter(pc.invert(held))]
                yield rows("text", chunk=pa.array([chunk], pa.binary()), n=pa.array([len(trained)], pa.int64()))
                for group, counted in ((trained, True), ([b.as_py() for b in bodies.filter(held)], False)):
                    for g, _ in pieces(group):
                        grams.add(g, counted)
                    for own in (w for t in group for w in words_of(t)):
                        words.update(own if counted else dict.fromkeys(own, 0))
                taken += int(pc.sum(pc.binary_length(bodies)).as_py())
            if taken >= BLOCK or len(words) >= BLOCK_WORDS or grams.size >= BLOCK_GRAMS:
                yield from lists()
                seq, taken, grams = seq + 1, 0, Counts()
                words.clear()
        if taken or grams.size:
            yield from lists()
        words.clear()
        grams = Counts()
        give_back()

    src = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))
    return ws.table(src.mapInArrow(run, GATHERED), "gathered")


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: seven steps of the recurrence, then Stirling's series (error under 1e-9)."""
    z = z.cast("double")
    up, steps = z + 7, z
    for k in range(1, 7):
        steps = steps * (z + k)
    return (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + 1 / (12 * up) - 1 / (360 * up * up * up) + 1 / (1260 * up * up * up * up * up) - F.log(steps)


def log_kt(a: Column, b: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of a string of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - math.log(math.pi)


def _within(depth: int) -> Column:
    return F.col("ctx").bitwiseAND(F.lit((1 << 8 * depth) - 1))


def tree(grams: DataFrame, ws: Workspace) -> list[DataFrame]:
    """For each depth 0..DEPTH (ctx, j, p): the probability of a one at bit node j, if ctx is the deepest context of j in training.

    A bit node is one with the byte's known bits behind a leading 1. Upwards, a node's weighted probability
    is half its own KT estimate and half the product of its children's; w is the share of the first. Downwards,
    a path's probability is the sum of the estimates on it, each weighted with w and what the nodes above left,
    the last one with all that is left. Each level is one grouping and one join of written tables.
    """
    x, k = F.col("gram").bitwiseAND(F.lit(255)), F.col("k")
    bits = grams.where("n > 0").select(F.shiftright("gram", 8).alias("ctx"), x.alias("x"), "n", F.explode(F.array(*map(F.lit, range(8)))).alias("k"))
    one = F.expr("shiftright(x, 7 - k) & 1")
    level = bits.withColumn("j", F.expr("shiftleft(1, k) | CAST(shiftright(x, 8 - k) AS int)")).groupBy("ctx", "j").agg(F.sum((1 - one) * F.col("n")).alias("a"), F.sum(one * F.col("n")).alias("b"))
    levels = [ws.table(level.select("*", log_kt(F.col("a"), F.col("b")).alias("lw"), F.lit(1.0).alias("w")), f"level-{DEPTH}")]
    for d in range(DEPTH - 1, -1, -1):
        up = levels[0].groupBy(_within(d).alias("ctx"), "j").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("lw").alias("below"))
        up = up.withColumn("kt", log_kt(F.col("a"), F.col("b"))).withColumn("top", F.greatest("kt", "below"))
        up = up.withColumn("lw", F.col("top") + F.log(0.5 * F.exp(F.col("kt") - F.col("top")) + 0.5 * F.exp(F.col("below") - F.col("top"))))
        levels.insert(0, ws.table(up.select("ctx", "j", "a", "b", "lw", (0.5 * F.exp(F.col("kt") - F.col("lw"))).alias("w")), f"level-{d}"))
    heads: list[DataFrame] = []
    est = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1)
    for d, level in enumerate(levels):
        if d:
            above = heads[-1].select(F.col("ctx").alias("up_ctx"), F.col("j").alias("up_j"), "acc", "rest")
            level = level.join(above, (_within(d - 1) == F.col("up_ctx")) & (F.col("j") == F.col("up_j")))
        else:
            level = level.withColumns({"acc": F.lit(0.0), "rest": F.lit(1.0)})
        w, rest = F.col("w"), F.col("rest")
        heads.append(ws.table(level.select("ctx", "j", (F.col("acc") + rest * est).alias("p"), (F.col("acc") + rest * w * est).alias("acc"), (rest * (1 - w)).alias("rest")), f"head-{d}"))
        ws.drop(f"level-{d}")
    return heads


def code_lengths(grams: DataFrame, heads: list[DataFrame], ws: Workspace) -> DataFrame:
    """(gram, lp): log10 of the probability of the gram's byte behind its context, for every gram, seen in training or not.

    Of the eight bits of a byte the first ones are known at the deepest context, further ones at shorter
    contexts only: from the deepest level on, each level settles the bits that it knows. Grams that are
    settled leave, so the upper levels, whose contexts many grams share, see few.
    """
    left = grams.select("gram", F.shiftright("gram", 8).alias("ctx"), F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("x"), F.lit(0).alias("r"), F.lit(0.0).alias("lp"))
    done = None
    for d in range(DEPTH, -1, -1):
        per = heads[d].groupBy(F.col("ctx").alias("at")).agg(F.collect_list(F.struct("j", F.expr("CAST(floor(log2(j)) AS int)").alias("k"), "p")).alias("nodes"))
        # At most 256 contexts of 255 nodes at depth 1 and one at depth 0: these are sent to all tasks.
        got = left.join(F.broadcast(per) if d <= 1 else per, _within(d) == F.col("at"), "left")
        got = got.withColumn("path", F.expr("filter(coalesce(nodes, array()), e -> e.j = shiftright(x + 256, 8 - e.k))"))
        more = F.expr("aggregate(filter(path, e -> e.k >= r), CAST(0 AS double), (s, e) -> s + log10(if((shiftright(x, 7 - e.k) & 1) = 1, e.p, 1 - e.p)))")
        step = ws.table(got.select("gram", "ctx", "x", F.greatest("r", F.size("path")).alias("r"), (F.col("lp") + more).alias("lp")), f"codes-{d}")
        settled = step.where("r = 8") if d else step.withColumn("lp", F.col("lp") + (8 - F.col("r")) * math.log10(0.5))
        done = settled.select("gram", "lp") if done is None else done.unionByName(settled.select("gram", "lp"))
        left = step.where("r < 8")
    return done


def folded(data: bytes) -> bytes:
    """``data`` compressed if that is worth it, behind a byte that tells."""
    import zstandard

    return b"\1" + zstandard.compress(data) if len(data) >= 512 else b"\0" + data


def unfolded(data: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(data[1:]) if data[0] else data[1:]


def listed(rows: DataFrame, part: int, held: int = 400_000) -> DataFrame:
    """(block, part, chunk): what a task has of each block's list as one chunk, of (block, number, value) or (block, number, word).

    A chunk is its numbers, then its values or its words with spaces between. Where a task has few rows of a
    block, as in a corpus of very many blocks, a chunk costs no more than its rows.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def told(own: list) -> pa.RecordBatch:
            table = pa.Table.from_batches(own)
            blocks = table.column(0).to_numpy()
            order = np.argsort(blocks, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(blocks[order]) != 0])
            numbers, other = table.column(1).to_numpy()[order], table.column(2)
            other = other.to_numpy()[order] if part == 0 else np.array(other.to_pylist(), object)[order]
            chunks = [numbers[i:j].tobytes() + (other[i:j].tobytes() if part == 0 else b" ".join(other[i:j])) for i, j in zip(first, [*first[1:], len(order)])]
            heads = [len(numbers[i:j]).to_bytes(4, "little") for i, j in zip(first, [*first[1:], len(order)])]
            return pa.RecordBatch.from_arrays([pa.array(blocks[order][first]), pa.array([part] * len(first), pa.int32()), pa.array([folded(h + c) for h, c in zip(heads, chunks)], pa.binary())], ["block", "part", "chunk"])

        own, n = [], 0
        for batch in batches:
            own.append(batch)
            n += len(batch)
            if n >= held:
                yield told(own)
                own, n = [], 0
        if n:
            yield told(own)
        own = []
        give_back()

    return rows.mapInArrow(run, "block long, part int, chunk binary")


def _score(tokens: int, per_token: float, end: float) -> Callable:
    """Scores the texts of blocks that come as their lists first, then their texts.

    A token costs ``per_token`` and gains log10(count + 1), the end of a text ``end``.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        block, grams, values, words, table = None, [], [], {}, None
        for batch in batches:
            for now, part, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if now != block:
                    block, grams, values, words, table = now, [], [], {}, None
                if part == 2:
                    if table is None:
                        keys, found = np.concatenate([np.zeros(0, np.int64), *grams]), np.concatenate([np.zeros(0), *values])
                        order = np.argsort(keys)
                        table, grams, values = (keys[order].astype(np.uint64), found[order]), [], []
                    with pa.ipc.open_stream(pa.py_buffer(chunk.as_py())) as stream:
                        for texts in stream:
                            yield scored(texts, table, words)
                    continue
                data = unfolded(chunk.as_py())
                n = int.from_bytes(data[:4], "little")
                numbers = np.frombuffer(data, np.int64, n, 4)
                if part == 0:
                    grams.append(numbers)
                    values.append(np.frombuffer(data, np.float64, n, 4 + 8 * n))
                else:
                    words.update(zip(data[4 + 8 * n :].split(b" "), np.log10(numbers + 1).tolist()))
        grams, values, words, table = [], [], {}, None
        give_back()

    def scored(batch, table: tuple[np.ndarray, np.ndarray], words: dict[bytes, float]):
        import pyarrow as pa

        texts = batch.column(2).to_pylist()
        score = np.zeros(len(texts))
        for g, doc in pieces(texts):
            least = int(doc[0])  # a piece holds fewer than 2**16 texts
            key = g.astype(np.uint64) << np.uint64(16) | (doc - least).astype(np.uint64)
            key.sort()
            g, doc = key >> np.uint64(16), (key & np.uint64(0xFFFF)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            at = np.searchsorted(table[0], g[first])
            if at[-1] >= len(table[0]) or (table[0][at] != g[first]).any():
                raise ValueError("a block lacks a gram of its texts")
            score[least : least + int(doc.max()) + 1] += np.bincount(doc, np.repeat(table[1][at], np.diff(np.r_[first, len(g)])))
        n, known, plain = [], [], []
        for t in texts:
            logs = [np.fromiter(map(words.__getitem__, own), np.float64, len(own)) for own in words_of(t)]
            n.append(1 + sum(map(len, logs)))
            known.append(sum(int(np.count_nonzero(x)) for x in logs) + (end > 0))
            plain.append(math.fsum(float(x.sum()) for x in logs) + end - n[-1] * per_token)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(texts), tokens)), pa.array(plain, pa.float64()), pa.array(score), pa.array(list(map(len, texts)), pa.int64())],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"],
        )

    return run


def score_texts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes) for each row of ``docs`` (doc_id, text).

    score is log10 of the probability of the whole text and its end under the weighted context tree of
    all training texts; -score * log2(10) / (n_bytes + 1) is its code length in bits a byte. base_score
    is that of a table of single words. The tree grows with the corpus and stays distributed: tasks read
    of it what the texts of a block ask for, so no task and no driver holds it whole.

    A null text is empty; a text of any length is read whole; a null doc_id is in training; repeated rows
    count each time; an empty table gives no rows; without training rows each bit has one half. Further
    columns aren't read.
    """
    ws = Workspace(spark, "lm")
    with job_settings(spark):
        all_rows = gather(docs, ws)
        lists = {k: all_rows.where(F.col("kind") == k) for k in ("text", "gram", "word")}
        grams = ws.table(lists["gram"].groupBy("gram").agg(F.sum("n").alias("n")), "grams")
        words = ws.table(lists["word"].groupBy("word").agg(F.sum("n").alias("c")), "words")
        texts = lists["text"].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_distinct("block").alias("blocks")).first()
        seen = words.where("c > 0").agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
        tokens, kinds = seen["n"] + texts["n"], seen["v"] + (texts["n"] > 0)
        codes = code_lengths(grams, tree(grams, ws), ws)
        # Written one after the other, so that the shuffles of one are gone when the next begins.
        word_rows = ws.table(listed(lists["word"].select("block", "word").join(words, "word").select("block", "c", "word"), 1), "word-lists")
        gram_rows = ws.table(listed(lists["gram"].select("block", "gram").join(codes, "gram").select("block", "gram", "lp"), 0), "gram-lists")
        for name in ("grams", "words", *(f"{what}-{d}" for what in ("head", "codes") for d in range(DEPTH + 1))):
            ws.drop(name)
        both = gram_rows.unionByName(word_rows).unionByName(lists["text"].select("block", F.lit(2).alias("part"), "chunk"))

        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-texts["blocks"] // 4))
        place = F.expr(f"CAST(pmod(shiftright(block, 24) + (block & {(1 << 24) - 1}) * 1000003, {n}) AS int)")  # blocks of tasks 0, 1, 2, ... take turns
        rows = both.repartitionById(n, place).sortWithinPartitions("block", "part")
        out = type(docs.schema)([docs.schema["doc_id"]])
        for name, kind in (("held_out", "boolean"), ("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"), ("n_bytes", "long")):
            out = out.add(name, kind)
        scores = ws.table(rows.mapInArrow(_score(tokens, math.log10(tokens + kinds + 1), math.log10(texts["n"] + 1)), out), "scores")
    for name in ("gathered", "word-lists", "gram-lists"):
        ws.drop(name)
    return scores
