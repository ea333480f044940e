"""SimHash near-duplicates: fingerprints, and exact close pairs by a forest of vantage-point trees."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.llm.blocks import BOTH, SIDE_A, SIDE_B, Forest, bucket_blocks
from sorrel.llm.components import components
from sorrel.llm.workspace import Workspace

SEED = 42
#: Fingerprints in a leaf, on average, and at most on each side of a block that a task compares.
LEAF, HOME_CAP, VISITOR_CAP = 1024, 2048, 4096
#: Fingerprints that the trees are built from: half of all at most, so the driver never holds all.
SAMPLE, MAX_DEPTH = 8192, 20


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """64 bits, each set if set in over half of the XXH64 values (seed 42) of the shingles, repeats included.

    ASCII letters are lower-cased and ASCII white space ends words. Fewer words than a shingle
    are one shingle; no word at all gives zero.
    """
    import xxhash

    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(tokens), SEED)]
    else:
        line, h = memoryview(b" ".join(tokens)), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        starts = np.concatenate([[0], ends[: -words]]).tolist()
        hashes = [h(line[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
    total, n = np.zeros(64, np.int64), len(hashes)
    for i in range(0, n, 65_536):
        bits = np.unpackbits(np.array(hashes[i : i + 65_536], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, carried: Column | None = None) -> DataFrame:
    """(doc_id, fp), or (row, doc_id, fp) with ``carried`` as row: the fingerprint as a signed long; null and empty texts have zero."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())], [*batch.schema.names[:-1], "fp"])

    row = [] if carried is None else [carried.alias("row")]
    src = docs.select(*row, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return src.mapInArrow(run, src.drop("text").schema.add("fp", "long"))


class VantageTrees:
    """One vantage-point tree per block of bits; distances are Hamming distances within the block.

    Two fingerprints at most ``radius`` bits apart are at most ``radius // blocks`` apart in one of
    the blocks, so one of the trees finds them with that smaller radius r. A node sends what lies
    within its median distance m of its vantage point inside, the rest outside. By the triangle
    inequality, what lies within r of a fingerprint at distance d lies at d - r to d + r of the
    vantage point: the outer branch is pruned if d + r <= m, the inner if d - r > m. So each
    fingerprint has one home leaf in each tree, and visits those whose border it overlaps.
    """

    def __init__(self, sample: np.ndarray, depth: int, radius: int, blocks: int = 2, seed: int = 1):
        self.depth, self.reach = depth, radius // blocks
        width = 64 // blocks
        self.masks = [np.uint64(((1 << width) - 1) << (width * t)) for t in range(blocks)]
        rng = np.random.default_rng(seed)
        if not len(sample):
            sample = rng.integers(0, 1 << 63, 64, dtype=np.uint64)
        self.points, self.medians = [], []
        for mask in self.masks:
            points, medians = np.zeros((1 << depth) - 1, np.uint64), np.full((1 << depth) - 1, width // 2, np.int16)
            node = np.zeros(len(sample), np.int64)
            for level in range(depth):
                first, order = (1 << level) - 1, np.argsort(node, kind="stable")
                bounds = np.searchsorted(node[order], np.arange(first, 2 * first + 2))
                for k in range(first + 1):
                    own = sample[order[bounds[k] : bounds[k + 1]]]
                    points[first + k] = rng.choice(own if len(own) else sample)
                    if len(own) >= 8:
                        medians[first + k] = int(np.median(np.bitwise_count((own ^ points[first + k]) & mask)))
                node = 2 * node + 1 + (np.bitwise_count((sample ^ points[node]) & mask) > medians[node])
            self.points.append(points)
            self.medians.append(medians)

    def visits(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tree, leaf, place in fps, whether at home), for each leaf that a fingerprint visits."""
        out = []
        for tree, mask in enumerate(self.masks):
            at, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
            for _ in range(self.depth):
                d = np.bitwise_count((fps[at] ^ self.points[tree][node]) & mask).astype(np.int16)
                m = self.medians[tree][node]
                inner, outer, within = d - self.reach <= m, d + self.reach > m, d <= m
                at, node, home = np.concatenate([at[inner], at[outer]]), np.concatenate([2 * node[inner] + 1, 2 * node[outer] + 2]), np.concatenate([(home & within)[inner], (home & ~within)[outer]])
            out.append((np.full(len(at), tree, np.int32), node - ((1 << self.depth) - 1), at, home))
        return tuple(np.concatenate(x) for x in zip(*out))


def close_forest(home: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all pairs (home, visitor) at most ``radius`` bits apart: each member with its group's first.

    Pairs are compared only if their distances to a common point differ by ``radius`` at most.
    """
    nodes = np.unique(np.concatenate([home, visitors]))
    forest = Forest(len(nodes))
    home_d, d = np.bitwise_count(home ^ nodes[0]), np.bitwise_count(visitors ^ nodes[0])
    order = np.argsort(d, kind="stable")
    visitors, d, place = visitors[order], d[order], np.searchsorted(nodes, visitors[order])
    for k in np.unique(home_d):
        lo, hi = np.searchsorted(d, [int(k) - radius, int(k) + radius + 1])
        own = home[home_d == k]
        own_place, step = np.searchsorted(nodes, own), max(1, 1_000_000 // max(1, hi - lo))
        for i in range(0, len(own), step):
            a, b = np.nonzero(np.bitwise_count(own[i : i + step, None] ^ visitors[None, lo:hi]) <= radius)
            forest.link(own_place[i + a], place[lo + b])
    moved = np.flatnonzero(forest.root != np.arange(len(nodes)))
    return nodes[moved], nodes[forest.root[moved]]


def close_edges(reps: DataFrame, ws: Workspace, radius: int = 3) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of distinct fingerprints within ``radius`` bits.

    ``reps`` is a written table of distinct ``fp``. Leaves are compared in bounded blocks; each
    block gives a spanning forest, at most an edge for each of its rows.
    """
    n = reps.count()
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, n / LEAF)))))
    every = max(2, n // SAMPLE)
    sample = reps.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").limit(2 * SAMPLE)
    trees = VantageTrees(np.sort(np.array([r.fp for r in sample.collect()] if depth else [], np.int64)).view(np.uint64), depth, radius)

    def visit(frames):
        import pandas as pd

        for f in frames:
            fps = f["fp"].to_numpy(np.int64)
            tree, leaf, at, home = trees.visits(fps.view(np.uint64))
            yield pd.DataFrame({"tree": tree, "leaf": leaf, "fp": fps[at], "in_a": home, "in_b": True})

    visits = ws.table(reps.select("fp").mapInPandas(visit, "tree int, leaf long, fp long, in_a boolean, in_b boolean"), "visits")
    dealt = bucket_blocks(visits, ["tree", "leaf"], ws, "large-leaves", F.xxhash64("fp"), HOME_CAP, VISITOR_CAP)

    def compare(f):
        import pandas as pd

        fps, role = f["fp"].to_numpy(np.int64).view(np.uint64), f["role"].to_numpy()
        home, visitors = fps[(role == SIDE_A) | (role == BOTH)], fps[(role == SIDE_B) | (role == BOTH)]
        a, b = close_forest(home, visitors, radius) if len(home) and len(visitors) else (fps[:0], fps[:0])
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("tree", "leaf", "block_a", "block_b").applyInPandas(compare, "a long, b long")


def fingerprint_groups(fps: DataFrame, ws: Workspace, radius: int, least: Column) -> DataFrame:
    """(key, least): each distinct ``fp`` of the written table ``fps`` and the least value of ``least`` over its component."""
    reps = ws.table(fps.groupBy("fp").agg(F.min(least).alias("least")), "reps")
    edges = ws.table(close_edges(reps, ws, radius), "edges")
    ws.drop("visits")
    roots = ws.table(components(edges, ws), "roots")
    joined = ws.table(reps.join(roots, reps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "joined")
    lowest = ws.table(joined.groupBy(F.col("root").alias("group")).agg(F.min("least").alias("lowest")), "lowest")
    named = ws.table(joined.join(lowest, joined.root == lowest.group).select(F.col("fp").alias("key"), F.col("lowest").alias("least")), "named")
    for name in ("reps", "edges", "roots", "joined", "lowest", "large-leaves"):
        ws.drop(name)
    return named


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    Fingerprints at most ``radius`` bits apart are linked; component_id is the smallest doc_id
    reachable. Null and empty texts have fingerprint zero, linked like any other. A null doc_id
    takes part, but is never a component_id unless its whole component has none. Repeated rows
    give a row each. An empty table gives no rows. Further columns are ignored.
    """
    ws = Workspace(spark, "simhash")
    fps = ws.table(fingerprints(docs, words), "fps")
    named = fingerprint_groups(fps, ws, radius, F.col("doc_id"))
    return fps.join(named, fps.fp == named.key).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component of ``docs``, with all its columns, whatever they are named.

    The row of the smallest doc_id stays; a row without a doc_id only where no row of the component
    has one. Of rows that share that doc_id, one stays. Null and empty texts are one component. An
    empty table gives an empty one.
    """
    ws = Workspace(spark, "simhash-keep")
    rows = ws.table(fingerprints(docs, words, F.struct("*")).withColumn("at", F.monotonically_increasing_id()), "rows")
    named = fingerprint_groups(rows, ws, radius, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("at")))
    # A bit a row says which rows stay: small enough to send to every task (5 MB for ten million rows), so that no text is shuffled.
    at = F.col("least.at")
    keep = ws.table(named.groupBy(F.shiftrightunsigned(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(least.at & 63 AS int))")).alias("bits")), "keep")
    stays = (F.shiftrightunsigned("at", 6) == F.col("word")) & (F.expr("shiftright(bits, CAST(at & 63 AS int)) & 1L") == 1)
    return rows.join(F.broadcast(keep), stays).select("row.*")
