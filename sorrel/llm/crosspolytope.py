"""Approximate nearest neighbours by cross-polytope hashing with fast Hadamard rotations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sorrel.llm.blocks import BOTH, SIDE_A, SIDE_B, bucket_blocks
from sorrel.llm.vectors import matrix, products, usable
from sorrel.llm.workspace import Workspace

INDEX_CAP, QUERY_CAP = 4096, 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, in d log d steps; d is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


@dataclass
class CrossPolytope:
    """Hashes of directions: three rounds of random signs and a Hadamard transform, then the nearest of the 2 * size signed axes.

    A table's bucket is named by the axes of ``axes`` independent rotations.
    """

    dim: int
    tables: int
    axes: int = 1
    seed: int = 11

    def __post_init__(self):
        self.size = 1 << max(1, int(np.ceil(np.log2(max(2, self.dim)))))
        self.signs = np.random.default_rng(self.seed).choice([-1.0, 1.0], (self.tables, self.axes, 3, self.size))

    def directions(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.size))
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out[:, : self.dim] = x / np.linalg.norm(x, axis=1, keepdims=True)
        return out

    def turned(self, directions: np.ndarray, table: int, axis: int) -> np.ndarray:
        """The products with all signed axes: size + k is -k."""
        for signs in self.signs[table, axis]:
            directions = hadamard(directions * signs)
        return np.concatenate([directions, -directions], axis=1)

    def buckets(self, directions: np.ndarray, table: int, probes: int = 1) -> np.ndarray:
        """rows x probes**axes buckets: every combination of the ``probes`` nearest axes of each rotation."""
        out = np.zeros((len(directions), 1), np.int64)
        for a in range(self.axes):
            both = self.turned(directions, table, a)
            near = both.argmax(1)[:, None] if probes == 1 else np.argpartition(-both, probes - 1, axis=1)[:, :probes]
            out = (out[:, :, None] * (2 * self.size) + near[:, None, :]).reshape(len(directions), -1)
        return out

    def depths(self, queries: np.ndarray, others: np.ndarray) -> np.ndarray:
        """pairs x tables: how many nearest axes of each rotation a query must probe to meet the bucket of its pair's other."""
        out = np.zeros((len(queries), self.tables), np.int64)
        for t in range(self.tables):
            for a in range(self.axes):
                both, at = self.turned(queries, t, a), self.turned(others, t, a).argmax(1)
                out[:, t] = np.maximum(out[:, t], (both > both[np.arange(len(both)), at][:, None]).sum(1) + 1)
        return out


def plan_probes(depths: np.ndarray, recall: float, axes: int, all_axes: int) -> tuple[int, int]:
    """(tables, probes): those that meet ``recall`` of the pairs at the least number of buckets asked. Without pairs: one bucket in each table."""
    best = (1, all_axes)
    for tables in range(1, depths.shape[1] + 1):
        found = np.sort(depths[:, :tables].min(1))
        probes = int(found[min(len(found) - 1, int(np.ceil(recall * len(found))))]) if len(found) else 1
        if tables * probes**axes < best[0] * best[1] ** axes:
            best = (tables, probes)
    return best


def top_products(q: np.ndarray, q_at: np.ndarray, x: np.ndarray, at: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, other's place, product) of each query's ``k`` largest inner products with other rows; ties to the smaller id."""
    out = []
    for i in range(0, len(q) if len(x) else 0, 256):
        s = q[i : i + 256] @ x.T
        s[q_at[i : i + 256, None] == at[None]] = -np.inf
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1] if s.shape[1] > k else np.full(len(s), -np.inf)
        scale = np.abs(np.where(np.isfinite(s), s, 0)).max() + 1e-300
        a, b = np.nonzero((s >= least[:, None] - 1e-9 * scale) & np.isfinite(s))
        exact = products(q[i + a], x[b])
        order = np.lexsort((at[b], ids[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        top = np.arange(len(a)) - np.searchsorted(a, a) < k
        out.append((i + a[top], b[top], exact[top]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


#: Queries whose exact neighbours set the number of tables and probes; all rows are compared with them once.
TUNE_QUERIES = 64


def neighbour_pairs(spark: SparkSession, rows: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(queries, neighbours): the vectors of at most TUNE_QUERIES queries with each of their exact ``k`` neighbours.

    Each task keeps the best ``k`` of what it reads for each of the queries, so a few rows a task come together.
    """
    import pandas as pd

    asks = rows.where("asks").orderBy(F.xxhash64("at"), "at").limit(TUNE_QUERIES).select("at", "dim", "embedding").toPandas()
    q, q_at, q_dim = matrix(asks["embedding"], width), asks["at"].to_numpy(np.int64), asks["dim"].to_numpy(np.int64)

    def scan(frames):
        kept = None
        for f in frames:
            f = f if kept is None else pd.concat([kept.drop(columns=["ask", "score"]).drop_duplicates("at"), f])
            x, dims, found = matrix(f["embedding"], width), f["dim"].to_numpy(), []
            for d in np.unique(q_dim):
                own, others = np.flatnonzero(q_dim == d), np.flatnonzero(dims == d)
                a, b, s = top_products(q[own], q_at[own], x[others], f["at"].to_numpy()[others], f["vec_id"].to_numpy()[others], k)
                found.append(f.iloc[others[b]].assign(ask=q_at[own[a]], score=s))
            kept = pd.concat(found) if found else None
        if kept is not None and len(kept):
            yield kept[["ask", "at", "vec_id", "dim", "embedding", "score"]]

    kind = rows.schema["embedding"].dataType.simpleString()
    found = rows.select("at", "vec_id", "dim", "embedding").mapInPandas(scan, f"ask long, at long, vec_id long, dim int, embedding {kind}, score double")
    best = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id", "at")
    pairs = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("ask", "embedding").toPandas()
    place = {a: i for i, a in enumerate(q_at.tolist())}
    return q[[place[a] for a in pairs["ask"]]] if len(pairs) else q[:0], matrix(pairs["embedding"], width)


def nearest(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 20, tables: int = 10, recall: float = 0.97, bucket_rows: int = 50_000) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query, the ``k`` candidates of largest inner product found.

    ``is_query`` is a condition on vec_id. Every usable row is a candidate for all queries of its
    vector's length but itself; unusable rows (see ``vectors.usable``) take no part. Norms are cut
    into bands of a factor of two, down from the largest; each is hashed by itself and probed by
    every query, so within a band directions stand for inner products and a long vector has no say
    in the others' buckets. Candidates share a bucket with one of the query's probes in some table.
    Buckets are named by as many axes as keep them near ``bucket_rows`` rows; the tables (at most
    ``tables``) and the probes are those that found ``recall`` of the exact neighbours of a few
    queries, up to probing every bucket. A query that is left with fewer than ``k`` candidates meets
    every row. All are ranked by exact inner products of the original vectors, ties to the smaller
    vec_id. Repeated rows, and different vectors of one vec_id, are queries and candidates of their
    own. With fewer candidates than ``k`` in the table, all are returned. An empty table gives no
    rows. Further columns are ignored.
    """
    ws = Workspace(spark, "crosspolytope")
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    # The logarithm of the norm; components are divided by the largest, so that no square overflows.
    norm = F.log2(largest) + 0.5 * F.log2(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (x / largest) * (x / largest)))
    rows = usable(vectors).select("vec_id", "dim", "embedding", norm.alias("norm"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = ws.table(rows.withColumn("at", F.monotonically_increasing_id()), "rows")
    about = rows.agg(F.count("*").alias("n"), F.max("norm").alias("hi"), F.max("dim").alias("dim")).first()
    width = about["dim"] or 1
    banded = rows.withColumn("band", F.floor(F.lit(about["hi"] or 0.0) - F.col("norm")).cast("int"))
    bands = {(r["dim"], r["band"]) for r in banded.select("dim", "band").distinct().collect()}  # a row for each length and factor of two
    of_dim = {d: [b for e, b in sorted(bands) if e == d] for d, _ in bands}
    size = CrossPolytope(width, 1).size
    axes = max(1, min(4, int(np.ceil(np.log(max(1, about["n"] / bucket_rows)) / np.log(2 * size)))))
    hashes = CrossPolytope(width, tables, axes)
    asked, near = neighbour_pairs(spark, rows, k, width)
    depths = hashes.depths(hashes.directions(asked), hashes.directions(near)) if len(near) else np.zeros((0, tables), np.int64)
    used, probes = plan_probes(depths, recall, axes, 2 * size)

    def hashed(frames):
        import pandas as pd

        for f in frames:
            if not len(f):
                continue
            place, at, dims, asks = hashes.directions(matrix(f["embedding"], width)), f["at"].to_numpy(), f["dim"].to_numpy(), f["asks"].to_numpy(bool)
            for t in range(used):
                yield pd.DataFrame({"dim": dims, "band": f["band"], "tab": t, "bucket": hashes.buckets(place, t)[:, 0], "at": at, "in_a": True, "in_b": False})
                for i in range(0, int(asks.sum()), 256):
                    own = np.flatnonzero(asks)[i : i + 256]
                    found = hashes.buckets(place[own], t, probes)
                    for d in np.unique(dims[own]):
                        of = dims[own] == d
                        for b in of_dim[int(d)]:
                            yield pd.DataFrame({"dim": d, "band": b, "tab": t, "bucket": found[of].ravel(), "at": np.repeat(at[own[of]], found.shape[1]), "in_a": False, "in_b": True})

    keys = ["dim", "band", "tab", "bucket"]
    source = banded.select("at", "dim", "band", "embedding", "asks")
    slim = ws.table(source.mapInPandas(hashed, "dim int, band int, tab int, bucket long, at long, in_a boolean, in_b boolean"), "slim")
    met = ws.table(slim.groupBy(*keys).agg(F.bool_or("in_a").alias("a"), F.bool_or("in_b").alias("b")).where("a AND b").drop("a", "b"), "met")
    buckets = ws.table(slim.join(met, keys, "left_semi"), "buckets")
    facts = rows.select(F.col("at").alias("fact_at"), "vec_id", "embedding")

    def best(f):
        import pandas as pd

        role = f["role"].to_numpy()
        index, asks = f[(role == SIDE_A) | (role == BOTH)], f[(role == SIDE_B) | (role == BOTH)]
        x, ids, at = matrix(index["embedding"], width), index["vec_id"].to_numpy(), index["at"].to_numpy()
        a, b, s = top_products(matrix(asks["embedding"], width), asks["at"].to_numpy(), x, at, ids, k)
        return pd.DataFrame({"query_at": asks["at"].to_numpy()[a], "query_id": asks["vec_id"].to_numpy()[a], "at": at[b], "vec_id": ids[b], "score": np.asarray(s, float)})

    def ranked(buckets: DataFrame, keys: list[str], name: str) -> DataFrame:
        dealt = bucket_blocks(buckets, keys, ws, f"{name}-large", F.xxhash64("at"), INDEX_CAP, QUERY_CAP)
        dealt = dealt.join(facts, F.col("at") == F.col("fact_at")).select(*keys, "block_a", "block_b", "role", "at", "vec_id", "embedding")
        found = dealt.groupBy(*keys, "block_a", "block_b").applyInPandas(best, "query_at long, query_id long, at long, vec_id long, score double")
        each = found.groupBy("query_at", "at").agg(F.first("query_id").alias("query_id"), F.first("vec_id").alias("vec_id"), F.max("score").alias("score"))
        order = Window.partitionBy("query_at").orderBy(F.desc("score"), "vec_id", "at")
        return ws.table(each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_at", "query_id", "rank", "vec_id", "score"), name)

    first = ranked(buckets, keys, "first")
    for name in ("slim", "met", "buckets", "first-large"):
        ws.drop(name)
    got = ws.table(first.groupBy("query_at").agg(F.count("*").alias("got")), "got")
    others = ws.table(rows.groupBy(F.col("dim").alias("of_dim")).agg((F.count("*") - 1).alias("others")), "others")
    short = rows.where("asks").join(others, F.col("dim") == F.col("of_dim")).join(got, F.col("at") == F.col("query_at"), "left")
    short = ws.table(short.where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.col("others"))).select(F.col("at").alias("short_at")), "short")
    if short.limit(1).count():
        swept = rows.join(short, F.col("at") == F.col("short_at"), "left")
        swept = ws.table(swept.select(F.col("dim").alias("bucket"), "at", F.lit(True).alias("in_a"), F.col("short_at").isNotNull().alias("in_b")), "swept")
        rest = ranked(swept, ["bucket"], "rest")
        first = first.join(short, first.query_at == short.short_at, "left_anti").unionByName(rest)
    return first.select("query_id", "rank", "vec_id", "score")
