"""Embedding near-duplicates: codes by iterative quantisation, multi-index Hamming tables, exact cosines."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.llm.blocks import BOTH, SIDE_A, SIDE_B, Forest, bucket_blocks
from sorrel.llm.components import components
from sorrel.llm.vectors import matrix, products, usable
from sorrel.llm.workspace import Workspace

#: Vectors that the rotations are learned from, at most; taken in the order of a hash of their id.
FIT_ROWS = 8000
#: A pair at the least cosine is found with this probability or more, for codes whose bits differ as random hyperplanes' do.
RECALL, BUCKET, CAP = 0.995, 64, 2048


@dataclass
class Quantizer:
    """Balanced binary codes: principal axes, then rotations that bring the vectors closest to corners of the cube.

    A rotation gives as many bits as the vectors have dimensions. More bits come from further
    rotations, each learned from another random start. The codes are cut into tables of
    ``bits`` bits; a pair is retrieved if any of them is equal.
    """

    planes: np.ndarray  # dim x bits of all tables
    tables: int
    bits: int

    @staticmethod
    def fit(x: np.ndarray, tables: int, bits: int, rounds: int = 30, seed: int = 9) -> Quantizer:
        dim, rng, planes = x.shape[1], np.random.default_rng(seed), []
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        _, axes = np.linalg.eigh(unit.T @ unit + 1e-9 * np.eye(dim))
        projected = unit @ axes
        while sum(p.shape[1] for p in planes) < tables * bits:
            r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
            for _ in range(rounds):
                corners = np.where(projected @ r >= 0, 1.0, -1.0)
                u, _, v = np.linalg.svd(projected.T @ corners)
                r = u @ v
            planes.append((axes @ r)[:, rng.permutation(dim)])
        return Quantizer(np.concatenate(planes, axis=1)[:, : tables * bits], tables, bits)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """rows x tables; each code as a number."""
        on = (x @ self.planes >= 0).reshape(len(x), self.tables, self.bits)
        return on @ (1 << np.arange(self.bits, dtype=np.int64))


def plan_tables(largest: int, cosine: float) -> tuple[int, int]:
    """(tables, bits): buckets of about BUCKET random vectors of the largest label, and tables enough for RECALL."""
    bits = min(30, max(4, math.ceil(math.log2(max(1, largest / BUCKET)))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - same))), bits


def links(spark: SparkSession, classes: DataFrame, ws: Workspace, cosine: float) -> DataFrame:
    """(cls, links, root) rows from all blocks: linked rows of other classes, and an edge to the block's first of its group.

    ``classes`` is a written table of a label's distinct vectors: cls, label, embedding, copies. A pair
    counts in the first table in which it meets, so each pair counts once for each of its two ends.
    Buckets are planned on ids alone; a vector joins its row of a bucket when the blocks are dealt.
    """
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    tables, bits = plan_tables(largest, cosine)
    sample = classes.orderBy(F.xxhash64("cls"), "cls").limit(FIT_ROWS).select("embedding").toPandas()
    if not len(sample):
        return spark.createDataFrame([], "cls long, links long, root long")
    # Vectors of one length share rotations; shorter ones are taken as if zeros followed.
    width = int(classes.agg(F.max(F.size("embedding"))).first()[0])
    codes = Quantizer.fit(matrix(sample["embedding"], width), tables, bits)

    def encode(frames):
        import pandas as pd

        for f in frames:
            if len(f):
                yield pd.DataFrame({"cls": f["cls"], "label": f["label"], "codes": list(codes.codes(matrix(f["embedding"], width)))})

    coded = ws.table(classes.select("cls", "label", "embedding").mapInPandas(encode, "cls long, label string, codes array<long>"), "coded")
    slim = coded.select("cls", "label", F.posexplode("codes").alias("tab", "bucket"), F.lit(True).alias("in_a"), F.lit(True).alias("in_b"))
    buckets = ws.table(slim, "buckets")
    dealt = bucket_blocks(buckets, ["label", "tab", "bucket"], ws, "large", F.xxhash64("cls"), CAP, CAP)
    facts = classes.join(coded.select(F.col("cls").alias("coded_cls"), "codes"), F.col("cls") == F.col("coded_cls")).select(F.col("cls").alias("fact_cls"), "embedding", "copies", "codes")
    dealt = dealt.join(ws.table(facts, "facts"), F.col("cls") == F.col("fact_cls")).select(
        "label", "tab", "bucket", "block_a", "block_b", "role", "cls", "embedding", "copies", F.slice("codes", F.lit(1), F.col("tab")).alias("earlier")
    )

    def compare(f):
        import pandas as pd

        f = f.sort_values("cls", kind="stable")
        role = f["role"].to_numpy()
        cls, first = np.unique(f["cls"].to_numpy(), return_index=True)
        x, copies = matrix(f["embedding"], width)[first], f["copies"].to_numpy()[first]
        earlier = np.array(f["earlier"].tolist(), np.int64).reshape(len(f), -1)[first]
        place = np.searchsorted(cls, f["cls"].to_numpy())
        a, b = np.unique(place[(role == SIDE_A) | (role == BOTH)]), np.unique(place[(role == SIDE_B) | (role == BOTH)])
        norm = np.sqrt(products(x, x))
        unit, count, forest = x / norm[:, None], np.zeros(len(cls), np.int64), Forest(len(cls))
        for i in range(0, len(a), 512):
            own = a[i : i + 512]
            p, q = np.nonzero(unit[own] @ unit[b].T >= cosine - 1e-9)
            p, q = own[p], b[q]
            keep = p != q
            p, q = p[keep], q[keep]
            keep = ~(earlier[p] == earlier[q]).any(axis=1) if earlier.shape[1] else np.ones(len(p), bool)
            p, q = p[keep], q[keep]
            keep = products(x[p], x[q]) / (norm[p] * norm[q]) >= cosine
            p, q = p[keep], q[keep]
            np.add.at(count, p, copies[q])
            forest.link(p, q)
        moved = np.flatnonzero((count > 0) | (forest.root != np.arange(len(cls))))
        return pd.DataFrame({"cls": cls[moved], "links": count[moved], "root": cls[forest.root[moved]]})

    return dealt.groupBy("label", "tab", "bucket", "block_a", "block_b").applyInPandas(compare, "cls long, links long, root long")


def near_vectors(spark: SparkSession, vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Rows of one label and one length at ``cosine`` or more are linked. A null label, an unusable
    vector (see ``vectors.usable``) or a null vec_id links with nothing: no links, itself as
    component. Equal vectors of a label are one class, compared once, and count as often as they
    stand there. Repeated rows, and different vectors of one vec_id, are rows of their own, each
    with its own links. An empty table gives no rows. Further columns are ignored.
    """
    ws = Workspace(spark, "itq")
    # A label's vectors of another length are a group of their own.
    group = F.concat_ws(":", F.size("embedding").cast("string"), F.col("label"))
    rows = ws.table(usable(vectors).where("label IS NOT NULL").select("vec_id", group.alias("label"), "embedding"), "rows")
    grouped = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    classes = ws.table(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    found = ws.table(links(spark, classes, ws, cosine), "found")
    for name in ("buckets", "large", "facts", "coded"):
        ws.drop(name)
    roots = ws.table(components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), ws), "roots")
    total = ws.table(found.groupBy(F.col("cls").alias("linked")).agg(F.sum("links").alias("links")), "total")
    known = classes.join(total, classes.cls == total.linked, "left").join(roots, classes.cls == roots.node, "left")
    known = ws.table(known.select("label", "embedding", "least_id", F.coalesce("root", "cls").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    least = ws.table(known.groupBy(F.col("component").alias("of")).agg(F.min("least_id").alias("component_id")), "least")
    named = ws.table(known.join(least, known.component == least.of).select(F.col("label").alias("l"), F.col("embedding").alias("e"), "n_links", "component_id"), "named")
    own = ["vec_id", "n_links", "component_id"]
    linked = rows.join(named, (rows.label == named.l) & (rows.embedding == named.e)).select(*own)
    everyone = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).groupBy("vec_id").agg(F.count("*").alias("all_rows"))
    used = ws.table(rows.groupBy(F.col("vec_id").alias("known_id")).agg(F.count("*").alias("known_rows")), "used")
    alone = everyone.join(used, F.col("vec_id") == F.col("known_id"), "left")
    alone = alone.select("vec_id", F.explode(F.array_repeat(F.lit(0).cast("long"), (F.col("all_rows") - F.coalesce("known_rows", F.lit(0))).cast("int"))).alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
