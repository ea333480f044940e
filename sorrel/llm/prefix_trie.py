"""Prefix trie of conversations: an external mergesort that carries common-prefix lengths, and nodes from an open-path stack."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.llm.workspace import CommittedFile, Workspace, open_input

#: Bytes of a turn in a sequence's key: 128 bits of its SHA-256.
WIDTH = 16
#: A conversation takes at most SHARED - 1 first turns of its block's first conversation; a block is so many ids.
SHARED, BLOCK = 6, 100
#: Sequences of a sorted run; bytes of runs that a task keeps before it writes them to the shared folder; children that wait for a parent.
RUN_ROWS, MEMORY, WAITING = 50_000, 128 << 20, 50_000
#: Characters of ids in a row when the ids of a sequence are joined.
JOINED = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = "edge boolean, conv_id long, depth long, parent_conv_id long, id binary, parent_id binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, size long, path_size long"


class Sequence(NamedTuple):
    """A distinct sequence: its key, the turns that it shares with the one before, and what ends there."""

    key: bytes
    lcp: int
    sizes: list[int]
    n: int
    least: int
    ends: str


def common_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """How many first turns two keys share, of which ``known`` needn't be compared."""
    most = min(len(a), len(b)) // WIDTH
    while known < most and a[known * WIDTH : (known + 1) * WIDTH] == b[known * WIDTH : (known + 1) * WIDTH]:
        known += 1
    return known


def sorted_run(rows: list[Sequence]) -> list[Sequence]:
    """``rows`` in key order, each with its common turns with the row before."""
    rows.sort(key=lambda r: r.key)
    return [r._replace(lcp=common_turns(rows[i - 1].key, r.key) if i else 0) for i, r in enumerate(rows)]


class LoserTree:
    """Merge of sorted runs of distinct keys. Each head keeps its common turns with the row given out last
    (or with the head that beat it), so two heads are compared only behind the turns that both are known to share."""

    def __init__(self, runs: list[Iterator[Sequence]]):
        self.runs, self.width, self.compared = runs, 1 << max(0, len(runs) - 1).bit_length(), 0
        self.heads: list[Sequence | None] = [next(r, None) for r in runs] + [None] * (self.width - len(runs))
        self.lcp, self.losers = [0] * self.width, [0] * self.width
        winners = [*[0] * self.width, *range(self.width)]
        for node in range(self.width - 1, 0, -1):
            winners[node], self.losers[node] = self._play(winners[2 * node], winners[2 * node + 1])
        self.winner = winners[1] if self.width > 1 else 0

    def _play(self, i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser's common turns become those with the winner."""
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if self.lcp[i] != self.lcp[j]:
            return (i, j) if self.lcp[i] > self.lcp[j] else (j, i)
        shared = common_turns(a.key, b.key, self.lcp[i])
        self.compared += shared - self.lcp[i] + 1
        at = slice(shared * WIDTH, (shared + 1) * WIDTH)
        won, lost = (i, j) if a.key[at] < b.key[at] else (j, i)
        self.lcp[lost] = shared
        return won, lost

    def __iter__(self) -> Iterator[Sequence]:
        while (row := self.heads[self.winner]) is not None:
            at = self.winner
            yield row._replace(lcp=self.lcp[at])
            self.heads[at] = head = next(self.runs[at], None)
            self.lcp[at] = head.lcp if head else 0
            node = (at + self.width) // 2
            while node:
                at, self.losers[node] = self._play(at, self.losers[node])
                node //= 2
            self.winner = at


def external_sort(rows: Iterable[Sequence], folder: str) -> Iterator[Sequence]:
    """``rows`` in key order with their common turns; runs beyond MEMORY go to files in the shared ``folder``."""
    import pyarrow as pa

    names = ["key", "lcp", "sizes", "n", "least", "ends"]
    schema = pa.schema(list(zip(names, [pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()])))

    def spilled(run: list[Sequence]) -> str:
        out = CommittedFile(folder, "run", ".arrow")
        with pa.ipc.new_stream(out.stream, schema) as stream:
            for k in range(0, len(run), 1024):
                stream.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*run[k : k + 1024]), schema.types)], schema=schema))
        return out.close()

    def read(name: str) -> Iterator[Sequence]:
        with open_input(folder, name) as f, pa.ipc.open_stream(f) as stream:
            for batch in stream:
                yield from map(Sequence, *[c.to_pylist() for c in batch.columns])

    kept: list[list[Sequence]] = []
    files: list[str] = []
    own, held = [], 0
    for row in rows:
        own.append(row)
        held += len(row.key) + 64 * len(row.sizes) + 400
        if len(own) >= RUN_ROWS or held >= MEMORY:
            kept.append(sorted_run(own))
            own = []
            if held >= MEMORY:
                files += map(spilled, kept)
                kept, held = [], 0
    kept.append(sorted_run(own))
    return iter(LoserTree([*map(read, files), *map(iter, kept)]))


@dataclass
class Open:
    """A node on the open path. An edge node may have more members in other tasks."""

    key: bytes
    depth: int
    size: int
    path_size: int
    edge: bool = False
    id: bytes | None = None
    n: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str | None = None
    waiting: list[tuple] = field(default_factory=list)

    def add(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


def nodes(ordered: Iterable[Sequence]) -> Iterator[tuple]:
    """NODE rows of a task's share of the sorted sequences.

    A node is finished when the next sequence leaves it, and is given out when its parent is, whose
    conv_id it needs. Nodes on the paths of the first and of the last sequence are edges: other tasks
    may hold more of them. They are given out in part, with an id, and their finished children name
    that id. A node with too many waiting children becomes an edge as well.
    """
    path: list[Open] = []

    def named(upto: int) -> None:
        """The first ``upto`` open nodes become edges."""
        h = hashlib.sha256()
        for d, node in enumerate(path[:upto]):
            if d:
                h.update(node.key[(d - 1) * WIDTH : d * WIDTH])
            node.edge, node.id = True, h.copy().digest()[:WIDTH]

    def told(node: Open, above: Open | None, done: tuple) -> Iterator[tuple]:
        """What can be given out once ``node`` is finished: its children, and itself if it is an edge."""
        if node.edge:
            yield from ((*w[:3], None, None, node.id, *w[3:], None, None) for w in node.waiting)
            yield (True, node.least, node.depth, None, node.id, above.id if above else None, node.n, node.children, node.leaves, node.saved, node.ends, node.size, node.path_size)
        else:
            yield from ((*w[:3], node.least, None, None, *w[3:], None, None) for w in node.waiting)
            above.waiting.append(done)

    def close() -> Iterator[tuple]:
        node = path.pop()
        above = path[-1] if path else None
        done = ()
        if not node.edge:
            leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.size
            above.add(node.n, node.least)
            above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved
            done = (False, node.least, node.depth, node.n, node.children, leaves, saved, node.ends)
        yield from told(node, above, done)
        if above and len(above.waiting) >= WAITING:
            named(len(path))
            yield from ((*w[:3], None, None, above.id, *w[3:], None, None) for w in above.waiting)
            above.waiting = []

    for row in ordered:
        first = not path
        if first:
            path.append(Open(row.key, 0, 0, 0))
        while path[-1].depth > row.lcp:
            yield from close()
        for d in range(path[-1].depth + 1, len(row.key) // WIDTH + 1):
            path.append(Open(row.key, d, row.sizes[d - 1], path[-1].path_size + row.sizes[d - 1]))
        path[-1].ends = row.ends
        path[-1].add(row.n, row.least)
        if first:
            named(len(path))
    named(len(path))
    while path:
        yield from close()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, sizes): a conversation as the digests of its turns and the code points of their texts.

    The first h turns come from the first conversation of its block of ids, h being a checksum of the
    conv_id modulo SHARED, the others from behind its own first h. Turns of equal number are ordered by digest.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        F.col("turn"), F.substring(F.sha2(F.concat(F.char_length(role), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH).alias("digest"), F.char_length(text).cast("long").alias("size"),
    )
    own = conversations.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    first = conversations.where(F.col("conv_id") % BLOCK == 0).select("conv_id", turn.alias("t")).groupBy(F.col("conv_id").cast("long").alias("first_id"))
    first = first.agg(F.slice(F.array_sort(F.collect_list("t")), 1, SHARED - 1).alias("first_turns"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    both = own.join(first, own.conv_id - own.conv_id % BLOCK == first.first_id, "left")
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    turns = F.when(F.col("first_turns").isNull(), rest).otherwise(F.concat(F.slice("first_turns", F.lit(1), h), rest))
    return both.select("conv_id", turns.alias("t")).select("conv_id", F.unhex(F.array_join(F.col("t.digest"), "")).alias("key"), F.col("t.size").alias("sizes"))


def ends_of(sequences: DataFrame) -> DataFrame:
    """(n, least, ends): for each distinct key how many conversations have it, the smallest, and the digest of all their ids.

    A digest is made of its ids in order. Tasks that hold ranges of (key, conv_id) join the ids to
    pieces first, so that even a key with a third of all conversations brings few rows to the task
    that digests its pieces one by one; no task holds the ids of a key.
    """

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out: list[tuple] = []
        key, first, ids, size = None, None, [], 0

        for batch in batches:
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key or size >= JOINED:
                    if ids:
                        out.append((key, first, len(ids), ",".join(ids)))
                    key, first, ids, size = k, i, [], 0
                ids.append(str(i))
                size += len(ids[-1])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["key_id", "first", "n", "piece"])
                out = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (key, first, len(ids), ",".join(ids))], ["key_id", "first", "n", "piece"])

    def digests(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, least, n, h = None, None, 0, None
        for batch in batches:
            out = []
            for k, first, m, piece in zip(*[c.to_pylist() for c in batch.columns]):
                if k != key:
                    if key is not None:
                        out.append((n, least, h.hexdigest()))
                    key, least, n, h = k, first, 0, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(piece.encode())
                n += m
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["n", "least", "ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (n, least, h.hexdigest())], ["n", "least", "ends"])

    ids = sequences.select(F.substring(F.sha2("key", 256), 1, 2 * WIDTH).alias("key_id"), "conv_id")
    joined = ids.repartitionByRange("key_id", "conv_id").sortWithinPartitions("key_id", "conv_id").mapInArrow(pieces, "key_id string, first long, n long, piece string")
    return joined.repartition("key_id").sortWithinPartitions("key_id", "first").mapInArrow(digests, "n long, least long, ends string")


def spine_totals(edges: DataFrame, ws: Workspace) -> DataFrame:
    """Edge nodes put together over tasks, with the totals of their subtrees.

    Sums run up the tree by doubling: in round k each node hands what it has gathered to its ancestor
    2**k above. There are a few edge nodes for each task, whatever the table's size.
    """
    own = edges.groupBy("id").agg(
        F.first("parent_id").alias("parent_id"), F.first("depth").alias("depth"), F.first("size").alias("size"), F.first("path_size").alias("path_size"),
        F.sum("n_convs").alias("n"), F.min("conv_id").alias("least"), F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("ends_sha256").alias("ends_sha256"),
    )
    own = ws.table(own, "edges-own")
    below = own.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("below"))
    own = own.join(below, "id", "left").withColumn("children", F.col("children") + F.coalesce("below", F.lit(0).cast("long"))).drop("below")
    # A node saves (members - 1) * size: over a subtree, each member's sizes on its way down, less each node's size once.
    start = own.select("*", F.col("parent_id").alias("up"), F.when(F.col("children") == 0, F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("s_leaves"),
                       F.col("n").alias("s_n"), F.col("least").alias("s_least"), (F.col("saved") + F.col("n") * F.col("path_size") - F.col("size")).alias("s_saved"))
    at, k = ws.table(start, "edges-0"), 0
    while not at.where("up IS NOT NULL").isEmpty():
        handed = at.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("s_n").alias("a_n"), F.min("s_least").alias("a_least"), F.sum("s_leaves").alias("a_leaves"), F.sum("s_saved").alias("a_saved"))
        higher = at.select(F.col("id").alias("up"), F.col("up").alias("next_up"))
        zero = F.lit(0).cast("long")
        moved = at.join(handed, "id", "left").join(higher, "up", "left").select(
            *own.columns, F.col("next_up").alias("up"), *[(F.col(f"s_{c}") + F.coalesce(f"a_{c}", zero)).alias(f"s_{c}") for c in ("n", "leaves", "saved")], F.least("s_least", "a_least").alias("s_least"),
        )
        k += 1
        at = ws.table(moved, f"edges-{k}")
        ws.drop(f"edges-{k - 1}")
    return at.select(
        "id", "parent_id", "depth", F.col("s_least").alias("conv_id"), F.col("s_n").alias("n_convs"), F.col("children").alias("n_children"), F.col("s_leaves").alias("n_leaves"),
        (F.col("s_saved") - F.col("s_n") * (F.col("path_size") - F.col("size"))).alias("saved_tokens"), "ends_sha256",
    )


def prefix_trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns of the rebuilt conversations (conv_id, turn, role, text), the empty one included.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Equal
    conversations are one sequence before anything is sorted, and distinct keys are dealt by ranges, so
    no group of copies and no common first turn fills a task. Each task merges its sorted runs and walks
    the merged stream; paths that cross a border are put together afterwards.

    Null roles and texts count as empty ones, a null turn comes first, turns of equal number are ordered
    by content and repeated rows count each time. Rows without conv_id belong to no conversation. An empty
    table has no members and gives no rows. Further columns aren't read. A conversation is one record of
    the sort, of 24 bytes a turn; a turn is known by 128 bits of its SHA-256.
    """
    ws = Workspace(spark, "trie")
    sequences = ws.table(rebuilt(conversations), "sequences")
    ends = ws.table(ends_of(sequences), "ends")
    distinct = sequences.join(ends, sequences.conv_id == ends.least).select("key", "sizes", "n", "least", "ends")
    runs = ws.sub("runs")

    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([pa.field(f, t) for f, t in zip([x.split()[0] for x in NODE.split(", ")], [{"boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[x.split()[1]] for x in NODE.split(", ")])])
        rows = (Sequence(key, 0, sizes, n, least, ends) for b in batches for key, sizes, n, least, ends in zip(*[c.to_pylist() for c in b.columns]))
        out: list[tuple] = []
        for node in nodes(external_sort(rows, runs)):
            out.append(node)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    found = ws.table(distinct.repartitionByRange("key").mapInArrow(merge, NODE), "nodes")
    ws.drop("runs")
    return assembled(found, ws)


def assembled(found: DataFrame, ws: Workspace) -> DataFrame:
    """All nodes, of the NODE rows that tasks have given out: edges are put together, and their finished children learn their conv_id."""
    spine = ws.table(spine_totals(found.where("edge"), ws), "spine")
    above = spine.select(F.col("id").alias("above_id"), F.col("conv_id").alias("above"))

    def shaped(df: DataFrame, parent: Column) -> DataFrame:
        return df.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))

    inner = shaped(found.where("NOT edge AND parent_id IS NULL"), F.col("parent_conv_id"))
    border = shaped(found.where("NOT edge AND parent_id IS NOT NULL").join(above, F.col("parent_id") == F.col("above_id")), F.col("above"))
    return inner.unionByName(border).unionByName(shaped(spine.join(above, F.col("parent_id") == F.col("above_id"), "left"), F.col("above")))
