"""Hierarchical packing: tiers of context sizes, gaps of long windows filled from shorter tiers."""

from __future__ import annotations

import struct
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.llm.tokens import byte_bpe_path, shared_tokenizer

#: Tokens that a task holds before it packs, and of its pool that it keeps for a better fit later.
FLUSH_TOKENS, KEEP_TOKENS = 1 << 20, 1 << 16
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


class TierPacker:
    """Packs pieces (document, start, length) into windows whose sizes are powers of two.

    A document longer than the largest tier fills whole windows of its own; what is left goes to
    the smallest tier that holds it. From the largest tier down, a window is opened for the
    longest piece of the tier; its gap takes the longest pieces of the shorter tiers that fit, and
    at last a part of a piece, cut to close it. What remains at the very end is cut to windows of
    smaller powers of two, so no window needs padding.
    """

    def __init__(self, tiers: list[int]):
        self.tiers = sorted(tiers, reverse=True)
        if any(t < 1 or t & (t - 1) for t in self.tiers):
            raise ValueError("tiers are powers of two")
        self.pool: list[list[tuple[int, int]]] = [[] for _ in range(self.tiers[0] + 1)]
        self.mask, self.tokens = 0, 0  # bit n of mask: the pool has pieces of length n
        self.windows: list[list[tuple[int, int, int]]] = []

    def _put(self, doc: int, start: int, n: int) -> None:
        self.pool[n].append((doc, start))
        self.mask |= 1 << n
        self.tokens += n

    def _take(self, n: int) -> tuple[int, int, int]:
        doc, start = self.pool[n].pop()
        if not self.pool[n]:
            self.mask &= ~(1 << n)
        self.tokens -= n
        return doc, start, n

    def _longest(self, most: int) -> int:
        return (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1 if self.mask else -1

    def add(self, doc: int, n: int) -> None:
        top = self.tiers[0]
        for start in range(0, n - n % top, top):
            self.windows.append([(doc, start, top)])
        if n % top:
            self._put(doc, n - n % top, n % top)

    def _fill(self, size: int) -> None:
        """Close a window of ``size``, for which the pool has tokens enough."""
        window, gap = [], size
        while gap:
            n = self._longest(gap)
            if n > 0:
                window.append(self._take(n))
                gap -= n
                continue
            longer = self.mask >> (gap + 1)
            n = (longer & -longer).bit_length() + gap  # the shortest piece that is too long
            doc, start, n = self._take(n)
            window.append((doc, start, gap))
            self._put(doc, start + gap, n - gap)
            gap = 0
        self.windows.append(window)

    def pack(self, keep: int) -> None:
        """Pack while the pool holds over ``keep`` tokens."""
        for k, tier in enumerate(self.tiers):
            low = self.tiers[k + 1] if k + 1 < len(self.tiers) else 0
            while self.tokens >= max(keep, tier) and self._longest(tier) > low:
                self._fill(tier)

    def finish(self) -> None:
        self.pack(0)
        for tier in self.tiers:
            while self.tokens >= tier:
                self._fill(tier)
        while self.tokens:
            self._fill(1 << (self.tokens.bit_length() - 1))

    def drain(self) -> list[list[tuple[int, int, int]]]:
        out, self.windows = self.windows, []
        return out


def step_groups(windows: list[list[tuple[int, int, int]]], step_tokens: int) -> list[int]:
    """A group number per window. Groups hold windows of one size and ``step_tokens`` tokens; windows are
    dealt back and forth in order of their squared piece lengths, so groups cost attention alike."""
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(windows):
        by_size.setdefault(sum(n for _, _, n in w), []).append(i)
    out, base = [0] * len(windows), 0
    for size in sorted(by_size, reverse=True):
        order = sorted(by_size[size], key=lambda i: -sum(n * n for _, _, n in windows[i]))
        groups = -(-len(order) * size // step_tokens) or 1
        for k, i in enumerate(order):
            lap, pos = divmod(k, groups)
            out[i] = base + (pos if lap % 2 == 0 else groups - 1 - pos)
        base += groups
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, tiers: tuple[int, ...] = (2048, 1024, 512, 256), step_tokens: int = 16384) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    Each task packs what it reads, with a bounded pool, so nothing is shuffled; its numbers start at
    its partition's number times 2**40. A null text is empty and has the end id alone. Null doc_ids
    and repeated rows are packed like others, each row by itself. An empty table gives no rows.
    Further columns are ignored.
    """
    path, tiers = tokenizer or byte_bpe_path(), list(tiers)

    def pack(batches):
        import pyarrow as pa

        tk, base, end = shared_tokenizer(path), TaskContext.get().partitionId() << 40, struct.pack("<I", end_id)
        packer, held, number, group, made = TierPacker(tiers), {}, 0, 0, 0
        names = [x.split()[0] for x in _PIECES.split(", ")]

        def rows(windows):
            nonlocal number, group
            out, groups = [], step_groups(windows, step_tokens)
            for w, g in zip(windows, groups):
                at, size = 0, sum(n for _, _, n in w)
                for key, start, n in w:
                    doc, data = held[key]
                    out.append((doc, start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), len(data) // 4, base + number, at, size, base + group + g))
                    at += n
                number += 1
            group += max(groups, default=-1) + 1
            live = {doc for pieces in packer.pool for doc, _ in pieces}
            for key in [k for k in held if k not in live]:
                del held[key]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names) if out else None

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(doc_ids), 256):
                for doc, data in zip(doc_ids[i : i + 256], tk.encode(texts[i : i + 256].to_pylist())):
                    held[made] = (doc, memoryview(data + end))
                    packer.add(made, len(data) // 4 + 1)
                    made += 1
                if sum(len(d) for _, d in held.values()) >= 4 * FLUSH_TOKENS:
                    packer.pack(KEEP_TOKENS)
                    if (out := rows(packer.drain())) is not None:
                        yield out
        tk.rest()
        packer.finish()
        if (out := rows(packer.drain())) is not None:
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, _PIECES)
