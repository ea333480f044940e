"""Token shards as wavelet matrices: one compressed file answers access, count, rank and occurrences."""

from __future__ import annotations

import json
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sorrel.llm.tokens import byte_bpe_path, shared_tokenizer
from sorrel.llm.workspace import CommittedFile, Workspace, open_input

MAGIC = b"SWM1"
BLOCK = 1 << 15  # bits in a block that is compressed by itself
SHARD_TOKENS = 4 << 20
_SHARDS = "file string, part long, seq long, docs long, tokens long"
_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long, file string"


def pack_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file: a header with the place of every part, then documents, rank directories and blocks of bits."""
    import zstandard

    z, body, parts, at = zstandard.ZstdCompressor(level=3), [], {}, 0

    def put(name: str, data: bytes) -> None:
        nonlocal at
        parts[name] = (at, len(data))
        body.append(data)
        at += len(data)

    put("doc_ids", z.compress(np.array([x or 0 for x in doc_ids], "<i8").tobytes()))
    put("null_ids", z.compress(np.array([x is None for x in doc_ids], "u1").tobytes()))
    put("lengths", z.compress(np.array(lengths, "<i8").tobytes()))
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    seq, zeros = ids.astype(np.uint16 if bits <= 16 else np.uint32), []
    spare = np.empty_like(seq)
    for level in range(bits):
        one = (seq & seq.dtype.type(1 << (bits - 1 - level))) != 0
        packed = np.packbits(one, bitorder="little")
        filled = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        filled[: len(packed)] = packed
        ones = np.bitwise_count(filled.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
        packed = packed.tobytes()
        blocks = [z.compress(packed[i : i + BLOCK // 8]) for i in range(0, len(packed), BLOCK // 8)]
        put(f"ranks{level}", z.compress(np.concatenate([[0], np.cumsum(ones)]).astype("<i8").tobytes()))
        put(f"places{level}", z.compress(np.cumsum([0, *map(len, blocks)]).astype("<i8").tobytes()))
        put(f"bits{level}", b"".join(blocks))
        zeros.append(int(len(one) - ones.sum()))
        np.compress(~one, seq, out=spare[: zeros[-1]])
        np.compress(one, seq, out=spare[zeros[-1] :])
        seq, spare = spare, seq
    head = json.dumps({"n": len(ids), "docs": len(doc_ids), "bits": bits, "zeros": zeros, "parts": parts}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(body)


class WaveletShard:
    """Reads a shard file; single tokens need a block of each level only."""

    def __init__(self, stream):
        import zstandard

        self._f, self._z = stream, zstandard.ZstdDecompressor()
        if stream.read(4) != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack("<I", stream.read(4))
        head = json.loads(stream.read(size))
        self.n, self.docs, self.bits, self.zeros, self._parts, self._base = head["n"], head["docs"], head["bits"], head["zeros"], head["parts"], 8 + size
        self._array = lru_cache(None)(self._array)
        self._block = lru_cache(256)(self._block)

    def _raw(self, name: str, start: int = 0, size: int | None = None) -> bytes:
        at, n = self._parts[name]
        self._f.seek(self._base + at + start)
        return self._f.read(n - start if size is None else size)

    def _array(self, name: str, kind: str = "<i8") -> np.ndarray:
        return np.frombuffer(self._z.decompress(self._raw(name)), kind)

    def _block(self, level: int, k: int) -> np.ndarray:
        places = self._array(f"places{level}")
        data = self._z.decompress(self._raw(f"bits{level}", int(places[k]), int(places[k + 1] - places[k])))
        return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")

    def _rank1(self, level: int, i: int) -> int:
        k, r = divmod(i, BLOCK)
        return int(self._array(f"ranks{level}")[k]) + (int(self._block(level, k)[:r].sum()) if r else 0)

    def _step(self, level: int, bit: int, i: int) -> int:
        ones = self._rank1(level, i)
        return self.zeros[level] + ones if bit else i - ones

    def access(self, i: int) -> int:
        """The token at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(self.bits):
            bit = int(self._block(level, i // BLOCK)[i % BLOCK])
            token, i = token << 1 | bit, self._step(level, bit, i)
        return token

    def _range(self, token: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        if token < 0 or token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            bit = token >> (self.bits - 1 - level) & 1
            lo, hi = self._step(level, bit, lo), self._step(level, bit, hi)
        return lo, hi

    def rank(self, token: int, end: int) -> int:
        """How often ``token`` stands before position ``end``."""
        lo, hi = self._range(token, min(max(end, 0), self.n))
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The position of the ``k``-th occurrence (from 0)."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        ranks = self._array(f"ranks{level}")
        seen = ranks if bit else np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        b = int(np.searchsorted(seen, k, "right")) - 1
        return b * BLOCK + int(np.flatnonzero(self._block(level, b) == bit)[k - int(seen[b])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def documents(self) -> list[tuple[int | None, int]]:
        """(doc_id, tokens) in file order."""
        ids, null, n = self._array("doc_ids"), self._array("null_ids", "u1"), self._array("lengths")
        return [(None if x else int(i), int(k)) for i, x, k in zip(ids, null, n)]

    def decode(self) -> np.ndarray:
        """All tokens, from the last level up: each level puts back the order it was split from."""
        seq = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            places, data = self._array(f"places{level}"), self._raw(f"bits{level}")
            packed = b"".join(self._z.decompress(data[places[k] : places[k + 1]]) for k in range(len(places) - 1))
            one = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n, bitorder="little").astype(bool)
            out = np.empty_like(seq)
            out[np.flatnonzero(~one)] = seq[: self.zeros[level]]
            out[np.flatnonzero(one)] = seq[self.zeros[level] :] | seq.dtype.type(1 << (self.bits - 1 - level))
            seq = out
        return seq


def write_shards(docs: DataFrame, ws: Workspace, tokenizer: str, end_id: int) -> DataFrame:
    """Encode documents in ascending doc_id order (nulls first, ties by a hash of the text) and write shard files.

    Texts are dealt into ranges of the order, so tasks hold runs of it, and each task cuts its run
    into shards of about four million tokens. A doc_id that many texts share may span ranges.
    """
    folder = ws.sub("shards")

    def write(batches):
        import pyarrow as pa

        tk, part, done = shared_tokenizer(tokenizer), TaskContext.get().partitionId(), []
        end, ids, names, sizes, held = struct.pack("<I", end_id), [], [], [], 0

        def flush():
            nonlocal ids, names, sizes, held
            out = CommittedFile(folder, f"part-{part:06d}-{len(done):04d}", ".swm")
            out.write(pack_shard(np.frombuffer(b"".join(ids), "<u4"), names, sizes))
            done.append((out.close(), part, len(done), len(names), held))
            ids, names, sizes, held = [], [], [], 0

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(doc_ids), 4096):
                for doc, data in zip(doc_ids[i : i + 4096], tk.encode_column(texts[i : i + 4096])):
                    ids += [data, end]
                    names.append(doc)
                    sizes.append(len(data) // 4 + 1)
                    held += sizes[-1]
                    if held >= SHARD_TOKENS:
                        flush()
        tk.rest()
        if names:
            flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), *[pa.int64()] * 4))], [x.split()[0] for x in _SHARDS.split(", ")])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.withColumn("tie", F.xxhash64("text"))
    return ws.table(src.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").mapInArrow(write, _SHARDS), "shard-files")


def read_shards(shards: DataFrame, folder: str, tasks: int) -> DataFrame:
    """Per document, from the files: its place in the whole order, its tokens and their checksum."""
    # Ranges are numbered in their order; a row for each of them, then the shards within a range.
    ranges = shards.groupBy("part").agg(F.sum("tokens").alias("held")).withColumn("before", F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held"))
    within = F.sum("tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    placed = shards.join(ranges.select(F.col("part").alias("range"), "before"), F.col("part") == F.col("range")).withColumn("base", F.col("before") + within)

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for file, base in zip(*(c.to_pylist() for c in batch.columns)):
                shard = WaveletShard(open_input(folder, file))
                ids, rows, at = shard.decode().astype("<u4"), [], 0
                for doc, n in shard.documents():
                    rows.append((doc, base + at, n, zlib.crc32(ids[at : at + n]), file))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int64()] * 4, pa.string()))], [x.split()[0] for x in _DOCS.split(", ")])

    return placed.select("file", "base").repartition(tasks).mapInArrow(read, _DOCS)


def tokenize_to_shards(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Encode whole texts, append ``end_id``, write wavelet shards and return per-document rows read back from them.

    A null text is empty and has the end id alone. Null doc_ids come first. Repeated rows are kept.
    A text may be as long as a task can hold. An empty table gives no shard and no rows. Further
    columns are ignored.
    """
    ws = Workspace(spark, "wavelet")
    shards = write_shards(docs, ws, tokenizer or byte_bpe_path(), end_id)
    n = shards.count()
    return read_shards(shards, ws.sub("shards"), max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 8))))
