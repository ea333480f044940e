import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cases import documents, texts
from sorrel.llm.packing import TierPacker, pack_documents
from sorrel.llm.tokens import WordTokenizer, byte_bpe_path
from sorrel.llm.wavelet import WaveletShard, pack_shard, tokenize_to_shards


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_bpe_path())
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_words_give_the_same_ids(plain):
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "a", "Foo", "1", "!!", "'s", "\x1c", "\x85", "é", "<|endoftext|>", "\r\n", "漢", "don't", "word.", "A.\n", "x--", "é!", "a\xa0", "1,"]
    some = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    assert [np.frombuffer(b, "<u4").tolist() for b in WordTokenizer(byte_bpe_path()).encode(some)] == [plain(x) for x in some]


def test_columns_give_the_same_ids(plain, monkeypatch):
    import pyarrow as pa

    from sorrel.llm import tokens

    rng = random.Random(2)
    bits = [" ", " ", " ", "  ", "\n", "\n", "\t", "a", "Foo", "1", "!!", "'s", "\x1c", "\x85", "é", "ß", "ǅ", "ª", "\u0301", "<|endoftext|>", "\r\n", "漢", "don't", "word.", "A.\n", "é!", "a\xa0", "\u3000", "\x00", "😀"]
    some = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(6000)] + ["", None, "\n", " ", "a\n.", ".\na", "x" * 3000, "é漢 " * 900]
    want = [plain(x) for x in some]
    for most in (8 << 20, 1000):
        monkeypatch.setattr(tokens, "COLUMN_BYTES", most)
        for column in (pa.array(some), pa.array(some, pa.large_string()), pa.array(["x", *some, "y"])[1:-1]):
            assert [np.frombuffer(b, "<u4").tolist() for b in WordTokenizer(byte_bpe_path()).encode_column(column)] == want
    assert WordTokenizer(byte_bpe_path()).encode_column(pa.array([], pa.string())) == []


def test_a_column_merges_a_word_once():
    import pyarrow as pa

    t, seen = WordTokenizer(byte_bpe_path()), []
    letters = t._letters
    t._letters = lambda words: seen.extend(words) or letters(words)
    t.encode_column(pa.array(["The qwertish, qwertish. The qwertish!\nThe qwertish", "Le qwertish; Le qwertish?"] * 50))
    assert sorted(seen) == [" Le", " The", " qwertish", "Le", "The"]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_wavelet_query(spark, plain):
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenize_to_shards(spark, documents(spark)).collect()]
    want, at = [], 0
    for doc, text in sorted(texts(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = plain(text) + [2]
        want.append((doc, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert tokenize_to_shards(spark, documents(spark, [])).count() == 0


def test_wavelet_structure():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (100, 5), (70_001, 50_000), (40_000, 2)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        shard = WaveletShard(io.BytesIO(pack_shard(ids, [None, 4], [n, 0])))
        assert (shard.decode() == ids).all() and shard.documents() == [(None, n), (4, 0)]
        for i in rng.integers(0, max(n, 1), 20) if n else ():
            token = int(ids[i])
            assert shard.access(int(i)) == token
            assert shard.rank(token, int(i)) == int((ids[:i] == token).sum()) and shard.count(token) == int((ids == token).sum())
        if n:
            token = int(ids[0])
            assert shard.occurrences(token)[:50] == np.flatnonzero(ids == token)[:50].tolist()
            with pytest.raises(IndexError):
                shard.select(token, shard.count(token))
        assert shard.count(1 << 20) == 0


def check_pieces(rows, lengths, top=2048):
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r[0]].append((r[1], r[2]))
        seqs[r[3]].append((r[4], r[2]))
    for parts in (*docs.values(), *seqs.values()):
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
    assert {d: sum(n for _, n in p) for d, p in docs.items()} == lengths
    sizes = [sum(n for _, n in p) for p in seqs.values()]
    assert all(s <= top and s & (s - 1) == 0 for s in sizes)


def test_packer_on_random_lengths():
    rng = random.Random(3)
    for n in (0, 1, 2, 30, 2000):
        p, lengths, rows = TierPacker([256, 2048, 512, 1024]), {}, []
        for d in range(n):
            lengths[d] = rng.choice([1, 2, 255, 256, 257, 2047, 2048, 2049, 5000, rng.randint(1, 700)])
            p.add(d, lengths[d])
            if d % 500 == 499:
                p.pack(1000)
        p.finish()
        for k, w in enumerate(p.drain()):
            at = 0
            for d, s, m in w:
                rows.append((d, s, m, k, at))
                at += m
        check_pieces(rows, lengths)


def test_packing_query(spark, plain):
    rows = [(i, t) for i, t in enumerate(t for _, t in texts())]
    got = pack_documents(documents(spark, rows)).collect()
    ids = {i: plain(t) + [1] for i, t in rows}
    check_pieces([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in got], {i: len(x) for i, x in ids.items()})
    assert all(r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id]) for r in got)
    groups = defaultdict(set)
    for r in got:
        groups[r.step_group].add((r.sequence_id, r.tier))
    assert all(sum(t for _, t in g) <= 16384 for g in groups.values())
    assert pack_documents(documents(spark, texts())).count() > 0 and pack_documents(documents(spark, [])).count() == 0
