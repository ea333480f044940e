"""Byte-level BPE by the ``tokenizers`` library, with the ids of each distinct word kept."""

from __future__ import annotations

import gc
import os
import re
from array import array
from itertools import chain

import numpy as np

#: Words whose ids a worker keeps during a task; later words are encoded again each time, which bounds its memory.
KEPT_WORDS = 1_000_000
#: Words that it may keep between tasks; a worker with more drops them all at a task's end, as other stages need the memory.
IDLE_WORDS = 600_000
_MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"  # no apostrophe: it may start a contraction
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_LATIN = re.compile(f" ?[{_LETTERS}]+").fullmatch
_ENDED = re.compile(f"( ?[{_LETTERS}]+)([{re.escape(_MARKS)}]+)").fullmatch
#: How byte-level files write bytes: those of visible Latin-1 characters as themselves, the others from U+0100 on, in order.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_LINE = chr(_BYTE_CHARS[0x0A])
_WRITTEN = np.array([_BYTE_CHARS.get(b, b) for b in range(256)], "<u2")
_RARE = re.compile(r"[^\S \n]").search  # white space other than spaces and line ends
#: For Arrow: a text with white space at an end, in a run, or other than spaces and line ends.
_UNUSUAL = r"^[ \n]|[ \n]$|[ \n][ \n]|[\t\v\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Bytes of text that are encoded at once as a column; a longer text is encoded by itself.
COLUMN_BYTES = 8 << 20


class WordTokenizer:
    """Encodes whole texts exactly as the tokenizer file does, several times as fast.

    The file's pattern always ends a word between a character that isn't white space and a
    white-space character. So a text may be cut before any space that follows another kind of
    character, and each part encoded by itself: every distinct part goes through the library
    once. A part that is empty or ends in white space would move such a cut into a run of white
    space; it's joined with what follows it instead. Null texts count as empty.
    Splitting a new word further, at a line end or before trailing marks, saves most of the work.
    A new word of Latin letters, with one space before it or none, is one word to the pattern too;
    it goes straight to the file's merges, without the passes that find words and keep offsets.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._t = Tokenizer.from_file(path)
        self._t.encode_special_tokens = True
        self._merges = self._t.model
        getattr(self._merges, "_resize_cache", lambda n: None)(0)  # the words are kept here, and each is new to the model
        self._words: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._t.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters; the merges are of bytes, written as characters."""
        if not words:
            return []
        chars, merge = _WRITTEN[np.frombuffer("\n".join(words).encode(), np.uint8)].tobytes().decode("utf-16-le"), self._merges.tokenize
        return [array("I", [t.id for t in merge(x)]).tobytes() for x in chars.split(_LINE)]

    @staticmethod
    def parts(text: str) -> list[str]:
        """The text cut before each space that follows a character other than white space."""
        first, *rest = text.split(" ")
        out, cur = [], first
        for x in rest:
            if cur and not cur[-1].isspace() and cur != " ":
                out.append(cur)
                cur = " " + x
            else:
                cur += " " + x
        out.append(cur)
        return out

    @staticmethod
    def _pieces(word: str) -> list[str]:
        """Parts of a word that the pattern always keeps apart: lines, and a tail of marks."""
        if "\n" in word and word.count("\n") == 1 and word[-1] != "\n":
            a, b = word.split("\n")
            return [*WordTokenizer._pieces(a), "\n", *WordTokenizer._pieces(b)]
        core = word.rstrip(_MARKS)
        return [core, word[len(core) :]] if core != word and core[-1:].isalpha() else [word]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of words not kept; keeps them while there is room."""
        words, split = self._words, {}
        for w in new:
            if m := _ENDED(w):
                split[w] = m.groups()
            elif not w[1:].isalpha() and not _RARE(w) and len(ps := self._pieces(w)) > 1:
                split[w] = ps
        todo = list({p for p in chain(new, *split.values()) if p not in words and p not in split})
        latin = [w for w in todo if _LATIN(w)]
        ids = dict(zip(latin, self._letters(latin)))
        todo = [w for w in todo if w not in ids]
        for i in range(0, len(todo), 4096):
            ids.update(zip(todo[i : i + 4096], self._plain(todo[i : i + 4096])))
        ids.update((w, b"".join([ids[p] if p in ids else words[p] for p in ps])) for w, ps in split.items())
        if len(words) < KEPT_WORDS:
            words.update(ids)
        return ids

    def rest(self) -> None:
        """At a task's end: drop the words if they are many."""
        if len(self._words) > IDLE_WORDS:
            self._words.clear()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        collects = gc.isenabled()
        gc.disable()  # nothing here makes a cycle, and each pass over the kept words takes time
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        get, found, missing = self._words.get, [], {}
        for x in texts:
            p = (x or "").split(" ")
            # The usual text has single spaces only between words: then each part is a space and a word.
            if all(p) and not any(map(str.isspace, [w[-1] for w in p])):
                q = [" " + w for w in p]
                q[0] = p[0]
            else:
                q = self.parts(x or "")
            ids = list(map(get, q))
            if None in ids:
                gaps = [i for i, data in enumerate(ids) if data is None]
                missing.update((q[i], None) for i in gaps)
                found.append((ids, [(i, q[i]) for i in gaps]))
            else:
                found.append((ids, ()))
        learnt = self._learn(list(missing)) if missing else {}
        for ids, gaps in found:
            for i, w in gaps:
                ids[i] = learnt[w]
        return [b"".join(ids) for ids, _ in found]


    def encode_column(self, texts) -> list[bytes]:
        """As ``encode``, of an Arrow column of strings: only distinct words are looked up in Python.

        Usual texts have one space or line end between words and none elsewhere. They are cut
        there, and before trailing marks, by Arrow; others go to ``encode``.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts.fill_null("")
        sizes, out = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64), [b""] * len(texts)
        usual = ~pc.match_substring_regex(texts, _UNUSUAL).to_numpy(zero_copy_only=False) & (sizes <= COLUMN_BYTES)
        for i in np.flatnonzero(~usual).tolist():
            out[i] = self.encode([texts[i].as_py()])[0]
        at, step = np.flatnonzero(usual), np.cumsum(sizes[usual]) // COLUMN_BYTES
        collects = gc.isenabled()
        gc.disable()
        try:
            for k in np.unique(step):
                own = at[step == k]
                for i, data in zip(own.tolist(), self._encode_usual(texts.take(pa.array(own)).cast(pa.string()))):
                    out[i] = data
        finally:
            if collects:
                gc.enable()
        return out

    def _encode_usual(self, texts) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        # Each word starts with its line end, else a space stood before it; a text's first word gets a line end, dropped later.
        lists = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        words = lists.flatten().dictionary_encode()
        found, codes = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
        starts_line = pc.starts_with(found, "\n")
        body = pc.utf8_ltrim(found, "\n")
        core = pc.utf8_rtrim(body, _MARKS)
        split = pc.utf8_is_alpha(core)
        keys = pc.binary_join_element_wise(pc.if_else(starts_line, "", " "), pc.if_else(split, core, body), "").dictionary_encode()
        ids = self._ids(keys.dictionary.to_numpy(zero_copy_only=False).tolist())
        # A word is a line end or nothing, its letters, and its trailing marks or nothing.
        tail_sizes = pc.if_else(split, pc.subtract(pc.binary_length(body), pc.binary_length(core)), 0).to_numpy(zero_copy_only=False)
        tailed = np.flatnonzero(tail_sizes)
        tails = [w[-n:] for w, n in zip(found.take(pa.array(tailed)).to_numpy(zero_copy_only=False).tolist(), tail_sizes[tailed].tolist())]
        place = {"": len(ids), "\n": len(ids) + 1}
        for x in tails:
            place.setdefault(x, len(ids) + len(place))
        ids += [b"", *self._ids(list(place)[1:])]
        pieces = np.full((len(found), 3), place[""], np.int64)
        pieces[:, 0][starts_line.to_numpy(zero_copy_only=False)] = place["\n"]
        pieces[:, 1] = keys.indices.to_numpy(zero_copy_only=False)
        pieces[tailed, 2] = [place[x] for x in tails]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat = _strung(np.frombuffer(b"".join(ids), "<u4"), lengths, pieces.ravel())
        lengths = lengths[pieces].sum(axis=1)
        data = memoryview(_strung(flat, lengths, codes).tobytes())
        ends = np.concatenate([[0], np.cumsum(lengths[codes])])[lists.offsets.to_numpy()] * 4
        return [bytes(data[a + 4 : b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, each learnt if it is new."""
        ids = list(map(self._words.get, words))
        gaps = [i for i, data in enumerate(ids) if data is None]
        latin, rest = [], []
        for i in gaps:
            w = words[i]
            (latin if _LATIN(w) else rest).append(w)
        letters = dict(zip(latin, self._letters(latin)))
        if len(self._words) < KEPT_WORDS:
            self._words.update(letters)
        if rest:
            letters |= self._learn(rest)
        for i in gaps:
            ids[i] = letters[words[i]]
        return ids


def _strung(pool: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs of ``pool``, of these lengths and one behind the other, put together in the order of ``codes``."""
    n = lengths[codes]
    shift = (np.cumsum(lengths) - lengths)[codes] - (np.cumsum(n) - n)
    return pool[np.arange(n.sum(), dtype=np.int32) + np.repeat(shift.astype(np.int32), n)]  # a column's ids are far fewer than 2**31


_SHARED: dict[str, WordTokenizer] = {}


def shared_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a worker."""
    if path not in _SHARED:
        _SHARED[path] = WordTokenizer(path)
    return _SHARED[path]


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
