"""Distinct sampled segmentations of a text: Gumbel top-k without replacement over the SentencePiece lattice."""

from __future__ import annotations

import heapq
import math
import random
import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
#: Texts that are sampled together, at most, and the characters at which a batch ends.
BATCH_ROWS, BATCH_CHARS = 1024, 400_000
#: Weight of a character that no piece holds, and the factor a character that keeps products of weights near one.
BYTES_WEIGHT, CHAR_SCALE = 1e-5, 20.0
#: Longer words are summed in logarithms, place by place; shorter ones all at once.
LONG_WORD = 64
#: Characters of words whose lattices are built together, and words that are walked together: their arrays stay in a core's cache.
BUILD_CHARS, WALK_WORDS = 1 << 15, 1 << 14
#: Characters, the commonest in pieces first, whose steps have a table.
COMMON_LETTERS = 128
#: Edges of lattices that a worker keeps from batch to batch, and the node at which every word ends.
KEPT_EDGES, END = 6_000_000, 0
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_MODELS: dict[tuple, Lattices] = {}


def mixed(x: np.ndarray, counter) -> np.ndarray:
    """64 bits that depend on ``x`` and the counter."""
    with np.errstate(over="ignore"):
        x = (x ^ np.asarray(counter).astype(np.uint64)) * _MIX[0] + _MIX[0]
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


def uniforms(x: np.ndarray, counter) -> np.ndarray:
    """Numbers in (0, 1) that depend on ``x`` and the counter only: the same row gives the same samples wherever it's read."""
    return ((mixed(x, counter) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Lattices:
    """A model's pieces, and the lattices of words.

    No piece holds a space after another character, so a text's segmentations are all combinations
    of its words'. A character that no piece holds is spelled by its bytes.
    """

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        # Scores of merged pieces are the negative place of their merge: weights fall with it as word frequencies do.
        self.weight = {self.sp.id_to_piece(i): (i, (10.0 + min(n, -self.sp.get_score(i))) ** -alpha) for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))}
        self.bytes = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        spelled = [self._spelling(i) for i in range(n)]
        self.spell_bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.spell_size = np.array([len(x) for x in spelled], np.int64)
        self.spell_start = np.cumsum(self.spell_size) - self.spell_size
        pairs = {x for p in self.weight for x in zip(p, p[1:])}
        if any(SPACE in p.lstrip(SPACE) for p in self.weight):
            raise ValueError("a piece goes on after a space")
        self.words = self._cutter(pairs).findall
        self._trie()
        self._clear()

    def _spelling(self, i: int) -> bytes:
        if self.sp.is_control(i):
            return b""
        return bytes([int(self.sp.id_to_piece(i)[3:5], 16)]) if self.sp.is_byte(i) else self.sp.id_to_piece(i).encode()

    def with_bytes(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with those of its bytes in the place of each character that no piece holds, and where their parts then end."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, ends
        points, which = np.unique(-1 - ids[odd], return_inverse=True)
        codes = [[self.bytes[b] for b in chr(p).encode("utf-8", "replace")] for p in points.tolist()]
        table = np.array([c + [0] * (4 - len(c)) for c in codes], np.int32)
        size, own = np.ones(len(ids), np.int64), np.array([len(c) for c in codes])[which]
        size[odd] = own
        until = np.cumsum(size)
        out, first = np.repeat(ids, size), until[odd] - own
        for k in range(4):
            more = np.flatnonzero(own > k)
            out[first[more] + k] = table[which[more], k]
        return out, np.concatenate([[0], until])[ends]

    def spell(self, ids) -> bytes:
        """The normalised text that the ids stand for, in UTF-8."""
        ids = np.asarray(ids, np.int64)
        size = self.spell_size[ids]
        place = np.repeat(self.spell_start[ids] - (np.cumsum(size) - size), size)
        return self.spell_bytes[place + np.arange(len(place))].tobytes()

    @staticmethod
    def _cutter(pairs: set[tuple[str, str]]) -> re.Pattern:
        """Cuts a text where no piece can lie: before spaces, and between marks that no piece joins with other characters."""
        marks = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\n")
        while bad := {c for c in marks for a, b in pairs if (c == a and b not in marks) or (c == b and a not in marks and a != SPACE)}:
            marks -= bad
        m = "".join(map(re.escape, sorted(marks)))
        return re.compile(f"{SPACE}*(?:[^{SPACE}{m}]+|[{m}]+)|{SPACE}+" if m else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def _trie(self) -> None:
        """Beginnings of pieces as numbered states; a step is looked up by state and character, that of a rare character in a sorted array."""
        states = {"": 0}
        for p in self.weight:
            for k in range(1, len(p) + 1):
                states.setdefault(p[:k], len(states))
        used = Counter(c for p in self.weight for c in p)
        letters = sorted(used, key=lambda c: (-used[c], c))
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        steps = [(states[p[:-1]], int(self.code[ord(p[-1])]), k) for p, k in states.items() if p]
        self.table = np.zeros(len(states) * COMMON_LETTERS, np.int32)
        for state, code, k in steps:
            if code < COMMON_LETTERS:
                self.table[state * COMMON_LETTERS + code] = k
        rare = sorted((state * self.letters + code, k) for state, code, k in steps if code >= COMMON_LETTERS)
        self.step_key, self.step_to = np.array([k for k, _ in rare] or [-1], np.int64), np.array([k for _, k in rare] or [0], np.int32)
        self.state_piece, self.state_weight = np.full(len(states), -1, np.int32), np.zeros(len(states))
        for p, (i, w) in self.weight.items():
            self.state_piece[states[p]], self.state_weight[states[p]] = i, w * CHAR_SCALE ** len(p)

    def _step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states after a character; 0 where no piece begins so."""
        out = self.table.take(state.astype(np.int64) * COMMON_LETTERS + np.minimum(code, COMMON_LETTERS - 1))
        rare = np.flatnonzero(code >= COMMON_LETTERS - 1)
        if len(rare):
            key = state[rare].astype(np.int64) * self.letters + code[rare]
            at = np.minimum(np.searchsorted(self.step_key, key), len(self.step_key) - 1)
            known = np.where(self.step_key[at] == key, self.step_to[at], 0)
            out[rare] = np.where(code[rare] >= COMMON_LETTERS, known, out[rare])
        return out

    def nodes(self, words: list[str]) -> np.ndarray:
        """Each word's first place in the graph; builds what it lacks. All kept lattices go when they are many, which bounds a worker's memory."""
        if self.graph.edges > KEPT_EDGES:
            self._clear()
        found = list(map(self.place.get, words))
        if None in found:
            new = list(dict.fromkeys([w for w, at in zip(words, found) if at is None]))
            lengths = np.fromiter(map(len, new), np.int64, len(new))
            ends, at = np.cumsum(lengths), 0
            starts = (self.graph.nodes + ends - lengths).tolist()
            while at < len(new):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BUILD_CHARS)))
                self.graph.append(*self._part(new[at:to], lengths[at:to], self.graph.nodes))
                at = to
            self.place.update(zip(new, starts))
            for i in [i for i, at in enumerate(found) if at is None]:
                found[i] = self.place[words[i]]
        return np.array(found, np.int64)

    def _clear(self) -> None:
        self.place, self.graph = {}, Graph()

    def _part(self, words: list[str], lengths: np.ndarray, base: int) -> tuple[np.ndarray, ...]:
        """(edges of each place, their targets, pieces and shares) of some words, whose first place is ``base``."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        n, starts = len(points), np.cumsum(lengths) - lengths
        end, code = np.repeat(starts + lengths, lengths), self.code[points]
        at = np.arange(n)
        state, found, k = self._step(np.zeros(n, np.int32), code), [], 1
        alone = np.flatnonzero(self.state_piece[state] < 0)
        found.append((alone, alone + 1, -1 - points[alone].astype(np.int32), np.full(len(alone), BYTES_WEIGHT * CHAR_SCALE)))
        while len(at):
            pieces = self.state_piece[state]
            hit = np.flatnonzero(pieces >= 0)
            found.append((at[hit], at[hit] + k, pieces[hit], self.state_weight[state[hit]]))
            on = np.flatnonzero((state > 0) & (at + k < end[at]))
            at, state = at[on], self._step(state[on], code[at[on] + k])
            k += 1
        count = np.bincount(np.concatenate([f[0] for f in found]), minlength=n).astype(np.int32)
        first = np.zeros(n + 1, np.int64)
        np.cumsum(count, out=first[1:])
        filled, total = first[:-1].copy(), int(first[-1])
        target, piece, weight = np.empty(total, np.int64), np.empty(total, np.int32), np.empty(total)
        for where, to, pieces, w in found:
            slot = filled[where]
            filled[where] += 1
            target[slot], piece[slot], weight[slot] = np.where(to == end[where], n, to), pieces, w
        q = self._shares(first, count, target, weight, end, starts, lengths)
        return count, np.where(target == n, END, target + base), piece, q

    @staticmethod
    def _shares(first, count, target, weight, end, starts, lengths) -> np.ndarray:
        """Each edge's share of the weight of all ways from its place to the word's end."""
        n = len(end)
        source = np.repeat(np.arange(n), count)
        left = end - np.arange(n)  # characters to the word's end
        total = np.zeros(n + 1)
        total[n] = 1.0
        long_words = np.flatnonzero(lengths > LONG_WORD)
        edges = np.flatnonzero(np.repeat(lengths <= LONG_WORD, lengths)[source]) if len(long_words) else np.arange(len(source))
        level = left[source[edges]].astype(np.uint8)
        edges = edges[np.argsort(level, kind="stable")]
        bounds = np.cumsum(np.bincount(level, minlength=1))
        for k in range(1, len(bounds)):
            own = edges[bounds[k - 1] : bounds[k]]
            if len(own):
                src = source[own]
                heads = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
                total[src[heads]] = np.add.reduceat(weight[own] * total[target[own]], heads)
        with np.errstate(divide="ignore", invalid="ignore"):
            q = weight * total[target] / total[source]
        q[count[source] == 1] = 1.0
        for w in long_words:
            logs = {n: 0.0}
            for i in range(int(starts[w] + lengths[w]) - 1, int(starts[w]) - 1, -1):
                lo, hi = int(first[i]), int(first[i + 1])
                ways = [math.log(x) + logs[t] for x, t in zip(weight[lo:hi].tolist(), target[lo:hi].tolist())]
                top = max(ways)
                logs[i] = top + math.log(sum([math.exp(x - top) for x in ways]))
                q[lo:hi] = [math.exp(x - logs[i]) for x in ways] if hi - lo > 1 else 1.0
        return q


@dataclass
class Draw:
    """A segmentation of each word: the edges, how many stand before each word, and the words' log probabilities."""

    edges: np.ndarray
    ends: np.ndarray
    logs: np.ndarray


class Graph:
    """Lattices of words as one growing graph: a node is a place in a word, an edge a piece that leads to the place after it.

    A node's edges are those from first[node] to first[node + 1]; END, which has none, is the end of
    every word. An edge's q is its share of the weight of all ways from its start to the word's end,
    so a walk from a word's first place draws a segmentation in proportion to the product of its
    pieces' weights. A negative piece is a character that is spelled by its bytes.
    """

    def __init__(self):
        self.nodes, self.edges = 1, 0
        self.first = np.zeros(KEPT_EDGES // 2, np.int64)
        self.target, self.piece, self.q = np.empty(KEPT_EDGES, np.int64), np.empty(KEPT_EDGES, np.int32), np.empty(KEPT_EDGES)

    def append(self, count: np.ndarray, target: np.ndarray, piece: np.ndarray, q: np.ndarray) -> None:
        """Add nodes with ``count`` edges each; there is room for what is usually kept, and more is made by halves."""
        def grown(array: np.ndarray, size: int) -> np.ndarray:
            return array if size <= len(array) else np.concatenate([array, np.zeros(max(size - len(array), len(array) // 2), array.dtype)])

        nodes, edges = self.nodes + len(count), self.edges + len(q)
        self.first = grown(self.first, nodes + 1)
        self.first[self.nodes + 1 : nodes + 1] = self.edges + np.cumsum(count)
        self.target, self.piece, self.q = grown(self.target, edges), grown(self.piece, edges), grown(self.q, edges)
        self.target[self.edges : edges], self.piece[self.edges : edges], self.q[self.edges : edges] = target, piece, q
        self.nodes, self.edges = nodes, edges

    def walk(self, nodes: np.ndarray, noise: np.ndarray, draw: int) -> Draw:
        """A way from each node to the end."""
        parts = [self._walk(nodes[i : i + WALK_WORDS], noise[i : i + WALK_WORDS], draw) for i in range(0, len(nodes), WALK_WORDS)]
        sizes, edges = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in range(2))
        ends = np.zeros(len(nodes) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        return Draw(edges, ends, np.concatenate([p[2] for p in parts] or [np.zeros(0)]))

    def _walk(self, nodes: np.ndarray, noise: np.ndarray, draw: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edges of each way, the edges, the ways' log probabilities). One uniform number serves three steps: what a choice leaves of it is uniform again."""
        first, q, target = self.first, self.q, self.target
        at, who, u, level = nodes, np.arange(len(nodes)), np.zeros(0), 0
        seen: list[tuple] = []
        while len(at) > 16:
            if level % 3 == 0:
                u = uniforms(noise.take(who), (draw << 32) + level)
            edge, stop = first.take(at), first.take(at + 1) - 1
            share = q.take(edge)
            behind = np.flatnonzero((u >= share) & (edge < stop))
            while len(behind):
                rest, e = u.take(behind) - share.take(behind), edge.take(behind) + 1
                now = q.take(e)
                u[behind], edge[behind], share[behind] = rest, e, now
                behind = behind.compress((rest >= now) & (e < stop.take(behind)))
            u = u / share
            seen.append((who, edge, level, share))
            at = target.take(edge)
            on = np.flatnonzero(at != END)
            at, who, u, level = at.take(on), who.take(on), u.take(on), level + 1
        for k in range(len(at)):  # a few long words: one by one
            edges = np.array(self._walk_one(int(at[k]), float(u[k]) if level % 3 else 0.0, noise[who[k]], draw, level), np.int64)
            seen.append((np.full(len(edges), who[k]), edges, np.arange(level, level + len(edges)), q[edges]))
        sizes = np.bincount(np.concatenate([s[0] for s in seen]), minlength=len(nodes))
        starts = np.cumsum(sizes) - sizes
        out, logs = np.empty(int(sizes.sum()), np.int64), np.empty(int(sizes.sum()))
        for w, e, lv, share in seen:
            place = starts.take(w) + lv
            out[place] = e
            logs[place] = share
        return sizes, out, np.add.reduceat(np.log(logs), starts)

    def _walk_one(self, at: int, u: float, noise: np.uint64, draw: int, level: int) -> list[int]:
        first, q, target, edges, fresh = self.first, self.q, self.target, [], iter(())
        while at != END:
            if level % 3 == 0:
                if (x := next(fresh, None)) is None:
                    fresh = iter(uniforms(np.full(256, noise), (draw << 32) + level + 3 * np.arange(256)).tolist())
                    x = next(fresh)
                u = x
            edge, stop = int(first[at]), int(first[at + 1]) - 1
            while u >= (share := float(q[edge])) and edge < stop:
                u -= share
                edge += 1
            u /= share
            edges.append(edge)
            at = int(target[edge])
            level += 1
        return edges

    def others(self, node: int, barred: list[list[int]]) -> tuple[list[dict[int, int]], list[float]]:
        """The barred ways from ``node`` as a tree of edges (a dict for each place), and the mass of the ways beside them from each place on, as sums of positive terms."""
        tree, at = [{}], [node]
        for way in barred:
            i = 0
            for e in way:
                if e not in tree[i]:
                    tree[i][e] = len(tree)
                    tree.append({})
                    at.append(int(self.target[e]))
                i = tree[i][e]
        mass = [0.0] * len(tree)
        for i in range(len(tree) - 1, -1, -1):
            if at[i] != END:
                lo, hi = int(self.first[at[i]]), int(self.first[at[i] + 1])
                mass[i] = sum([q if (child := tree[i].get(lo + k)) is None else q * mass[child] for k, q in enumerate(self.q[lo:hi].tolist())])
        return tree, mass

    def other(self, node: int, barred: list[list[int]], rng: random.Random) -> list[int]:
        """A way from ``node`` to the end that isn't one of ``barred`` (there is another), in proportion to its probability."""
        (tree, mass), edges, i = self.others(node, barred), [], 0
        while node != END:
            lo, hi = int(self.first[node]), int(self.first[node + 1])
            share = self.q[lo:hi].tolist()
            if i is not None:
                share = [q if (child := tree[i].get(lo + k)) is None else q * mass[child] for k, q in enumerate(share)]
            u, edge = rng.random() * sum(share), lo + max(range(hi - lo), key=share.__getitem__)
            for k, x in enumerate(share):
                u -= x
                if u < 0:
                    edge = lo + k
                    break
            i = None if i is None else tree[i].get(edge)
            edges.append(edge)
            node = int(self.target[edge])
        return edges


def shared_lattices(path: str, alpha: float) -> Lattices:
    if (path, alpha) not in _MODELS:
        _MODELS[path, alpha] = Lattices(path, alpha)
    return _MODELS[path, alpha]


class _Sample:
    """A segmentation of a text: its edges and log probability, and the draw from which its words come after the ``j``-th of ``old``'s; tables are made when they are asked for."""

    def __init__(self, value: float, edges: np.ndarray, total: float, ends: np.ndarray, logs: np.ndarray, old: _Sample | None = None, j: int = -1, before: int = 0, at: float = 0.0):
        self.value, self.edges, self.total = value, edges, total
        self.made, self.parts = None, (ends, logs, old, j, before, at)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """(edges before each word, log probability of the words before each word)."""
        if self.made is None:
            ends, logs, old, j, before, at = self.parts
            if old is None:
                self.made = ends - ends[0], np.concatenate([[0.0], np.cumsum(logs)])
            else:
                old_ends, old_logs = old.tables()
                self.made = np.concatenate([old_ends[: j + 1], before + ends[j + 1 :] - ends[j + 1]]), np.concatenate([old_logs[: j + 1], [at], at + np.cumsum(logs[j + 1 :])])
            self.parts = None
        return self.made


class _Search:
    """One text's search. A set of segmentations is what shares the words before ``lo`` with a sample and
    first differs from it in a word before ``hi``, or, with barred ways, what shares the words before
    ``lo`` with it and goes another way in that word than all of those."""

    def __init__(self, graph: Graph, starts: np.ndarray, key: int):
        self.graph, self.starts, self.rng = graph, starts, random.Random(key)
        self.samples: list[_Sample] = []
        self.heap = [(math.log(-math.log(self.rng.random() or 0.5)), 0, None)]
        self.made = 0

    def _push(self, value: float, mass: float, part: tuple) -> None:
        """Add a set with a bound: a Gumbel of its mass, cut off at ``value``."""
        g = mass - math.log(-math.log(self.rng.random() or 0.5))
        hi, lo = max(-value, -g), min(-value, -g)
        self.made += 1
        heapq.heappush(self.heap, (hi + math.log1p(math.exp(lo - hi)), self.made, part))

    def _push_range(self, value: float, s: int, lo: int, hi: int, log_lo: float, log_hi: float) -> None:
        """Add what leaves a sample in the words from ``lo`` to ``hi``; the logs are those of the sample's words before them."""
        if lo < hi and (less := log_hi - log_lo) < 0:
            self._push(value, log_lo + math.log(-math.expm1(less)), (s, lo, hi, None))

    def next(self, edges: np.ndarray, ends: np.ndarray, logs: np.ndarray) -> bool:
        """Add the next sample; the arguments are an independent draw of the whole text, whose words it takes after the one that differs."""
        if not self.heap:
            return False
        bound, _, part = heapq.heappop(self.heap)
        value, d, n = -bound, len(self.samples), len(self.starts)
        if part is None:
            self.samples.append(_Sample(value, edges, total := float(logs.sum()), ends, logs))
            self._push_range(value, d, 0, n, 0.0, total)
            return True
        s, j, hi, barred = part
        old = self.samples[s]
        old_ends, old_logs = old.tables()
        if barred is None:
            # The word in which the set's best member leaves the sample, in proportion to the words' parts of the set.
            lost = old_logs[j : hi + 1] - old_logs[j]
            u = max(math.log1p(self.rng.random() * math.expm1(float(lost[-1]))), float(lost[-1]))
            lo, j = j, j + max(0, int(np.searchsorted(-lost[1:], -u)))
            self._push_range(value, s, lo, j, float(old_logs[lo]), float(old_logs[j]))
            self._push_range(value, s, j + 1, hi, float(old_logs[j + 1]), float(old_logs[hi]))
            barred = [old.edges[old_ends[j] : old_ends[j + 1]].tolist()]
        way = self.graph.other(int(self.starts[j]), barred, self.rng)
        start, before = float(old_logs[j]), int(old_ends[j])
        at = start + sum([math.log(x) for x in self.graph.q[way].tolist()])
        total = at + float(logs[j + 1 :].sum())
        self.samples.append(_Sample(value, np.concatenate([old.edges[:before], way, edges[int(ends[j + 1] - ends[0]) :]]), total, ends, logs, old, j, before + len(way), at))
        barred = [*barred, way]
        rest = self.graph.others(int(self.starts[j]), barred)[1][0]
        if rest > 0:
            self._push(value, start + math.log(rest), (d, j, j + 1, barred))
        self._push_range(value, d, j + 1, n, at, total)
        return True

    def threshold(self) -> float:
        """The largest bound of what was not drawn."""
        return -self.heap[0][0] if self.heap else -math.inf


def sample_segmentations(lattices: Lattices, texts: list[str], keys: list[int], k: int) -> list[list[tuple[float, float, float, np.ndarray]]]:
    """For each text at most ``k`` distinct segmentations: (perturbed log probability, log probability, inclusion score, piece ids), best first.

    A set of segmentations has a bound: the largest of its members' Gumbel-perturbed log
    probabilities, drawn without looking at the members. The search takes the set of the largest
    bound (A-star; the bound is exact), draws the member that attains it, and splits the rest by the
    first word in which they leave it; each part's bound is a Gumbel of its mass, cut off at the
    bound of the whole. So the samples are those of the k largest perturbed values of all
    segmentations. The next bound is the threshold of the inclusion score, the chance that a
    segmentation's perturbed value lies over it. Words that a split leaves free are drawn for the
    whole batch at once.
    """
    cut = [lattices.words(t) for t in texts]
    bounds, words = np.cumsum([0, *map(len, cut)]), list(chain.from_iterable(cut))
    nodes, graph = lattices.nodes(words), lattices.graph
    del cut, words
    row = np.repeat(mixed(np.array(keys, np.int64).view(np.uint64), 0), np.diff(bounds))
    noise = mixed(row, np.arange(len(nodes)) - np.repeat(bounds[:-1], np.diff(bounds)))
    rows = [_Search(graph, nodes[a:b], key) for a, b, key in zip(bounds[:-1], bounds[1:], keys)]
    live = list(range(len(rows)))
    for turn in range(k):
        if not live:
            break
        draw, going = graph.walk(nodes, noise, turn), []
        for i in live:
            a, b = int(bounds[i]), int(bounds[i + 1])
            ends = draw.ends[a : b + 1]
            if rows[i].next(draw.edges[ends[0] : ends[-1]], ends, draw.logs[a:b]):
                going.append(i)
        live = going
    # The pieces of all samples at once; then each sample's part.
    samples = [s for r in rows for s in r.samples]
    ids = graph.piece.take(np.concatenate([s.edges for s in samples])) if samples else np.zeros(0, np.int32)
    ids, ends = lattices.with_bytes(ids, np.cumsum([len(s.edges) for s in samples]))
    parts = np.split(ids, ends[:-1]) if samples else []
    at, out = iter(parts), []
    for r in rows:
        least = r.threshold()
        out.append([(s.value, lp := s.total, -math.expm1(-math.exp(min(700.0, lp - least))), next(at)) for s in r.samples])
    return out


def segmentations(spark: SparkSession, docs: DataFrame, model: str | None = None, k: int = 3, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """(doc_id, draw, perturbed, log_prob, inclusion, n_pieces, pieces array<int>, decodes) of each row's samples; ``decodes``: whether the ids spell the normalised text.

    The seed of a row is its doc_id (with ``seed``), so equal rows give equal samples; a null doc_id
    has a seed of its own. A null text is empty; an empty text has one segmentation, without pieces.
    A text with fewer segmentations than ``k`` gives all it has. Texts are sampled whole, with or
    without spaces, in memory that grows with their length. An empty table gives no rows. Further
    columns are ignored.
    """
    path = model or piece_bpe_path()

    def run(batches):
        import pyarrow as pa

        lat = shared_lattices(path, alpha)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                part, size = [], 0
                while at + len(part) < len(ids) and len(part) < BATCH_ROWS and size < BATCH_CHARS:
                    part.append(texts[at + len(part)].as_py() or "")
                    size += len(part[-1])
                own = ids[at : at + len(part)]
                norms = [lat.sp.normalize(t) if t else "" for t in part]
                found = sample_segmentations(lat, norms, [((-1 if i is None else i) * 1_000_003 + seed) % 2**62 for i in own], k)
                at += len(part)
                rows = [(i, d, *s[:3], len(s[3])) for i, f in zip(own, found) for d, s in enumerate(f)]
                drawn = [s[3] for f in found for s in f]
                ids_ = np.concatenate(drawn) if drawn else np.zeros(0, np.int32)
                ends = np.cumsum([0, *map(len, drawn)])
                spelled, bytes_to = lat.spell(ids_), np.concatenate([[0], np.cumsum(lat.spell_size[ids_])])[ends].tolist()
                wanted = (text for f, text in zip(found, [n.encode("utf-8", "replace") for n in norms]) for _ in f)
                same = [j - i == len(text) and spelled[i:j] == text for i, j, text in zip(bytes_to, bytes_to[1:], wanted)]
                pieces = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids_, pa.int32()))
                kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(zip(*rows), kinds)], pieces, pa.array(same, pa.bool_())], ["doc_id", "draw", "perturbed", "log_prob", "inclusion", "n_pieces", "pieces", "decodes"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, draw int, perturbed double, log_prob double, inclusion double, n_pieces int, pieces array<int>, decodes boolean")


def decode_segmentations(found: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, draw, text) for each row of (doc_id, draw, pieces): the ids as text. No ids, or null, are an empty text. Further columns are ignored."""
    path = model or piece_bpe_path()

    def run(batches):
        import pyarrow as pa

        sp = shared_lattices(path, 1.0).sp
        for batch in batches:
            texts = [sp.decode(ids) if ids else "" for ids in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "draw", "text"])

    return found.select("doc_id", "draw", "pieces").mapInArrow(run, "doc_id long, draw int, text string")


def segmentation_report(spark: SparkSession, docs: DataFrame, k: int = 3) -> DataFrame:
    """The samples with a hash in the place of their ids (XXH64 of them in their order) and whether they decode to the text."""
    found = segmentations(spark, docs, k=k)
    return found.select("doc_id", "draw", "perturbed", "log_prob", "inclusion", "n_pieces", F.xxhash64("pieces").alias("ids_hash"), "decodes")


def piece_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
