"""Segmentation lattices of a SentencePiece vocabulary and exact top-k sampling from them, in numpy.

A text is cut before runs of spaces and at line ends, which no piece crosses (pieces hold spaces
in front or are runs of them), so its lattice is a chain of small lattices, one a chunk. A lattice node is a character position; its edges are the
pieces that start there, at most 16 characters long. Lattices of distinct chunks are
built together and kept while they fit a bounded cache.

Weights: a piece of rank r has the Zipf log-probability -ln(r + 2) times ``theta`` (the
vocabulary is of the merge kind, whose scores are ranks); a character without a piece
falls back to its bytes. Backward sums give each edge its exact conditional probability.

Sampling without replacement (Gumbel top-k as A-star search): the whole space has a
Gumbel maximum and a segmentation drawn by the conditionals. Taking it splits what is left
into the subtrees that leave its path, one a step; each gets its own maximum, truncated
at its parent's, which is an exact bound of everything inside. The next sample is drawn in
the subtree of the largest maximum. All steps of all texts run as arrays.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

LONGEST = 16
SPACE = "▁"
BYTE0 = 3  # id of <0x00>
_FALLBACK = 0xFFFF
#: Nodes (characters of distinct chunks) whose lattices are kept, and characters worked on at once.
CACHE, CHUNK = 700_000, 150_000
_G = np.uint64(0x9E3779B97F4A7C15)


def uniform(key: np.ndarray, stream: int, at: np.ndarray) -> np.ndarray:
    """Uniforms in (0, 1) that depend on the row key, a stream number and a position only."""
    x = key + np.uint64((stream * 0xD1B54A32D192ED03) & (2**64 - 1)) + at.astype(np.uint64) * _G
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    theta: float = 1.0

    def __post_init__(self):
        self.bytes = [b""] * len(self.pieces)
        usable = {}
        for i, (p, s) in enumerate(zip(self.pieces, self.scores)):
            if m := re.fullmatch("<0x([0-9A-F]{2})>", p):
                self.bytes[i] = bytes([int(m[1], 16)])
            elif i > 2:
                self.bytes[i] = p.replace(SPACE, " ").encode()
                if len(p) <= LONGEST:
                    usable[p] = (i, -self.theta * np.log(2 + min(-s, len(self.pieces))))
        self.byte_weight = -self.theta * np.log(2 + len(self.pieces))
        nodes: dict[int, int] = {}
        ends: dict[int, tuple[int, float]] = {}
        for p, end in usable.items():
            at = 0
            for c in p:
                at = nodes.setdefault(at << 21 | ord(c), len(nodes) + 1)
            ends[at] = end
        self.id_of, self.weight_of = np.full(len(nodes) + 1, -1, np.int32), np.full(len(nodes) + 1, -np.inf)
        for n, (i, w) in ends.items():
            self.id_of[n], self.weight_of[n] = i, w
        size = 1 << max(4, (4 * len(nodes)).bit_length())
        self._shift, self._keys, self._next = np.uint64(64 - size.bit_length() + 1), np.full(size + 64, -1, np.int64), np.zeros(size + 64, np.int32)
        slots = (np.fromiter(nodes, np.uint64, len(nodes)) * _G) >> self._shift
        self._probes = 1
        for slot, (key, to) in zip(slots.tolist(), nodes.items()):
            first = slot
            while self._keys[slot] >= 0:
                slot += 1
            self._keys[slot], self._next[slot] = key, to
            self._probes = max(self._probes, slot - first + 1)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Trie transitions; 0 where there is none."""
        key = node.astype(np.int64) << 21 | char
        slot = ((key.astype(np.uint64) * _G) >> self._shift).astype(np.int64)
        found = self._keys[slot]
        out = np.where(found == key, self._next[slot], 0)
        todo = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(self._probes - 1):
            if not len(todo):
                break
            slot[todo] += 1
            found = self._keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self._next[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


#: By node and edge length: cumulative conditional probability, its log, log probability of the other edges, piece.
_TABLES = (("below", np.float32), ("log", np.float32), ("other", np.float32), ("piece", np.uint16))


_spaces = re.compile(" ( *[^ ]*)")


def _runs(line: str, first: bool) -> list[str]:
    """The line's words, each with the spaces in front of it but one. The text's first line has one more space in front."""
    if first:
        return _spaces.findall(" " + line)
    head = line[: len(line) - len(line.lstrip(" "))] and "" or line.split(" ", 1)[0]
    return [head, *_spaces.findall(line[len(head) :])]


class _Numbers(dict):
    """Chunk numbers by key; a key met for the first time is numbered and its chunk noted in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key[1:] or key if key[:1] == "\n" else " " + key)
        return n


class Lattices:
    """Lattices of chunks; rows of all tables are nodes."""

    def __init__(self, vocab: Vocabulary, cache: int = CACHE):
        self.vocab, self.cache = vocab, cache
        self._clear()

    def _clear(self) -> None:
        self.at = _Numbers()
        self.base, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = 0
        for name, kind in _TABLES:
            if not hasattr(self, name):
                setattr(self, name, np.zeros((0, LONGEST), kind))

    def chunks(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunk numbers of all texts and how many each text has."""
        if self.used > self.cache:
            self._clear()
        number, out, counts = self.at.__getitem__, [], np.zeros(len(texts), np.int64)
        # a key is what follows a space (more spaces and a word), or, behind a line end, "\n" and the word; "\n" alone is the line end
        for i, t in enumerate(texts):
            before = len(out)
            for j, line in enumerate(t.split("\n") if t else ()):
                words = line.split(" ") if "  " not in line and line[:1] != " " else _runs(line, not j)
                if j:
                    out.append(number("\n"))
                    if words[0]:
                        words[0] = "\n" + words[0]
                    else:
                        del words[0]
                out.extend(map(number, words))
            counts[i] = len(out) - before
        if self.at.new:
            self._build(self.at.new)
            self.at.new = []
        return np.array(out, np.int64), counts

    def _build(self, new: list[str]) -> None:
        v = self.vocab
        chars = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        chars[chars == 32] = ord(SPACE)
        length = np.fromiter(map(len, new), np.int64, len(new))
        end = np.cumsum(length)
        stop = np.repeat(end, length)
        n = len(chars)
        at, state, edges = np.arange(n), np.zeros(n, np.int64), []
        for d in range(LONGEST):
            state = v.step(state, chars[at + d])
            live = state > 0
            at, state = at[live], state[live]
            ends = v.id_of[state] >= 0
            if ends.any():
                edges.append((d, at[ends], state[ends]))
            more = at + d + 1 < stop[at]
            at, state = at[more], state[more]
        # columns are nodes by what is left of their chunk, rows are edge lengths, so sums over edges add whole rows;
        # all tables are LONGEST wide, so a chunk's numbers do not depend on the chunks built with it
        distance = stop - np.arange(n)
        by_left = np.argsort(distance.astype(np.uint16) if distance.max() < 1 << 16 else distance, kind="stable")
        column = np.empty(n, np.int64)
        column[by_left] = np.arange(n)
        weight, piece = np.full((LONGEST, n), -np.inf, np.float32), np.zeros((n, LONGEST), np.uint16)
        for d, i, end_of in edges:
            weight[d, column[i]], piece[i, d] = v.weight_of[end_of], v.id_of[end_of]
        bare = np.flatnonzero(np.isneginf(weight[0, column]))
        c = chars[bare]
        weight[0, column[bare]] = v.byte_weight * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
        piece[bare, 0] = np.where(c < 128, BYTE0 + c, _FALLBACK)
        # beta[i]: log sum over the completions of node i, from the ends of chunks backward;
        # an edge's conditional probability is exp(weight + beta at its end - beta[i])
        beta = np.zeros(n + LONGEST + 1)
        p = np.zeros((LONGEST, n), np.float32)
        ahead = np.arange(1, LONGEST + 1)[:, None]
        left = distance[by_left]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(left)) + 1, [n]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            i, k = by_left[a:b], int(min(left[a], LONGEST))
            x = beta[i + ahead[:k]]
            if left[a] == k:
                x[-1] = 0.0  # the chunk's end
            x += weight[:k, a:b]
            top = x.max(0)
            x = (x - top).astype(np.float32)
            e = np.exp(x)
            total = e.sum(0) if b - a > 1 else np.cumsum(e, axis=0)[-1]  # in the edges' order for one column too
            log = np.log(total)
            beta[i] = top + log
            weight[:k, a:b] = x - log
            p[:k, a:b] = e / total
        # the other edges' share, summed without the edge itself: exact where the edge is near 1
        below, rest = p.copy(), np.zeros_like(p)
        for d in range(1, LONGEST):
            below[d] += below[d - 1]
            rest[d] = below[d - 1]
        after, seen = np.zeros(n, np.float32), np.zeros(n, bool)
        for d in range(LONGEST - 1, -1, -1):
            rest[d] += after
            after += p[d]
            below[d, ~seen] = 1.0
            seen |= p[d] > 0
        with np.errstate(divide="ignore"):
            np.log(rest, out=rest)
        start = self.used
        self.base = np.concatenate([self.base, start + end - length])
        self.length = np.concatenate([self.length, length])
        self._room(start + n)
        self.piece[start : start + n] = piece
        for held, table in ((self.below, below), (self.log, weight), (self.other, rest)):
            held[start + by_left] = table.T
        self.used = start + n

    def _room(self, rows: int) -> None:
        """Tables of at least so many rows; grown by half, so adding to them is linear."""
        if rows > len(self.below):
            for name, kind in _TABLES:
                new = np.empty((rows * 3 // 2, LONGEST), kind)
                new[: self.used] = getattr(self, name)[: self.used]
                setattr(self, name, new)


@dataclass
class Path:
    """One sampled segmentation of every text, by character position over all texts."""

    edge: np.ndarray  # edge length at a piece's first character, else 0
    logp: np.ndarray  # per text
    gumbel: np.ndarray  # per text; -inf where there is no such sample
    bound: np.ndarray  # maximum of the subtree that leaves the path at this character, -inf where none
    branch: np.ndarray  # per text: position where it left its parent, -1 for the first
    barred: np.ndarray  # per text: edges of the branch node that are taken (bits)


class Sampler:
    """Top-k of a batch of texts. ``keys`` seed each text."""

    def __init__(self, lattices: Lattices, texts: Sequence[str], keys: np.ndarray):
        self.l = lattices
        chunk, counts = lattices.chunks(texts)
        lengths = lattices.length[chunk]
        self.first = np.concatenate(([0], np.cumsum(lengths)))  # of chunks
        n = int(self.first[-1])
        text = np.repeat(np.arange(len(texts)), counts)
        sizes = np.bincount(text, lengths, len(texts)).astype(np.int64)
        self.start = np.concatenate(([0], np.cumsum(sizes)))  # of texts
        self.text = np.repeat(text, lengths)
        self.node = np.repeat(lattices.base[chunk] - self.first[:-1], lengths) + np.arange(n)
        self.stop = np.repeat(self.first[1:], lengths)
        self.keys, self.n_texts, self.n = keys.astype(np.uint64), len(texts), n

    def _walk(self, edge: np.ndarray, at: np.ndarray, stream: int) -> None:
        """Draw paths from the positions ``at`` to the ends of their chunks."""
        while len(at):
            t = self.text[at]
            u = uniform(self.keys[t], stream, at - self.start[t])
            e = (self.l.below[self.node[at]] < u[:, None].astype(np.float32)).sum(1, dtype=np.int64)
            np.minimum(e, self.l.below.shape[1] - 1, out=e)
            edge[at] = e + 1
            stop = self.stop[at]
            at = at + e + 1
            at = at[at < stop]

    def _finish(self, edge, gumbel, branch, barred, stream: int) -> Path:
        at = np.flatnonzero(edge)
        e = edge[at] - 1
        t = self.text[at]
        log = self.l.log[self.node[at], e].astype(np.float64)
        logp = np.bincount(t, log, self.n_texts)
        running = np.cumsum(log)
        heads = np.concatenate(([0.0], running))[np.searchsorted(at, self.start[:-1])]
        before = running - log - heads[t]
        mass = self.l.other[self.node[at], e].astype(np.float64)
        on = branch[t] == at
        if on.any():  # at the branch node the edges taken before are barred too
            i = np.flatnonzero(on)
            p = np.exp(self.l.log[self.node[at[i]]].astype(np.float64))
            p[(barred[t[i]][:, None] >> np.arange(p.shape[1])) & 1 == 1] = 0
            p[np.arange(len(i)), e[i]] = 0
            with np.errstate(divide="ignore"):
                mass[i] = np.log(p.sum(1))
        mass += before
        g = mass - np.log(-np.log(uniform(self.keys[t], stream + 1, at - self.start[t])))
        with np.errstate(invalid="ignore"):
            g = -np.logaddexp(-gumbel[t], -g)
        g[np.isneginf(mass) | (at < branch[t]) | np.isneginf(gumbel[t])] = -np.inf
        bound = np.full(self.n, -np.inf)
        bound[at] = g
        return Path(edge, logp, gumbel, bound, branch, barred)

    def _best(self, path: Path) -> np.ndarray:
        out = np.full(self.n_texts, -np.inf)
        some = np.flatnonzero(np.diff(self.start) > 0)
        if len(some):
            out[some] = np.maximum.reduceat(path.bound, self.start[:-1][some])
        return out

    def top(self, k: int) -> tuple[list[Path], np.ndarray]:
        """k paths in falling order of their perturbed log-probability, and the bound of what is left."""
        none, no = np.full(self.n_texts, -1, np.int64), np.zeros(self.n_texts, np.int64)
        edge = np.zeros(self.n, np.uint8)
        self._walk(edge, self.first[:-1].copy(), 2)
        root = -np.log(-np.log(uniform(self.keys, 1, np.zeros(self.n_texts))))
        paths = [self._finish(edge, root, none, no, 2)]
        best = [self._best(paths[0])]
        while len(paths) < k:
            stream = 2 + 2 * len(paths)
            which = np.argmax(np.stack(best), axis=0)
            gumbel = np.stack(best)[which, np.arange(self.n_texts)]
            edge = np.zeros(self.n, np.uint8)
            branch, barred = none.copy(), no.copy()
            fresh = np.zeros(self.n, bool)
            for r, path in enumerate(paths):
                t = np.flatnonzero((which == r) & np.isfinite(gumbel))
                if not len(t):
                    continue
                mine = np.zeros(self.n_texts, bool)
                mine[t] = True
                at = np.flatnonzero(mine[self.text] & (path.bound == gumbel[self.text]))
                at = at[np.concatenate(([True], np.diff(self.text[at]) > 0))]
                branch[t] = at
                bits = np.int64(1) << (path.edge[at].astype(np.int64) - 1)
                barred[t] = bits | np.where(path.branch[t] == at, path.barred[t], 0)
                path.bound[at] = -np.inf
                best[r] = self._best(path)
                here = np.arange(self.n)
                keep = mine[self.text] & (here < branch[self.text])
                edge[keep] = path.edge[keep]
                fresh |= mine[self.text] & (here >= branch[self.text])
            t = np.flatnonzero(branch >= 0)
            at = branch[t]
            p = np.exp(self.l.log[self.node[at]].astype(np.float64))
            p[(barred[t][:, None] >> np.arange(p.shape[1])) & 1 == 1] = 0
            c = np.cumsum(p, axis=1)
            u = uniform(self.keys[t], stream, at - self.start[t]) * c[:, -1]
            e = np.minimum((c <= u[:, None]).sum(1), c.shape[1] - 1)
            edge[at] = e + 1
            nxt = at + e + 1
            starts = self.first[:-1][fresh[np.minimum(self.first[:-1], self.n - 1)]] if self.n else self.first[:0]
            inside = nxt[nxt < self.stop[at]]
            self._walk(edge, np.concatenate([inside, starts[~np.isin(starts, at)]]), stream)
            paths.append(self._finish(edge, gumbel, branch, barred, stream))
            best.append(self._best(paths[-1]))
        return paths, np.max(np.stack(best), axis=0)

    def ids(self, path: Path, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts and where each text's begin. ``chars`` are the code points of the chunks."""
        at = np.flatnonzero(path.edge)
        out = self.l.piece[self.node[at], path.edge[at] - 1].astype(np.int32)
        text = self.text[at]
        if (bare := np.flatnonzero(out == _FALLBACK)).size:
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in chars[at[bare]].tolist()]
            many = np.ones(len(out), np.int64)
            many[bare] = [len(r) for r in raw]
            to = np.concatenate(([0], np.cumsum(many)))[:-1]
            out, text = np.repeat(out, many), np.repeat(text, many)
            for i, r in zip(to[bare].tolist(), raw):
                out[i : i + len(r)] = [BYTE0 + b for b in r]
        return out, np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.n_texts))))
