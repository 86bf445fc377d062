"""Context-mixing range coder for token ids, vectorised over blocks.

A segment is a byte string that holds many blocks. Each block is coded by itself (all
statistics and the coder start anew) and carries a CRC-32 of its ids, so a damaged block
spoils no other: ``decode_blocks`` returns the good ones and names the bad. All blocks of a
segment advance together, one id a step, as numpy arrays.

A block lists its different ids in order, with their counts; what is coded are their numbers. Model:
a mixture of three predictions, of which one interval a step is coded.

* order 0: the block's counts, whose sum is the number of its ids.
* orders 1 and 2: the last number, or the last two, predict the one that followed them last.

A number's probability is w0 * order0 + w1 * [it is order 1's] + w2 * [it is order 2's]. The
weights adapt in the block, chosen by how often either was right before and by whether
both agree. w0 never falls under FLOOR / 2 ** BITS, so every number has an interval of 1 at least.

Numbers lie on the line in order, each with its weights of orders 2 and 1 before its share of order 0. To decode,
what orders 1 and 2 add below a point is taken away; the rest is a place among the block's sorted ids.

Weights are whole numbers up to 2 ** 20 in floats, low ends and ranges under 2 ** 53 in doubles, so every step is exact.

Layout, little-endian: magic "TMRC", u16 version, u32 blocks, u32 ids in a block, u32 crc32 of
the block table; the block table (u32 ids, u32 crc32 of the ids as u32, u32 payload words of 24
bits, u32 bytes of the id list); the id lists (zlib: gaps less one as bytes, counts less one as bytes, 255 for those of
255 or more; those gaps, then those counts, as u16; u16 ids); the payloads.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"TMRC", 4
#: Most ids in a block, blocks in a segment, and fewest ids in a block of a segment that has several.
BLOCK, LANES, SMALL = 4096, 2048, 1024
#: Intervals are parts of 2 ** BITS; a block's low end and range have 48 bits and give out words of 24.
BITS, _WORD = 20, float(1 << 24)
FLOOR = 1 << 13
#: An entry of a guess is a number and how often it was right in a row, 3 at most.
_RATE = 1 / 16
_ALL = float(1 << BITS)
_PART, _OUT = 1 / _ALL, 1 / _WORD
_MOST = _ALL - FLOOR
_KEPT, _GAIN = np.float32(1 - _RATE), np.float32(_MOST * _RATE)
_IDS = 1 << 16
assert FLOOR > BLOCK * 1.01  # no interval is empty


class Damaged(ValueError):
    """A segment or block that does not read back as it was written."""


def _weights(lanes: int) -> np.ndarray:
    """First weights of orders 2 and 1, for all lanes, in each context (times right of order 2, of order 1, whether they agree)."""
    c2, c1, same = np.arange(32) >> 3, np.arange(32) >> 1 & 3, np.arange(32) & 1
    rate = np.array([0, 0.3, 0.6, 0.8])
    w2, w1 = rate[c2] * np.where((c1 > 0) & (same == 0), 0.5, 1), rate[c1] * np.where(c2 > 0, 0.5, 1) * (1 - same)
    return np.concatenate((np.tile(w2 * _MOST, lanes), np.tile(w1 * _MOST, lanes))).astype(np.int32).astype(np.float32)


class _Model:
    """Guesses and weights of all lanes, of order 2 and then of order 1; ``sizes`` is the number of ids of each."""

    def __init__(self, sizes: np.ndarray):
        lanes = len(sizes)
        lane = np.arange(2 * lanes).reshape(2, lanes)
        self.entries, self.contexts = lane << 12, lane << 5
        self.sizes = np.maximum(sizes, 1).astype(np.float32)
        self.guesses, self.weights = np.full(lanes << 13, 0, np.uint16), _weights(lanes)
        self.context = np.zeros((2, lanes), np.int64)
        self.last = np.zeros(lanes, np.uint16)

    def shorten(self, n: int) -> None:
        self.sizes, self.last = self.sizes[:n], self.last[:n]
        self.entries, self.contexts, self.context = self.entries[:, :n], self.contexts[:, :n], self.context[:, :n]

    def predict(self) -> None:
        """The guesses g, their weights w, and the weight w0 of an occurrence in order 0."""
        self.i = self.entries + self.context
        self.e = self.guesses.take(self.i)
        self.g = self.e >> 2
        sure = self.e & 3
        at = sure[0] << 3
        at += sure[1] << 1
        at |= self.g[0] == self.g[1]
        self.at = self.contexts + at
        self.w = self.weights.take(self.at)
        rest = np.float32(_ALL) - self.w[0]
        rest -= self.w[1]
        rest /= self.sizes
        self.w0 = np.floor(rest, out=rest)

    def interval(self, x: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Start and width of the numbers x, where ``held`` is how many of order 0 are below them, and how many they are."""
        above = np.empty((2, *self.g.shape), bool)
        np.greater(x, self.g, out=above[0])
        self.hit = np.equal(x, self.g, out=above[1])
        more = self.w * above
        found = self.w0 * held
        found += more[:, 0]
        found += more[:, 1]
        return found

    def place(self, v: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Places in order 0 of the points v, where ``before`` stand before the guesses."""
        g2, g1 = self.g
        w2, w1 = self.w
        begin = self.w0 * before
        begin[1] += w2 * (g2 <= g1)
        for begins, w in ((begin[1], w1), (begin[0], w2)):
            over = v - begins
            np.maximum(over, 0, out=over)
            v = v - np.minimum(over, w, out=over)
        v /= self.w0
        return np.floor(v, out=v)

    def update(self, x: np.ndarray) -> None:
        """Learn the numbers x (16 bits), of which ``interval`` was asked."""
        right = np.minimum(self.e + 1, self.e | 3)
        new = x << 2
        new |= 1
        self.guesses[self.i] = np.where(self.hit, right, new)
        hit = self.hit
        hit[1] &= ~hit[0]
        self.w *= _KEPT
        self.w += hit * _GAIN
        self.weights[self.at] = np.floor(self.w, out=self.w)
        self.context[1] = x
        key = x * 2531
        key += self.last
        key &= 4095
        self.context[0] = key
        self.last = x * 1049


def _list(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising different ids and their counts as bytes."""
    gaps, more = ids.copy(), counts - 1
    gaps[1:] -= ids[:-1] + 1
    small = [np.minimum(x, 255).astype(np.uint8).tobytes() for x in (gaps, more)]
    large = [x[x >= 255].astype("<u2").tobytes() for x in (gaps, more)]
    return zlib.compress(b"".join(small + large) + struct.pack("<H", len(ids)), 1)


def _listed(raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of a list; ``size`` times the id 0 if the bytes are no list of so many."""
    try:
        x = zlib.decompress(raw)
        n = struct.unpack("<H", x[-2:])[0]
        both = np.frombuffer(x, np.uint8, 2 * n).astype(np.int64)
        both[both == 255] = np.frombuffer(x[2 * n : -2], "<u2")
        ids, counts = np.cumsum(both[:n] + 1) - 1, both[n:] + 1
        if n and ids[-1] < _IDS and counts.sum() == size:
            return ids, counts
    except (zlib.error, struct.error, ValueError):
        pass
    return np.zeros(1, np.int64), np.array([size])


def _steps(sizes: np.ndarray):
    """(step, lanes still in it); all lanes but the last have the same size, and the last no more."""
    for t in range(int(sizes.max(initial=0))):
        yield t, int(np.count_nonzero(sizes > t))


def encode(ids: np.ndarray) -> bytes:
    """One segment of the ids (below 2 ** 16)."""
    ids = np.asarray(ids)
    if len(ids) and not 0 <= ids.min() <= ids.max() < _IDS:
        raise ValueError("ids must be below 65536")
    block = min(BLOCK, max(SMALL, -(-len(ids) // LANES)))
    lanes = -(-len(ids) // block)
    sizes = np.full(lanes, block)
    if lanes:
        sizes[-1] = len(ids) - block * (lanes - 1)
    ids = ids.astype(np.uint16)
    tables, crcs, number_of = [], [], np.zeros(_IDS, np.uint16)
    grid, befores, counts = (np.zeros((lanes, block), np.uint16) for _ in range(3))
    for i, size in enumerate(sizes.tolist()):
        own = ids[i * block : i * block + size]
        count = np.bincount(own)
        known = np.flatnonzero(count > 0)
        count = count[known]
        starts = np.cumsum(count) - count
        number_of[known] = np.arange(len(known), dtype=np.uint16)
        grid[i, :size] = number = number_of[own]
        befores[i, :size], counts[i, :size] = starts[number], count[number]
        tables.append(_list(known, count))
        crcs.append(zlib.crc32(own.astype("<u4").tobytes()))
    grid, counted = np.ascontiguousarray(grid.T), np.stack((befores.T, counts.T))
    del befores, counts
    low, rng = np.zeros(lanes), np.full(lanes, _WORD * _WORD)
    model, alive, ended = _Model(sizes), lanes, low
    out, kept = np.zeros((block + 2, lanes), np.uint32), np.zeros((block + 2, lanes), bool)
    for t, n in _steps(sizes):
        if n < alive:  # the last lane has no more ids
            model.shorten(n)
            low, rng, alive = low[:n], rng[:n], n
        x = grid[t, :n]
        model.predict()
        held = model.interval(x, counted[:, t, :n])
        held = held * np.floor(rng * _PART)
        low += held[0]
        top = np.floor(low * _OUT)
        out[t, :n] = top  # may hold a carry in bit 24
        full = np.less(held[1], _WORD, out=kept[t, :n]).astype(np.float64)
        top *= full
        top *= _WORD
        low -= top
        full *= _WORD - 1
        full += 1
        low *= full
        np.multiply(held[1], full, out=rng)
        model.update(x)
    for t in (block, block + 1):
        top = np.floor(ended * _OUT)
        out[t], kept[t] = top, True
        ended = (ended - top * _WORD) * _WORD
    fill = np.count_nonzero(kept, axis=0)
    words = out.T[kept.T]
    while (carry := words >> 24).any():  # never out of a lane's first word
        words &= (1 << 24) - 1
        words[:-1] += carry[1:]
    blocks = np.zeros((lanes, 4), "<u4")
    blocks[:, 0], blocks[:, 1], blocks[:, 2], blocks[:, 3] = sizes, crcs, fill, [len(x) for x in tables]
    words = words.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return MAGIC + struct.pack("<HIII", VERSION, lanes, block, zlib.crc32(blocks.tobytes())) + blocks.tobytes() + b"".join(tables) + words


def decode_blocks(segment: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The ids of a segment and the (start, end) of blocks that do not match their checksum, whose ids are not to be used."""
    if segment[:4] != MAGIC or len(segment) < 18:
        raise Damaged("not a segment")
    version, lanes, block, crc = struct.unpack_from("<HIII", segment, 4)
    if version != VERSION:
        raise Damaged(f"version {version}")
    at = 18 + lanes * 16
    if not 0 < block <= BLOCK or len(segment) < at or zlib.crc32(segment[18:at]) != crc:
        raise Damaged("the block table does not match its checksum")
    blocks = np.frombuffer(segment, "<u4", lanes * 4, 18).reshape(lanes, 4).astype(np.int64)
    sizes, fill = blocks[:, 0], blocks[:, 2]
    ends = at + np.cumsum(blocks[:, 3])
    lists = [_listed(segment[b - size : b], n) for b, size, n in zip(ends.tolist(), blocks[:, 3].tolist(), sizes.tolist())]
    at = int(ends[-1]) if lanes else at
    payload = np.frombuffer(segment, np.uint8, max(0, len(segment) - at) // 3 * 3, min(at, len(segment))).reshape(-1, 3)
    words = np.zeros((len(payload) + 4, 4), np.uint8)
    words[: len(payload), :3] = payload
    words = words.view("<u4").reshape(-1).astype(np.float64)
    take = np.cumsum(fill) - fill
    # per block: the numbers in order, as often as they occur, and for each number how many stand before it
    rows = max((len(x) for x, _ in lists), default=0) + 1
    rising, befores, names = np.zeros((lanes, block), np.uint16), np.zeros((lanes, rows), np.uint16), np.zeros((lanes, rows), np.uint16)
    for i, (known, count) in enumerate(lists):
        rising[i, : sizes[i]] = np.repeat(np.arange(len(known), dtype=np.uint16), count)
        befores[i, 1 : len(known) + 1] = np.cumsum(count)
        names[i, : len(known)] = known
    rising, befores = rising.reshape(-1), befores.reshape(-1)
    model, lane, last = _Model(sizes), np.arange(lanes), (sizes - 1).astype(np.float32)
    row, first, above = lane * rows, lane * block, np.array([[0], [1]])
    code, rng, alive = words.take(take, mode="clip") * _WORD + words.take(take + 1, mode="clip"), np.full(lanes, _WORD * _WORD), lanes
    take = take + 2
    grid = np.zeros((block, lanes), np.uint16)
    for t, n in _steps(sizes):
        if n < alive:  # the last lane has no more ids
            model.shorten(n)
            code, rng, take, row, first, last, alive = code[:n], rng[:n], take[:n], row[:n], first[:n], last[:n], n
        model.predict()
        r = np.floor(rng * _PART)
        v = np.floor(code / r)
        place = model.place(v.astype(np.float32), befores.take(row + model.g))
        np.minimum(place, last, out=place)
        x = rising.take(first + place.astype(np.int64))
        held = befores.take(row + x + above)
        held[1] -= held[0]
        held = model.interval(x, held)
        held = held * r
        rng = held[1]
        code = np.subtract(code, held[0], out=held[0])
        np.minimum(code, rng - 1, out=code)  # met in damaged blocks only
        moved = rng < _WORD
        full = moved.astype(np.float64)
        more = words.take(take, mode="clip")
        more *= full
        take += moved
        full *= _WORD - 1
        full += 1
        rng *= full
        code *= full
        code += more
        model.update(x)
        grid[t, :n] = x
    ids = np.empty((lanes, block), np.uint16)
    for i in range(lanes):
        ids[i] = names[i].take(grid[:, i])
    whole = ids.reshape(-1)[: int(sizes.sum())].astype("<u4")
    ends = np.cumsum(sizes)
    spans = zip((ends - sizes).tolist(), ends.tolist(), blocks[:, 1].tolist())
    return whole, [(a, b) for a, b, sum_ in spans if zlib.crc32(whole[a:b].tobytes()) != sum_]


def decode(segment: bytes) -> np.ndarray:
    """The ids of a segment; raises Damaged, naming the blocks, where one does not match its checksum."""
    ids, bad = decode_blocks(segment)
    if bad:
        raise Damaged("; ".join(f"ids {a} to {b} do not match their checksum" for a, b in bad))
    return ids
