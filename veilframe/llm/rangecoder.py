"""Adaptive context-mixing range coder for token ids.

A block is coded by itself: models start anew, and its bytes carry checksums. Its ids stand in lanes, consecutive stretches
of equal length, and one step codes an id of every lane, so that numpy does the work of thousands of coders at once. All
lanes share the models, which learn after every step:

* order 2 and order 1: the id that last followed the two ids (the id) before, with a confidence;
* order 0: how often each id has occurred.

Their opinions on the predicted ids are mixed in the logistic domain with learnt weights; the outcome (the order-2 id, the
order-1 id, another one) is coded with the mixed probabilities, and another id with its order-0 probability. All arithmetic
is on integers, so every machine decodes what any other has written.

The range coder is the asymmetric one: a lane's state takes in an interval by one division and gives it back by one
multiplication, and sheds at most one word for it. Writing goes through the intervals backwards, so the models run ahead of
it; the words of all lanes make one stream, in the order in which reading asks for them.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

LANES = 4096
BLOCK_IDS = 1 << 20
MAGIC = b"VFB2"
HEADER = struct.Struct("<4sIIIIII")     # magic, ids, lanes, vocabulary, bytes of the document table, crc32 of the ids, crc32 of the rest

_LOW = np.uint64(1 << 31)               # states stay between this and 2**63
_32 = np.uint64(32)
_SCALE = 16                             # bits of a coded probability
_GUIDE = 15                             # bits of a place in order 0 that are looked up at once
_REFRESH = 2                            # tables of probabilities are made anew after half as many steps more
_LEVELS, _SIZES = 8, 24                 # confidences of an order; magnitudes of a count
_GAIN = np.int32(24)                              # what an occurrence adds to an id's count
_TABLE = 1 << 17                        # slots of the order-2 table
_BITS = 3                               # of a confidence, below the id in a table's entry
_NONE = np.int32(-1 << _BITS)
_SURE = np.int32(_LEVELS - 1)

# stretch(p) = ln(p / (1 - p)) in 1/256, for p in 1/4096; squash is its inverse
_STRETCH = np.array([round(256 * math.log((p + 0.5) / (4095.5 - p))) for p in range(4096)], np.int64)
_SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int64)


class _Models:
    """Predictions for one step of all lanes, and what is learnt from it.

    What the mixing sees of an order is its confidence (order 0: the magnitude of the predicted id's count), so mixed
    probabilities are looked up in tables, which are made anew at every refresh.
    """

    def __init__(self, lanes: int, vocabulary: int, n: int) -> None:
        self.counts = np.ones(vocabulary, np.int32)     # their sum stays far below 2**31
        self.scale = max(_GUIDE, (vocabulary + int(_GAIN) * n).bit_length())     # bits of an order-0 share: every id gets one
        self.sizes = np.ones(vocabulary + 1, np.int32)  # magnitudes of the counts, as of the last refresh
        self.steps, self.due, self.new = 0, 1, []
        self.last = [np.full(lanes, vocabulary, np.int64), np.full(lanes, vocabulary, np.int64)]
        self.held = [np.full(vocabulary + 1, _NONE), np.full(_TABLE, _NONE)]     # order 1, order 2: id and confidence
        self.hits = np.full((2, _LEVELS), 1024, np.int64)      # of 4096, by order and confidence
        self.weights = np.array([[40000, 20000, 6000], [0, 50000, 6000]], np.int64)  # of 65536, for order 2 and order 1
        self._share()
        self._mix()

    def _share(self) -> None:
        """The ids' shares of 2**scale by order 0."""
        ends = np.cumsum(self.counts, dtype=np.int64)
        self.total = int(ends[-1])
        self.limits = np.zeros(len(ends) + 1, np.int64)
        self.limits[1:] = (ends << self.scale) // self.total
        self.guide = None

    def at(self, target: np.ndarray) -> np.ndarray:
        """The ids whose shares hold these places."""
        shift = self.scale - _GUIDE
        if self.guide is None:      # of each cell, the id whose share holds its beginning
            begins = (self.limits[:-1] + ((1 << shift) - 1)) >> shift
            self.guide = np.cumsum(np.bincount(begins, minlength=1 << _GUIDE))[:1 << _GUIDE] - 1
        found = self.guide[target >> shift]
        other = np.flatnonzero(self.limits[found + 1] <= target)
        if len(other):
            found[other] = np.searchsorted(self.limits, target[other], "right") - 1
        return found

    def _mix(self) -> None:
        """Mixed probabilities (of 4096) of the order-2 id and of the order-1 id, by what the orders say of them."""
        total = self.total.bit_length()
        t1, t2 = _STRETCH[self.hits[0]], _STRETCH[self.hits[1]]
        t0 = _STRETCH[np.minimum(4095, (1 << np.arange(_SIZES + 1)) * 4096 >> total)][:_SIZES]
        # by confidence of order 2, whether order 1 agrees and how surely, size of the count
        agree = np.concatenate(([0], t1))
        self.inputs = [np.stack(np.broadcast_arrays(t2[:, None, None], agree[None, :, None], t0[None, None, :])).reshape(3, -1),
                       np.stack(np.broadcast_arrays(np.zeros((_LEVELS, _SIZES), np.int64), t1[:, None], t0[None, :])).reshape(3, -1)]
        self.mixed = [_SQUASH[np.clip((w[:, None] * x).sum(0) >> 16, -2047, 2047) + 2047].astype(np.int32) for w, x in zip(self.weights, self.inputs)]

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Order-2 id, order-1 id, and their shares of 2**16."""
        one, two = self.last
        self.slots = (one, ((two * 40503 + one * 2654435761) >> 7) & (_TABLE - 1))
        held = self.held[0].take(one), self.held[1].take(self.slots[1])
        first, second = held[0] >> _BITS, held[1] >> _BITS
        level1, level2 = held[0] & _SURE, held[1] & _SURE
        same = first == second
        self.entries, self.guess, self.levels = held, (first, second), (level1, level2)
        # an id of -1 (none yet) finds the last size, which no id has
        size1, size2 = self.sizes.take(first, mode="wrap"), self.sizes.take(second, mode="wrap")
        self.spots = ((level2 * np.int32(_LEVELS + 1) + (level1 + np.int32(1)) * same) * np.int32(_SIZES) + size2, level1 * np.int32(_SIZES) + size1)
        part2 = self.mixed[0].take(self.spots[0], mode="wrap") << 4
        np.putmask(part2, second < 0, 1)
        part1 = (65300 - part2) * self.mixed[1].take(self.spots[1], mode="wrap") >> 12
        np.putmask(part1, same | (first < 0), 1)
        np.maximum(part1, 1, out=part1)
        return second, first, part2, part1

    def learn(self, ids: np.ndarray, active: int) -> None:
        """``ids`` of the lanes; only the first ``active`` lanes have one."""
        now = ids[:active].astype(np.int32)
        fresh = now << _BITS
        self.steps += 1
        refresh = self.steps == self.due
        for k in (0, 1):
            entry, guess, level, slot = (x[k][:active] for x in (self.entries, self.guess, self.levels, self.slots))
            hit = guess == now
            if refresh:
                self._adapt(k, hit, guess >= 0, level, self.spots[1 - k][:active])
            # one surer after a hit; after a miss half as sure, or another id if it was not at all
            self.held[k][slot] = np.where(hit, entry + (level < _SURE), np.where(level > 0, entry - ((level + 1) >> 1), fresh))
        self.new.append(now)
        if refresh:
            self.counts += _GAIN * np.bincount(np.concatenate(self.new), minlength=len(self.counts)).astype(np.int32)
            self.new, self.due = [], self.steps + 1 + self.steps // _REFRESH
            self._share()
            # the exponent of a float is the magnitude
            np.minimum((self.counts.astype(np.float32).view(np.int32) >> 23) - 126, _SIZES - 1, out=self.sizes[:-1])
            self._mix()
        self.last = [ids, self.last[0]]

    def _adapt(self, k: int, hit: np.ndarray, known: np.ndarray, level: np.ndarray, spot: np.ndarray) -> None:
        """Hit rates by confidence, and a step of the weights against the mean error; ``k`` 0 is order 1."""
        seen = np.bincount((2 * level + hit)[known], minlength=2 * _LEVELS).reshape(_LEVELS, 2).astype(np.int64)
        n = seen.sum(1)
        rate = seen[:, 1] * 4095 // np.maximum(n, 1)
        self.hits[k] = np.clip(np.where(n > 0, self.hits[k] + (rate - self.hits[k]) // 4, self.hits[k]), 1, 4094)
        if known.any():
            error = np.where(hit, 4095, 0) - self.mixed[1 - k][spot]
            step = (self.inputs[1 - k][:, spot] * np.where(known, error, 0)).sum(1) // (64 * len(hit))
            self.weights[1 - k] = np.clip(self.weights[1 - k] + step, -262144, 262144)


def _lanes(n: int) -> tuple[int, int]:
    lanes = min(LANES, max(1, n // 64))
    return lanes, -(-n // lanes)


def _take_in(states: np.ndarray, start: np.ndarray, part: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """New states after an interval ``part`` of 2**scale, and the words that some of the lanes shed for it."""
    part = part.astype(np.uint64)
    full = states >= part << np.uint64(63 - scale)
    words = states[full].astype(np.uint32)
    states = np.where(full, states >> _32, states)
    times = states // part
    return (times << np.uint64(scale)) + (states - times * part) + start.astype(np.uint64), words


class _Reader:
    def __init__(self, states: np.ndarray, words: np.ndarray) -> None:
        self.states, self.words, self.at = states.astype(np.uint64), words.astype(np.uint64), 0

    def target(self, lanes: np.ndarray | slice, scale: int) -> np.ndarray:
        return (self.states[lanes] & np.uint64((1 << scale) - 1)).astype(np.int64)

    def consume(self, lanes: np.ndarray | slice, target: np.ndarray, start: np.ndarray, part: np.ndarray, scale: int) -> None:
        states = part.astype(np.uint64) * (self.states[lanes] >> np.uint64(scale)) + (target - start).astype(np.uint64)
        empty = np.flatnonzero(states < _LOW)
        if len(empty):
            states[empty] = states[empty] << _32 | self.words[self.at:self.at + len(empty)]
            self.at += len(empty)
        self.states[lanes] = states


def encode_ids(ids: np.ndarray, vocabulary: int) -> bytes:
    """Coded ids: last states of the lanes, then the 32-bit words in the order of reading."""
    n = len(ids)
    if not n:
        return b""
    lanes, steps = _lanes(n)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = grid.reshape(lanes, steps).T.copy()
    active = [min(lanes, max(0, -(-(n - i) // steps))) for i in range(steps)]
    models, intervals = _Models(lanes, vocabulary, n), []
    for now, held in zip(grid, active):
        second, first, part2, part1 = (x[:held] for x in models.predict())
        mine = now[:held]
        is2 = mine == second
        is1 = ~is2 & (mine == first)
        start = np.where(is2, 0, np.where(is1, part2, part2 + part1))
        part = np.where(is2, part2, np.where(is1, part1, 65536 - part2 - part1))
        rest = np.flatnonzero(~is2 & ~is1)
        low = models.limits[mine[rest]]
        intervals.append((start, part, rest, low, models.limits[mine[rest] + 1] - low))
        models.learn(now, held)
    states, words = np.full(lanes, _LOW), []
    for held, (start, part, rest, low, size) in zip(reversed(active), reversed(intervals)):
        if len(rest):
            states[rest], shed = _take_in(states[rest], low, size, models.scale)
            words.append(shed)
        states[:held], shed = _take_in(states[:held], start, part, _SCALE)
        words.append(shed)
    return states.astype("<u8").tobytes() + np.concatenate(words[::-1]).astype("<u4").tobytes()


def decode_ids(data: bytes, n: int, lanes: int, vocabulary: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint32)
    steps = -(-n // lanes)
    reader = _Reader(np.frombuffer(data, "<u8", lanes), np.frombuffer(data, "<u4", offset=8 * lanes))
    models = _Models(lanes, vocabulary, n)
    grid = np.zeros((steps, lanes), np.int64)
    for i in range(steps):
        held = min(lanes, max(0, -(-(n - i) // steps)))
        second, first, part2, part1 = (x[:held] for x in models.predict())
        target = reader.target(slice(0, held), _SCALE)
        is2 = target < part2
        is1 = ~is2 & (target < part2 + part1)
        start = np.where(is2, 0, np.where(is1, part2, part2 + part1))
        part = np.where(is2, part2, np.where(is1, part1, 65536 - part2 - part1))
        reader.consume(slice(0, held), target, start, part, _SCALE)
        now = np.where(is2, second, first)
        rest = np.flatnonzero(~is2 & ~is1)
        if len(rest):
            target = reader.target(rest, models.scale)
            now[rest] = found = models.at(target)
            low = models.limits[found]
            reader.consume(rest, target, low, models.limits[found + 1] - low, models.scale)
        grid[i, :held] = now
        models.learn(grid[i], held)
    return grid.T.reshape(-1)[:n].astype(np.uint32)


def pack_block(ids: np.ndarray, table: bytes) -> bytes:
    """A block: header, document table (any bytes), coded ids."""
    ids = np.ascontiguousarray(ids, "<u4")
    vocabulary = int(ids.max()) + 1 if len(ids) else 1
    body = zlib.compress(table, 1)
    size = len(body)
    body += encode_ids(ids, vocabulary)
    return HEADER.pack(MAGIC, len(ids), _lanes(len(ids))[0], vocabulary, size, zlib.crc32(ids.tobytes()), zlib.crc32(body)) + body


def open_block(block: bytes) -> tuple[np.ndarray, bytes]:
    """Ids and document table of a block; an error if a checksum does not hold."""
    magic, n, lanes, vocabulary, size, ids_crc, body_crc = HEADER.unpack_from(block)
    body = block[HEADER.size:]
    if magic != MAGIC or zlib.crc32(body) != body_crc:
        raise ValueError("not a block, or a damaged one")
    ids = decode_ids(body[size:], n, lanes, vocabulary)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("the ids of the block do not match their checksum")
    return ids, zlib.decompress(body[:size])
