"""Frames of token ids: blocks that are coded on their own by an adaptive range coder over mixed predictions.

Model of one block, which starts anew in each. Order 2 and order 1 each predict one id, the one that last followed the same
two ids or the same id, with a confidence of how often it did. Order 0 gives every id that the others missed before a probability, from
counts of what they missed, and the rest to a sign before an id that is new, which then comes as it is. The three are mixed: for each
pair of confidences the block learns how much of the probability order 2 and order 1 deserve, and order 0 has the rest. So an id is one
interval of a range coder, whatever predicted it, but for the first time that order 0 meets it.

A block is cut into as many stretches as LANES, which go forward together, a step an id, and learn into one model: each step is a few numpy
operations over all lanes, and memory is that of one model, however many lanes there are. The model learns in spans of steps, the first of
one step, each later one as long as all before, up to SPAN: within a span it stands still, so that a writer handles whole spans. A block
needs nothing from its neighbours: any set of them can be read alone. Each has a checksum of its ids and bytes.

Layout of a frame, little-endian: MAGIC, then unsigned 32-bit numbers of ids in a block, of ids, of blocks and of documents, then
for each block the number of its bytes and the crc32 of its ids, as unsigned 32-bit integers, and its bytes, then for each document its doc_id and number of
ids as signed 64-bit integers, then the crc32 of all before, then the blocks' bytes. A block's bytes: the number of its lanes and
of each lane's words, as unsigned 32-bit integers, then the lanes' words of 16 bits.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"EVIDS2\0\0"
#: Ids of a block, of a lane at least unless there is one only, and lanes of a block.
BLOCK, SHORTEST, LANES = 1 << 21, 512, 4096
#: All probability, the bits of a word that is sent, and the range below which it is. Quotients of a range have 48 bits at most, so that floats are exact.
TOTAL_BITS, WORD, RENORM, FULL = 22, 16, 1 << 32, 1 << 48
TOTAL = 1 << TOTAL_BITS
#: Probability within order 0; orders 2 and 1 leave as much of all, so that every cell of order 0 has some.
CELL_BITS = 17
CELLS, MOST = 1 << CELL_BITS, TOTAL - (1 << CELL_BITS)
#: Slots of order 2, the longest span of steps, and hits of a pair of confidences above which they are halved.
SLOTS_2, SPAN, OLD = 1 << 17, 32, 1 << 15
IDS = 1 << 16
#: By confidence (0 to 7): what it gains if its id came, and loses if not; at less than two, another id takes the slot.
_GAIN = np.array([0, -1, -1, -2, -2, -3, -3, -4, 1, 1, 1, 1, 1, 1, 1, 0], np.int32)
_YIELDS = np.arange(16) < 2


class BrokenBlock(ValueError):
    """What was read is not what was written."""


class _Model:
    """What a block has learned: slots of id and confidence, hits of each pair of confidences, and counts of missed ids."""

    def __init__(self):
        self.slots_2, self.slots_1 = np.zeros(SLOTS_2, np.int32), np.zeros(IDS, np.int32)
        sure_2, sure_1, same = (x.reshape(-1) for x in np.meshgrid(np.arange(8), np.arange(8), np.arange(2), indexing="ij"))
        self.hits = np.stack([1 + 4 * sure_2, 1 + 4 * sure_1 * (1 - same), np.full(128, 8)], axis=1)  # order 2, order 1, neither
        self.counts = np.zeros(IDS + 1, np.int64)  # the last is the sign before a new id
        self.counts[IDS] = 1
        self.cell, self.from_, self.until = np.full(IDS, IDS), np.zeros(IDS + 1, np.int64), np.zeros(IDS + 1, np.int64)
        self.settle()

    def settle(self) -> None:
        """Probabilities from hits and counts."""
        old = self.hits.sum(axis=1) > OLD
        self.hits[old] = self.hits[old] + 1 >> 1
        share = np.cumsum(self.hits, axis=1) * MOST // self.hits.sum(axis=1)[:, None]
        self.m_2, self.m_known = share[:, 0].copy(), share[:, 1].copy()
        seen = np.flatnonzero(self.counts)
        counts = self.counts[seen]
        width = 1 + counts * (CELLS - len(seen)) // int(counts.sum())
        width[-1] += CELLS - int(width.sum())
        self.cell[seen[:-1]], self.until[seen] = seen[:-1], np.cumsum(width)
        self.from_[seen] = self.until[seen] - width
        self.at = np.repeat(seen, width)

    def predict(self, before: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The slot of order 2, the entries of both orders, and their confidences with whether they name the same id."""
        i_2 = last * 0x9E3779B1 + before * 0x85EBCA6B >> 15 & SLOTS_2 - 1
        e_2, e_1 = self.slots_2.take(i_2), self.slots_1.take(last)
        return i_2, e_2, e_1, (e_2 & 7) << 4 | (e_1 & 7) << 1 | ((e_2 ^ e_1) < 8)

    def intervals(self, x: np.ndarray, e_2: np.ndarray, e_1: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and width of each id's interval, and which are new."""
        hit_2, hit_1 = x == e_2 >> 3, x == e_1 >> 3
        m_2, known = self.m_2.take(state), self.m_known.take(state)
        cell = self.cell.take(x)
        low, width = self._order_0(cell, TOTAL - known)
        start, size = np.where(hit_2, 0, np.where(hit_1, m_2, known + low)), np.where(hit_2, m_2, np.where(hit_1, known - m_2, width))
        return start, size, (cell == IDS) & ~(hit_2 | hit_1)

    def _order_0(self, cell: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = self.from_.take(cell) * rest >> CELL_BITS
        return low, (self.until.take(cell) * rest >> CELL_BITS) - low

    def find(self, value: np.ndarray, e_2: np.ndarray, e_1: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id (IDS: a new one) in whose interval each value lies, and the start and width of that."""
        m_2, known = self.m_2.take(state), self.m_known.take(state)
        hit_2, hit = value < m_2, value < known
        rest = TOTAL - known
        above = np.maximum(value - known, 0) + 1
        x = self.at.take((((above << CELL_BITS) - 1) / rest).astype(np.int64))
        low, width = self._order_0(x, rest)
        start, size = np.where(hit, m_2, known + low), np.where(hit, known - m_2, width)
        start[hit_2] = 0
        return np.where(hit, np.where(hit_2, e_2, e_1) >> 3, x), start, np.where(hit_2, m_2, size)

    def learn(self, x: np.ndarray, last: np.ndarray, i_2: np.ndarray, e_2: np.ndarray, e_1: np.ndarray, state: np.ndarray) -> None:
        """Take in a span, step by step and in each step lane by lane; where two fall into one slot, the later one stays."""
        hit_2, hit_1 = x == e_2 >> 3, x == e_1 >> 3
        missed = x[~(hit_2 | hit_1)]
        kind = np.where(hit_2, 0, 2 - hit_1)
        self.hits += np.bincount((state * 3 + kind).reshape(-1), minlength=384).reshape(128, 3)
        fresh = (x << 3 | 1).astype(np.int32)
        self.slots_2[i_2.reshape(-1)] = self._slot(e_2, hit_2, fresh).reshape(-1)
        self.slots_1[last.reshape(-1)] = self._slot(e_1, hit_1, fresh).reshape(-1)
        self.counts[IDS] += np.count_nonzero(self.cell.take(missed) == IDS)
        self.counts[:IDS] += np.bincount(missed, minlength=IDS)
        self.settle()

    @staticmethod
    def _slot(entry: np.ndarray, hit: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        sure = (entry & 7) + hit * np.int32(8)
        return np.where(_YIELDS.take(sure), fresh, entry + _GAIN.take(sure))


def _shape(count: int) -> tuple[int, int]:
    """Lanes of a block of count ids, and their steps; the last lanes may go beyond its end."""
    lanes = max(1, min(LANES, count // SHORTEST))
    return lanes, -(-count // lanes)


def _spans(steps: int) -> list[tuple[int, int]]:
    out, t = [], 0
    while t < steps:
        out.append((t, min(steps, t + min(SPAN, max(1, t)))))
        t = out[-1][1]
    return out


class _Sender:
    """Words of all lanes, as many lanes code intervals."""

    def __init__(self, lanes: int, steps: int):
        self.low, self.size = np.zeros(lanes, np.int64), np.full(lanes, FULL, np.int64)
        self.words = np.zeros((lanes, 3 * steps + 8), np.int32)
        self.flat, self.first = self.words.reshape(-1), np.arange(lanes) * (3 * steps + 8)
        self.next = self.first.copy()

    def send(self, start: np.ndarray, width: np.ndarray) -> None:
        unit = self.size >> TOTAL_BITS
        self.low += start * unit
        self.size = width * unit
        self._settle(np.flatnonzero(self.low >= FULL), np.flatnonzero(self.size < RENORM))

    def send_some(self, lanes: np.ndarray, start: np.ndarray, width: int) -> None:
        unit = self.size[lanes] >> TOTAL_BITS
        low = self.low[lanes] + start * unit
        self.low[lanes], self.size[lanes] = low, width * unit
        self._settle(lanes[low >= FULL], lanes[self.size[lanes] < RENORM])

    def _settle(self, over: np.ndarray, short: np.ndarray) -> None:
        if len(over):
            self.flat[self.next[over] - 1] += 1
            self.low[over] -= FULL
        while len(short):
            bottom, place, size = self.low[short], self.next[short], self.size[short] << WORD
            self.flat[place] = bottom >> 32
            self.next[short] = place + 1
            self.low[short] = (bottom & RENORM - 1) << WORD
            self.size[short] = size
            short = short[size < RENORM]

    def done(self) -> bytes:
        for shift in (32, 16, 0):
            self.flat[self.next] = self.low >> shift & 0xFFFF
            self.next += 1
        while len(at := np.flatnonzero(self.flat == 1 << WORD)):  # what ran over goes to the word before
            self.flat[at] = 0
            self.flat[at - 1] += 1
        sent = self.next - self.first
        words = self.words.astype("<u2")
        return struct.pack("<I", len(sent)) + sent.astype("<u4").tobytes() + b"".join(words[i, :n].tobytes() for i, n in enumerate(sent))


def _code(ids: np.ndarray) -> bytes:
    lanes, steps = _shape(len(ids))
    padded = np.zeros(lanes * steps, np.int64)
    padded[: len(ids)] = ids
    x = np.zeros((steps + 2, lanes), np.int64)  # before the first id of a lane stand zeros
    x[2:] = padded.reshape(lanes, steps).T
    model, sender = _Model(), _Sender(lanes, steps)
    for low, high in _spans(steps):
        now, last = x[low + 2 : high + 2], x[low + 1 : high + 1]
        guess = model.predict(x[low:high], last)
        start, width, new = model.intervals(now, *guess[1:])
        some = new.any(axis=1)
        for t in range(high - low):
            sender.send(start[t], width[t])
            if some[t]:
                at = np.flatnonzero(new[t])
                sender.send_some(at, now[t, at] << TOTAL_BITS - 16, 1 << TOTAL_BITS - 16)
        if high < steps:
            model.learn(now, last, *guess)
    return sender.done()


class _Receiver:
    """Values of all lanes from their words."""

    def __init__(self, payload: bytes, lanes: int):
        sent = np.frombuffer(payload, "<u4", lanes, 4).astype(np.int64)
        self.words = np.frombuffer(payload, "<u2", offset=4 + 4 * lanes).astype(np.int64)
        if (sent < 3).any() or sent.sum() != len(self.words):
            raise BrokenBlock("a block of impossible size")
        self.next = np.cumsum(sent) - sent
        self.code = self.words[self.next] << 32 | self.words[self.next + 1] << 16 | self.words[self.next + 2]
        self.next += 3
        self.size = np.full(lanes, FULL, np.int64)

    def values(self) -> np.ndarray:
        self.unit = self.size >> TOTAL_BITS
        return np.minimum((self.code / self.unit).astype(np.int64), TOTAL - 1)

    def take(self, start: np.ndarray, width: np.ndarray) -> None:
        self.code -= start * self.unit
        self.size = width * self.unit
        self._settle(np.flatnonzero(self.size < RENORM))

    def plain(self, lanes: np.ndarray) -> np.ndarray:
        """Ids that come as they are."""
        unit = (self.size[lanes] >> TOTAL_BITS) << TOTAL_BITS - 16
        x = np.minimum(self.code[lanes] // unit, IDS - 1)
        self.code[lanes] -= x * unit
        self.size[lanes] = unit
        self._settle(lanes[unit < RENORM])
        return x

    def _settle(self, short: np.ndarray) -> None:
        while len(short):
            place, size = self.next[short], self.size[short] << WORD
            self.code[short] = (self.code[short] << WORD | self.words.take(place, mode="clip")) & FULL - 1
            self.next[short] = place + 1
            self.size[short] = size
            short = short[size < RENORM]


def _uncode(payload: bytes, count: int) -> np.ndarray:
    lanes = struct.unpack_from("<I", payload)[0] if len(payload) >= 4 else 0
    if not 0 < lanes <= count or len(payload) < 4 + 4 * lanes or len(payload) % 2:
        raise BrokenBlock("a block of impossible size")
    steps = -(-count // lanes)
    model, receiver = _Model(), _Receiver(payload, lanes)
    x = np.zeros((steps + 2, lanes), np.int64)
    for low, high in _spans(steps):
        guesses = []
        for t in range(low, high):
            guess = model.predict(x[t], x[t + 1])
            now, start, width = model.find(receiver.values(), *guess[1:])
            receiver.take(start, width)
            if now.max() == IDS:
                at = np.flatnonzero(now == IDS)
                now[at] = receiver.plain(at)
            x[t + 2] = now
            guesses.append(guess)
        if high < steps:
            model.learn(x[low + 2 : high + 2], x[low + 1 : high + 1], *(np.stack(g) for g in zip(*guesses, strict=True)))
    return x[2:].T.reshape(-1)[:count].astype(np.uint16)


def _crc(ids: np.ndarray, coded: bytes) -> int:
    return zlib.crc32(coded, zlib.crc32(ids.astype("<u4").tobytes()))


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, block: int | None = None) -> bytes:
    """A frame of documents (whole numbers) and their ids (below IDS), one after the other. Documents may have no ids, and there may be none."""
    if len(ids) and (ids.min() < 0 or ids.max() >= IDS):
        raise ValueError(f"ids have to lie in 0 to {IDS - 1}")
    block = block or BLOCK
    coded = [_code(ids[low : low + block]) for low in range(0, len(ids), block)]
    crcs = [_crc(ids[i * block : (i + 1) * block], c) for i, c in enumerate(coded)]
    head = MAGIC + struct.pack("<4I", block, len(ids), len(coded), len(doc_ids))
    head += np.array([[len(c), crc] for c, crc in zip(coded, crcs, strict=True)], "<u4").tobytes()
    head += np.stack([np.asarray(doc_ids, "<i8"), np.asarray(lengths, "<i8")], axis=1).tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(coded)


def unpack(frame: bytes, blocks: slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a frame; of the chosen blocks only, if a slice is given. Raises BrokenBlock if anything has changed."""
    if frame[:8] != MAGIC or len(frame) < 28:
        raise BrokenBlock("not a frame")
    block, count, n, docs = struct.unpack_from("<4I", frame, 8)
    end = 24 + 8 * n + 16 * docs
    if len(frame) < end + 4 or zlib.crc32(frame[:end]) != struct.unpack_from("<I", frame, end)[0]:
        raise BrokenBlock("the head of a frame does not match its checksum")
    table = np.frombuffer(frame, "<u4", 2 * n, 24).reshape(n, 2).astype(np.int64)
    listed = np.frombuffer(frame, "<i8", 2 * docs, 24 + 8 * n).reshape(docs, 2)
    at = end + 4 + np.append(0, np.cumsum(table[:, 0]))
    if at[-1] != len(frame):
        raise BrokenBlock("blocks are missing")
    chosen = range(n)[blocks]
    lengths = np.array([min(block, count - i * block) for i in chosen], np.int64)
    found = [_uncode(frame[at[i] : at[i + 1]], n) for i, n in zip(chosen, lengths.tolist(), strict=True)]
    for i, ids in zip(chosen, found, strict=True):
        if _crc(ids, frame[at[i] : at[i + 1]]) != table[i, 1]:
            raise BrokenBlock(f"block {i} does not match its checksum")
    return listed[:, 0], listed[:, 1], np.concatenate(found) if found else np.zeros(0, np.int64)
