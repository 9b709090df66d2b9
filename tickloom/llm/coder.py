"""Token ids in an adaptive context-mixing range coder, many independent blocks abreast.

Each block starts from the same fresh state. For every id, an order-2 and an order-1 context each name the id that
followed them last, with a confidence. How often the first, or else the second, is right is learnt for each pair of confidences;
what is left goes to an adaptive order-0 distribution. These three are mixed into one distribution, by which a range
coder narrows its interval. Order 0 knows each of the smallest ids by itself and the others by ranges, an eighth of an
octave each (vocabularies number their tokens by falling frequency); the place in a range follows in as many bits as it has.
All blocks of a segment advance by one id at a time, as numpy vectors, so that a step costs a fixed number of array
operations however many blocks there are. Only integers decide: encoder and decoder follow the same states on any machine.

Segment bytes (little-endian): magic ``TLK3``; shard, segment, documents, ids, ids per block (5 x u64); documents: null
flag u8, doc_id i64, ids u64, each as one array; blocks: bytes u32, crc32 of those bytes u32, crc32 of the ids u32,
each as one array; payloads.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TLK3"
BLOCK = 1024
#: Ranges of an octave, units of the order-0 distribution, what an id adds to its range's count, most steps between two readings of the counts.
_EACH, _UNITS, _COUNT, _REFRESH = 8, 1024, 24, 256
#: Slots of an order in a lane, and the bits of a 32-bit hash beyond their number.
_SLOTS, _SHIFT = 256, np.uint32(24)
_U, _L, _TOP = np.uint32, np.uint64, np.uint32(1 << 16)
_16, _3, _4 = np.uint32(16), np.uint32(3), np.uint32(4)
# A guess is kept as its id times four plus its confidence; an empty slot has the id of all ones and confidence 0.
_NONE = np.uint32(0x3FFFFFFF << 2)
#: The least share of either guess of 2**16, and a 32nd of the most that one can approach.
_FLOOR, _SURE = np.uint32(64), np.uint32(1875)
# The interval lies in 60 bits; below 28 bits of width, it moves on by a word of 32.
_WORD, _REST, _LEAST = np.uint64(32), np.uint64(28), np.uint64(1 << 28)


def range_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order-0 range of ids, its first id, and the bits of a place in it."""
    ids = np.asarray(ids, np.int64)
    octave = np.frexp(np.maximum(ids, _EACH))[1] - 1
    bits = octave - (_EACH.bit_length() - 1)
    number = np.where(ids < 2 * _EACH, ids, _EACH * (bits + 1) + ((ids >> bits) & (_EACH - 1)))
    return number, ids >> bits << bits, bits


class _Model:
    """The state of all lanes, and what it says of the next id."""

    def __init__(self, lanes: int, block: int, vocabulary: int, places: bool):
        number, first, bits = range_of(np.arange(max(vocabulary, 1)))
        at = np.unique(number, return_index=True)[1]
        self.lanes, self.ranges = lanes, len(at)
        self.kind = np.uint8 if self.ranges <= 256 else np.uint16
        self.number, self.first, self.bits = number.astype(self.kind), first[at].astype(np.uint32), bits[at].astype(np.uint32)
        # The slots of order 1 and then of order 2, those of a lane side by side.
        self.slots = np.arange(lanes) * (2 * _SLOTS) + np.array([[0], [_SLOTS]])
        self.pairs = (np.arange(lanes) * 32).astype(np.uint32)
        self.units, self.rows = np.arange(lanes) * _UNITS, np.arange(lanes) * self.ranges
        self.guess = np.full(lanes * 2 * _SLOTS, _NONE, np.uint32)
        # Chance that the order-2 guess is right (lower half), and that either is, by 16 for equal guesses, 4 x order-2 confidence and order-1 confidence.
        two = np.repeat(np.array([0, 14000, 40000, 54000], np.uint32), 4)
        either = np.maximum(two + 1, np.tile(np.array([0, 5000, 16000, 30000], np.uint32), 4) * (65536 - two) // 65536 + two)
        self.rates = np.tile(np.concatenate([two + (either << _16), two + (two << _16)]), lanes)
        self.counts = np.full(lanes * self.ranges, 8, np.int64)
        # Ranges that order 0 gave, of each step since the counts were read.
        self.seen, self.given = np.zeros((block, lanes), self.kind), np.zeros((block, lanes), bool)
        self.read, self.places = 0, places
        self.hashes = np.zeros((2, lanes), np.uint32)
        self.slot = self.slots
        self.read_counts(0)

    def read_counts(self, t: int) -> None:
        """Make the order-0 distribution of all ids before step t; only decoders look a place up in it."""
        if t > self.read:
            rows = (self.seen[self.read : t] + self.rows)[self.given[self.read : t]]
            self.counts += np.bincount(rows, minlength=len(self.counts)) * _COUNT
            self.read = t
        edges = np.zeros((self.lanes, self.ranges + 1))
        np.cumsum(self.counts.reshape(self.lanes, self.ranges), axis=1, out=edges[:, 1:])
        # Whole numbers below 2**53, whose quotients are further from the next whole number than doubles round.
        edges = np.floor(edges * (_UNITS - self.ranges) / edges[:, -1:]).astype(np.uint32) + np.arange(self.ranges + 1, dtype=np.uint32)
        wide = np.diff(edges, axis=1)
        self.edge = (edges[:, :-1] | wide << _16).reshape(-1)
        if self.places:
            self.range_at = np.repeat(np.tile(np.arange(self.ranges, dtype=self.kind), self.lanes), wide.reshape(-1))

    def mix(self, k: int) -> None:
        """The guesses of the first k lanes, and the ends of their shares; order 0 has the rest."""
        if k < self.slot.shape[1]:
            self.slot, self.slots, self.hashes = (np.ascontiguousarray(x[:, :k]) for x in (self.slot, self.slots, self.hashes))
        self.held = self.guess.take(self.slot, mode="wrap")
        self.said = self.said1, self.said2 = self.held >> _U(2)
        trust1, trust2 = self.trust = self.held & _3
        same = (self.said1 == self.said2).astype(np.uint32)
        self.pair = ((((same << _U(2)) + trust2) << _U(2)) + trust1 + self.pairs[:k]).astype(np.intp)
        self.rate = self.rates.take(self.pair, mode="wrap")
        self.end2 = (self.rate & _U(0xFFFF)) + _FLOOR
        self.end12 = (self.rate >> _16) + _U(2) * _FLOOR
        self.unit = (_TOP - self.end12) >> _U(10)

    def share(self, number: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of each lane's share, by what gave the id: a guess, or the order-0 range."""
        edge = self.edge.take(number + self.rows[: len(number)], mode="wrap")
        start = other * (self.end12 + (edge & _U(0xFFFF)) * self.unit) + hit1 * self.end2
        width = other * ((edge >> _16) * self.unit) + hit1 * (self.end12 - self.end2) + hit2 * self.end2
        return start.astype(np.uint64), width.astype(np.uint64)

    def learn(self, t: int, k: int, ids: np.ndarray, number: np.ndarray, hit2: np.ndarray, other: np.ndarray) -> None:
        """hit2, other: 1 where the order-2 guess, and where order 0, gave the id."""
        fade = self.rate - ((self.rate >> _U(5)) & _U(0x07FF07FF))
        self.rates[self.pair] = fade + (((_U(1) - other) << _16) + hit2) * _SURE
        # A right guess gains confidence; a wrong one loses some, or is replaced.
        right = self.said == ids
        gains = self.held + (self.trust < _3)
        loses = np.where(self.trust >= _U(2), self.held - _U(1), (ids << _U(2)) + _U(1))
        self.guess[self.slot] = np.where(right, gains, loses)
        self.seen[t, :k], self.given[t, :k] = number, other
        now, before = self.hashes
        self.hashes[1] = now * _U(5)
        np.multiply(ids + _U(1), _U(0x9E3779B1), out=now)
        before += now
        self.slot = (self.hashes >> _SHIFT) + self.slots


def _reads(t: int) -> bool:
    """Whether the counts are read again before step t: often at first."""
    return t % _REFRESH == 0 if t >= _REFRESH else t >= 8 and t & (t - 1) == 0


def encode_blocks(ids: np.ndarray, vocabulary: int, block: int = BLOCK) -> list[bytes]:
    """The payload of each block of ``block`` ids (the last may be shorter)."""
    lanes = -(-len(ids) // block)
    if not lanes:
        return []
    sheet = np.zeros(lanes * block, np.uint32)
    sheet[: len(ids)] = ids
    sheet = np.ascontiguousarray(sheet.reshape(lanes, block).T)
    last = len(ids) - (lanes - 1) * block
    model = _Model(lanes, block, vocabulary, False)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 60) - 1, np.uint64)
    # Words of 32 bits and the carries above them, which are passed on at the end; a lane gives one in the steps that are marked.
    words, carried, marked = (np.zeros((block + 2, lanes), kind) for kind in (np.uint32, bool, bool))
    for t in range(block if lanes > 1 else last):
        k = lanes if t < last else lanes - 1
        if _reads(t):
            model.read_counts(t)
        x = sheet[t, :k]
        number = model.number.take(x, mode="clip")
        model.mix(k)
        hit2 = model.said2 == x
        other = ~(hit2 | (model.said1 == x))
        hit2, other = hit2.astype(np.uint32), other.astype(np.uint32)
        start, width = model.share(number, hit2, _U(1) - hit2 - other, other)
        step = span[:k] >> _L(16)
        bits = model.bits.take(number, mode="wrap") * other
        place = (x & ((_U(1) << bits) - _U(1))).astype(np.uint64)
        wide = (width * step) >> bits.astype(np.uint64)
        at = low[:k] + start * step + place * wide
        small = wide < _LEAST
        words[t, :k], carried[t, :k], marked[t, :k] = at >> _REST, at >> _L(60), small
        moved = small.astype(np.uint64)
        shift = moved << _L(5)
        low[:k] = (at & (_L(0xFFFFFFFFFFFFFFFF) >> (moved * _L(36)))) << shift  # all bits, or the lower 28
        span[:k] = wide << shift
        model.learn(t, k, x, number, hit2, other)
    words[block], words[block + 1], carried[block], marked[block:] = low >> _REST, (low & (_LEAST - _L(1))) << _L(4), low >> _L(60), True
    ends = np.cumsum(np.count_nonzero(marked, axis=0))
    words = words.T[marked.T] + (carried.T[marked.T].astype(np.uint64) << _WORD)
    while True:
        over = np.flatnonzero(words > 0xFFFFFFFF)
        if not len(over):
            break
        words[over - 1] += words[over] >> _WORD  # one place a round
        words[over] &= _L(0xFFFFFFFF)
    data = words.astype("<u4")
    return [data[a:b].tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist())]


def decode_blocks(payloads: list[bytes], count: int, vocabulary: int, block: int = BLOCK) -> np.ndarray:
    """The ``count`` ids that encode_blocks was given."""
    lanes = len(payloads)
    if not lanes:
        return np.zeros(0, np.uint32)
    room = max(map(len, payloads)) // 4 + 4
    words = np.zeros((lanes, room), np.uint32)
    for i, p in enumerate(payloads):
        words[i, : len(p) // 4] = np.frombuffer(p, "<u4", len(p) // 4)
    code = (words[:, 0].astype(np.uint64) << _REST) + (words[:, 1] >> _4)
    # From here on, words begin four bits before those of the payload end.
    words[:, :-1] = (words[:, :-1] << _U(28)) + (words[:, 1:] >> _4)
    words = words.reshape(-1)
    taken = np.arange(lanes) * room + 1
    last = count - (lanes - 1) * block
    sheet = np.zeros((block, lanes), np.uint32)
    model = _Model(lanes, block, vocabulary, True)
    span = np.full(lanes, (1 << 60) - 1, np.uint64)
    for t in range(block if lanes > 1 else last):
        k = lanes if t < last else lanes - 1
        if _reads(t):
            model.read_counts(t)
        model.mix(k)
        step = span[:k] >> _L(16)
        value = np.minimum(code[:k] // step, _L(0xFFFF)).astype(np.uint32)
        other = (value >= model.end12).astype(np.uint32)
        hit2 = (value < model.end2).astype(np.uint32)
        hit1 = _U(1) - hit2 - other
        unit = np.minimum(((value - model.end12) * other / model.unit).astype(np.intp), _UNITS - 1)
        number = model.range_at.take(unit + model.units[:k], mode="wrap")
        start, width = model.share(number, hit2, hit1, other)
        bits = model.bits.take(number, mode="wrap") * other
        wide = (width * step) >> bits.astype(np.uint64)
        left = code[:k] - start * step
        place = np.minimum((left // wide).astype(np.uint32), (_U(1) << bits) - _U(1))
        x = other * (model.first.take(number, mode="wrap") + place) + hit1 * model.said1 + hit2 * model.said2
        small = wide < _LEAST
        moved = small.astype(np.uint64)
        shift = moved << _L(5)
        code[:k] = ((left - place * wide) << shift) + words.take(taken[:k], mode="clip") * moved
        span[:k] = wide << shift
        taken[:k] += small
        model.learn(t, k, x, number, hit2, other)
        sheet[t, :k] = x
    return np.ascontiguousarray(sheet.T).reshape(-1)[:count]


def pack_segment(shard: int, segment: int, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, vocabulary: int, block: int = BLOCK) -> bytes:
    """The bytes of a segment of whole documents."""
    payloads = encode_blocks(ids, vocabulary, block)
    crcs = [zlib.crc32(np.ascontiguousarray(ids[k : k + block], "<u4").data) for k in range(0, len(ids), block)]
    return b"".join(
        [
            MAGIC,
            struct.pack("<5Q", shard, segment, len(doc_ids), len(ids), block),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.asarray(counts, "<u8").tobytes(),
            np.array([len(p) for p in payloads], "<u4").tobytes(),
            np.array([zlib.crc32(p) for p in payloads], "<u4").tobytes(),
            np.array(crcs, "<u4").tobytes(),
            *payloads,
        ]
    )


def read_segment(data: bytes, at: int, vocabulary: int) -> tuple[int, int, list[int | None], np.ndarray, np.ndarray, int]:
    """shard, segment, doc_ids, counts and ids of the segment at an offset, and the offset behind it; raises on damage."""
    if data[at : at + 4] != MAGIC:
        raise ValueError(f"no segment starts at byte {at}")
    shard, segment, docs, total, block = struct.unpack_from("<5Q", data, at + 4)
    at += 44

    def array(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    nulls, named, counts = array("u1", docs), array("<i8", docs), array("<u8", docs).astype(np.int64)
    blocks = -(-total // block)
    sizes, marks, crcs = array("<u4", blocks), array("<u4", blocks), array("<u4", blocks)
    payloads = []
    for k, (n, mark) in enumerate(zip(sizes.tolist(), marks.tolist())):
        payloads.append(data[at : at + n])
        at += n
        if zlib.crc32(payloads[-1]) != mark:
            raise ValueError(f"the bytes of block {k} of segment {segment} of shard {shard} are damaged")
    ids = decode_blocks(payloads, total, vocabulary, block)
    for k, want in enumerate(crcs.tolist()):
        if zlib.crc32(np.ascontiguousarray(ids[k * block : (k + 1) * block], "<u4").data) != want:
            raise ValueError(f"block {k} of segment {segment} of shard {shard} is damaged")
    return shard, segment, [None if n else d for n, d in zip(nulls.tolist(), named.tolist())], counts, ids, at
