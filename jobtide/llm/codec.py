"""Adaptive context-mixing range coder for token ids, many independent blocks side by side.

A block starts from an empty model. For every id the order-2 and the order-1 context (hashed, per block) each propose the id
that followed them last, with a confidence; order 0 proposes the ids seen so far in the block, by number. The
weights of the three are learnt while coding, per pair of confidences. They mix into one distribution: share f2 for
the order-2 proposal, f1 for the order-1 proposal, f0 spread over the ids of order 0, and the rest spread evenly
over all ids. The id's interval of that distribution narrows a 64-bit range coder with carry.

The order-0 table is renewed when the block has 256, 512, 1024, ... ids. All blocks take the same step at the same time, so one
numpy operation works on one id of every block. Encoder and decoder share the model code below.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"JTCM"
HEAD = struct.Struct("<4sIIII")  # magic, ids, documents that start here, payload words, checksum
IDS = 1 << 16
LONGEST = 4096  # ids of a block
LANES = 512  # blocks coded side by side
_ORDER1, _ORDER2 = 12, 13  # bits of the context tables
_FIRST = 256
_SHIFT, _TOP = np.uint64(28), np.uint64(1 << 32)
_32 = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


def _hash(bits: int, factor: int) -> np.ndarray:
    return ((np.arange(IDS, dtype=np.uint64) * np.uint64(factor)) >> np.uint64(11) & np.uint64((1 << bits) - 1)).astype(np.int64)


_H1, _H2A, _H2B = _hash(_ORDER1, 0x9E3779B1), _hash(_ORDER2, 0x85EBCA77), _hash(_ORDER2, 0xC2B2AE3D)


_4, _16, _UP = np.int32(4), np.int32(16), np.int32(3968 - 16)  # a weight moves between 16 and 3968 of 4096
# By confidence 0 to 3, then the same after a hit: whether the proposal stays, and its confidence afterwards (from bit 16).
_STAYS = np.array([False, False, True, True, True, True, True, True])
_CONFIDENCE = np.array([1, 1, 1, 2, 1, 2, 3, 3], np.int32) << 16


class _Model:
    """The state of ``lanes`` blocks."""

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.at1, self.at2, self.at_q = lane << _ORDER1, lane << _ORDER2, lane * 32
        self.table1 = np.zeros(lanes << _ORDER1, np.int32)  # id, and confidence from bit 16
        self.table2 = np.zeros(lanes << _ORDER2, np.int32)
        start = np.array([64, 1024, 2048, 3072], np.int32)
        state = np.arange(32)
        self.q2 = np.tile(start[(state >> 2) & 3], lanes)
        self.q1 = np.tile(start[state & 3], lanes)
        self.known = np.full(lanes, 256, np.int32)
        self.c1 = np.zeros(lanes, np.int32)
        self.c2 = np.zeros(lanes, np.int32)

    def propose(self) -> None:
        self.i1 = self.at1 + _H1.take(self.c1)
        self.i2 = self.at2 + (_H2A.take(self.c1) ^ _H2B.take(self.c2))
        e1, e2 = self.table1.take(self.i1), self.table2.take(self.i2)
        self.s1, self.k1, self.s2, self.k2 = e1 & 0xFFFF, e1 >> 16, e2 & 0xFFFF, e2 >> 16
        self.iq = self.at_q + ((self.k2 << 2) | self.k1 | (self.s1 == self.s2) * _16)
        q2, q1 = self.q2.take(self.iq), self.q1.take(self.iq)
        self.now2, self.now1 = q2, q1
        rest = 4096 - q2
        self.f2, self.f1 = q2, np.maximum((rest * q1) >> 12, 1)
        rest = rest - self.f1
        self.f0 = np.maximum((rest * self.known) >> 12, 1)
        self.fe = rest - self.f0
        self.o1 = q2
        self.o0 = q2 + self.f1
        self.oe = self.o0 + self.f0

    def learn(self, x: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, seen: np.ndarray) -> None:
        """``hit1`` and ``seen`` are only looked at where the proposals before them failed."""
        self.q2[self.iq] = self.now2 + ((hit2 * _UP + _16 - self.now2) >> 5)
        self.q1[self.iq] = np.where(hit2, self.now1, self.now1 + ((hit1 * _UP + _16 - self.now1) >> 5))
        self.known = np.where(hit2 | hit1, self.known, self.known + ((seen * _UP + _16 - self.known) >> 5))
        for table, i, s, k in ((self.table1, self.i1, self.s1, self.k1), (self.table2, self.i2, self.s2, self.k2)):
            state = k | (s == x) * _4
            table[i] = np.where(_STAYS.take(state), s, x) | _CONFIDENCE.take(state)
        self.c2, self.c1 = self.c1, x


def _sorted_runs(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the first ``n`` ids of each block (a column of ``ids``): sorted, the first place of each value, its number."""
    s = np.sort(ids[:n].T, axis=1)
    first = np.zeros(s.shape, np.int32)
    fresh = s[:, 1:] != s[:, :-1]
    first[:, 1:] = np.where(fresh, np.arange(1, n, dtype=np.int32), 0)
    np.maximum.accumulate(first, axis=1, out=first)
    last = np.full(s.shape, n, np.int32)
    last[:, :-1] = np.where(fresh, np.arange(1, n, dtype=np.int32), n)
    last = np.minimum.accumulate(last[:, ::-1], axis=1)[:, ::-1]
    return s, first, last - first


def encode_lanes(ids: np.ndarray) -> list[np.ndarray]:
    """The payload words (uint32) of each block; ``ids`` is (length, blocks), int32."""
    length, lanes = ids.shape
    model = _Model(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    room = length + 4
    out = np.zeros(lanes * room, np.uint32)
    begin = np.arange(lanes, dtype=np.int64) * room
    place = begin.copy()
    kinds = int(ids.max()) + 1 if ids.size else 1
    row = np.arange(lanes, dtype=np.int64) * kinds
    order0 = np.zeros(lanes * kinds, np.uint32)  # by id: first place in the sorted ids, and the number from bit 16
    shift, renew = 16, _FIRST
    for t in range(length):
        if t == renew:
            s, first, number = _sorted_runs(ids, t)
            for k in range(lanes):  # block by block: no index array over all of them
                order0[row[k] : row[k] + kinds][s[k]] = first[k] | (number[k] << 16)
            shift, renew = 16 - (t.bit_length() - 1), 2 * t
        x = ids[t]
        model.propose()
        hit2 = x == model.s2
        hit1 = ~hit2 & (x == model.s1)
        hit = hit2 | hit1
        entry = order0.take(row + x)
        number = (entry >> np.uint32(16)).astype(np.int32)
        seen = number > 0
        f = np.where(hit2, model.f2, np.where(hit1, model.f1, np.where(seen, model.f0, model.fe)))
        o = np.where(hit2, 0, np.where(hit1, model.o1, np.where(seen, model.o0, model.oe)))
        inner = np.where(hit, 0, np.where(seen, (entry & np.uint32(0xFFFF)).astype(np.int32) << shift, x))
        width = np.where(hit, IDS, np.where(seen, number << shift, 1))
        f = f.astype(np.uint64)
        r = span >> _SHIFT
        moved = low + r * ((o.astype(np.uint64) << np.uint64(16)) + f * inner.astype(np.uint64))
        carried = np.flatnonzero(moved < low)
        if len(carried):
            at = place[carried] - 1
            out[at] += np.uint32(1)
            for k in at[out[at] == 0].tolist():
                while out[k] == 0:
                    k -= 1
                    out[k] += np.uint32(1)
        low, span = moved, r * (f * width.astype(np.uint64))
        small = np.flatnonzero(span < _TOP)
        if len(small):
            out[place[small]] = (low[small] >> _32).astype(np.uint32)
            place[small] += 1
            low[small] <<= _32
            span[small] <<= _32
        model.learn(x, hit2, hit1, seen)
    out[place], out[place + 1] = (low >> _32).astype(np.uint32), (low & _LOW).astype(np.uint32)
    return [out[a : b + 2] for a, b in zip(begin, place)]


def decode_lanes(payload: list[np.ndarray], length: int) -> np.ndarray:
    """(length, blocks) ids; a block shorter than ``length`` is followed by ids without meaning."""
    lanes = len(payload)
    model = _Model(lanes)
    sizes = np.fromiter(map(len, payload), np.int64, lanes)
    words = np.zeros(int(sizes.sum()) + 2 * lanes + 2, np.uint64)
    begin = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]]) if lanes else np.zeros(0, np.int64)
    for a, p in zip(begin, payload):
        words[a : a + len(p)] = p
    end = begin + sizes
    value = (words[begin] << _32) | words[begin + 1]
    place = begin + 2
    span = np.full(lanes, 2**64 - 1, np.uint64)
    ids = np.zeros((length, lanes), np.int32)
    row = np.zeros(lanes, np.int64)
    s = first = number = np.zeros(lanes, np.int32)
    shift, renew, filled = 16, _FIRST, False
    for t in range(length):
        if t == renew:
            s, first, number = (a.ravel() for a in _sorted_runs(ids, t))
            row = np.arange(lanes, dtype=np.int64) * t
            shift, renew, filled = 16 - (t.bit_length() - 1), 2 * t, True
        model.propose()
        r = span >> _SHIFT
        slot = np.minimum(value // np.maximum(r, np.uint64(1)), np.uint64((1 << 28) - 1)).astype(np.int32)
        part = slot >> 16
        hit2, below1, below0 = part < model.o1, part < model.o0, part < model.oe
        hit1, hit = below1 & ~hit2, below1
        seen = below0 & ~below1
        f = np.where(hit2, model.f2, np.where(hit1, model.f1, np.where(seen, model.f0, model.fe)))
        o = np.where(hit2, 0, np.where(hit1, model.o1, np.where(seen, model.o0, model.oe)))
        even = np.minimum((slot - (o << 16)) // f, IDS - 1)
        if filled:
            at = row + (even >> shift)
            known, start, count = s.take(at), first.take(at) << shift, number.take(at) << shift
        else:
            known = start = count = np.zeros(lanes, np.int32)
        x = np.where(hit2, model.s2, np.where(hit1, model.s1, np.where(seen, known, even)))
        inner = np.where(hit, 0, np.where(seen, start, even))
        width = np.where(hit, IDS, np.where(seen, count, 1))
        f = f.astype(np.uint64)
        value = value - r * ((o.astype(np.uint64) << np.uint64(16)) + f * inner.astype(np.uint64))
        span = r * (f * width.astype(np.uint64))
        small = np.flatnonzero(span < _TOP)
        if len(small):
            value[small] = (value[small] << _32) | words[np.minimum(place[small], end[small])]
            place[small] += 1
            span[small] <<= _32
        ids[t] = x
        # What the encoder saw: an id proposed by order 1 or 2 counts as seen only where neither proposed it.
        model.learn(x, hit2, hit1, seen)
    return ids


# --- blocks -------------------------------------------------------------------------------------


def block_length(n: int) -> int:
    """Ids of a block for ``n`` ids: enough blocks to fill the lanes, 512 ids at least."""
    length = 512
    while length < LONGEST and n > length * LANES // 2:
        length *= 2
    return length


def write_blocks(ids: np.ndarray, starts: np.ndarray, doc_ids: list[int | None], totals: np.ndarray) -> list[bytes]:
    """Blocks of ``ids``. Document i starts at id ``starts[i]`` and has ``totals[i]`` ids (which may go on beyond)."""
    if len(ids) and int(ids.max()) >= IDS:
        raise ValueError(f"token ids must be below {IDS}")
    length = block_length(len(ids))
    blocks = -(-len(ids) // length)
    padded = np.zeros(blocks * length, np.int32)
    padded[: len(ids)] = ids
    payload: list[np.ndarray] = []
    for a in range(0, blocks, LANES):
        part = padded[a * length : (a + LANES) * length].reshape(-1, length)
        payload += encode_lanes(np.ascontiguousarray(part.T))
    own = np.searchsorted(starts, np.arange(blocks + 1) * length)
    out = []
    for b in range(blocks):
        a, z = own[b], own[b + 1]
        given = [d is not None for d in doc_ids[a:z]]
        index = b"".join((
            np.array(given, "<u1").tobytes(), np.array([d or 0 for d in doc_ids[a:z]], "<i8").tobytes(),
            (starts[a:z] - b * length).astype("<u4").tobytes(), np.asarray(totals[a:z]).astype("<u8").tobytes(),
        ))
        body = ids[b * length : (b + 1) * length].astype("<u4").tobytes()
        check = zlib.crc32(body, zlib.crc32(index))
        out.append(HEAD.pack(MAGIC, len(body) // 4, z - a, len(payload[b]), check) + index + payload[b].astype("<u4").tobytes())
    return out


def read_blocks(blocks: list[bytes]) -> list[tuple[np.ndarray, list[int | None], np.ndarray, np.ndarray]]:
    """(ids, doc_ids, starts, totals) of each block; a damaged block is an error."""
    out = []
    for at in range(0, len(blocks), LANES):
        parts, payload = [], []
        for data in blocks[at : at + LANES]:
            if len(data) < HEAD.size:
                raise ValueError("block cut short")
            magic, n, docs, size, check = HEAD.unpack_from(data)
            place = HEAD.size + 21 * docs
            if magic != MAGIC or len(data) != place + 4 * size:
                raise ValueError("not a block, or cut short")
            parts.append((n, docs, check, data[HEAD.size : place]))
            payload.append(np.frombuffer(data, "<u4", size, place))
        ids = decode_lanes(payload, max(p[0] for p in parts)).T
        for (n, docs, check, index), own in zip(parts, ids):
            own = own[:n]
            if zlib.crc32(own.astype("<u4").tobytes(), zlib.crc32(index)) != check:
                raise ValueError("checksum differs")
            given = np.frombuffer(index, "<u1", docs)
            names = np.frombuffer(index, "<i8", docs, docs).tolist()
            starts, totals = np.frombuffer(index, "<u4", docs, 9 * docs), np.frombuffer(index, "<u8", docs, 13 * docs)
            out.append((own, [d if g else None for d, g in zip(names, given)], starts.astype(np.int64), totals.astype(np.int64)))
    return out
