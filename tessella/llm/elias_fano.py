"""Elias-Fano sequences and n-gram trie levels on numpy arrays that may be memory-mapped."""

from __future__ import annotations

import os

import numpy as np

U64 = np.uint64

#: Place of the k-th zero in a byte: SELECT0[byte, k].
_ZEROS = ~np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(bool)
SELECT0 = np.argsort(~_ZEROS, axis=1, kind="stable").astype(np.uint8)

#: One in each octet of a 64-bit word.
_EACH = U64(0x0101010101010101)


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of each value, end to end in 64-bit words: 64 values fill `width` words. One word pads the end."""
    if not width or not len(values):
        return np.zeros(1, U64)
    groups = -(-len(values) // 64)
    lanes = np.zeros(groups * 64, U64)
    lanes[: len(values)] = values & U64((1 << width) - 1)
    lanes = lanes.reshape(groups, 64)
    out = np.zeros(groups * width + 1, U64)
    words = out[:-1].reshape(groups, width)
    for lane in range(64):
        word, offset = divmod(lane * width, 64)
        words[:, word] |= lanes[:, lane] << U64(offset)
        if offset + width > 64:
            words[:, word + 1] |= lanes[:, lane] >> U64(64 - offset)
    return out[: -(-len(values) * width // 64) + 1]


class EliasFano:
    """An ascending sequence of unsigned 64-bit integers.

    With n values up to m, the low floor(log2(m / n)) bits of each are packed bit by bit; the high bits stand in unary: for value i
    a one at place high + i. Zeros are counted before each 64-bit block, in 32 bits; ones follow from that.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, shift: int, size: int) -> None:
        self.low, self.high, self.zeros, self.shift, self.size = low, high, zeros, shift, size

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        shift = max(0, (top // max(n, 1)).bit_length() - 1)
        low = _packed(values, shift)
        upper = (values >> U64(shift)).astype(np.int64)
        bits = np.zeros((n + (top >> shift) + 2 + 63) // 64 * 64, bool)
        bits[upper + np.arange(n)] = True
        packed = np.packbits(bits, bitorder="little").view(U64)
        zeros = np.r_[0, np.cumsum(64 - np.bitwise_count(packed).astype(np.int64))].astype(np.uint32)
        return cls(low, packed, zeros, shift, n)

    def save(self, folder: str, name: str) -> None:
        for part in ("low", "high", "zeros"):
            np.save(os.path.join(folder, f"{name}.{part}.npy"), getattr(self, part))
        np.save(os.path.join(folder, f"{name}.size.npy"), np.array([self.shift, self.size]))

    @classmethod
    def mapped(cls, folder: str, name: str) -> EliasFano:
        load = lambda part: np.load(os.path.join(folder, f"{name}.{part}.npy"), mmap_mode="r")
        shift, size = load("size").tolist()
        return cls(load("low"), load("high"), load("zeros"), shift, size)

    def low_at(self, at: np.ndarray) -> np.ndarray:
        """Low bits of the values at places."""
        if not self.shift:
            return np.zeros(len(at), U64)
        bit = at.astype(U64) * U64(self.shift)
        word, offset = (bit >> U64(6)).astype(np.int64), bit & U64(63)
        both = (self.low[word] >> offset) | (self.low[word + 1] << U64(1) << (U64(63) - offset))
        return both & U64((1 << self.shift) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at places, which must be within the sequence."""
        ones = np.arange(0, 64 * len(self.zeros), 64) - self.zeros
        block = np.searchsorted(ones, at, side="right") - 1
        place = block * 64 + self._within(block, at - ones[block], one=True)
        return ((place - at).astype(U64) << U64(self.shift)) | self.low_at(at)

    def _within(self, block: np.ndarray, rest: np.ndarray, one: bool) -> np.ndarray:
        """Bit place in its block of the rest-th zero, or one, from 0."""
        words = self.high[block] if not one else ~self.high[block]
        # Zeros of each octet and of those before it, in the octets of one word.
        ahead = ~words
        ahead -= ahead >> U64(1) & _EACH * U64(0x55)
        ahead = (ahead & _EACH * U64(0x33)) + (ahead >> U64(2) & _EACH * U64(0x33))
        ahead = (ahead + (ahead >> U64(4)) & _EACH * U64(0x0F)) * _EACH
        rest = rest.astype(U64)
        reached = (ahead | _EACH * U64(0x80)) - (rest + U64(1)) * _EACH & _EACH * U64(0x80)
        start = U64(64) - np.bitwise_count(reached).astype(U64) * U64(8)
        before = ahead << U64(8) >> start & U64(0xFF)
        return start.astype(np.int64) + SELECT0[words >> start & U64(0xFF), rest - before]

    def place_of_zero(self, k: np.ndarray) -> np.ndarray:
        """Bit place of the k-th zero (from 0); k must be within the zeros there are."""
        block = np.searchsorted(self.zeros, k.astype(np.uint32), side="right") - 1
        return block * 64 + self._within(block, k - self.zeros[block], one=False)

    def search(self, values: np.ndarray) -> np.ndarray:
        """Place of each value in the sequence, or -1: successor search in the bucket of its high bits."""
        out = np.full(len(values), -1, np.int64)
        if not self.size:
            return out
        upper = (values >> U64(self.shift)).astype(np.int64)
        ok = np.flatnonzero(upper < int(self.zeros[-1]) - 1)
        for a in range(0, len(ok), 1 << 18):
            part = ok[a : a + (1 << 18)]
            h = upper[part]
            stop = self.place_of_zero(h) - h
            begin = np.where(h > 0, self.place_of_zero(np.maximum(h - 1, 0)) - h + 1, 0)
            if not self.shift:
                hit = begin < stop
                out[part[hit]] = begin[hit]
                continue
            want = values[part] & U64((1 << self.shift) - 1)
            lo, hi = begin, stop.copy()
            while True:  # lowest place whose low bits reach those wanted
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                less = self.low_at(mid) < want[open_]
                lo[open_[less]] = mid[less] + 1
                hi[open_[~less]] = mid[~less]
            inside = lo < stop
            hit = np.zeros(len(part), bool)
            hit[inside] = self.low_at(lo[inside]) == want[inside]
            out[part[hit]] = lo[hit]
        return out


#: The codebook of counts: up to EXACT they stand for themselves, above that 8-bit codes grow by a fixed ratio up to 2**40.
EXACT = 32
RATIO = (2.0**40 / EXACT) ** (1 / (256 - EXACT))
COUNTS = np.r_[np.arange(1.0, EXACT + 1), EXACT * RATIO ** np.arange(1, 257 - EXACT)]
_EDGES = np.sqrt(COUNTS[1:] * COUNTS[:-1])


def quantised(counts: np.ndarray) -> np.ndarray:
    """8-bit codes of counts from 1: the place in COUNTS that is nearest by ratio, off by RATIO ** 0.5 (5.6 %) at most."""
    return np.searchsorted(_EDGES, counts).astype(np.uint8)
