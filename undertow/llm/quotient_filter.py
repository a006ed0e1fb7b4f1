"""Counting quotient filters of packed word-id n-grams, lossless as the whole remainder is stored.

An n-gram of k ids of `bits` bits is one number of m = k * bits bits (two halves of at most 64). A Feistel network permutes
the m-bit numbers; it can be undone, so the permuted number stands for the n-gram. Its leading bits are the quotient and
name a slot of a table, the rest is the remainder. In a filter the remainders of a quotient form a sorted run; two bit
vectors (which quotients occur; which remainders continue a run) put the quotients back. Counters take a byte, or nine
from 255 on. As everything is sorted by permuted number, filters of one range merge by one pass over sorted runs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from undertow.llm.shared import mix

_U = np.uint64
_ROUNDS = tuple(_U(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89))


def _mask(bits: int) -> np.uint64:
    return _U((1 << bits) - 1)


@dataclass(frozen=True)
class Packing:
    """n-grams of `k` ids below 2**bits as permuted numbers of `size` bits: `top`, their first 64 at most, and `rest`."""

    k: int
    bits: int

    def __post_init__(self) -> None:
        if self.bits * (self.k - self.k // 2) > 64:
            raise ValueError(f"{self.k} ids of {self.bits} bits do not fit two halves of 64 bits")

    @property
    def size(self) -> int:
        return self.k * self.bits

    @property
    def top_bits(self) -> int:
        return min(64, self.size)

    def permute(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids: one row an n-gram."""
        half = self.k - self.k // 2
        left, right = (_packed(part, self.bits) for part in (ids[:, :half], ids[:, half:]))
        for i, key in enumerate(_ROUNDS):
            if i % 2:
                right = right ^ (mix(left + key) & _mask(self.bits * (self.k - half)))
            else:
                left = left ^ (mix(right + key) & _mask(self.bits * half))
        low = self.bits * (self.k - half)
        over = self.size - self.top_bits
        if not over:
            return (left << _U(low)) | right, np.zeros(len(left), _U)
        return (left << _U(low - over)) | (right >> _U(over)), right & _mask(over)

    def restore(self, top: np.ndarray, rest: np.ndarray) -> np.ndarray:
        half = self.k - self.k // 2
        low, over = self.bits * (self.k - half), self.size - self.top_bits
        left = top >> _U(low - over)
        right = ((top & _mask(low - over)) << _U(over)) | rest
        for i, key in reversed(list(enumerate(_ROUNDS))):
            if i % 2:
                right = right ^ (mix(left + key) & _mask(low))
            else:
                left = left ^ (mix(right + key) & _mask(self.bits * half))
        return np.concatenate([_unpacked(left, half, self.bits), _unpacked(right, self.k - half, self.bits)], axis=1)

    def quotient(self, top: np.ndarray, bits: int) -> np.ndarray:
        return top >> _U(self.top_bits - bits)


def _packed(ids: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(ids), _U)
    for column in ids.T:
        out = (out << _U(bits)) | column.astype(_U)
    return out


def _unpacked(x: np.ndarray, k: int, bits: int) -> np.ndarray:
    return np.stack([(x >> _U(bits * (k - 1 - i))) & _mask(bits) for i in range(k)], axis=1).astype(np.int64) if k else np.zeros((len(x), 0), np.int64)


@dataclass
class Filter:
    """Distinct permuted n-grams in order, each with its count."""

    packing: Packing
    top: np.ndarray
    rest: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, packing: Packing, ids: np.ndarray) -> Filter:
        top, rest = packing.permute(ids)
        return cls(packing, *_summed(top, rest, np.ones(len(top), np.int64), bool(packing.size > 64)))

    def __len__(self) -> int:
        return len(self.top)

    def merge(self, *others: Filter) -> Filter:
        every = [f for f in (self, *others) if len(f)]
        if len(every) < 2:
            return every[0] if every else self
        parts = (np.concatenate([getattr(f, name) for f in every]) for name in ("top", "rest", "count"))
        return Filter(self.packing, *_summed(*parts, self.packing.size > 64))

    def pieces(self, bits: int) -> list[tuple[int, Filter]]:
        """The filters of all values of the first `bits` bits that occur."""
        of = self.packing.quotient(self.top, bits)
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        return [(int(of[a]), Filter(self.packing, self.top[a:b], self.rest[a:b], self.count[a:b])) for a, b in zip(starts, [*starts[1:], len(of)], strict=True)]

    def ids(self) -> np.ndarray:
        return self.packing.restore(self.top, self.rest)

    def to_bytes(self, bits: int) -> bytes:
        """One piece: all numbers share their first `bits` bits, which are not stored."""
        p, n = self.packing, len(self)
        q = min(p.top_bits - bits, max(1, n).bit_length())  # about as many quotients as remainders
        low = p.top_bits - bits - q
        quotient = ((self.top >> _U(low)) & _mask(q)).astype(np.int64)
        new = np.concatenate([[True], quotient[1:] != quotient[:-1]])
        occupied = np.zeros(1 << q, bool)
        occupied[quotient[new]] = True
        small = np.minimum(self.count, 255).astype(np.uint8)
        return b"".join([
            np.array([n, q], np.int64).tobytes(), np.packbits(occupied).tobytes(), np.packbits(~new).tobytes(),
            _to_columns(self.top & _mask(low), low), _to_columns(self.rest, p.size - p.top_bits), small.tobytes(), self.count[small == 255].astype(np.int64).tobytes(),
        ])

    @classmethod
    def from_bytes(cls, packing: Packing, bits: int, piece: int, data: bytes) -> Filter:
        raw = np.frombuffer(data, np.uint8)
        n, q = (int(x) for x in np.frombuffer(data, np.int64, 2))
        at = 16

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return raw[at - size : at]

        occupied = np.flatnonzero(np.unpackbits(take(-(-(1 << q) // 8)), count=1 << q))
        run = np.cumsum(np.unpackbits(take(-(-n // 8)), count=n) == 0) - 1
        low = packing.top_bits - bits - q
        top = (_U(piece) << _U(packing.top_bits - bits)) if bits else _U(0)
        top = top | (occupied[run].astype(_U) << _U(low)) | _from_columns(take(n * -(-low // 8)), n)
        rest = _from_columns(take(n * -(-(packing.size - packing.top_bits) // 8)), n)
        count = take(n).astype(np.int64)
        large = count == 255
        count[large] = np.frombuffer(raw[at:].tobytes(), np.int64)
        return cls(packing, top, rest, count)


def _to_columns(x: np.ndarray, bits: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)].tobytes()


def _from_columns(data: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n and len(data):
        out[:, : len(data) // n] = data.reshape(n, -1)
    return out.reshape(-1).view("<u8").astype(_U)


def _summed(top: np.ndarray, rest: np.ndarray, count: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted, with equal numbers as one. A stable sort goes through runs that are sorted already."""
    order = np.argsort(top, kind="stable")
    top, rest, count = top[order], rest[order], count[order]
    same = top[1:] == top[:-1]
    if wide and (same & (rest[1:] != rest[:-1])).any():  # equal in 64 bits and different beyond
        order = np.lexsort((rest, top))
        top, rest, count = top[order], rest[order], count[order]
        same = (top[1:] == top[:-1]) & (rest[1:] == rest[:-1])
    starts = np.flatnonzero(np.concatenate([[True], ~same])) if len(top) else np.zeros(0, np.int64)
    return top[starts], rest[starts], np.add.reduceat(count, starts) if len(starts) else count
