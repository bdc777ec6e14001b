"""Ribbon filters: static membership filters from banded linear systems over GF(2).

A key gives a start slot, a 64-bit coefficient band (lowest bit set) and a
fingerprint.  Building a filter solves, for all its keys at once, "the XOR of
the solution's rows that the band selects equals the fingerprint"; a query
evaluates that XOR.  A key of the set always agrees; another key agrees with
probability 2**-fingerprint_bits.

Keys are spread over buckets, each its own small banded system.  All buckets
are eliminated in lockstep, one key of each at a time, so the work is numpy
operations over buckets instead of Python steps over keys.  A key whose row
vanishes against a contradicting fingerprint is kept aside exactly (``bumped``).
"""

from __future__ import annotations

import numpy as np

BAND = 64
_U = np.uint64


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        z = x + _U(salt)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def _reduce(x: np.ndarray, n: int) -> np.ndarray:
    """The upper 32 bits of x scaled to 0..n-1."""
    return ((x >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def mix(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """What any filter needs of a key: bucket, start, coefficients and fingerprint before they are fitted to the filter's size."""
    with np.errstate(over="ignore"):
        return (
            _mix(h1, 11), _mix(h1 ^ (h2 << _U(1)), 23), _mix(h2, 37) | _U(1), (_mix(h1 + (h2 >> _U(1)), 53) >> _U(48)).astype(np.uint16),
        )


class RibbonFilter:
    """Filter over keys given as two independent 64-bit hashes each."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, *, bits: int = 16, bucket_keys: int = 256, load: float = 1.06):
        if not 1 <= bits <= 16:
            raise ValueError("bits must be between 1 and 16")
        h1, h2 = h1.astype(np.uint64), h2.astype(np.uint64)
        self.n_keys, self.bits = len(h1), bits
        self.buckets = max(1, -(-len(h1) // bucket_keys))
        mixed = mix(h1, h2)
        g = _reduce(mixed[0], self.buckets)
        count = np.bincount(g, minlength=self.buckets)
        self.slots = int(max(count.max() if len(h1) else 1, 1) * load) + BAND
        _, start, coeff, print_ = self._place(mixed)
        order = np.lexsort((start, g))
        first = np.cumsum(count) - count
        rows = np.zeros((self.buckets, self.slots), np.uint64)
        right = np.zeros((self.buckets, self.slots), np.uint16)
        bumped = []
        for step in range(int(count.max()) if len(h1) else 0):
            at = np.flatnonzero(count > step)
            key = order[first[at] + step]
            s, c, f = start[key], coeff[key], print_[key]
            while len(at):
                held = rows[at, s]
                free = held == 0
                if free.any():
                    rows[at[free], s[free]] = c[free]
                    right[at[free], s[free]] = f[free]
                    busy = ~free
                    at, s, c, f, key, held = at[busy], s[busy], c[busy], f[busy], key[busy], held[busy]
                    if not len(at):
                        break
                c = c ^ held
                f = f ^ right[at, s]
                gone = c == 0
                if gone.any():
                    bumped.append(key[gone & (f != 0)])
                    left = ~gone
                    at, s, c, f, key = at[left], s[left], c[left], f[left], key[left]
                low = np.bitwise_count((c & (~c + _U(1))) - _U(1))
                c = c >> low.astype(np.uint64)
                s = s + low
        self.bumped = np.sort(h1[np.concatenate(bumped)]) if bumped else np.empty(0, np.uint64)
        self.planes = self._planes(self._solve(rows, right))

    def _place(self, mixed: tuple[np.ndarray, ...]):
        m1, m2, coeff, print_ = mixed
        return _reduce(m1, self.buckets), _reduce(m2, self.slots - BAND + 1), coeff, print_ >> np.uint16(16 - self.bits)

    def _solve(self, rows: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Back substitution from the last slot to the first; free slots are 0."""
        table = np.zeros((self.buckets, self.slots + BAND), np.uint16)
        place = np.arange(1, BAND, dtype=np.uint64)
        for i in range(self.slots - 1, -1, -1):
            c = rows[:, i]
            if c.any():
                chosen = (c[:, None] >> place & _U(1)).astype(np.uint16)
                value = right[:, i] ^ np.bitwise_xor.reduce(table[:, i + 1:i + BAND] * chosen, axis=1)
                table[:, i] = np.where(c != 0, value, 0)
        return table

    def _planes(self, table: np.ndarray) -> np.ndarray:
        """The solution by bits: [64 slots, fingerprint bit] as words, each bucket from a whole word on."""
        self.width = (self.slots >> 6) + 1  # words of a bucket; a band begins at slot slots - BAND at most, so it never leaves them
        padded = np.zeros((self.buckets, self.width * 64), np.uint16)
        padded[:, :self.slots] = table[:, :self.slots]
        out = np.empty((self.buckets * self.width, self.bits), np.uint64)
        for bit in range(self.bits):
            out[:, bit] = np.packbits((padded >> bit & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()
        return out

    @property
    def n_bytes(self) -> int:
        return self.planes.nbytes + self.bumped.nbytes

    def contains(self, h1: np.ndarray, h2: np.ndarray, mixed: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        """True for each key of the set, and by chance for others.

        Fingerprint bits are compared two at a time, and keys that disagree are
        asked no further, so an absent key costs about three bits of sixteen.
        ``mixed``: ``mix`` of the hashes, where several filters are asked.
        """
        h1, h2 = h1.astype(np.uint64), h2.astype(np.uint64)
        out = np.zeros(len(h1), bool)
        if not self.n_keys:
            return out
        g, start, coeff, print_ = self._place(mixed or mix(h1, h2))
        left, place = np.arange(len(h1)), g * self.width * 64 + start
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        flat = self.planes.ravel()
        for bit in range(self.bits):
            at = word * self.bits + bit
            band = flat[at] >> shift | flat[at + self.bits] << (_U(63) - shift) << _U(1)
            agrees = (np.bitwise_count(band & coeff) & 1) == (print_ >> bit & 1)
            if bit % 2 or bit + 1 == self.bits:
                agrees &= last if bit % 2 else True
                left, word, shift, coeff, print_ = left[agrees], word[agrees], shift[agrees], coeff[agrees], print_[agrees]
                if not len(left):
                    break
            else:
                last = agrees
        out[left] = True
        if len(self.bumped):
            at = np.minimum(np.searchsorted(self.bumped, h1), len(self.bumped) - 1)
            out |= self.bumped[at] == h1
        return out


#: How a key was answered: new, found among the keys not yet sealed (exact hashes), found by a sealed filter.
NEW, OPEN, SEALED = 0, 1, 2


class Generations:
    """Keys seen so far in a stream: sealed ribbon filters and one open batch of hashes.

    The open batch is sealed when it holds ``seal`` keys; each generation is
    twice as large as the one before, up to ``seal_most``, so that n keys make
    about log2(n / seal) filters, and memory is that of the filters plus one batch of hashes.
    """

    def __init__(self, *, bits: int = 16, seal: int = 1 << 10, seal_most: int = 1 << 20):
        self.bits, self.size, self.seal_most = bits, seal, seal_most
        self.sealed: list[RibbonFilter] = []
        self.open1 = np.empty(0, np.uint64)
        self.open2 = np.empty(0, np.uint64)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """How each key is answered."""
        how = np.zeros(len(h1), np.int8)
        if len(self.open1):
            at = np.minimum(np.searchsorted(self.open1, h1), len(self.open1) - 1)
            how[(self.open1[at] == h1) & (self.open2[at] == h2)] = OPEN
        left = np.flatnonzero(how == NEW)
        parts = (h1[left], h2[left], *mix(h1[left], h2[left]))
        for f in self.sealed:  # the oldest are the smallest and know the keys that come most often
            if not len(left):
                break
            found = f.contains(parts[0], parts[1], parts[2:])
            how[left[found]] = SEALED
            if found.any():
                left, parts = left[~found], tuple(x[~found] for x in parts)
        return how

    def seal(self) -> None:
        """A filter of the open batch; it is empty then."""
        if len(self.open1):
            self.sealed.append(RibbonFilter(self.open1, self.open2, bits=self.bits))
            self.open1, self.open2 = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def add(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """How each key is answered, keys of this call in their order included; the new ones are seen from now on."""
        h1, h2 = h1.astype(np.uint64), h2.astype(np.uint64)
        out, a = np.empty(len(h1), np.int8), 0
        while a < len(h1):  # steps that do not outgrow the open batch
            b = a + max(self.size // 2, 1)
            out[a:b] = self._add(h1[a:b], h2[a:b])
            a = b
        return out

    def _add(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        how = self.probe(h1, h2)
        new = np.flatnonzero(how == NEW)
        _, first = np.unique(h1[new], return_index=True)
        again = np.ones(len(new), bool)
        again[first] = False
        how[new[again]] = OPEN
        new = new[first]
        both1, both2 = np.concatenate([self.open1, h1[new]]), np.concatenate([self.open2, h2[new]])
        order = np.argsort(both1, kind="stable")
        self.open1, self.open2 = both1[order], both2[order]
        if len(self.open1) >= self.size:
            self.seal()
            self.size = min(self.size * 2, self.seal_most)
        return how
