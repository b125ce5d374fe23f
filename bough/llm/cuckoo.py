"""A cuckoo filter over 128-bit keys, worked on with whole arrays of keys.

Buckets of four 16-bit fingerprints; a key may lie in either of two buckets, and the
second follows from the first and the fingerprint alone (partial-key hashing), so
entries can be moved and deleted without their key. There are no false negatives
for keys inserted once and not deleted; a false positive has a probability of about
8 / 65536.
"""

from __future__ import annotations

import numpy as np

from bough.llm.text import mix

SLOTS = 4


class CuckooFilter:
    def __init__(self, buckets: int, table: np.ndarray | None = None):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table.reshape(buckets, SLOTS)
        self.mask = np.uint64(buckets - 1)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """For so many keys, filled to 80 % at most."""
        return cls(1 << max(4, int(np.ceil(np.log2(max(1, keys) / (0.8 * SLOTS))))))

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray) -> CuckooFilter:
        """Holds these distinct keys; twice as large again whenever they don't fit."""
        size = len(hi)
        while True:
            out = cls.sized(size)
            if out.insert(hi, lo):
                return out
            size = 2 * size + 64

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        print_ = (mix(lo.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        first = mix(hi.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) & self.mask
        return print_, first, self._other(first, print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(print_.astype(np.uint64)) & self.mask)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        p, a, b = self._places(hi, lo)
        return (self.table[a] == p[:, None]).any(axis=1) | (self.table[b] == p[:, None]).any(axis=1)

    def _place(self, bucket: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Put what fits into free slots of the buckets given; returns which were put."""
        done = np.zeros(len(p), bool)
        for _ in range(SLOTS):
            left = np.flatnonzero(~done)
            if not len(left):
                break
            _, one = np.unique(bucket[left], return_index=True)
            at = left[one]
            free = self.table[bucket[at]] == 0
            can = free.any(axis=1)
            at = at[can]
            self.table[bucket[at], free[can].argmax(axis=1)] = p[at]
            done[at] = True
            if not can.any():
                break
        return done

    def insert(self, hi: np.ndarray, lo: np.ndarray, rounds: int = 500) -> bool:
        """Insert keys that aren't held; False if it is too full, and then to be built anew."""
        p, a, b = self._places(hi, lo)
        left = ~self._place(a, p)
        p, b = p[left], b[left]
        left = ~self._place(b, p)
        p, at = p[left], b[left]
        dice = np.random.default_rng(len(hi))
        for _ in range(rounds):
            if not len(p):
                return True
            # one eviction in each bucket: the evicted fingerprint goes to its other bucket
            _, one = np.unique(at, return_index=True)
            slot = dice.integers(0, SLOTS, len(one))
            out = self.table[at[one], slot]
            self.table[at[one], slot] = p[one]
            p[one], at[one] = out, self._other(at[one], out)
            left = ~self._place(at, p) & (p != 0)
            p, at = p[left], at[left]
        return not len(p)

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Take out keys that are held."""
        p, first, second = self._places(hi, lo)
        for k in (0, 1):
            bucket = (first, second)[k]
            left, gone = np.arange(len(p)), np.zeros(len(p), bool)
            while len(left):
                there = self.table[bucket[left]] == p[left][:, None]
                can = there.any(axis=1)
                left, slot = left[can], there[can].argmax(axis=1)
                if not len(left):
                    break
                _, one = np.unique(bucket[left], return_index=True)
                self.table[bucket[left[one]], slot[one]] = 0
                gone[left[one]] = True
                left = np.delete(left, one)
            p, first, second = p[~gone], first[~gone], second[~gone]
