"""Cuckoo filters over 64-bit hashes, filled and probed a column at a time."""

from __future__ import annotations

import numpy as np

from pairmatch.llm.text import mix

#: Fingerprints in a bucket.
SLOTS = 4
#: Rounds of moves after which a filter counts as full.
MOST_MOVES = 500
#: The largest part of the slots that is filled; fuller filters take long to fill.
LOAD = 0.85


def buckets_for(n: int) -> int:
    """Number of buckets, a power of two, for ``n`` keys."""
    return 1 << max(0, int(np.ceil(n / (SLOTS * LOAD))) - 1).bit_length()


class CuckooFilter:
    """A set of hashes as 16-bit fingerprints, each in one of two buckets that it names itself.

    ``has`` never misses a key that was added and not removed; it takes an unknown key for a
    member with a probability of about ``2 * SLOTS / 2 ** 16``. A key may be removed only if it
    was added, and each key is added once, so the caller keeps the exact table.
    """

    def __init__(self, buckets: int, data: bytes | None = None):
        self.mask = np.uint64(buckets - 1)
        self.table = (
            np.zeros((buckets, SLOTS), np.uint16)
            if data is None
            else np.frombuffer(data, np.uint16).reshape(buckets, SLOTS).copy()
        )
        self.rng = np.random.default_rng(0)

    def tobytes(self) -> bytes:
        """The fingerprints, bucket after bucket."""
        return self.table.tobytes()

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, and first and second bucket of each hash."""
        h = mix(hashes)
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (h & self.mask).astype(np.int64)
        return prints, first, self.other(prints, first)

    def other(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The other bucket of a fingerprint."""
        return bucket ^ (mix(prints.astype(np.uint64)) & self.mask).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may be in the set."""
        prints, first, second = self.places(hashes)
        same = (self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])
        return same.any(axis=1)

    def add(self, hashes: np.ndarray) -> bool:
        """Add hashes that are not in the set; False if the filter is full, and then spoilt."""
        prints, bucket, second = self.places(hashes)
        prints, bucket, _ = self.fill(prints, bucket)
        second = self.other(prints, bucket)
        prints, bucket, _ = self.fill(prints, second)
        for _ in range(MOST_MOVES):
            if not len(prints):
                return True
            # each full bucket gives one of its fingerprints for one that waits there
            turn = np.unique(bucket, return_index=True)[1]
            slot = self.rng.integers(0, SLOTS, len(turn))
            moved = self.table[bucket[turn], slot]
            self.table[bucket[turn], slot] = prints[turn]
            prints[turn] = moved
            prints, bucket, _ = self.fill(prints, self.other(prints, bucket))
        return not len(prints)

    def fill(self, prints: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Put fingerprints into free slots of their buckets; returns those without a slot."""
        order = np.argsort(bucket, kind="stable")
        prints, bucket = prints[order], bucket[order]
        start = np.flatnonzero(np.diff(bucket, prepend=-1))
        rank = np.arange(len(bucket)) - np.repeat(start, np.diff(np.append(start, len(bucket))))
        free = self.table[bucket] == 0
        # the slot of the rank-th free one
        reached = np.cumsum(free, axis=1) == (rank + 1)[:, None]
        slot = np.argmax(reached & free, axis=1)
        fits = free.sum(axis=1) > rank
        self.table[bucket[fits], slot[fits]] = prints[fits]
        return prints[~fits], bucket[~fits], int(fits.sum())

    def remove(self, hashes: np.ndarray) -> None:
        """Remove hashes of the set, each one fingerprint from one of its buckets."""
        for print_, *buckets in zip(*self.places(hashes)):
            for bucket in buckets:
                slots = np.flatnonzero(self.table[bucket] == print_)
                if len(slots):
                    self.table[bucket, slots[0]] = 0
                    break
            else:
                raise ValueError("a key was removed that is not in the filter")
