"""Sets of (key, slot) pairs as one compressed bitmap of slots per key.

Slots are 16-bit numbers of documents in a chunk. A key with up to ``SPARSE`` slots keeps them as a sorted
list, one with more keeps a bitmap of 8 KB. All keys of a plane are handled together in arrays.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

SLOTS = 1 << 16
SPARSE = 4096


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.diff(np.append(first, len(values)))


@dataclass
class Plane:
    """``sparse``: sorted key << 16 | slot; ``dense``: bitmaps of the keys in ``heads``, sorted."""
    sparse: np.ndarray
    heads: np.ndarray
    dense: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Plane:
        """From sorted, distinct key << 16 | slot."""
        keys, sizes = runs(entries >> 16)
        large = sizes > SPARSE
        if not large.any():
            return cls(entries, np.zeros(0, np.int64), np.zeros((0, SLOTS // 8), np.uint8))
        heads = keys[large]
        mine = np.repeat(large, sizes)
        bits = np.zeros((len(heads), SLOTS), bool)
        bits[np.searchsorted(heads, entries[mine] >> 16), entries[mine] & 0xFFFF] = True
        return cls(entries[~mine], heads, np.packbits(bits, axis=1, bitorder="little"))

    @classmethod
    def merge(cls, planes: Iterable[Plane]) -> Plane:
        """All planes OR-ed together."""
        planes = list(planes)
        heads = np.unique(np.concatenate([p.heads for p in planes]))
        dense = np.zeros((len(heads), SLOTS // 8), np.uint8)
        for p in planes:
            dense[np.searchsorted(heads, p.heads)] |= p.dense
        sparse = np.unique(np.concatenate([p.sparse for p in planes]))
        if len(heads):  # lists of a key that is dense elsewhere go into its bitmap
            at = np.minimum(np.searchsorted(heads, sparse >> 16), len(heads) - 1)
            mine = heads[at] == sparse >> 16
            slot = sparse[mine] & 0xFFFF
            np.bitwise_or.at(dense, (at[mine], slot >> 3), (1 << (slot & 7)).astype(np.uint8))
            sparse = sparse[~mine]
        grown = cls.of(sparse)
        if not len(grown.heads):
            return cls(sparse, heads, dense)
        heads, dense = np.concatenate([heads, grown.heads]), np.concatenate([dense, grown.dense])
        order = np.argsort(heads)
        return cls(grown.sparse, heads[order], dense[order])

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys in order and the number of slots of each."""
        keys, sizes = runs(self.sparse >> 16)
        keys = np.concatenate([keys, self.heads])
        sizes = np.concatenate([sizes, np.bitwise_count(self.dense).sum(axis=1, dtype=np.int64)])
        order = np.argsort(keys)
        return keys[order], sizes[order]

    def entries(self) -> np.ndarray:
        """Sorted key << 16 | slot."""
        if not len(self.heads):
            return self.sparse
        row, slot = np.nonzero(np.unpackbits(self.dense, axis=1, bitorder="little"))
        return np.sort(np.concatenate([self.sparse, self.heads[row] << 16 | slot]))

    def to_bytes(self) -> bytes:
        keys, sizes = runs(self.sparse >> 16)
        sizes_of = np.array([len(keys), len(self.sparse), len(self.heads)], "<i8")
        return b"".join([sizes_of.tobytes(), keys.astype("<i8").tobytes(), sizes.astype("<i4").tobytes(),
                         (self.sparse & 0xFFFF).astype("<u2").tobytes(), self.heads.astype("<i8").tobytes(), self.dense.tobytes()])

    @classmethod
    def read(cls, raw: memoryview, at: int = 0) -> tuple[Plane, int]:
        """The plane that starts at ``at``, and where it ends."""
        n_keys, n_sparse, n_dense = np.frombuffer(raw, "<i8", 3, at).tolist()
        at += 24

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(raw, kind, count, at)
            at += part.nbytes
            return part

        keys, sizes, slots = take("<i8", n_keys), take("<i4", n_keys), take("<u2", n_sparse)
        heads, dense = take("<i8", n_dense), take("u1", n_dense * (SLOTS // 8))
        return cls(np.repeat(keys, sizes) << 16 | slots.astype(np.int64), heads, dense.reshape(n_dense, SLOTS // 8)), at


@dataclass
class Counted:
    """How often each key occurs in each slot: who has it at all, and bit planes of the occurrences beyond one."""
    present: Plane
    more: list[Plane]

    @classmethod
    def of(cls, entries: np.ndarray, times: np.ndarray) -> Counted:
        extra = times - 1
        bits = int(extra.max(initial=0)).bit_length()
        return cls(Plane.of(entries), [Plane.of(entries[extra >> b & 1 == 1]) for b in range(bits)])

    @classmethod
    def merge(cls, parts: list[Counted]) -> Counted:
        """Parts of one chunk; a slot is in one part only, so its planes can be OR-ed."""
        depth = max(len(p.more) for p in parts)
        return cls(Plane.merge(p.present for p in parts),
                   [Plane.merge(p.more[b] for p in parts if b < len(p.more)) for b in range(depth)])

    def totals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys in order, slots that have each, and occurrences of each: popcounts of the planes."""
        keys, slots = self.present.counts()
        times = slots.copy()
        for bit, plane in enumerate(self.more):
            some, sizes = plane.counts()
            times[np.searchsorted(keys, some)] += sizes << bit
        return keys, slots, times

    def postings(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted key << 16 | slot, and the occurrences of each."""
        entries = self.present.entries()
        times = np.ones(len(entries), np.int64)
        for bit, plane in enumerate(self.more):
            times[np.searchsorted(entries, plane.entries())] += 1 << bit
        return entries, times

    def to_bytes(self) -> bytes:
        return b"".join([len(self.more).to_bytes(8, "little"), self.present.to_bytes(), *(p.to_bytes() for p in self.more)])

    @classmethod
    def from_bytes(cls, raw: bytes) -> Counted:
        view = memoryview(raw)
        present, at = Plane.read(view, 8)
        more = []
        for _ in range(int.from_bytes(view[:8], "little")):
            plane, at = Plane.read(view, at)
            more.append(plane)
        return cls(present, more)
