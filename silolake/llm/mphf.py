"""Minimal perfect hash of a set of 64-bit key hashes, in the cascade form (bit array per level).

Level ``l`` is a bit array of ``GAMMA`` bits per remaining key. A key whose
position no other remaining key shares sets its bit and is done; the others go
to the next level. The slot of a key is the rank of its bit over all levels, so
``n`` keys get the slots ``0..n-1`` exactly. Keys whose hashes are equal never
separate; they stay in a short tail that callers store beside the slots.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2.0
MAX_LEVELS = 40

_U = np.uint64


def mix(h: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64 constants) of ``h`` with ``seed`` added."""
    with np.errstate(over="ignore"):
        z = h.astype(_U) + _U(0x9E3779B97F4A7C15) * _U(seed + 1)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


class Mphf:
    """``slots(hashes)`` gives each key its slot; a hash outside the set gets some slot or -1."""

    def __init__(self, sizes: np.ndarray, bits: list[np.ndarray], n: int):
        self.sizes, self.bits, self.n = sizes, bits, n
        flat = np.concatenate([np.unpackbits(b, count=int(s)) for b, s in zip(bits, sizes)]) if bits else np.zeros(0, np.uint8)
        self._set = flat.astype(bool)
        self._rank = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])
        self._base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> tuple["Mphf", np.ndarray]:
        """The function and the slot of each given hash (-1: in the tail)."""
        left = np.arange(len(hashes))
        sizes, bits = [], []
        while len(left) and len(sizes) < MAX_LEVELS:
            size = int(len(left) * GAMMA) | 1
            at = (mix(hashes[left], len(sizes)) % _U(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone))
            left = left[~alone[at]]
        made = cls(np.array(sizes, np.int64), bits, len(hashes) - len(left))
        slots = made.slots(hashes)
        slots[left] = -1
        return made, slots

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self._base[level] + (mix(hashes[left], level) % _U(size)).astype(np.int64)
            hit = self._set[at]
            out[left[hit]] = self._rank[at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([self.n, len(self.sizes), *self.sizes], "<i8").tobytes()
        return head + b"".join(b.tobytes() for b in self.bits)

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Mphf":
        n, levels = np.frombuffer(raw, "<i8", 2)
        sizes = np.frombuffer(raw, "<i8", int(levels), 16).astype(np.int64)
        bits, at = [], 16 + 8 * int(levels)
        for s in sizes:
            width = (int(s) + 7) // 8
            bits.append(np.frombuffer(raw, np.uint8, width, at))
            at += width
        return cls(sizes, bits, int(n))
