"""Multiplicities of a stratified bootstrap, derived where they are needed.

The draws of a stratum of ``n`` places are not made one by one. Their number goes down a
binary tree over the places: blocks whose sizes are the powers of two in ``n``, and halves
below. A node's count is split by coin tosses, one bit of a hash each, so every count follows
the multinomial law of ``n`` draws with replacement, and any place's multiplicity comes from
the nodes above it alone. All steps are integer arithmetic, the same on every engine.
"""

from __future__ import annotations

import hashlib

import numpy as np

SPREAD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)  # odd factors of the parts of a toss's name
MIX = (0x85EBCA6B, 0xC2B2AE35)  # multipliers of the finishing step of a 32-bit hash
DIGITS = 32  # binary digits of a block's share
TREE = 64  # added to a block's number in names of tosses below it
KNOWN = 1 << 10  # nodes per block whose counts are kept ready
HASHES = 1 << 16  # hashes that are taken at once, so that they stay in the cache


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(MIX[0])
    x = x ^ (x >> np.uint32(13))
    x = x * np.uint32(MIX[1])
    return x ^ (x >> np.uint32(16))


def _mix_in_place(bits: np.ndarray) -> np.ndarray:
    """As ``_mixed``, in the same memory."""
    shifted = np.empty_like(bits)
    for by, factor in ((16, MIX[0]), (13, MIX[1])):
        np.right_shift(bits, np.uint32(by), out=shifted)
        np.bitwise_xor(bits, shifted, out=bits)
        np.multiply(bits, np.uint32(factor), out=bits)
    np.right_shift(bits, np.uint32(16), out=shifted)
    return np.bitwise_xor(bits, shifted, out=bits)


def _mask(coins: np.ndarray) -> np.ndarray:
    """The lowest ``coins`` of 32 bits; a shift by 32 leaves none, and none less one are all."""
    mask = np.left_shift(np.uint32(1), coins.astype(np.uint32))
    return np.subtract(mask, np.uint32(1), out=mask)


def _few_heads(base: np.ndarray, name: np.ndarray, tosses: np.ndarray) -> np.ndarray:
    """As ``heads``, for at most 32 coins each: one hash a node, in small types."""
    found = np.empty(tosses.shape, tosses.dtype)
    name = _mixed(name)
    step = max(1, HASHES // max(1, len(base)))
    for low in range(0, len(name), step):
        part = slice(low, low + step)
        bits = _mix_in_place(base[None, :] ^ name[part, None])
        np.bitwise_and(bits, _mask(tosses[part]), out=bits)
        found[part] = np.bitwise_count(bits)
    return found


def heads(base: np.ndarray, node: np.ndarray, kind: int, tosses: np.ndarray) -> np.ndarray:
    """Heads among ``tosses[node, replicate]`` coins named by replicate, node and kind."""
    name = node.astype(np.uint32) * np.uint32(SPREAD[0]) + np.uint32(kind * SPREAD[1] % (1 << 32))
    most = int(tosses.max(initial=0))
    if most <= 32:
        return _few_heads(base, name, tosses)
    found, left = np.zeros(tosses.shape, tosses.dtype), tosses.astype(np.int32)
    whole, words = int(tosses.min()) // 32, -(-most // 32)  # all coins of the words below ``whole`` are tossed
    step = max(1, HASHES // max(1, tosses.size))
    for first, last in ((0, whole), (whole, words)):
        for low in range(first, last, step):
            word = np.arange(low, min(low + step, last))
            names = _mixed(name[None, :] + word.astype(np.uint32)[:, None] * np.uint32(SPREAD[2]))
            bits = _mix_in_place(base[None, None, :] ^ names[:, :, None])
            if last > whole:
                coins = left[None] - (32 * word).astype(np.int32)[:, None, None]
                np.bitwise_and(bits, _mask(np.minimum(np.maximum(coins, 0, out=coins), 32, out=coins)), out=bits)
            np.add(found, np.bitwise_count(bits).sum(axis=0, dtype=np.uint32), out=found, casting="unsafe")
    return found


def blocks(size: int) -> list[tuple[int, int]]:
    """(start, power) of the blocks of ``size`` places, the largest first."""
    found, start = [], 0
    for power in range(size.bit_length() - 1, -1, -1):
        if size >> power & 1:
            found.append((start, power))
            start += 1 << power
    return found


def bases(seed: int, first: int, count: int, dataset: str | None, y_true: int | None) -> np.ndarray:
    """A 32-bit number for every replicate of a stratum; missing names count as empty."""
    names = f"{'' if dataset is None else dataset}:{'' if y_true is None else y_true}"
    texts = (f"{seed}:{r}:{names}" for r in range(first, first + count))
    return np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in texts], np.uint32)


def _small(count: np.ndarray) -> np.ndarray:
    """Counts in the smallest type that holds them, which keeps more of them in the cache."""
    if count.itemsize > 1:
        most = int(count.max(initial=0))
        return count.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64, copy=False)
    return count


class Multiplicities:
    """One stratum over a block of replicates; ``of(places)`` gives a row per place."""

    def __init__(self, base: np.ndarray, size: int):
        self.base, self.known = base, []
        left, rest = np.full((1, len(base)), size, np.int64), size
        for start, power in blocks(size):
            count = self._block(left, power, rest) if rest > 1 << power else left
            left, rest = left - count, rest - (1 << power)
            depth, node = 0, np.ones(1, np.int64)
            while depth < power and len(node) < KNOWN:
                node, count, depth = *self._below(node, count, power, np.arange(2 << depth, 4 << depth)), depth + 1
            self.known.append((start, power, depth, count))

    def _block(self, left: np.ndarray, power: int, rest: int) -> np.ndarray:
        """Successes of ``left`` trials that fall in the block, its share compared digit by digit."""
        share = (1 << (power + DIGITS)) // rest
        inside, open_ = np.zeros_like(left), left
        for digit in range(DIGITS):
            ones = heads(self.base, np.array([digit]), power, open_)
            if share >> (DIGITS - 1 - digit) & 1:
                inside, open_ = inside + open_ - ones, ones
            else:
                open_ = open_ - ones
            if not open_.any():
                break
        return inside

    def _below(self, node: np.ndarray, count: np.ndarray, power: int, children: np.ndarray):
        ones = heads(self.base, node, TREE + power, count)
        at = np.searchsorted(node, children >> 1)
        below, odd = ones.take(at, axis=0), np.flatnonzero(children & 1)
        below[odd] = count.take(at[odd], axis=0) - below[odd]
        return children, below

    def of(self, places: np.ndarray, kind: type = np.int64) -> np.ndarray:
        out = np.zeros((len(places), len(self.base)), kind)
        for start, power, depth, count in self.known:
            mine = np.flatnonzero((places >= start) & (places < start + (1 << power)))
            if not len(mine):
                continue
            leaf = places[mine] - start + (1 << power)
            node = np.unique(leaf >> (power - depth))
            count = count[node - (1 << depth)]
            for level in range(depth, power):
                count = _small(count)
                node, count = self._below(node, count, power, np.unique(leaf >> (power - level - 1)))
            out[mine] = count[np.searchsorted(node, leaf)]
        return out
