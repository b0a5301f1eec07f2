"""Seeded 64-bit generators with the same results everywhere, and the level of a graph node."""

from __future__ import annotations

import math

import numpy as np

MASK = (1 << 64) - 1
#: Fixed values of the published splitmix64 mixer.
STEP, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def splitmix64(x):
    """The mixer, for a Python integer or an array of unsigned 64-bit integers."""
    if isinstance(x, np.ndarray):
        z = x.astype(np.uint64) + np.uint64(STEP)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
        return z ^ (z >> np.uint64(31))
    z = (x + STEP) & MASK
    z = ((z ^ (z >> 30)) * MIX_A) & MASK
    z = ((z ^ (z >> 27)) * MIX_B) & MASK
    return z ^ (z >> 31)


class Xoshiro:
    """xoshiro256**, its state filled by splitmix64."""

    def __init__(self, seed: int):
        self.state = [splitmix64((seed + k * STEP) & MASK) for k in range(4)]

    def bits(self) -> int:
        a, b, c, d = self.state
        turn = lambda x, k: ((x << k) | (x >> (64 - k))) & MASK
        out = (turn((b * 5) & MASK, 7) * 9) & MASK
        c ^= a
        d ^= b
        self.state = [a ^ d, b ^ c, c ^ ((b << 17) & MASK), turn(d, 45)]
        return out

    def unit(self) -> float:
        """In [0, 1), on a grid of 2**-53."""
        return (self.bits() >> 11) * 2.0**-53

    def below(self, bound: int) -> int:
        """Unbiased below ``bound``: a product's high half, unless its low half falls in the uneven part."""
        uneven = (1 << 64) % bound
        while True:
            product = self.bits() * bound
            if product & MASK >= uneven:
                return product >> 64

    def between(self, low: float, high: float) -> np.float32:
        """float32 in [low, high)."""
        x = np.float32(low + (high - low) * self.unit())
        return x if x < np.float32(high) else np.nextafter(np.float32(high), np.float32(low))

    def normals(self):
        """Standard normal values by the polar method, two from each accepted point."""
        while True:
            u, v = 2 * self.unit() - 1, 2 * self.unit() - 1
            s = u * u + v * v
            if 0 < s < 1:
                scale = math.sqrt(-2 * math.log(s) / s)
                yield u * scale
                yield v * scale


def levels(nodes: np.ndarray, seed: int, m: int, most: int) -> np.ndarray:
    """Top level of each node, a function of its number: level l is reached with probability m ** -l."""
    bits = splitmix64(np.uint64(seed & MASK) ^ splitmix64(nodes.astype(np.uint64)))
    bound = np.uint64(1 << 53) // ((bits >> np.uint64(11)) + np.uint64(1))
    out, power = np.zeros(len(nodes), np.int32), 1
    for _ in range(most):
        power *= m
        if power > 1 << 53:
            break
        out += bound >= np.uint64(power)
    return out
