"""Rolling hashes of stretches of many values at once, in numpy."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_ONE = np.uint64(1)


def code_points(strings: list[str]) -> np.ndarray:
    """The code points of all strings, one after the other."""
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)


def mixed(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """Each unsigned 64-bit value hashed (a finaliser of a multiplicative generator)."""
    with np.errstate(over="ignore"):
        z = values + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class Rolling:
    """Hashes of stretches of ``values`` (unsigned, well mixed), from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, values: np.ndarray, base: int = BASE):
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([[_ONE], np.full(len(values), np.uint64(base))]))
            self.total = np.concatenate([[np.uint64(0)], np.cumsum(values * power[:-1])])
            self.back = np.cumprod(np.concatenate([[_ONE], np.full(len(values), np.uint64(pow(base, -1, 2**64)))]))

    def __call__(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.total[start + size] - self.total[start]) * self.back[start]
