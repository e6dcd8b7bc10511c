"""Counter-based random numbers for samplers: nothing but its key and its place decides a number.

A key is the first 16 hex digits of the MD5 of its parts; the k-th number of a key (from 0) is SplitMix64's finaliser of
key + (k + 1) * golden ratio, its upper 53 bits as a fraction. One digest so serves all samples of a step, and SQL can recompute every number.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
#: Fixed values of SplitMix64.
GOLDEN, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
LEAST = 1e-15


def key(*parts: object) -> int:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:16], 16)


def uniforms(keys: list[int] | np.ndarray, n: int) -> np.ndarray:
    """Keys by n numbers in [0, 1)."""
    x = np.asarray(keys, np.uint64)[:, None] + np.arange(1, n + 1, dtype=np.uint64) * _U(GOLDEN)
    x = (x ^ (x >> _U(30))) * _U(FIRST)
    x = (x ^ (x >> _U(27))) * _U(SECOND)
    return ((x ^ (x >> _U(31))) >> _U(11)).astype(np.float64) / float(1 << 53)


def laplace(u: np.ndarray, scale: float | np.ndarray) -> np.ndarray:
    c = np.maximum(u, LEAST) - 0.5
    return -scale * np.sign(c) * np.log(np.maximum(LEAST, 1.0 - 2.0 * np.abs(c)))


def normal(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(-2.0 * np.log(np.maximum(u, LEAST))) * np.cos(2.0 * np.pi * v)
