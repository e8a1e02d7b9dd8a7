"""How large a sketch must be for an error bound and a confidence."""

from __future__ import annotations

import math
from typing import NamedTuple

#: What the native sketches of Spark take at most.
NATIVE_HLL_PRECISION, NATIVE_KLL_K, NATIVE_TOP_K = 21, 65535, 1_000_000
#: Defaults of sketches that an insert starts without a hint.
DEFAULT_EPSILON, DEFAULT_CONFIDENCE, DEFAULT_K = 0.05, 0.90, 10

_LEAST_PRECISION, _MOST_PRECISION = 4, 24
_LEAST_K, _MOST_K = 32, 1 << 20
_LEAST_WIDTH, _MOST_WIDTH, _LEAST_DEPTH, _MOST_DEPTH = 16, 1 << 24, 2, 64
_MOST_CAPACITY = 1 << 20
_TINY = 1e-12


class Size(NamedTuple):
    """met: the size isn't capped below what the bounds ask for."""

    value: int
    met: bool


class Dims(NamedTuple):
    width: int
    depth: int
    met: bool = True


def hll_precision(epsilon: float, confidence: float) -> Size:
    """Registers as a power of two. By Chebyshev's inequality a relative standard error of epsilon * sqrt(1 - confidence) is
    enough; that of m registers is 1.04 / sqrt(m)."""
    error = epsilon * math.sqrt(max(1 - confidence, 2.0**-52))
    registers = (1.04 / error) ** 2
    for p in range(_LEAST_PRECISION, _MOST_PRECISION + 1):
        if 2.0**p >= registers:
            return Size(p, True)
    return Size(_MOST_PRECISION, False)


def kll_capacity(epsilon: float, confidence: float) -> Size:
    k = math.ceil(2 / epsilon * math.sqrt(math.log(2 / max(1 - confidence, _TINY))))
    return Size(min(max(k, _LEAST_K), _MOST_K), k <= _MOST_K)


def cms_dims(epsilon: float, confidence: float) -> Dims:
    width, depth = math.ceil(math.e / epsilon), math.ceil(math.log(1 / max(1 - confidence, _TINY)))
    return Dims(min(max(width, _LEAST_WIDTH), _MOST_WIDTH), min(max(depth, _LEAST_DEPTH), _MOST_DEPTH), width <= _MOST_WIDTH and depth <= _MOST_DEPTH)


def topk_capacity(k: int, epsilon: float) -> Size:
    capacity = max(k, math.ceil(1 / epsilon))
    return Size(min(capacity, _MOST_CAPACITY), capacity <= _MOST_CAPACITY)
