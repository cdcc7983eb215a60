"""Hashes of all stretches of a text, by numpy: one array operation for each doubling of their length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _wider(x: np.ndarray, length: int, both) -> np.ndarray:
    """What `both` makes of all `length` values from each place on, by doubling; the last step's halves may overlap."""
    wide = 1
    while wide < length:
        step = min(wide, length - wide)
        x = both(x[: len(x) - step], x[step:])
        wide += step
    return x


def hashes(points: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the stretches of `length` code points that start at each place."""
    return _wider(_mix(points.astype(np.uint64) + _M1), length, lambda a, b: _mix(a * _M1 + b))


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of `width` values from each place on."""
    return _wider(x, width, np.minimum)


def core(length: int) -> int:
    """Length of the short stretches that stand for those of `length`: half of it, at least 1."""
    return max(1, length // 2)


def stretches(text: str, length: int, block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first place, hashes of the stretches, the least hash of the short ones in each, hashes of the short ones), for
    `block` places at a time: each stretch lies in one block, whatever the text's length."""
    short = core(length)
    for at in range(0, len(text) - length + 1, block):
        points = np.frombuffer(text[at : at + block + length - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        small = hashes(points, short)
        yield at, hashes(points, length), least(small, length - short + 1), small
