"""Prefix-free parsing of one text: rolling hashes, triggers, and hashes of any stretch."""

from __future__ import annotations

import numpy as np

from .minhash import mix64

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
GRAM = 16


class _Powers:
    """Powers of BASE and of its inverse, grown to the longest text seen up to a bound."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n <= len(self.up):
            return self.up[:n], self.down[:n]
        size = max(n, 1 << 16)
        up, down = np.full(size, BASE), np.full(size, INVERSE)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 1 << 20:
            self.up, self.down = up, down
        return up[:n], down[:n]


POWERS = _Powers()


class Parsed:
    """A text, of at least window + GRAM bytes, cut into phrases at triggers.

    A window of ``window`` grams has its trigger at the gram with the least rolling hash (the leftmost of
    equal ones).  So the trigger of a stretch depends on the bytes of the stretch alone, every ``window`` grams hold
    one, and equal stretches are parsed alike wherever they stand.  ``trigger[p]`` is the trigger of the window
    that starts at p.
    """

    def __init__(self, data: bytes, window: int):
        self.data = data
        byte = np.frombuffer(data, np.uint8).astype(np.uint64)
        h, size = byte + np.uint64(1), 1
        while size < GRAM:
            h = h[:-size] * np.uint64(pow(int(BASE), size, 1 << 64)) + h[size:]
            size *= 2
        value = mix64(h)
        up, self.down = POWERS.get(len(value))
        self.sums = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value * up, out=self.sums[1:])
        low = np.uint64(0xFFFFFFFF)
        least = (value & ~low) | np.arange(len(value), dtype=np.uint64)
        reach = 1
        while reach * 2 <= window:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < window:
            least = np.minimum(least[: len(least) - (window - reach)], least[window - reach :])
        self.trigger = (least & low).astype(np.int64)

    def hash(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        """64-bit hashes of data[start:end), each at least GRAM bytes long."""
        part = (self.sums[end - GRAM + 1] - self.sums[start]) * self.down[start]
        return mix64(part ^ ((end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.asarray(salt, np.uint64))
