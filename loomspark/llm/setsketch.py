"""SetSketch: registers of exponentially spaced, truncated minima (Ertl, 2021).

Each element of a set owns a Poisson process of rate ``m``; every arrival picks a register at
random, so each register sees the first arrival of an independent unit-rate process: an
exponential value. A register keeps the minimum over the elements on a scale whose steps grow
by the factor ``b``: ``K = clip(floor(1 - log_b(min)) , 0, q + 1)``. Registers of a union are
the maxima of the registers of its parts, so sketches merge; two sets agree in a register
with a probability close to their Jaccard similarity, so runs of registers are band keys; and
the numbers of larger, equal and smaller registers give the likelihood of a similarity.
"""

from __future__ import annotations

import numpy as np

from .shingles import mix

_GOLD = 0x9E3779B97F4A7C15


class SetSketch:
    """m registers, base b; ``offset`` steps are added so that sets of up to ``b**(q - offset)``
    elements stay in range. Defaults take sets from 1 to more than 10**12 elements."""

    def __init__(self, m: int = 160, b: float = 1.02, q: int = 2045, offset: int = 500) -> None:
        self.m, self.b, self.q, self.offset = m, b, q, offset

    def registers(self, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """int16 registers, a row for each set; an empty set has zeros."""
        n, m = len(offsets) - 1, self.m
        sizes = np.diff(offsets)
        least = np.full(n * m, np.inf)
        todo = np.flatnonzero(sizes)
        # Arrivals up to a bound that leaves no register of a set empty but with e**-6 odds;
        # the sets that it leaves short go on up to twice the bound, and so on.
        bound = np.zeros(n)
        bound[todo] = (np.log(m) + 6.0) / sizes[todo]
        own = np.repeat(np.arange(n), sizes)
        state = hashes.copy()
        at = np.zeros(len(hashes))
        live = np.arange(len(hashes))
        while len(live):
            while len(live):
                state[live] += np.uint64(_GOLD)
                r = mix(state[live])
                # Upper 40 bits: the waiting time; lower 24: the register.
                step = -np.log((((r >> np.uint64(24)).astype(np.float64)) + 0.5) / float(1 << 40)) / m
                at[live] += step
                inside = at[live] <= bound[own[live]]
                hit = live[inside]
                reg = ((r[inside] & np.uint64(0xFFFFFF)).astype(np.int64) * m) >> 24
                np.minimum.at(least, own[hit] * m + reg, at[hit])
                live = hit
            short = np.zeros(n, bool)
            short[todo] = np.isinf(least.reshape(n, m)[todo]).any(axis=1)
            if not short.any():
                break
            # Replay with a larger bound: arrivals already counted only repeat their minimum.
            bound[short] *= 2
            live = np.flatnonzero(short[own])
            state[live] = hashes[live]
            at[live] = 0.0
        with np.errstate(divide="ignore"):
            k = np.floor(1.0 - np.log(least) / np.log(self.b)) + self.offset
        k[np.isinf(least)] = 0
        return np.clip(k, 0, self.q + 1).astype(np.int16).reshape(n, m)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum(a, b)

    def bands(self, registers: np.ndarray, rows: int) -> np.ndarray:
        """A signed 64-bit key for each run of ``rows`` registers."""
        n = len(registers)
        r = registers.astype(np.uint64).reshape(n, self.m // rows, rows)
        key = np.zeros(r.shape[:2], np.uint64)
        for j in range(rows):
            key = mix(key * np.uint64(_GOLD) + r[:, :, j] + np.uint64(j + 1))
        return key.view(np.int64)

    def log_likelihood(self, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, jaccard: np.ndarray) -> np.ndarray:
        """Of each similarity (columns), for each pair of sketches (rows), given the set sizes."""
        bigger = (x > y).sum(axis=1)[:, None]
        smaller = (x < y).sum(axis=1)[:, None]
        same = self.m - bigger - smaller
        u = (nx / (nx + ny))[:, None]
        v = 1.0 - u
        # A similarity beyond the ratio of the sizes isn't possible.
        j = np.minimum(jaccard[None, :], np.minimum(u, v) / np.maximum(u, v))
        p = lambda z: -np.log1p(-np.clip(z, 0, 1) * (self.b - 1) / self.b) / np.log(self.b)
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return bigger * np.log(np.maximum(up, tiny)) + smaller * np.log(np.maximum(down, tiny)) + same * np.log(np.maximum(1 - up - down, tiny))

    def estimate(self, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, steps: int = 101) -> np.ndarray:
        """The similarity of greatest likelihood on an even grid."""
        grid = np.linspace(0, 1, steps)
        return grid[np.argmax(self.log_likelihood(x, y, nx, ny, grid), axis=1)]
