"""Byte contexts of variable length: counting them and walking a tree of them.

Texts are streams of bytes. BOUNDARY stands before every text and ends it; no
context reaches beyond it. A gram packs a byte (lowest) and the bytes before
it, nearest first; 0 is where the context ends.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.cloudpickle import register_pickle_by_value

# Executors need not have this package on their path.
register_pickle_by_value(sys.modules[__name__])

BOUNDARY = 0x0A
# Stands for the byte 0, which marks the end of a context.
_NUL = 0x0B
_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[0] = _NUL


def stream_of(texts: list[bytes]) -> np.ndarray:
    """BOUNDARY, text, BOUNDARY, text, ..., BOUNDARY; texts must not hold the boundary."""
    mark = bytes([BOUNDARY])
    return _CLEAN[np.frombuffer(mark + b"".join(t + mark for t in texts), np.uint8)]


def grams(stream: np.ndarray, depth: int) -> np.ndarray:
    """The gram of every byte behind the first boundary."""
    padded = np.concatenate((np.full(depth, BOUNDARY, np.uint8), stream))
    n = len(stream) - 1
    packed = stream[1:].astype(np.uint64)
    alive = np.ones(n, bool)
    for d in range(1, depth + 1):
        before = padded[depth + 1 - d : depth + 1 - d + n]
        packed |= np.where(alive, before, 0).astype(np.uint64) << np.uint64(8 * d)
        alive &= before != BOUNDARY
    return packed


class GramCounter:
    """Counts grams; keeps sorted distinct keys and merges when enough came in."""

    def __init__(self, limit: int = 4_000_000) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.limit = 0, limit

    def add(self, keys: np.ndarray) -> None:
        found, counts = np.unique(keys, return_counts=True)
        self.parts.append((found, counts))
        self.held += len(found)
        if self.held > self.limit:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys = np.concatenate([k for k, _ in self.parts])
        counts = np.concatenate([c for _, c in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        self.parts = [(keys[first], np.add.reduceat(counts, first))]
        self.held = len(first)
        # Mostly distinct already: wait longer before the next merge.
        self.limit = max(self.limit, 2 * self.held)
        return self.parts[0]


def chunks(keys: np.ndarray, counts: np.ndarray, rows: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(keys), rows):
        yield keys[i : i + rows].view(np.int64), counts[i : i + rows].astype(np.int64)


@dataclass
class ContextTree:
    """States are contexts. ``child[state, code]`` is the state one byte longer, 0 if there is none.

    ``cost[state, code]`` is the base-2 code length of the byte in the state.
    State 0 is no state, state 1 the empty context. ``codes`` maps bytes to
    codes; bytes never seen share the last code.
    """

    codes: np.ndarray
    child: np.ndarray
    cost: np.ndarray
    depth: int

    def costs(self, stream: np.ndarray) -> np.ndarray:
        """Code length of every byte behind the first boundary, each in its longest state."""
        symbols = self.codes[stream]
        width = self.child.shape[1]
        n = len(symbols) - 1
        padded = np.concatenate((np.full(self.depth, self.codes[BOUNDARY], symbols.dtype), symbols)).astype(np.int32)
        child, state = self.child.ravel(), np.ones(n, np.int32)
        best = state
        for d in range(1, self.depth + 1):
            state = child[state * width + padded[self.depth + 1 - d : self.depth + 1 - d + n]]
            best = np.where(state > 0, state, best)
        return self.cost.ravel()[best * width + padded[self.depth + 1 :]]


def build_tree(
    depths: np.ndarray, contexts: np.ndarray, symbols: np.ndarray, counts: np.ndarray, *, depth: int, alphabet: int, blend: bool
) -> ContextTree:
    """A tree from counted ``(depth, context, symbol, count)`` rows; every suffix of a context must be there.

    Below the root, a distribution is the counts of its ``q`` distinct symbols
    and ``q`` for all others together. ``blend`` adds the shorter context's
    distribution, weighted with ``q``, to every symbol (smoothing). Otherwise
    only symbols not seen here take it (escape). At the root, the rest is
    uniform over ``alphabet`` symbols.
    """
    seen = np.unique(np.concatenate((symbols, [BOUNDARY]))).astype(np.uint8)
    codes = np.full(256, len(seen), np.uint8 if len(seen) < 256 else np.uint16)
    codes[seen] = np.arange(len(seen))
    width = len(seen) + 1
    keys = np.stack([depths.astype(np.uint64), contexts.astype(np.uint64)], axis=1)
    states, of_row = np.unique(keys, axis=0, return_inverse=True)
    of_row = of_row.ravel()
    state_of = {(int(d), int(c)): i + 1 for i, (d, c) in enumerate(states)}
    child = np.zeros((len(states) + 1, width), np.int32)
    totals = np.bincount(of_row, weights=counts, minlength=len(states))
    distinct = np.bincount(of_row, minlength=len(states))
    probability = np.zeros((len(states) + 1, width))
    rows = np.split(np.argsort(of_row, kind="stable"), np.cumsum(distinct)[:-1])
    for i, (d, context) in enumerate(states):
        d, context, q, n = int(d), int(context), distinct[i], totals[i]
        if d == 0:
            below = np.full(width, 1.0 / alphabet)
        else:
            parent = state_of[d - 1, context & ((1 << 8 * (d - 1)) - 1)]
            child[parent, codes[context >> 8 * (d - 1)]] = i + 1
            below = probability[parent]
        here = below * (q / (n + q))
        at = codes[symbols[rows[i]]]
        share = counts[rows[i]] / (n + q)
        here[at] = here[at] + share if blend else share
        probability[i + 1] = here
    with np.errstate(divide="ignore"):
        cost = -np.log2(probability).astype(np.float32)
    cost[0] = 0
    return ContextTree(codes, child, cost, depth)


def empty_tree(depth: int, alphabet: int) -> ContextTree:
    """Knows nothing: every byte costs the same."""
    return ContextTree(
        np.where(np.arange(256) == BOUNDARY, 0, 1).astype(np.uint8),
        np.zeros((2, 2), np.int32),
        np.full((2, 2), np.log2(alphabet), np.float32),
        depth,
    )
