"""Context-tree weighting over bytes, on arrays: rows of one part of the tree.

A row is (context, byte): the ``depth`` bytes before a byte, nearest first, and the byte
itself, packed into one unsigned number so that a sort brings every context of every
length together:  x[-1] x[-2] ... x[-depth] x[0].

A byte is decided in eight binary steps. A node is (the last d bytes, the bits of the
byte decided so far); it holds the counts (a, b) of zeros and ones that followed in the
training rows, and its Krichevsky-Trofimov block probability
``G(a+1/2) G(b+1/2) / (pi G(a+b+1))``.  Its weighted probability is that value at the
deepest level, else the mean of it and the product over the nodes one byte longer.
The prediction follows the path of the context: at each node the estimate
``(b+1/2)/(a+b+1)`` has the posterior weight that the node's children lose. A path ends
at its deepest node that training has seen.
"""

from __future__ import annotations

import numpy as np

HALF = np.log(0.5)


def _log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log G(n + 1/2) for whole n >= 0."""
    x = n + 0.5
    shift = np.zeros_like(x)
    for _ in range(8):  # up to where Stirling's series is exact to 1e-13
        small = x < 8
        shift = np.where(small, shift + np.log(np.where(small, x, 1.0)), shift)
        x = np.where(small, x + 1, x)
    return _stirling(x) - shift


def _log_gamma_one(n: np.ndarray) -> np.ndarray:
    """log G(n + 1) for whole n >= 0."""
    x = n + 1.0
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        shift = np.where(small, shift + np.log(np.where(small, x, 1.0)), shift)
        x = np.where(small, x + 1, x)
    return _stirling(x) - shift


def _stirling(x: np.ndarray) -> np.ndarray:
    y = 1.0 / (x * x)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _log_gamma_half(a) + _log_gamma_half(b) - np.log(np.pi) - _log_gamma_one(a + b)


class Level:
    """The nodes of one context length: per binary step, sorted rows' node and bit counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, d: int) -> None:
        context = keys >> np.uint64(8 * (depth - d) + 8)
        full = (context << np.uint64(8)) | (keys & np.uint64(255))
        if d < depth:
            order = np.argsort(full, kind="stable")
        else:
            order = np.arange(len(full))
        full, counts = full[order], counts[order]
        self.order = order
        self.steps = []
        for step in range(8):
            node = full >> np.uint64(8 - step)
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, int)
            of_row = np.cumsum(np.r_[False, node[1:] != node[:-1]]) if len(node) else np.zeros(0, int)
            bit = ((full >> np.uint64(7 - step)) & np.uint64(1)).astype(bool)
            total = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
            ones = np.add.reduceat(np.where(bit, counts, 0.0), first) if len(first) else np.zeros(0)
            back = np.empty(len(order), dtype=np.int64)
            back[order] = of_row  # the node of every row, in the rows' own order
            one = np.empty(len(order), dtype=bool)
            one[order] = bit
            self.steps.append((back, one, total - ones, ones))


def block_weights(keys: np.ndarray, counts: np.ndarray, depth: int, top: int):
    """Levels ``top``..``depth`` of the tree and the log weighted probability of each node.

    keys must be sorted and distinct; counts are those of training (0: a row only asked for).
    """
    counts = counts.astype(np.float64)
    levels = {d: Level(keys, counts, depth, d) for d in range(top, depth + 1)}
    logs: dict[int, list[np.ndarray]] = {}
    for d in range(depth, top - 1, -1):
        logs[d] = []
        for step, (node, _, a, b) in enumerate(levels[d].steps):
            own = log_kt(a, b)
            if d < depth:
                child = levels[d + 1].steps[step][0]
                seen = np.unique(child, return_index=True)[1]  # one row of every child
                below = np.bincount(node[seen], weights=logs[d + 1][step], minlength=len(a))
                own = np.logaddexp(HALF + own, HALF + below)
            logs[d].append(own)
    return levels, logs


def path(levels, logs, depth: int, top: int, below=None):
    """Prediction of every row's byte, per binary step: P(one) of the part of the tree.

    below: for the levels above ``depth``, P(one) that deeper parts give (NaN: unseen).
    Returns for each step (bit, P(one)); NaN where no node of these levels was seen.
    """
    out = []
    for step in range(8):
        p = below[step] if below is not None else None
        for d in range(depth, top - 1, -1):
            node, bit, a, b = levels[d].steps[step]
            kt = (b + 0.5) / (a + b + 1.0)
            kt_row, seen = kt[node], (a + b > 0)[node]
            if p is None:
                p = np.where(seen, kt_row, np.nan)
                continue
            stay = np.exp(HALF + log_kt(a, b) - logs[d][step])[node]
            mixed = np.where(np.isnan(p), kt_row, stay * kt_row + (1 - stay) * p)
            p = np.where(seen, mixed, np.nan)
        out.append((levels[depth].steps[step][1], p))
    return out


def log_probability(steps) -> np.ndarray:
    """log10 P(byte) of every row; a step of which nothing is known counts one half."""
    total = 0.0
    for bit, p in steps:
        p = np.where(np.isnan(p), 0.5, p)
        total = total + np.log10(np.where(bit, p, 1.0 - p))
    return total
