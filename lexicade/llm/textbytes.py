"""Words and shingles of many texts at once, on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_MUL = U(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# words: digits, letters and everything outside ASCII
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
# words: everything but the space and the controls 9 to 13
DARK = np.ones(256, dtype=bool)
DARK[32] = False
DARK[9:14] = False


def release() -> None:
    """Hand freed memory back to the system: a worker lives on after its task."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each; a longer row stands alone."""
    if not len(lengths):
        return
    block = (np.cumsum(lengths) - 1) // most
    edges = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(lengths)]
    yield from zip(edges[:-1].tolist(), edges[1:].tolist())


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text begins and the last ends; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[
        column.offset: column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def blocks(column, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of blocks of bounded size."""
    data, offsets = text_bytes(column)
    for a, b in slices(np.diff(offsets), most):
        yield a, b, data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
    """Begin and end of every word, and the text it belongs to."""
    w = kind[data]
    if not len(w):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    before = np.empty_like(w)
    before[0] = False
    before[1:] = w[:-1]
    before[full] = False
    starts = np.flatnonzero(w & ~before)
    after = np.empty_like(w)
    after[-1] = False
    after[:-1] = w[1:]
    after[full[1:] - 1] = False
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


class WordHash:
    """64-bit hashes of byte ranges, from running sums of a polynomial modulo 2^64."""

    def __init__(self, seed: int = 1) -> None:
        base = mix(np.arange(1, 259, dtype=U) * _MUL + U(seed))
        self.table, self.p = base[:256], U(int(base[256]) | 1)
        self.q = U(pow(int(self.p), -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=U)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            for name, factor in (("up", self.p), ("down", self.q)):
                powers = np.full(n, factor, dtype=U)
                powers[0] = U(1)
                setattr(self, name, np.multiply.accumulate(powers))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        run = np.zeros(len(data) + 1, dtype=U)
        np.cumsum(self.table[data] * self.up[: len(data)], out=run[1:])
        raw = (run[ends] - run[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(U) * _MUL)


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, size: int, seed: int = 7):
    """(shingle hash, text) of every run of ``size`` words; a shorter text has one of all its words."""
    counts = np.bincount(doc, minlength=n_docs)
    place = mix(np.arange(1, size + 1, dtype=U) * _MUL + U(seed)) | U(1)
    out_h, out_d = [], []
    if len(words) >= size:
        h = np.zeros(len(words) - size + 1, dtype=U)
        for j in range(size):
            h += words[j: len(words) - size + 1 + j] * place[j]
        whole = doc[: len(h)] == doc[size - 1:]
        out_h.append(mix(h[whole]))
        out_d.append(doc[: len(h)][whole])
    short = counts[doc] < size
    if short.any():
        d = doc[short]
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])[d]
        at = np.flatnonzero(short) - first
        sums = np.zeros(n_docs, dtype=U)
        np.add.at(sums, d, words[short] * place[at])
        own = np.unique(d)
        out_h.append(mix(sums[own] + counts[own].astype(U)))
        out_d.append(own)
    if not out_h:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    h, d = np.concatenate(out_h), np.concatenate(out_d)
    order = np.argsort(d, kind="stable")
    return h[order], d[order]


def sums_by_text(values: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Sums of 64-bit values modulo 2^64; doc must ascend."""
    run = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values, out=run[1:])
    edges = np.searchsorted(doc, np.arange(n_docs + 1))
    return run[edges[1:]] - run[edges[:-1]]


def sequence_keys(words: np.ndarray, doc: np.ndarray, n_docs: int, seed: int) -> np.ndarray:
    """One 64-bit value for the whole word sequence of each text."""
    counts = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])[doc]
    at = (np.arange(len(doc)) - first).astype(U)
    return mix(sums_by_text(mix(words + mix(at * _MUL + U(seed))), doc, n_docs) + counts.astype(U))
