"""Words of many texts at once: positions and 64-bit hashes by numpy over one byte buffer, without a Python loop over words."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_STEP = 1 << 16


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads all bits (public splitmix64 constants)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_POWERS = np.cumprod(np.concatenate([np.ones(1, U64), np.full(_STEP - 1, _BASE)]))
_HIGH = np.full(1, 1, U64)

#: The white space that separates words: blank and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def powers(at: np.ndarray) -> np.ndarray:
    """_BASE ** at modulo 2**64."""
    global _HIGH
    high = int(at.max() // _STEP) + 1 if len(at) else 1
    if high > len(_HIGH):
        _HIGH = np.cumprod(np.concatenate([np.ones(1, U64), np.repeat(_POWERS[-1:] * _BASE, high - 1)]))
    return _POWERS[at % _STEP] * _HIGH[at // _STEP]


class Texts:
    """A batch of texts as one UTF-8 buffer; `bounds[i]:bounds[i+1]` are the bytes of text i. Null counts as empty."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        parts = [(x or "").encode("utf-8", "surrogatepass") for x in column.to_pylist()]
        self.n = len(parts)
        self.bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def lower_ascii(self) -> np.ndarray:
        return np.where((self.bytes >= 65) & (self.bytes <= 90), self.bytes + 32, self.bytes).astype(np.uint8)

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Per text, how many bytes are flagged."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def spans(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every longest run of bytes that are not separators and lie in one text."""
        inside = ~separator[self.bytes]
        first = np.zeros(len(inside) + 1, bool)
        first[self.bounds] = True
        begins = inside & (first[:-1] | np.concatenate([[True], ~inside[:-1]]))[: len(inside)]
        ends = inside & (first[1:] | np.concatenate([~inside[1:], [True]]))[: len(inside)]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return start, end, np.searchsorted(self.bounds, start, side="right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    if not len(start):
        return np.zeros(0, U64)
    at = np.arange(len(data))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(_BYTES[data] * powers(at), dtype=U64)])
    inverse = pow(int(_BASE), -1, 1 << 64)
    return mix((sums[end] - sums[start]) * _inverse_powers(start, inverse) + (end - start).astype(U64))


_INV_LOW, _INV_HIGH = None, np.ones(1, U64)


def _inverse_powers(at: np.ndarray, inverse: int) -> np.ndarray:
    global _INV_LOW, _INV_HIGH
    if _INV_LOW is None:
        _INV_LOW = np.cumprod(np.concatenate([np.ones(1, U64), np.full(_STEP - 1, U64(inverse))]))
    high = int(at.max() // _STEP) + 1
    if high > len(_INV_HIGH):
        _INV_HIGH = np.cumprod(np.concatenate([np.ones(1, U64), np.repeat(_INV_LOW[-1:] * U64(inverse), high - 1)]))
    return _INV_LOW[at % _STEP] * _INV_HIGH[at // _STEP]


def windows(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every `size` words in a row of one text, and where each begins."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = np.zeros(n, U64)
    for k in range(size):
        h = mix(h * _BASE + words[k : k + n] + U64(k + 1)) if k < size - 1 else h * _BASE + words[k : k + n]
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix(h[at]), at


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on after its task, and would keep it through later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def batches(batch_iter, rows: int = 2000, size: int = 1 << 20):
    """Slices of Arrow batches with at most `rows` rows and about `size` bytes of strings, so that the work arrays stay small; a longer text stands alone."""
    for batch in batch_iter:
        wide = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
        ends = np.cumsum(sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in wide)) if wide else np.zeros(batch.num_rows, np.int64)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, done + size, side="right"))))
            yield batch.slice(at, stop - at)
            at = stop
        batch = None
    give_back()
