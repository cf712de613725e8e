"""Hashes of words and windows over Arrow columns of text, in numpy.

A window's hash comes from prefix sums of ``value[i] * base**i`` modulo 2**64; the
base is odd, so dividing by ``base**i`` is a product with its inverse. Bytes are first
replaced by random 64-bit numbers. Two families with other numbers give 128 bits where
a hash stands for its text.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Odd bases of the two families, and the multipliers of the bit mixer.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
SLICE_BYTES = 1 << 20
_BYTE_VALUES = [
    np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for seed in (11, 29)
]
_powers: dict[tuple[int, bool], np.ndarray] = {}

# [^\x20\x09-\x0D]+ is a word: every other byte, those above 127 included, belongs to one.
SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
# Letters, digits and every byte above 127 make words; all else separates them.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = values ^ (values >> np.uint64(30))
    x *= MIX[0]
    x ^= x >> np.uint64(27)
    x *= MIX[1]
    x ^= x >> np.uint64(31)
    return x


def powers(family: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of a family's base, or of its inverse modulo 2**64."""
    known = _powers.get((family, inverse))
    if known is None or len(known) < n:
        base = pow(BASES[family], -1, 1 << 64) if inverse else BASES[family]
        known = np.full(max(n, SLICE_BYTES + 1024), base, dtype=np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if len(known) < 8 * SLICE_BYTES:  # larger tables are for one long text only
            _powers[(family, inverse)] = known
    return known[:n]


def prefix_sums(values: np.ndarray, family: int) -> np.ndarray:
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(family, len(values)), out=sums[1:])
    return sums


def byte_sums(data: np.ndarray, family: int) -> np.ndarray:
    return prefix_sums(_BYTE_VALUES[family][data], family)


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int) -> np.ndarray:
    """Hashes of the spans from starts to ends (exclusive), not yet mixed."""
    return (sums[ends] - sums[starts]) * powers(family, len(sums), inverse=True)[starts]


def windows(sums: np.ndarray, size: int, family: int) -> np.ndarray:
    """Hashes of all windows of a size, in order, not yet mixed."""
    n = max(0, len(sums) - size)
    return (sums[size:] - sums[:n]) * powers(family, len(sums), inverse=True)[:n]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts and the offset of each text; null is empty."""
    column = column.cast(pa.large_binary())
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], pa.large_binary())
    whole = whole.fill_null(b"")
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    if whole.buffers()[2] is None or not len(whole):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(whole) + 1, dtype=np.int64)
    data = np.frombuffer(whole.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most SLICE_BYTES each, or of one longer text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end
    pa.default_memory_pool().release_unused()  # workers live on; what Arrow has freed needn't


# Rows of a batch that are turned into Python texts at a time.
TEXT_ROWS = 512


def few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXT_ROWS):
            yield batch.slice(at, TEXT_ROWS)
        pa.default_memory_pool().release_unused()


class Words:
    """The words of some texts: where they lie, and to which text they belong."""

    def __init__(
        self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, separators: np.ndarray = SEPARATORS
    ) -> None:
        self.data = LOWER[data] if lower else data
        inside = ~separators[data]
        before = np.zeros(len(data), dtype=bool)
        before[1:] = inside[:-1]
        bounds = offsets[:-1][offsets[:-1] < len(data)]
        before[bounds] = False
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = inside[1:]
        lasts = offsets[1:][offsets[1:] > 0] - 1
        after[lasts] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: first word of each text, and the number of words at the end
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def place(self) -> np.ndarray:
        """The place of each word in its text."""
        return np.arange(len(self)) - np.repeat(self.bounds[:-1], self.counts)

    def left(self) -> np.ndarray:
        """How many words of its text begin at each word or after it."""
        return np.repeat(self.bounds[1:], self.counts) - np.arange(len(self))

    def hashes(self, family: int = 0) -> np.ndarray:
        return mix(spans(byte_sums(self.data, family), self.starts, self.ends, family))

    def runs(self, size: int, hashes: np.ndarray, family: int = 0) -> np.ndarray:
        """Hash of the ``size`` words from each word on; meaningless where fewer are left."""
        out = np.zeros(len(self), dtype=np.uint64)
        made = mix(windows(prefix_sums(hashes, family), size, family))
        out[: len(made)] = made
        return out
