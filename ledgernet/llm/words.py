"""Vectorised words of Arrow text columns, for use inside tasks."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Rows a Python worker gets at once; long texts then stay within a worker's memory.
BATCH_BYTES = 8 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S27, _S30, _S31 = np.uint64(27), np.uint64(30), np.uint64(31)


def frugal(run):
    """``run`` over batches; what it has freed goes back to the machine when a task ends.

    Workers serve many tasks of different steps, and allocators keep what those have freed.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Return freed memory of this process to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # Other C libraries lack it.
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the splitmix finaliser)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def pieces(batches, column: str, most: int = BATCH_BYTES):
    """Slices of the batches whose texts add up to about ``most`` bytes at most, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for start, end in zip(edges, edges[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def words(text: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the code of each word in order, and where each row's words begin.

    Words are runs of characters other than space, tab, line feed, vertical tab, form feed
    and carriage return; ``lower`` turns A-Z, and nothing else, into lower case first. The
    offsets have one entry more than rows.
    """
    text = pc.fill_null(text, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    flat, bounds = split.values, split.offsets.to_numpy()
    full = pc.not_equal(flat, "")
    kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)))
    coded = flat.filter(full).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), kept[bounds]


def hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x, seed) for x in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))
