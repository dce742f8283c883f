"""Helpers that several operators share: whole texts in bounded slices, rolling hashes, scratch folders."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from passagelake.sources.scratch import discard, shared_dir, stored  # noqa: F401

#: Bytes of text that a Python worker handles at once (one longer text is handled alone).
SLICE_BYTES = 3 << 20

_ODD = 0x9E3779B97F4A7C15
_ODD = _ODD - (_ODD % 8) + 5  # 5 mod 8: long multiplicative order modulo 2**64
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTE_CODE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None  # glibc has it


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, cut so that each slice holds about `limit` bytes of `column` (at least one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def trim() -> None:
    """Gives freed memory back to the system: else the allocators keep what a step took at its peak, beside what the next one takes."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def trimming(run):
    """run (batches to batches), whose worker gives freed memory back when a task ends."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def filled(column: pa.Array) -> pa.Array:
    """The texts, null as the empty text."""
    return pc.fill_null(column, "")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for i, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


_LANES = [np.random.default_rng(s).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for s in (11, 12)]


def lane_hashes(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of all substrings of that width (at least 8), by start. Unlike span_hash() not linear in the bytes, so equal values stand for equal strings even where texts are made to collide."""
    lanes = np.lib.stride_tricks.sliding_window_view(np.ascontiguousarray(data), 8).copy().view(np.uint64).ravel()
    n, out = len(data) - width + 1, []
    steps = [*range(0, width - 7, 8)] + [width - 8] * (width % 8 > 0)
    for keys in _LANES:
        spread = mixed(lanes * keys[-1] + keys[-2])
        total = np.zeros(n, np.uint64)
        for k, step in enumerate(steps):
            total += spread[step : step + n] * keys[k % 60]
            if k % 60 == 59:
                total = mixed(total)
        out.append(mixed(total))
    return out[0], out[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the 64-bit hash of any substring of these bytes follows.

    It is linear in the bytes: strings can be made that differ and hash alike. It chooses places and brings strings together; what meets must be told apart by more."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * powers(len(data))[0], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, stop): equal for equal bytes wherever they stand."""
    return (prefix[stop] - prefix[start]) * powers(len(prefix))[1][start]


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all substrings of that width, by start."""
    n = len(prefix) - width
    return (prefix[width:] - prefix[:n]) * powers(max(1, n))[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit value over all its bits, one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
