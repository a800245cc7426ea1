"""Texts as byte arrays inside tasks: words, hashes and look-ups without a loop per word.

Functions here get Arrow batches from ``mapInArrow`` and work on pieces of a megabyte, so
a task's memory depends neither on its number of rows nor on the size of a batch; a single
longer text is one piece.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

PIECE_BYTES = 1_000_000
BATCH_BYTES = 16 << 20

#: The six white-space characters of the word pattern.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII that is neither letter nor digit; bytes of other characters are kept.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def bounded_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Bound the bytes of an Arrow batch, as texts may be of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def pieces(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of at most ``limit`` bytes of text, with their bytes and row offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = raw_bytes(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offs, offs[first] + limit, "right")) - 1
            last = max(last, first + 1)
            part = offs[first : last + 1]
            yield batch.slice(first, last - first), data[part[0] : part[-1]], part - part[0]
            first = last
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers live on, and what they keep adds up over stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
            ctypes.CDLL(None).malloc_trim(0)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the offsets of the rows; null texts are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, data = texts.buffers()
    offs = np.frombuffer(where, np.int64 if wide else np.int32)
    offs = offs[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not data.size:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def word_spans(
    data: np.ndarray, offs: np.ndarray, breaks: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the number of words before it."""
    inside = ~breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offs)


_P = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.RandomState(20).randint(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _inverse(p: int) -> int:
    return pow(p, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (one to one)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers modulo 2 ** 64; those of usual pieces are kept."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        out = np.full(max(n, 1), np.uint64(base & (2**64 - 1)), np.uint64)
        out[0] = 1
        known = np.multiply.accumulate(out)
        if n <= 2 * PIECE_BYTES:
            _POWERS[base] = known
    return known[:n]


def span_hasher(data: np.ndarray):
    """Function of starts and ends that gives 64-bit hashes of byte spans, from one running sum
    of a polynomial."""
    n = len(data)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(_P, n), out=running[1:])
    back = powers(_inverse(_P), n + 1)

    def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((running[ends] - running[starts]) * back[starts])

    return hashes


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hasher(data)(starts, ends)


def gathered(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Stretches of ``flat``, one after the other."""
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((start - (ends - n)).astype(kind), n)
    at += np.arange(total, dtype=kind)
    return flat[at]


class SortedHashes:
    """A sorted array of distinct 64-bit hashes with the first place of each leading-bits group."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0))  # one more, so that a look-up may read past the end
        self.n = len(keys)
        bits = max(4, min(22, int(np.ceil(np.log2(max(len(keys), 1)))) + 1))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is absent."""
        group = (h >> self.shift).astype(np.int32)
        at = self.first[group]
        hit = self.keys[at] == h
        # Hash 0 behind the end is no entry.
        out = np.where(hit & (at < self.n), at, np.int32(-1))
        todo = np.flatnonzero(~hit)
        at, end = at[todo] + 1, self.first[group[todo] + 1]
        more = at < end
        todo, at, end = todo[more], at[more], end[more]
        while len(todo):
            hit = self.keys[at] == h[todo]
            out[todo[hit]] = at[hit]
            more = ~hit & (at + 1 < end)
            todo, at, end = todo[more], at[more] + 1, end[more]
        return out


def columns(batch: pa.RecordBatch, names: list[str], arrays: list) -> pa.RecordBatch:
    """A batch of ``doc_id`` (or the first name, as it came) and computed arrays."""
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names)
