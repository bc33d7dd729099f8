"""Texts as fragments between spaces: what is worked out for a fragment is put together for texts by Arrow, not in Python.

A text is cut before each of its spaces, so ``a b`` is ``a`` and `` b``. Arrow cuts, numbers the distinct fragments of
a slice of rows and joins their values again; Python sees each distinct fragment once a slice, and works it out once as
long as its worker remembers it.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut up at a time; one longer text is handled alone.
SLICE_BYTES = 2 << 20
#: A text of more bytes is handled without joining columns, whose offsets have 32 bits.
LONG_TEXT = 64 << 20
#: Bytes (by estimate) in each half of what a worker remembers.
REMEMBERED = 20 << 20


#: What a worker holds for later tasks of its kind, as functions that drop it.
_HELD: list[Callable[[], None]] = []


def held(drop: Callable[[], None]) -> None:
    _HELD.append(drop)


def give_back() -> None:
    """Free memory goes back to the system: workers outlive their tasks, and an executor's memory is that of all of them."""
    gc.collect(0)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def turn_to_other_work() -> None:
    """For tasks that need nothing of what is held."""
    for drop in _HELD:
        drop()
    gc.collect()
    give_back()


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of the batch with at most ``SLICE_BYTES`` of text (or one row), and their texts; a null text is empty."""
    texts = pc.fill_null(batch.column(column), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.zeros(0, dtype=np.int64)
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield batch.slice(at, stop - at), texts.slice(at, stop - at)
        at = stop


def chunks_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of what stands between spaces, first code of each text and the end, the distinct chunks)."""
    parts = pc.split_pattern(texts, " ")
    numbered = pc.dictionary_encode(parts.flatten())
    offsets = parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - (offsets[0] if len(offsets) else 0)
    return numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets, numbered.dictionary


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(code of every fragment, first fragment of each text and the end, distinct fragments)."""
    codes, offsets, chunks = chunks_of(texts)
    inner = chunks.to_pylist()
    # A text's first fragment has no space in front: it gets a number of its own.
    heads = offsets[:-1]
    names = [inner[i] for i in codes[heads].tolist()]
    first = dict.fromkeys(names)
    place = {name: len(inner) + k for k, name in enumerate(first)}
    codes[heads] = [place[name] for name in names]
    return codes, offsets, [" " + x for x in inner] + list(first)


def joined(values: pa.Array, codes: np.ndarray, offsets: np.ndarray, between: str | bytes) -> pa.Array:
    """For each text the values of its fragments, joined."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.take(pa.array(codes))), between)


class Remembered:
    """Fragments to what ``work`` makes of a list of them, in bounded memory: when one half is full it becomes the older
    half, in which what is still in use is found again; no value may be None."""

    def __init__(self, work: Callable[[list[str]], list], limit: int = REMEMBERED):
        self.work, self.limit = work, limit
        self.young: dict = {}
        self.old: dict = {}
        self.size = 0

    def __call__(self, keys: list[str]) -> list:
        """The values of distinct keys, in their order."""
        young, old = self.young, self.old
        found = list(map(young.get, keys))
        missing = [i for i, v in enumerate(found) if v is None]
        new = []
        for i in missing:
            value = found[i] = old.get(keys[i])
            if value is None:
                new.append(i)
        for i, value in zip(new, self.work([keys[i] for i in new]) if new else (), strict=True):
            found[i] = value
        for i in missing:
            young[keys[i]] = found[i]
            self.size += 250 + 6 * len(keys[i])
        if self.size > self.limit:
            self.young, self.old, self.size = {}, young, 0
        return found
