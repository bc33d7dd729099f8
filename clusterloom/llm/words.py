"""Texts as numbered words: Arrow lower-cases, cuts and numbers a slice of rows, Python sees only distinct words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def numbered_words(texts: pa.Array, between: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of every word, first word of each text and the end, distinct words), A-Z in lower case.

    ``between`` is the regular expression of what stands between words. Where a text begins or ends with it, there is an
    empty word, whose number is -1.
    """
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), between)
    table = pc.dictionary_encode(parts.flatten())
    offsets = parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - (offsets[0] if len(offsets) else 0)
    numbers = table.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(table.dictionary, "").as_py()
    if empty >= 0:
        numbers[numbers == empty] = -1
    return numbers, offsets, table.dictionary


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row of every word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
