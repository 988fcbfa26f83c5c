"""Word shingles of texts as 64-bit hashes, vectorised over an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from arcframe.llm.common import mix64, run_hashes
from arcframe.llm.fragments import WHITE

WORDS = 5


#: Each byte, A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[list(WHITE)] = True


def shingle_sets(column: pa.Array, width: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of each text of a non-null Arrow string column.

    Words are runs without [\\x20\\x09-\\x0D], A-Z lower-cased. A text of fewer words than
    width has its whole sequence as one shingle; one without words has none.
    """
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    base = int(offsets[0])
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[base : int(offsets[-1])]
    edges = offsets - base
    solid = ~_WHITE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = edges[1:-1][edges[1:-1] < len(data)]
    begins[inner] = solid[inner]
    starts = np.flatnonzero(begins)
    if not len(starts):
        yield from (np.zeros(0, np.uint64) for _ in range(len(column)))
        return
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | begins[1:]
    sizes = np.flatnonzero(ends) + 1 - starts
    words = run_hashes(LOWER[data], starts, sizes)
    with np.errstate(over="ignore"):
        rows = np.searchsorted(starts, edges, "left")
        grams = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for i in range(width):
            grams = mix64(grams * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - width + 1 + i] + np.uint64(i + 1))
        for lo, hi in zip(rows[:-1], rows[1:]):
            if hi - lo >= width:
                yield np.unique(grams[lo : hi - width + 1])
            elif hi > lo:
                whole = np.uint64(hi - lo)
                for w in words[lo:hi]:
                    whole = mix64(np.array([whole * np.uint64(0xD6E8FEB86659FD93) + w + np.uint64(77)], np.uint64))[0]
                yield np.array([whole], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
