"""Rice coding (Golomb coding with a power-of-two divisor) of sorted integers."""

from __future__ import annotations

import numpy as np
import pandas as pd


def rice_parameter(span: int, count: int) -> int:
    """log2 of the mean gap: near the optimal divisor for uniformly spread values."""
    return max(0, int(span // max(1, count)).bit_length() - 1)


def encode(values: np.ndarray, k: int) -> bytes:
    """Sorted, distinct, non-negative values as Rice-coded gaps.

    The first gap is counted from -1. Layout: all unary quotients (a run of zeros closed
    by a one per value), then all k-bit remainders, packed most significant bit first.
    """
    if not len(values):
        return b""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    quotient = gaps >> k
    ends = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    shifts = np.arange(k - 1, -1, -1, dtype=np.int64)
    remainder = ((gaps[:, None] >> shifts) & 1).astype(np.uint8).ravel()
    return np.packbits(np.concatenate([unary, remainder])).tobytes()


def decode(blob: bytes, count: int, k: int) -> np.ndarray:
    """The values that encode() was given."""
    if not count:
        return np.zeros(0, np.int64)
    bits = np.unpackbits(np.frombuffer(blob, np.uint8))
    ends = np.flatnonzero(bits)[:count]
    quotient = np.diff(ends, prepend=-1) - 1
    start = int(ends[-1]) + 1
    rest = bits[start : start + count * k].reshape(count, k).astype(np.int64)
    remainder = rest @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64)) if k else 0
    return np.cumsum((quotient << k) + remainder + 1) - 1



def answered(runs: pd.DataFrame) -> pd.DataFrame:
    """Bitmaps over the runs (n, k, body of encode(), bits `twice`) that one owner received: values met more than once."""
    values = [decode(b, n, k) for b, n, k in zip(runs["body"], runs["n"], runs["k"])]
    twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=n).astype(bool) for t, n in zip(runs["twice"], runs["n"])]
    both = np.concatenate(values)
    _, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
    seen = (counts[inverse] > 1) | np.concatenate(twice)
    cuts = np.cumsum(runs["n"].to_numpy())[:-1]
    return runs.assign(k=0, body=b"", twice=[np.packbits(x).tobytes() for x in np.split(seen, cuts)])
