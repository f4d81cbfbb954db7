"""Similarity of many pairs of names at once, where one fold for each pair would take most of the time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Letters of a name that fit the bits of one number; longer names take numbers of any length, pair by pair.
BITS = 64
#: Pairs of names whose tables are in memory at once: some 30 kinds of letters, 8 bytes each; thousands of kinds take 60 MB.
ROWS = 1_000


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by rows of its table in the bits of one number."""
    at: dict[str, int] = {}
    for k, letter in enumerate(b):
        at[letter] = at.get(letter, 0) | 1 << k
    every = row = (1 << len(b)) - 1
    for letter in a:
        both = row & at.get(letter, 0)
        row = ((row + both) | (row - both)) & every
    return len(b) - row.bit_count()


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and how many each text has."""
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    if raw.max(initial=0) < 128:
        return raw, np.diff(ends)
    return np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32), pc.utf8_length(texts).to_numpy(zero_copy_only=False)


def _columns(codes: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The first code of each text, then the second, and so on; 0 behind its end."""
    out = np.zeros((len(lengths), lengths.max(initial=0)), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = codes
    return list(np.ascontiguousarray(out.T))


def _shared(a: pa.Array, b: pa.Array) -> np.ndarray:
    """_common() of many short texts: each row of bits is one number of an array."""
    (x, la), (y, lb) = _letters(a), _letters(b)
    used = np.zeros(max(x.max(initial=0), y.max(initial=0)) + 1, bool)
    used[x] = used[y] = True
    nth = np.cumsum(used)
    kinds, row = int(nth[-1]) + 1, np.full(len(a), ~np.uint64(0))
    at, start = np.zeros(len(a) * kinds, np.uint64), np.arange(len(a)) * kinds
    for k, code in enumerate(_columns(nth[y], lb)):
        at[start + code] |= np.uint64(1 << k)
    at[start] = 0
    for code in _columns(nth[x], la):
        both = row & at[start + code]
        row = (row + both) | (row - both)
    return np.bitwise_count(~row)


def similarities(a: pa.Array, b: pa.Array) -> np.ndarray:
    """200 * LCS / (length + length), 0 where one is empty: token_sort_similarity() of names whose words are sorted."""
    a, b = (pc.fill_null(x.cast(pa.string()), "") for x in (a, b))
    la, lb = (pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    common, long = np.zeros(len(a), np.int64), (la > BITS) | (lb > BITS)
    for k in np.flatnonzero(long):
        common[k] = _common(a[k].as_py(), b[k].as_py())
    short = np.flatnonzero(~long)
    for k in range(0, len(short), ROWS):
        part = short[k : k + ROWS]
        common[part] = _shared(a.take(pa.array(part)), b.take(pa.array(part)))
    return np.where((la == 0) | (lb == 0), 0.0, 200.0 * common / np.maximum(la + lb, 1))


@F.arrow_udf(DoubleType())
def _alike(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(similarities(a, b))


#: Not told to be repeatable, so that it isn't computed once more for each filter on it.
alike = _alike.asNondeterministic()
