"""Whole texts as codes into a table of their different white-space chunks, so that work on a chunk is done once a block."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A block holds so many bytes of text, or one text that is longer.
BLOCK_BYTES = 2 << 20


def blocks(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts (column number `text`) together stay under BLOCK_BYTES."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, held = 0, 0
    for k, n in enumerate(size.tolist()):
        if held and held + n > BLOCK_BYTES:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def chunked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(chunks of each text, code of each chunk, different chunks). Chunks lie between 0x20 and 0x09 to 0x0D; null: none."""
    parts = pc.ascii_split_whitespace(pc.fill_null(column, "").cast(pa.large_string()))
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    count = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    if not pc.all(full).as_py() and len(flat):
        some = full.to_numpy(zero_copy_only=False)
        count = np.bincount(np.repeat(np.arange(len(count)), count)[some], minlength=len(count))
        flat = flat.filter(full)
    codes = flat.dictionary_encode()
    return count, codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_numpy(zero_copy_only=False).tolist()


def spread(values: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each code one after another, and how many each has; values are laid out by code with these lengths."""
    n = lengths[codes]
    start = (np.cumsum(lengths) - lengths)[codes]
    to = np.repeat(start - (np.cumsum(n) - n), n)
    to += np.arange(len(to))
    return values[to], n


class Known:
    """What a function gives for each chunk, as bytes, kept between blocks for up to `most` chunks of LONGEST characters at
    most; longer chunks are rare as repeats, so what they give is kept for their own block alone. A table thus holds
    most * (LONGEST characters and their values), however long the words of a text are."""

    LONGEST = 48

    def __init__(self, of_new: Callable[[list[str]], list[bytes]], most: int = 300_000):
        self.of_new, self.most, self.kept = of_new, most, {}

    def all(self, chunks: list[str]) -> Mapping[str, bytes]:
        """A mapping that has all of these chunks, until the next call."""
        kept = self.kept
        new = [c for c in chunks if c not in kept]
        if len(kept) + len(new) > self.most:
            kept.clear()
            new = chunks
        got = self.of_new(new)
        if any(len(c) > self.LONGEST for c in new):
            once = {c: g for c, g in zip(new, got, strict=True) if len(c) > self.LONGEST}
            kept.update((c, g) for c, g in zip(new, got, strict=True) if len(c) <= self.LONGEST)
            return ChainMap(once, kept)
        kept.update(zip(new, got, strict=True))
        return kept

    def __call__(self, chunks: list[str], dtype: str) -> tuple[np.ndarray, np.ndarray]:
        """(values, lengths) over the given different chunks."""
        kept = self.all(chunks)
        got = [kept[c] for c in chunks]
        return np.frombuffer(b"".join(got), dtype), np.fromiter(map(len, got), np.int64, len(got)) // np.dtype(dtype).itemsize


def per_text(count: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many values each text has, from its chunks and the values of each chunk."""
    ends = np.r_[0, np.cumsum(n)]
    at = np.r_[0, np.cumsum(count)]
    return ends[at[1:]] - ends[at[:-1]]
