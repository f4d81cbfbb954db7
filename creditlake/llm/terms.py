"""Hashed terms of whole texts, as the classifiers of this subpackage read them."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import Known, chunked, per_text, spread

#: Words, and runs of marks such as %%% or |.
_TERM = re.compile(r"\w+|[^\w\s]+")


class Hasher:
    """Column of texts -> hashed terms of each text with their counts; stems adds the first letters of words as terms of
    their own, so that an ending hides no word."""

    def __init__(self, bits: int, stems: tuple[int, ...] = ()):
        self.mask, self.stems = (1 << bits) - 1, stems
        self.known = Known(self._new)

    def hash(self, term: str) -> int:
        return xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass")) & self.mask

    def _new(self, chunks: list[str]) -> list[bytes]:
        out, h = [], self.hash
        for c in chunks:
            terms = _TERM.findall(c.lower())
            ids = [h(t) for t in terms]
            ids += [h(f"{t[:k]}\0") for t in terms for k in self.stems if len(t) >= k]
            out.append(np.array(ids, "<i8").tobytes())
        return out

    def __call__(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """(different ids ascending, counts) for each text."""
        count, codes, different = chunked(texts)
        values, lengths = self.known(different, "<i8")
        ids, n = spread(values, lengths, codes)
        terms = per_text(count, n)
        doc = np.repeat(np.arange(len(terms)), terms)
        own, at = np.unique(ids, return_inverse=True)
        key, times = np.unique(doc * max(1, len(own)) + at, return_counts=True)
        cut = np.searchsorted(key, np.arange(1, len(terms)) * max(1, len(own)))
        return list(zip(np.split(own[key % max(1, len(own))] if len(own) else key, cut), np.split(times, cut), strict=True)) if len(terms) else []


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether a row's crc32(id as text) leaves `fold` when divided by `folds`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held: Column, most: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """(id, text, label) of at most `most` labelled ids, those with the smallest seeded hash; an id that repeats among docs
    gives all its rows.

    Only labels with `held` false count; null labels and ids are left out, contrary labels of one id give the larger one.
    `most` bounds what a classifier is fitted on; everything else covers all documents.
    """
    y = labels.where(~held & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label).cast("int").alias("label"))
    some = y.join(docs.select(F.col(id_col).alias("__id")), "__id", "left_semi").orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(most)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    # `most` rows of an id and a label: a size bound that the caller sets.
    return texts.join(F.broadcast(some), "__id").select(F.col("__id").alias("id"), "text", "label")


def word_slots(hasher: Hasher, texts: pa.Array, bits: int, again: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every occurrence of a term and of a pair of neighbouring terms in whole texts, in no order; slots are
    below 2 ** bits. Pairs of the same term are one pair, and so are those of a term and its return 2 to `again` places on."""
    count, codes, different = chunked(texts)
    values, lengths = hasher.known(different, "<i8")
    ids, n = spread(values, lengths, codes)
    text = np.repeat(np.arange(len(count)), per_text(count, n))
    h = ids.astype(np.uint64)
    shift = np.uint64(64 - bits)
    one = (h * np.uint64(0x9E3779B97F4A7C15)) >> shift
    here = np.flatnonzero(text[1:] == text[:-1])
    pair = (h[here] * np.uint64(0xC2B2AE3D27D4EB4F) + h[here + 1] * np.uint64(0x165667B19E3779F9)) >> shift
    pair[h[here] == h[here + 1]] = _return_slot(1, bits)
    owners, slots = [text, text[here]], [one, pair]
    for d in range(2, again + 1):
        back = np.flatnonzero((h[d:] == h[:-d]) & (text[d:] == text[:-d]))
        owners.append(text[back])
        slots.append(np.full(len(back), _return_slot(d, bits), np.uint64))
    return np.concatenate(owners), np.concatenate(slots).astype(np.int64)


def _return_slot(distance: int, bits: int) -> int:
    return xxhash.xxh3_64_intdigest(f"\0 again {distance}".encode()) >> (64 - bits)
