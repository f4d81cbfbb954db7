"""Quality: similarity-weighted votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import blocks
from .common import small_batches
from .terms import Hasher, held_out, labelled_sample, word_slots

#: Words and word pairs share 2 ** BITS slots; a slot counts if at least one document in LEAST_SHARE has it.
BITS, LEAST_SHARE = 18, 200
SLOTS = 1 << BITS
#: The fit's bounds: labelled documents, whose vectors are broadcast (SAMPLE x RANK floats, 1 MB), and the rank.
SAMPLE, RANK = 3000, 64
#: Voters, and the power of their cosines that weighs them. Cosines count to so many digits, so that equal ones tie.
NEAREST, POWER, DIGITS = 15, 8, 5
HELD_FOLDS, HELD_FOLD = 5, 0
THRESHOLD = 0.3
_BLOCK = 512
#: Slots of a block of document counts, and cells of a block of documents by slots.
_SUM_SLOTS, _CELLS = 512, 1 << 21


def occurrences(hasher: Hasher, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_slots(hasher, texts, BITS)


class LatentVotes:
    """Known slots with their idf, projection to the latent space, and the unit vectors and labels of the sample."""

    def __init__(self, known: np.ndarray, idf: np.ndarray, samples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rank: int = RANK, seed: int = 3):
        """samples: positions among the known slots and counts of each labelled document."""
        self.y = y.astype(np.float64)
        self.prior = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.5
        self.at = np.full(SLOTS, -1, np.int32)
        self.at[known] = np.arange(len(known))
        ends = np.cumsum([0, *(len(p) for p, _ in samples)])
        cols = np.concatenate([np.empty(0, np.int64), *(p for p, _ in samples)]).astype(np.int64)
        vals = np.concatenate([np.empty(0), *(c * idf[p] for p, c in samples)])
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            vals[a:b] /= np.linalg.norm(vals[a:b]) or 1

        def by_terms(x: np.ndarray) -> np.ndarray:
            return np.stack([vals[a:b] @ x[cols[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)])

        def by_samples(x: np.ndarray) -> np.ndarray:
            out = np.zeros((len(known), x.shape[1]))
            for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                out[cols[a:b]] += vals[a:b, None] * x[k]
            return out

        rank = min(rank, len(samples), len(known))
        self.project = np.zeros((len(known), rank), np.float32)
        if rank:  # randomized SVD with two power steps
            q = by_terms(np.random.default_rng(seed).standard_normal((len(known), min(rank + 16, len(samples), len(known)))))
            for _ in range(2):
                q = by_terms(by_samples(np.linalg.qr(q)[0]))
            _, _, vt = np.linalg.svd(by_samples(np.linalg.qr(q)[0]).T, full_matrices=False)
            self.project = np.ascontiguousarray(vt[:rank].T * idf[:, None], np.float32)
        base = np.stack([c.astype(np.float32) @ self.project[p] for p, c in samples]) if samples else np.zeros((0, rank), np.float32)
        self.base = self.unit(base)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-12).astype(np.float32)

    def vectors(self, count: int, text: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Unit vectors of `count` texts from the occurrences in them: counts by slot times the projection."""
        out, known = np.zeros((count, self.project.shape[1]), np.float32), self.at[slot]
        n = len(self.project)
        if not n:
            return out
        order = np.argsort(text[known >= 0], kind="stable")
        text, known = text[known >= 0][order], known[known >= 0][order]
        step = max(1, _CELLS // n)
        cut = np.searchsorted(text, np.arange(0, count + step, step))
        for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            here = min(step, count - k * step)
            x = np.bincount((text[a:b] - k * step) * n + known[a:b], minlength=here * n).reshape(here, n)
            out[k * step : k * step + here] = x.astype(np.float32) @ self.project
        return self.unit(out)

    def score(self, x: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
        """Votes by exact cosines with all labelled vectors, block by block; the prior where nothing is similar. All that
        tie with the last voter vote."""
        out = np.full(len(x), self.prior)
        k = min(nearest, len(self.y))
        if not k:
            return out
        for at in range(0, len(x), _BLOCK):
            c = np.maximum(np.round((x[at : at + _BLOCK] @ self.base.T).astype(np.float64), DIGITS), 0)
            last = np.partition(c, -k, axis=1)[:, -k]
            w = np.where(c >= last[:, None], c, 0) ** POWER
            total = w.sum(axis=1)
            out[at : at + _BLOCK] = np.where(total > 1e-9, (w @ self.y) / np.maximum(total, 1e-9), self.prior)
        return np.clip(out, 0, 1)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Documents in all, and those with each slot, over every row. Each task adds up its own counts first and sends them as
    blocks of slots; the sums that come to the driver are as long as the slots."""

    def blocks_of(counts: np.ndarray) -> pa.RecordBatch:
        cut = counts.reshape(-1, _SUM_SLOTS)
        some = np.flatnonzero(cut.any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([cut[k].astype("<i8").tobytes() for k in some], pa.binary())], names=["block", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, df = Hasher(40), np.zeros(SLOTS + _SUM_SLOTS, np.int64)
        for b in (x for y in batches for x in blocks(y, 0)):
            text, slot = occurrences(h, b.column(0))
            df[:SLOTS] += np.bincount(np.unique(text * SLOTS + slot) % SLOTS, minlength=SLOTS)
            df[SLOTS] += b.num_rows  # the block after the slots counts documents
        yield blocks_of(df)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(x.as_buffer(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    df = np.zeros((SLOTS // _SUM_SLOTS + 1, _SUM_SLOTS), np.int64)
    for r in docs.select(text_col).mapInArrow(count, schema).repartition("block").mapInArrow(total, schema).collect():
        df[r["block"]] = np.frombuffer(r["counts"], "<i8")
    return int(df[-1, 0]), df[:-1].reshape(-1)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> LatentVotes:
    """idf over all documents; the space and the voters from a bounded sample of labelled rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    n, df = document_frequencies(docs, text_col)
    known = np.flatnonzero(df >= max(2, n / LEAST_SHARE) if n >= LEAST_SHARE else df > 0)
    at = np.full(SLOTS, -1, np.int32)
    at[known] = np.arange(len(known))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher(40)
        for b in (x for y in batches for x in blocks(y, 1)):
            text, slot = occurrences(h, b.column(1))
            key, times = np.unique((text * SLOTS + at[slot])[at[slot] >= 0], return_counts=True)
            ends = np.searchsorted(key, np.arange(1, b.num_rows) * SLOTS)
            cols = [pa.array([x.astype(t).tobytes() for x in np.split(v, ends)], pa.binary()) for v, t in ((key % SLOTS, "<i4"), (times, "<f4"))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols], names=["id", "label", "slots", "counts"])

    some = labelled_sample(docs, labels, "quality", held_out(id_col, HELD_FOLDS, HELD_FOLD), sample, id_col, text_col)
    # Ids that repeat can give more rows than were sampled; the driver takes `sample` of them.
    rows = some.select(F.col("id").cast("string").alias("id"), "text", "label").mapInArrow(hashed, "id string, label int, slots binary, counts binary").orderBy("id", "slots", "counts").limit(sample).collect()
    rows = [r for r in rows if r["slots"]]
    return LatentVotes(known, np.log((1 + n) / (1 + df[known])) + 0.1, [(np.frombuffer(r["slots"], "<i4"), np.frombuffer(r["counts"], "<f4")) for r in rows], np.array([float(r["label"]) for r in rows]))


def _scores(model: LatentVotes, hasher: Hasher, column: pa.Array) -> np.ndarray:
    return model.score(model.vectors(len(column), *occurrences(hasher, column)))


def score(docs: DataFrame, model: LatentVotes, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs, from its whole text alone.

    Null, empty and blank texts get the sample's share of good documents. A null id gives held_out false. Other columns
    aren't read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # known slots x RANK and SAMPLE x RANK floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher(40)
        for b in (x for y in batches for x in blocks(y, 1)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(shared.value, h, b.column(1)))], names=["id", "score"])

    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), F.coalesce(held_out("id", HELD_FOLDS, HELD_FOLD), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on labels.quality and score every document."""
    return score(docs, train(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)


def drop_poor(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores at least the threshold, with all their columns, whatever their names. Null, empty
    and blank texts stay unless most of the sample is poor; null ids, repeated rows and ties are judged by their text alone.
    An empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher(40)
        for b in (x for y in batches for x in blocks(y, at)):
            yield b.filter(pa.array(_scores(shared.value, h, b.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
