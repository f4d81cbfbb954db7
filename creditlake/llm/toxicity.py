"""Toxicity: a second-order factorization machine over hashed terms, which also learns pairs such as insult and group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import blocks
from .common import materialize, small_batches
from .terms import Hasher, held_out, labelled_sample

#: Terms are hashed so wide that strangers rarely meet; words count with their stems of these lengths.
BITS, STEMS = 40, (4, 5, 6)
#: The fit's bounds: labelled documents, terms (the most telling of those in at least LEAST_DOCS of them), factors.
SAMPLE, MOST_TERMS, LEAST_DOCS, LEAST_CHI, FACTORS = 12_000, 4096, 4, 10.0, 8
#: Terms whose pairs are looked at: the most frequent ones of the sample, of those in at least a fiftieth of it and in
#: PAIR_DOCS documents; as many pairs at most bring their terms in.
PAIR_TERMS, PAIR_DOCS = 2048, 8
HELD_FOLDS, HELD_FOLD = 3, 1
THRESHOLD = 0.7


class FactorizationMachine:
    """p(toxic) = s(b + sum w + 1/2 sum_f ((sum v_f)^2 - sum v_f^2)) over the different known terms of a text.

    Unknown terms count nothing, so a text's length alone moves no score; a text without known terms has s(b)."""

    def __init__(self, terms: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.terms, self.bias, self.w, self.v = terms, bias, w, v

    def known(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, ids), len(self.terms) - 1)
        return at[self.terms[at] == ids]

    def score(self, ids: np.ndarray) -> float:
        k = self.known(ids)
        v = self.v[k]
        z = self.bias + self.w[k].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(terms: np.ndarray, rows: list[np.ndarray], y: np.ndarray, factors: int = FACTORS, epochs: int = 40, rate: float = 0.1, l2: float = 2e-4, l1: float = 2e-4, batch: int | None = None, seed: int = 5) -> FactorizationMachine:
    """Adagrad on the log loss, with shrinkage. terms: sorted known terms; rows: the positions there of each document's
    terms; y: labels. Without both labels the prior is all it has."""
    n = len(rows)
    batch = batch or max(16, min(128, n // 40))  # small samples need their steps too
    prior = float(np.clip((y.sum() + 0.5) / (n + 1), 1e-3, 1 - 1e-3)) if n else 0.5
    bias = float(np.log(prior / (1 - prior)))
    rng = np.random.default_rng(seed)
    m = FactorizationMachine(terms, bias, np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), factors)))
    if n == 0 or len(np.unique(y)) < 2 or not len(terms):
        return m
    gw, gv, gb = np.full(len(terms), 1e-2), np.full((len(terms), factors), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            part = order[at : at + batch]
            sizes = np.array([len(rows[k]) for k in part])
            idx = np.concatenate([rows[k] for k in part])
            if not len(idx):
                continue
            doc = np.repeat(np.arange(len(part)), sizes)
            v = m.v[idx]
            some = np.flatnonzero(sizes)
            total = np.zeros((len(part), factors))
            total[some] = np.add.reduceat(v, np.r_[0, np.cumsum(sizes[some])[:-1]], axis=0)
            square = np.bincount(doc, (v**2).sum(axis=1), len(part))
            z = m.bias + np.bincount(doc, m.w[idx], len(part)) + 0.5 * ((total**2).sum(axis=1) - square)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            gb += g.sum() ** 2
            m.bias -= rate * g.sum() / np.sqrt(gb)
            by = np.argsort(idx, kind="stable")
            own, starts = np.unique(idx[by], return_index=True)
            dw = np.add.reduceat(g[doc][by], starts) + l2 * m.w[own]
            dv = np.add.reduceat((g[doc][:, None] * (total[doc] - v))[by], starts) + l2 * m.v[own]
            gw[own] += dw**2
            gv[own] += dv**2
            step = rate / np.sqrt(gw[own])
            w = m.w[own] - step * dw
            m.w[own] = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
            m.v[own] -= rate * dv / np.sqrt(gv[own])
    return m


def _chi(pos, df, n: int, p: float):
    """Chi-squared, one degree of freedom, of a feature in df of n documents, pos of them positive, the share p of all."""
    return (pos - df * p) ** 2 / np.maximum(df * max(p * (1 - p), 1e-9) * np.maximum(1 - df / max(1, n), 1 / max(1, n)), 1e-12)


def term_counts(hashed: DataFrame) -> DataFrame:
    """(term, df, pos): documents of the sample with each term, and the positive ones among them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = b.column(0).to_numpy()
            each = [np.frombuffer(x.as_buffer(), "<i8") for x in b.column(1)]
            ids, at, df = np.unique(np.concatenate(each), return_inverse=True, return_counts=True) if each else (np.empty(0, np.int64),) * 3
            pos = np.bincount(at, np.repeat(labels, [len(x) for x in each]), len(ids)).astype(np.int64) if len(ids) else df
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(df.astype(np.int64)), pa.array(pos)], names=["term", "df", "pos"])

    return hashed.select("label", "terms").mapInArrow(count, "term long, df long, pos long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("pos").alias("pos"))


def telling(counts: DataFrame, n: int, positive: int, most: int = MOST_TERMS) -> np.ndarray:
    """Sorted terms whose presence and the label depend on each other most, by chi-squared."""
    p = positive / max(1, n)
    chi = F.pow(F.col("pos") - F.col("df") * p, 2) / (F.col("df") * max(p * (1 - p), 1e-9) * F.greatest(1 - F.col("df") / max(1, n), F.lit(1 / max(1, n))))
    return np.sort(np.array([r["term"] for r in counts.where(chi >= LEAST_CHI).orderBy(chi.desc(), "term").limit(most).select("term").collect()], np.int64))


def telling_pairs(rows: list[np.ndarray], y: np.ndarray, frequent: np.ndarray, terms: int, most: int = PAIR_TERMS) -> np.ndarray:
    """Positions of terms that tell in pairs: both together depend on the label by more than chance among so many pairs, and
    by clearly more than either alone. So words that tell nothing apart, such as insult and group, come in too.

    rows: positions below `terms` of each document; frequent: the positions whose pairs count. Memory: len(frequent) ** 2."""
    n, k, p = len(rows), len(frequent), float(y.mean()) if len(y) else 0.0
    if k < 2:
        return np.empty(0, np.int64)
    at = np.full(terms, -1)
    at[frequent] = np.arange(k)
    both, good = np.zeros((k, k), np.float32), np.zeros((k, k), np.float32)
    for lo in range(0, n, 1024):
        part = rows[lo : lo + 1024]
        x = np.zeros((len(part), k + 1), np.float32)
        x[np.repeat(np.arange(len(part)), [len(r) for r in part]), at[np.concatenate(part)]] = 1  # others land in the spare column
        x = x[:, :k]
        both += x.T @ x
        x = x[y[lo : lo + 1024] > 0]
        good += x.T @ x
    alone = _chi(np.diag(good), np.diag(both), n, p)
    chi = _chi(good, both, n, p)
    found = (both >= PAIR_DOCS) & (chi >= 2 * np.log(k * (k - 1) / 2)) & (chi >= np.maximum(alone[:, None], alone[None]) + LEAST_CHI)
    i, j = np.nonzero(np.triu(found, 1))
    top = np.argsort(-chi[i, j], kind="stable")[:most]
    return np.unique(frequent[np.r_[i[top], j[top]]])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> FactorizationMachine:
    """Fit on a bounded sample of labelled rows outside the held-out fold, over the terms that tell alone or in pairs. The
    driver gets MOST_TERMS and PAIR_TERMS terms, and of `sample` documents the positions of those that each has."""

    small_batches(docs.sparkSession)

    def hash_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher(BITS, STEMS)
        for b in (x for y in batches for x in blocks(y, 1)):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x.astype("<i8").tobytes() for x, _ in h(b.column(1))], pa.binary())], names=["id", "label", "terms"])

    some = labelled_sample(docs, labels, "toxic", held_out(id_col, HELD_FOLDS, HELD_FOLD), sample, id_col, text_col)
    hashed = materialize(some.select(F.col("id").cast("string").alias("id"), "text", "label").mapInArrow(hash_terms, "id string, label int, terms binary"), "toxic-sample")
    n, positive = hashed.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    counts = materialize(term_counts(hashed).where(F.col("df") >= min(LEAST_DOCS, max(1, n // 50))), "toxic-terms")
    single = telling(counts, n, positive)
    often = counts.where(F.col("df") >= max(PAIR_DOCS, n / 50)).orderBy(F.col("df").desc(), "term").limit(PAIR_TERMS).select("term").collect()
    often = np.array([r["term"] for r in often], np.int64)
    terms = np.union1d(single, often)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = FactorizationMachine(terms, 0.0, np.empty(0), np.empty((0, 0)))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m.known(np.frombuffer(x.as_buffer(), "<i8")).astype("<i4").tobytes() for x in b.column(2)], pa.binary())], names=["id", "label", "at"])

    # Ids that repeat can give more rows than were sampled; the driver takes `sample` of them.
    got = hashed.mapInArrow(place, "id string, label int, at binary").orderBy("id", "at").limit(sample).collect()
    rows, y = [np.frombuffer(r["at"], "<i4") for r in got], np.array([float(r["label"]) for r in got])
    keep = np.union1d(np.searchsorted(terms, single), telling_pairs(rows, y, np.searchsorted(terms, often), len(terms))).astype(np.int64)
    to = np.full(len(terms), -1)
    to[keep] = np.arange(len(keep))
    return fit(terms[keep], [(x := to[r])[x >= 0] for r in rows], y)


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs, from its whole text alone.

    Null and empty texts score as texts without known terms. A null id gives held_out false. Other columns aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # MOST_TERMS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, m = Hasher(BITS, STEMS), shared.value
        for b in (x for y in batches for x in blocks(y, 1)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(x) for x, _ in h(b.column(1))], pa.float64())], names=["id", "score"])

    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), F.coalesce(held_out("id", HELD_FOLDS, HELD_FOLD), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on labels.toxic and score every document."""
    return score(docs, train(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns, whatever their names; scored in one
    narrow pass. Null and empty texts have no known terms and stay unless most of the sample is toxic; null ids, repeated
    rows and ties are judged by their text alone. An empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, m = Hasher(BITS, STEMS), shared.value
        for b in (x for y in batches for x in blocks(y, at)):
            yield b.filter(pa.array([m.score(x) < threshold for x, _ in h(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
