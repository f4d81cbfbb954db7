"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import components_of, materialize, small_batches

COSINE = 0.95
#: Tables, polytopes to a table's key, and probes: the key itself and the keys with the likeliest single changes. Of pairs
#: at cosine 0.95 in 64 dimensions, 4000 of 4000 met. Two polytopes give 128 x 128 buckets a table there, which suits some
#: 10^8 vectors; beyond, more polytopes and tables keep buckets small. Results are exact for pairs that meet either way.
TABLES, POLYTOPES, PROBES, SEED = 8, 2, 3, 17
#: A bucket of more rows is cut into parts of about so many, and every pair of parts is a group of its own.
PART_ROWS = 1024
#: Groups up to this length are compared by shifting sorted rows, longer ones strip by strip; a block holds so many rows.
SHORT_RUN, BLOCK_ROWS = 48, 20_000
#: Keys of larger buckets are broadcast up to so many, and joined beyond.
BROADCAST_KEYS = 100_000


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    big = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < big))
    return F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def bucket_keys(x: np.ndarray, tables: int = TABLES, polytopes: int = POLYTOPES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(rows, tables, probes) keys of unit rows; probe 0 is the row's own bucket. Keys of different tables differ."""
    n, d = x.shape
    size = max(2, 1 << (d - 1).bit_length())
    out = np.zeros((n, tables, probes), np.int64)
    for t in range(tables):
        codes, gaps, others = [], [], []
        for p in range(polytopes):
            signs = np.random.default_rng([seed, size, t, p]).integers(0, 2, (3, size)) * 2.0 - 1
            y = np.zeros((n, size))
            y[:, :d] = x
            for s in signs:
                y = hadamard(y * s)
            a = np.abs(y)
            top = np.argsort(-a, axis=1, kind="stable")[:, : probes]
            rows = np.arange(n)[:, None]
            code = 2 * top + (y[rows, top] < 0)
            codes.append(code[:, 0])
            others.append(code[:, 1:])
            gaps.append(a[rows, top[:, :1]] - a[rows, top[:, 1:]])
        own = np.zeros(n, np.int64)
        for c in codes:
            own = own * 2 * size + c
        changes = np.concatenate([(others[p] - codes[p][:, None]) * (2 * size) ** (polytopes - 1 - p) for p in range(polytopes)], axis=1)
        near = np.argsort(np.concatenate(gaps, axis=1), axis=1, kind="stable")[:, : probes - 1]
        out[:, t, 0] = own
        out[:, t, 1:] = own[:, None] + np.take_along_axis(changes, near, axis=1)
        out[:, t] = out[:, t] * tables + t
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _dims(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of the vectors in a column."""
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(float)
    start = np.cumsum(n) - n
    return [(rows := np.flatnonzero(n == d), flat[start[rows][:, None] + np.arange(d)]) for d in np.unique(n).tolist()]


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket that a vector is in: its key, whether as its own, and the vector."""
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            for rows, x in _dims(part.column(2)):
                keys = bucket_keys(_unit(x))
                each = keys.shape[1] * keys.shape[2]
                own = np.tile(np.arange(each) % keys.shape[2] == 0, len(rows))
                take = pa.array(np.repeat(rows, each))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1)), pa.array(np.full(each * len(rows), x.shape[1], np.int32)), pa.array(own), *(part.column(k).take(take) for k in range(3))],
                    names=["key", "dim", "own", "rep", "copies", "vector"],
                )


def _entry_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _entries(batches):
        yield b.select(["key", "dim"])


def _first_meeting(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of rows that share a bucket which is the own one of either, the least key of that kind in the first such table."""
    same = p[:, :, :, None] == q[:, :, None, :]
    same[:, :, 1:, 1:] = False  # probes of both
    first = same.any(axis=(2, 3)).argmax(axis=1)
    rows = np.arange(len(p))
    return np.where(same[rows, first].any(axis=2), p[rows, first], np.iinfo(np.int64).max).min(axis=1)


def block_links(group: np.ndarray, key: np.ndarray, own: np.ndarray, part: np.ndarray, cross: np.ndarray, copies: np.ndarray, x: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(copies of linked others, root position) of each row of whole groups; group numbers ascend.

    A pair counts in the first bucket where it meets and nowhere else; of two rows one at least is there as its own.
    Where cross is set, only pairs of different parts count. Memory holds one strip of a group's cosines at a time.
    """
    n = len(group)
    links, label = np.zeros(n, np.int64), np.arange(n)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    length = np.diff(np.r_[start, n])
    run = np.repeat(np.arange(len(start)), length)

    def take(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        ok = (own[i] | own[j]) & (~cross[i] | (part[i] != part[j]))
        i, j = i[ok], j[ok]
        for at in range(0, len(i), 50_000):
            p, q = i[at : at + 50_000], j[at : at + 50_000]
            rows, where = np.unique(np.r_[p, q], return_inverse=True)
            keys = bucket_keys(x[rows])
            one = _first_meeting(keys[where[: len(p)]], keys[where[len(p) :]]) == key[p]
            p, q = p[one], q[one]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            label = components_of(n, p, q, label)

    pairs = []
    for d in range(1, int(min(length.max(initial=0), SHORT_RUN + 1))):
        i = np.flatnonzero((run[d:] == run[:-d]) & (length[run[d:]] <= SHORT_RUN))
        i = i[np.einsum("ij,ij->i", x[i], x[i + d]) >= cosine]
        pairs.append((i, i + d))
    if pairs:
        take(*(np.concatenate(p) for p in zip(*pairs, strict=True)))
    for k in np.flatnonzero(length > SHORT_RUN).tolist():
        s, e = int(start[k]), int(start[k] + length[k])
        for at in range(s, e, 256):
            i, j = np.nonzero(x[at : min(e, at + 256)] @ x[s:e].T >= cosine)
            i, j = i + at, j + s
            take(i[i < j], j[i < j])
    return links, label


def _links(cosine: float):
    def done(rows: pa.Table) -> pa.RecordBatch:
        out = ([], [], [])
        rows = rows.combine_chunks()
        vectors = rows["vector"].combine_chunks() if rows.num_rows else rows["vector"]
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        col = {c: rows[c].to_numpy() for c in ("key", "lo", "hi", "own", "part", "rep", "copies", "group")}
        for at, x in _dims(vectors):
            c = {k: v[at] for k, v in col.items()}
            links, label = block_links(c["group"], c["key"], c["own"].astype(bool), c["part"], c["lo"] != c["hi"], c["copies"], _unit(x), cosine)
            some = np.flatnonzero(links)
            for o, v in zip(out, (c["rep"][some], links[some], c["rep"][label[some]]), strict=True):
                o.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(o) if o else np.empty(0, np.int64)) for o in out], names=["rep", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            if rest.num_rows < BLOCK_ROWS:
                continue
            n = rest.num_rows
            ids = [rest[c].to_numpy() for c in ("key", "dim", "lo", "hi")]
            new = np.zeros(n, bool)
            for c in ids:
                new[1:] |= c[1:] != c[:-1]
            cut = np.flatnonzero(new)
            if len(cut):
                whole = rest.slice(0, int(cut[-1])).append_column("group", pa.array(np.cumsum(new)[: cut[-1]]))
                yield done(whole)
                rest = rest.slice(int(cut[-1]))
        if rest is not None and rest.num_rows:
            new = np.zeros(rest.num_rows, bool)
            for c in (rest[c].to_numpy() for c in ("key", "dim", "lo", "hi")):
                new[1:] |= c[1:] != c[:-1]
            yield done(rest.append_column("group", pa.array(np.cumsum(new))))

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Equal vectors are one class: its smallest id stands for it and its copies are links without being expanded. Classes
    that share a bucket in some table are compared exactly, in double precision; classes count as many links as they have
    rows. Vectors that are null, empty, zero or hold null or non-finite components have no links and are kept. Vectors of
    different lengths never link. Repeated ids are rows of their own class; rows without id have no component and aren't
    kept. An empty table gives no rows.
    """
    small_batches(vectors.sparkSession)
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    good = usable(F.col("vector"))
    classes = materialize(
        v.where(good & F.col("id").isNotNull()).groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).select("rep", "copies", "vector"), "vector-classes"
    )
    sizes = classes.mapInArrow(_entry_keys, "key long, dim int").groupBy("key", "dim").count()
    big = materialize(sizes.where(F.col("count") > PART_ROWS).select("key", "dim", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("parts")), "vector-buckets")
    if big.count() <= BROADCAST_KEYS:
        big = F.broadcast(big)
    number = classes.schema["vector"].dataType.elementType.simpleString()
    entries = classes.mapInArrow(_entries, f"key long, dim int, own boolean, rep long, copies long, vector array<{number}>")
    parts = F.coalesce("parts", F.lit(1))
    dealt = entries.join(big, ["key", "dim"], "left").withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
    dealt = dealt.drop("parts", "other").repartition("key", "dim", "lo", "hi").sortWithinPartitions("key", "dim", "lo", "hi", "rep")
    found = materialize(dealt.mapInArrow(_links(cosine), "rep long, links long, root long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected_components(found.select("rep", "root"), lambda df: materialize(df, "vector-edges"))
    verdict = classes.select("rep", "copies", "vector").join(links, "rep", "left").join(component, F.col("rep") == F.col("node"), "left")
    verdict = verdict.select(F.col("vector").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    member = F.when(good & F.col("id").isNotNull(), F.col("vector"))
    out = v.withColumn("v", member).join(verdict, "v", "left")
    alone = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), alone.alias("component_id"), F.coalesce(F.col("id") == alone, F.lit(False)).alias("kept"))
