"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard, kept as flat arrays."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import spread
from .common import filesystem, materialize, shared_dir
from .near_vectors import usable

#: Vectors of a shard and queries of a block; a task holds one of each, whatever the table's size, and reads so many graphs.
#: Measured on one core, 64 dimensions, a search of 8192 / 16384 / 32768 rows takes 3.3 / 3.6 / 4.1 ms, so large shards answer
#: more rows for the same time; building a row takes 0.17 / 0.29 / 0.57 ms, and such a graph 31 MB.
SHARD_ROWS, QUERY_ROWS, RUN_GRAPHS, MOST_TASKS = 32_768, 512, 32, 1 << 17
#: Neighbours of a node (twice as many on the ground level), candidates for them, and the beam of a search.
LINKS, CANDIDATES, BEAM, STEP = 20, 64, 160, 4


def _levels(ids: np.ndarray, seed: int) -> np.ndarray:
    """Seeded geometric levels: each level has one in LINKS of the one below."""
    z = ids.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53
    return np.floor(-np.log(np.maximum(u, 2.0**-53)) / np.log(LINKS)).astype(int)


def _sphere(x: np.ndarray) -> np.ndarray:
    """One more component brings all rows to one length, so that order by inner product is order by distance."""
    square = (x**2).sum(axis=1)
    most = square.max(initial=0) or 1.0
    return np.concatenate([x, np.sqrt(np.maximum(most - square, 0))[:, None]], axis=1).astype(np.float32) / np.float32(np.sqrt(most))


def _neighbours(a: np.ndarray, most: int) -> np.ndarray:
    """(n, most) positions, -1 filled: for each row diverse near rows, chosen from its exact nearest, and reverse links.

    A candidate is taken if it is nearer to the row than to any taken before; room left goes to the nearest others."""
    n = len(a)
    out = np.full((n, most), -1, np.int32)
    c = min(CANDIDATES, n - 1)
    if c < 1:
        return out
    half = min(most // 2, c)
    src, dst, sim = [], [], []
    for at in range(0, n, 256):
        s = a[at : at + 256] @ a.T
        b = len(s)
        s[np.arange(b), at + np.arange(b)] = -np.inf
        cand = np.argpartition(-s, c - 1, axis=1)[:, :c]
        near = np.take_along_axis(s, cand, axis=1)
        order = np.argsort(-near, axis=1, kind="stable")
        cand, near = np.take_along_axis(cand, order, axis=1), np.take_along_axis(near, order, axis=1)
        between = np.matmul(a[cand], a[cand].transpose(0, 2, 1))
        keep = np.zeros((b, c), bool)
        for t in range(c):
            keep[:, t] = (~keep[:, :t] | (between[:, t, :t] < near[:, t, None])).all(axis=1) & (keep[:, :t].sum(axis=1) < half)
        rank = np.argsort(np.where(keep, 0, c) + np.arange(c), axis=1, kind="stable")[:, :half]
        src.append(np.repeat(np.arange(at, at + b), half))
        dst.append(np.take_along_axis(cand, rank, axis=1).reshape(-1))
        sim.append(np.take_along_axis(near, rank, axis=1).reshape(-1))
    i, j, s = (np.concatenate(x) for x in (src, dst, sim))
    back = np.r_[np.zeros(len(i), bool), np.ones(len(i), bool)]
    i, j, s = np.r_[i, j], np.r_[j, i], np.r_[s, s]
    _, once = np.unique(i.astype(np.int64) * n + j, return_index=True)  # own links come first and so stay
    i, j, s, back = i[once], j[once], s[once], back[once]
    order = np.lexsort((-s, back, i))
    i, j = i[order], j[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    ok = nth < most
    out[i[ok], nth[ok]] = j[ok]
    return out


class Graph:
    """Layers of flat neighbour arrays over the rows of one shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, seed: int = 1):
        self.ids, self.x = ids, x
        self.a = _sphere(x)
        level = _levels(ids, seed)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(int(level.max(initial=0)) + 1):
            rows = np.flatnonzero(level >= k)
            self.layers.append((rows, _neighbours(self.a[rows], 2 * LINKS if k == 0 else LINKS)))

    def search(self, q: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """(queries, beam) rows by falling inner product, -1 filled. All queries take each step at the same time."""
        n, count = len(self.ids), len(q)
        q = np.concatenate([q, np.zeros((count, 1))], axis=1).astype(np.float32)
        rows, _ = self.layers[-1]
        at = np.full(count, rows[0])
        for rows, links in self.layers[:0:-1]:
            local = np.searchsorted(rows, at)
            best = np.einsum("ij,ij->i", self.a[rows[local]], q)
            going = np.arange(count)
            while len(going):
                near = links[local[going]]
                s = np.where(near >= 0, np.einsum("ijk,ik->ij", self.a[rows[near]], q[going]), -np.inf)
                top = s.argmax(axis=1)
                new = s[np.arange(len(going)), top]
                up = new > best[going]
                going, top, near, new = going[up], top[up], near[up], new[up]
                best[going], local[going] = new, near[np.arange(len(going)), top]
            at = rows[local]
        links = self.layers[0][1]
        found, sims, spent = np.full((count, beam), -1, np.int64), np.full((count, beam), -np.inf, np.float32), np.ones((count, beam), bool)
        found[:, 0], sims[:, 0], spent[:, 0] = at, np.einsum("ij,ij->i", self.a[at], q), False
        seen = np.zeros((count, n), bool)
        seen[np.arange(count), at] = True
        live = np.arange(count)
        while len(live):
            open_ = np.where(spent[live], -np.inf, sims[live])
            pick = np.argpartition(-open_, STEP - 1, axis=1)[:, :STEP] if beam > STEP else np.argsort(-open_, axis=1)
            some = np.take_along_axis(open_, pick, axis=1) > -np.inf
            go = some.any(axis=1)
            live, pick, some = live[go], pick[go], some[go]
            if not len(live):
                break
            spent[live[:, None], pick] |= some
            near = np.where(some[:, :, None], links[np.maximum(found[live[:, None], pick], 0)], -1).reshape(len(live), -1)
            r, c = np.nonzero(near >= 0)
            key = np.unique(r * np.int64(n) + near[r, c])
            r, v = key // n, key % n
            new = ~seen[live[r], v]
            r, v = r[new], v[new]
            seen[live[r], v] = True
            s = np.einsum("ij,ij->i", self.a[v], q[live[r]])
            nth = np.arange(len(r)) - np.searchsorted(r, r)
            width = int(nth.max(initial=-1)) + 1
            if not width:
                continue
            f2, s2, p2 = np.full((len(live), width), -1, np.int64), np.full((len(live), width), -np.inf, np.float32), np.ones((len(live), width), bool)
            f2[r, nth], s2[r, nth], p2[r, nth] = v, s, False
            f2, s2, p2 = (np.concatenate([x[live], y], axis=1) for x, y in ((found, f2), (sims, s2), (spent, p2)))
            top = np.argpartition(-s2, beam - 1, axis=1)[:, :beam]
            found[live], sims[live], spent[live] = (np.take_along_axis(y, top, axis=1) for y in (f2, s2, p2))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(found, order, axis=1)

    def save(self, uri: str, members: list[np.ndarray]) -> None:
        """Write the graph as one file of flat arrays, with the ids that each row stands for."""
        arrays = {"ids": self.ids, "x": self.x, "ends": np.cumsum([len(m) for m in members]), "members": np.concatenate(members)}
        for k, (rows, links) in enumerate(self.layers):
            arrays |= {f"rows{k}": rows, f"links{k}": links}
        _store(uri, arrays)

    @classmethod
    def load(cls, uri: str) -> tuple[Graph, np.ndarray, np.ndarray]:
        """(graph, ends, members): row r stands for members[ends[r - 1] : ends[r]]."""
        z, g = _fetch(uri), cls.__new__(cls)
        g.ids, g.x, g.a = z["ids"], z["x"], _sphere(z["x"])
        g.layers = [(z[f"rows{k}"], z[f"links{k}"]) for k in range(sum(n.startswith("rows") for n in z))]
        return g, z["ends"], z["members"]


def _store(uri: str, arrays: dict[str, np.ndarray]) -> None:
    out = io.BytesIO()
    np.savez(out, **arrays)
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as f:
        f.write(out.getvalue())


def _fetch(uri: str) -> dict[str, np.ndarray]:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        with np.load(io.BytesIO(f.read()), allow_pickle=False) as z:
            return {n: z[n] for n in z.files}


def build_index(vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(dim, shard, uri), a row per shard; the graphs are files in the shared folder. Every usable row is indexed.

    Equal vectors are one node with its k + 1 smallest different ids, which is all that a search for k can return; they are
    chosen in each task before any shuffle. Nodes are dealt to shards by a hash, so no shard outgrows the others. A graph's
    links come from the exact products of its shard's rows, not by inserting one row after the other: shard_rows products a
    row whatever the table's size, in matrix blocks, and no link hangs on an order of insertion.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(usable(F.col("vector")) & F.col("id").isNotNull())
    first = v.withColumn("nth", F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("nth") <= k + 1)
    nodes = materialize(first.groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("members")).select(F.col("members")[0].alias("rep"), "members", "vector"), "ann-nodes")
    shards = max(1, -(-nodes.count() // shard_rows))
    folder = shared_dir(spark, "ann-graphs")

    def build(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rep")
        # A name of its own for each attempt: the index names files of finished tasks alone.
        uri = f"{folder}/{key[0]}-{key[1]}-{uuid.uuid4().hex}.npz"
        Graph(f["rep"].to_numpy(), np.array(list(f["vector"]), float)).save(uri, [np.asarray(m, np.int64) for m in f["members"]])
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "uri": [uri]})

    dealt = nodes.withColumn("dim", F.size("vector")).withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"))
    return materialize(dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, uri string"), "ann-index")


def _best(rows: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k best (query, vec, score) of each query, ties to the smaller vec; a vec counts once, by its best score."""
    q, vec, score = rows
    order = np.lexsort((-score, vec, q))
    q, vec, score = q[order], vec[order], score[order]
    once = np.ones(len(q), bool)
    once[1:] = (q[1:] != q[:-1]) | (vec[1:] != vec[:-1])
    q, vec, score = q[once], vec[once], score[once]
    order = np.lexsort((vec, -score, q))
    q, vec, score = q[order], vec[order], score[order]
    top = np.arange(len(q)) - np.searchsorted(q, q) < k
    return [q[top], vec[top], score[top]]


def graph_answers(loaded: tuple[Graph, np.ndarray, np.ndarray], qid: np.ndarray, q: np.ndarray, k: int) -> list[np.ndarray]:
    """(query, vec, score) of the k best that each query finds in one graph, itself excepted. Rows stand for all their ids
    before anything is cut, and rows that tie with the last one stay until ids are compared."""
    g, ends, members = loaded
    out: list[list[np.ndarray]] = []
    for at in range(0, len(qid), 256):
        own, part = qid[at : at + 256], q[at : at + 256]
        found = g.search(part, max(1, min(max(BEAM, 2 * (k + 1)), len(g.ids))))
        score = np.where(found >= 0, (g.x[np.maximum(found, 0)] * part[:, None, :]).sum(axis=2), -np.inf)
        last = np.partition(-score, min(k, score.shape[1] - 1), axis=1)[:, min(k, score.shape[1] - 1)]
        r, c = np.nonzero((found >= 0) & (score >= -last[:, None]))
        node, s = found[r, c], score[r, c]
        n = np.diff(ends, prepend=0)
        vec, count = spread(members, n, node)
        who, s = np.repeat(own[r], count), np.repeat(s, count)
        other = vec != who
        out.append(_best([who[other], vec[other], s[other]], k))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _answers(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for queries, graphs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                block = _fetch(queries)
                best = None
                for uri in graphs:
                    now = graph_answers(Graph.load(uri), block["ids"], block["vectors"], k)
                    best = now if best is None else _best([np.concatenate(x) for x in zip(best, now, strict=True)], k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest that each query row finds, itself excepted, over all shards.

    Queries are packed into files of a block each. A task holds one block and reads a run of graphs one after the other,
    merging as it goes; only URIs are dealt out, and k answers a query leave each task. The answers of the runs are merged
    by score and then smaller id.
    """
    spark = queries.sparkSession
    q = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(usable(F.col("vector")) & F.col("id").isNotNull())
    blocks = max(1, -(-q.count() // QUERY_ROWS))
    folder = shared_dir(spark, "ann-queries")

    def pack(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        uri = f"{folder}/{key[0]}-{key[1]}-{uuid.uuid4().hex}.npz"
        _store(uri, {"ids": f["id"].to_numpy(), "vectors": np.array(list(f["vector"]), float)})
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "queries": [uri]})

    dealt = q.withColumn("dim", F.size("vector")).withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int"))
    packed = materialize(dealt.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, queries string"), "ann-queries")
    runs = index.groupBy("dim", F.floor(F.col("shard") / RUN_GRAPHS).alias("run")).agg(F.sort_array(F.collect_list("uri")).alias("graphs"))
    met = materialize(packed.join(runs, "dim"), "ann-meetings")
    # One meeting a task: a given number of partitions, which AQE doesn't merge though the rows are small.
    met = met.repartitionByRange(max(1, min(met.count(), MOST_TASKS)), "dim", "block", "run")
    found = materialize(met.select("queries", "graphs").mapInArrow(_answers(k), "query_id long, vec_id long, score double"), "ann-found")
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Search the table for its own rows whose id is divisible by `every`.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without id. Vectors
    of other lengths are no candidates. Repeated rows count once. A query id that repeats with different vectors is answered
    for all of them as one, and a candidate that does, by its best score. An empty table gives no rows; fewer candidates
    than k give fewer rows. Other columns aren't read.
    """
    index = build_index(vectors, k, id_col, vector_col, shard_rows)
    return search(index, vectors.where(F.col(id_col) % every == 0), k, id_col, vector_col)
