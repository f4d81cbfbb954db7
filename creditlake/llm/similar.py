"""Near-duplicates by SimHash: wide fingerprints of word shingles, cut into bands, propose pairs; whole shingle sets decide them.

At a Jaccard similarity of 0.8 two sets have a cosine of 8 / 9 at least, so each bit differs with probability
acos(8 / 9) / pi = 0.152. In 64 bits that is 9.7 of them on average, 18 and more are usual, and no table of so few shared
bits tells documents apart; hence the fingerprint has BITS bits here, and a limit of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import components_of, materialize, one_row_each, small_batches
from .simhash import SEED

#: Near-duplicates share at least 4 of 5 shingles of both together.
LEAST = (4, 5)
#: Bits of the fingerprint, bands of its bits that tables share, and bits of each band.
BITS, BANDS, ROWS = 512, 40, 12
#: Fingerprints meet at so many differing bits at most: at 0.8 the mean is 77.6 and the deviation 8.1, so this is six above;
#: unrelated ones differ by 256 +- 11.
MAX_BITS = 127
_RNG = np.random.default_rng(SEED)
_MASKS, _FACTORS = _RNG.integers(0, 1 << 64, (2, BITS // 64), np.uint64)
_FACTORS |= np.uint64(1)
#: The first bands are the fingerprint in order; then its bits are dealt out anew, again and again.
_BAND_BITS = np.concatenate([np.arange(BITS), *[_RNG.permutation(BITS) for _ in range(BANDS * ROWS // BITS)]])[: BANDS * ROWS]
#: Buckets up to this length are compared by shifting the sorted rows against themselves, longer ones row by row.
SHORT_RUN = 64
_CHUNK = 2048
#: A cell of a group that is compared in blocks holds so many shingles and nodes, or one node.
CELL_SHINGLES, CELL_ROWS = 1 << 17, 512
#: Shingles of so many sets of a block are counted by a matrix product.
_OFTEN = 16


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted different XXH64 hashes of the shingles of a whole text; words and short texts as for the fingerprint."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(x, SEED) for x in map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))], np.uint64))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """BITS // 64 words: a bit is 1 if set in over half of the hashes that each shingle has for the words."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), 255):
        h = (shingles[at : at + 255, None] ^ _MASKS) * _FACTORS
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        votes += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(shingles)).view(np.uint64)


def band_keys(words: np.ndarray) -> list[int]:
    """For each band its number and its bits of the fingerprint."""
    bits = np.unpackbits(words.view(np.uint8))[_BAND_BITS].reshape(BANDS, ROWS)
    return ((np.arange(BANDS) << ROWS) | (bits @ (1 << np.arange(ROWS)))).tolist()


def near_fingerprints(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j), fewer than rows, that span what is linked at MAX_BITS or fewer in one bucket of fingerprints."""
    n, label = len(fps), np.arange(len(fps))
    for i in range(n - 1):
        if i and label[i] == 0 and not label.any():
            break  # all are one component
        j = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]).sum(axis=1, dtype=np.int32) <= MAX_BITS) + i + 1
        j = j[label[j] != label[i]]
        if len(j):
            label = components_of(n, np.full(len(j), i), j, label)
    some = np.flatnonzero(label != np.arange(n))
    return label[some], some


def _proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of each bucket, from rows (key, node, fp) sorted by key; one bucket at most is held over."""

    def done(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        length = np.diff(cut)
        run = np.repeat(np.arange(len(length)), length)
        i, j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for d in range(1, int(min(length.max(), SHORT_RUN))):
            at = np.flatnonzero((run[d:] == run[:-d]) & (length[run[d:]] <= SHORT_RUN))
            at = at[np.bitwise_count(fps[at] ^ fps[at + d]).sum(axis=1, dtype=np.int32) <= MAX_BITS]
            i.append(at)
            j.append(at + d)
        label = components_of(len(keys), np.concatenate(i), np.concatenate(j))
        some = np.flatnonzero(label != np.arange(len(keys)))
        a, b = [nodes[label[some]]], [nodes[some]]
        for k in np.flatnonzero(length > SHORT_RUN):
            i, j = near_fingerprints(fps[cut[k] : cut[k + 1]])
            a.append(nodes[cut[k] + i])
            b.append(nodes[cut[k] + j])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    for x in batches:
        if not x.num_rows:
            continue
        keys, nodes = (x.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        fps = np.frombuffer(b"".join(x.column(2).to_pylist()), np.uint64).reshape(len(keys), -1)
        cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
        if cut or (held and held[-1][0][-1] != keys[-1]):
            yield done(*(np.concatenate(c) for c in zip(*held, (keys[:cut], nodes[:cut], fps[:cut]), strict=True)))
            held = []
        held.append((keys[cut:], nodes[cut:], fps[cut:]))
    if held:
        yield done(*(np.concatenate(c) for c in zip(*held, strict=True)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets have a Jaccard similarity of at least LEAST; two empty ones have."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= (len(a) + len(b) - both) * LEAST[0]


def _each(docs: DataFrame, width: int, row, schema: str) -> DataFrame:
    """One row of (id, *row(shingle set)) for each (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*(row(shingle_set(x.as_py(), width)) for x in b.column(1)), strict=True)) or [()] * len(row(np.empty(0, np.uint64)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["id", *names])

    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[x.split()[1]] for x in schema.split(", ")]
    return docs.mapInArrow(run, f"id long, {schema}")


def _node(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def _signature(shingles: np.ndarray) -> tuple[int, int, bytes, list[int]]:
    words = wide_fingerprint(shingles)
    return _node(shingles), len(shingles), words.tobytes(), band_keys(words)


def _whole(shingles: np.ndarray) -> tuple[int, bytes]:
    return _node(shingles), shingles.tobytes()


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = ([np.frombuffer(x.as_py(), np.uint64) for x in b.column(k)] for k in (2, 3))
        yield b.select([0, 1]).filter(pa.array([similar(x, y) for x, y in zip(*sets, strict=True)], pa.bool_()))


def linked_sets(sets: list[np.ndarray], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of the similar ones among shingle sets; where both sides occur, only of different sides.

    Shingles of many sets are counted by a matrix product, those of few by their pairs, those of one not at all."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    row = np.repeat(np.arange(n), sizes)
    _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = np.zeros((n, n), np.float32 if sizes.max(initial=0) < 1 << 24 else np.float64)
    often = np.cumsum(df >= _OFTEN) - 1
    here = df[code] >= _OFTEN
    column, of = often[code[here]], row[here]
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, _CHUNK):
        lo, hi = np.searchsorted(column, [at, at + _CHUNK])
        m = np.zeros((n, _CHUNK), both.dtype)
        m[of[lo:hi], column[lo:hi] - at] = 1
        both += m @ m.T
    here = (df[code] > 1) & ~here
    order = np.argsort(code[here], kind="stable")
    code, row = code[here][order], row[here][order]
    keys = [np.empty(0, np.int64)]
    for d in range(1, _OFTEN - 1):
        k = np.flatnonzero(code[d:] == code[:-d])
        if not len(k):
            break
        keys.append(row[k] * n + row[k + d])
    few = np.bincount(np.concatenate(keys), minlength=n * n).reshape(n, n)
    both += few + few.T
    ok = both * (LEAST[0] + LEAST[1]) >= (sizes[:, None] + sizes[None]) * LEAST[0]
    if len(np.unique(side)) > 1:
        ok &= side[:, None] != side[None]
    return np.nonzero(np.triu(ok, 1))


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that span what is linked within each block, from rows (block..., side, node, shingles) sorted by block."""

    def done() -> pa.RecordBatch:
        nodes = np.array([x[1] for x in held], np.int64)
        label = components_of(len(held), *linked_sets([np.frombuffer(x[2], np.uint64) for x in held], np.array([x[0] for x in held])))
        some = np.flatnonzero(label != np.arange(len(held)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[label[some]]), pa.array(nodes[some])], names=["a", "b"])

    block, held = None, []
    for b in batches:
        for *at, side, node, shingles in zip(*(b.column(k) for k in range(b.num_columns)), strict=True):
            at = [x.as_py() for x in at]
            if at != block and held:
                yield done()
                held = []
            block = at
            held.append((side.as_py(), node.as_py(), shingles.as_py()))
    if held:
        yield done()


def _sets(pairs: DataFrame, texts: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the nodes in pairs, whose texts alone are hashed for it."""
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    ids = reps.join(ends, "node").select("id").distinct()
    sets = _each(texts.join(ids, "id", "left_semi"), width, _whole, "node long, shingles binary").select("node", "shingles").dropDuplicates(["node"])
    return materialize(sets.join(ends, "node", "left_semi"), "similar-sets")


def _rest(reps: DataFrame, sets: DataFrame, linked: DataFrame, met: DataFrame) -> DataFrame:
    """Edges (a, b) that span the links within each group of met nodes that `linked` leaves in several components.

    A node meets those of its group whose sizes allow the similarity: a group is cut by size into bands, which link with
    themselves and the next one, and a band into cells of bounded weight. A block holds two cells; blocks of cells that are
    linked already are left out. Links alone leave a block, never its pairs."""
    place = reps.select("node", "size").join(met, "node", "left").join(linked, "node", "left")
    place = place.select("node", "size", F.coalesce("g", "node").alias("g"), F.coalesce("c", "node").alias("c"))
    # Two nodes that met are held against each other already.
    open_ = place.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo < hi AND n > 2").select("g")
    place = materialize(place.join(open_, "g").withColumn("band", F.floor(F.log(F.greatest("size", F.lit(1))) / F.log(F.lit(1.26))).cast("int")), "similar-open")
    cells = F.greatest(F.ceil(F.sum("size") / CELL_SHINGLES), F.ceil(F.count("*") / CELL_ROWS))
    weights = place.groupBy("g", "band").agg(cells.cast("int").alias("cells"))
    dealt = place.join(weights, ["g", "band"]).select("node", "g", "band", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int").alias("cell"), "c")
    dealt = materialize(dealt.join(sets, "node"), "similar-dealt")
    each = dealt.groupBy("g", "band", "cell").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    x = each.select("g", "band", "cell", "lo", "hi", F.explode(F.array("band", F.col("band") + 1)).alias("band_y"))
    y = each.select("g", F.col("band").alias("band_y"), F.col("cell").alias("cell_y"), F.col("lo").alias("lo_y"), F.col("hi").alias("hi_y"))
    solved = (F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("lo_y")) & (F.col("lo") == F.col("hi_y"))
    blocks = materialize(x.join(y, ["g", "band_y"]).where(((F.col("band") < F.col("band_y")) | (F.col("cell") <= F.col("cell_y"))) & ~solved).select("g", "band", "cell", "band_y", "cell_y"), "similar-blocks")
    key = ["g", "band", "cell", "band_y", "cell_y"]
    own = dealt.drop("c").join(blocks, ["g", "band", "cell"]).select(*key, F.lit(0).alias("side"), "node", "shingles")
    other = dealt.select("g", F.col("band").alias("band_y"), F.col("cell").alias("cell_y"), "node", "shingles").join(blocks.where("band < band_y OR cell < cell_y"), ["g", "band_y", "cell_y"])
    rows = own.unionAll(other.select(*key, F.lit(1).alias("side"), "node", "shingles"))
    return materialize(rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(_block_links, "a long, b long"), "similar-rest")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(id, component_id) for each different id: the smallest id that is reachable through documents whose sets of
    `width`-word shingles have a Jaccard similarity of at least 0.8. Null ids have no row; empty texts are alike.

    Equal sets are one node. In each band's bucket the fingerprints that differ by MAX_BITS or fewer meet, through edges
    that span them. What those meetings connect, similar or not, holds every such pair of a bucket; where its links leave
    several components, all its nodes are compared in blocks, of which only links come out.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    signed = materialize(_each(texts, width, _signature, "node long, size long, fp binary, bands array<long>"), "similar-signatures")
    reps = materialize(signed.groupBy("node").agg(F.min("id").alias("id"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "similar-nodes")
    spread = reps.select(F.explode("bands").alias("key"), "node", "fp").repartition("key").sortWithinPartitions("key")

    def save(df: DataFrame) -> DataFrame:
        return materialize(df, "similar-edges")

    first = save(spread.mapInArrow(_proposed, "a long, b long").distinct())
    sets = _sets(first, texts, reps, width)
    both = first.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    links = materialize(both.select("a", "b", "x", "y").mapInArrow(_decide, "a long, b long"), "similar-links")
    linked = connected_components(links, save).withColumnRenamed("component", "c")
    met = connected_components(first, save).withColumnRenamed("component", "g")
    links = links.unionAll(_rest(reps, sets, linked, met))
    ids = reps.select("node", "id")
    edges = links.join(ids.select(F.col("node").alias("a"), F.col("id").alias("x")), "a").join(ids.select(F.col("node").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    # A repeated id, or equal sets under more ids, joins what it stands for.
    copies = signed.join(ids.withColumnRenamed("id", "rep"), "node").select(F.col("id").alias("x"), F.col("rep").alias("y")).where("x <> y")
    found = connected_components(edges.unionAll(copies), save)
    out = signed.select("id").distinct().join(found, F.col("id") == F.col("node"), "left")
    return out.select("id", F.coalesce("component", "id").alias("component_id"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """The rows of docs, one for each group of near-duplicates: that with the smallest id. All rows of one id are one group;
    of those with the smallest id the one with the least text hash stays, then the least text, so reruns agree.
    Rows with a null id are all kept. Any other columns are kept, whatever their names."""
    gone = groups(docs, id_col, text_col, width).where("id > component_id").select(F.col("id").alias(id_col))
    return one_row_each(docs, gone, id_col, text_col)
