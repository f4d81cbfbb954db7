"""SimHash near-duplicates: 64-bit votes of hashed word shingles, linked through pigeonhole blocks of the fingerprint."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import components_of, materialize, one_row_each, small_batches

SEED = 42
#: The fingerprint is cut into six blocks. Two changed bits touch two blocks at most, so linked fingerprints share four:
#: 15 tables, one for each choice of four. The two free blocks have 22 bits at most, so a bucket holds 2^22 different
#: fingerprints at most (32 MB) however the data are skewed; copies share a fingerprint and count once.
BLOCKS = (11, 11, 11, 11, 10, 10)
FREE = 2
MAX_BITS = 2
#: Runs up to this length are compared by shifting the sorted bucket against itself, longer ones by flipping bits.
SHORT_RUN = 48
_CHUNK = 1 << 18


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned SimHash of a whole text: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, shingles of `width` words with
    repeats (the whole sequence if it is shorter), XXH64 with seed 42; a bit is 1 if set in over half of the hashes.
    No words (also null): 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    n = len(words) - width + 1
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, _CHUNK):
        part = words[at : min(n, at + _CHUNK) + width - 1]
        hashes = b"".join([digest(x, SEED) for x in map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False))])
        votes += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): fp is the signed 64-bit pattern of the fingerprint of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), width) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, fp long")


def _tables() -> list[tuple[int, list[int]]]:
    """For each table the mask of its shared bits, and the flips of one or two of its free bits."""
    ends = np.cumsum(BLOCKS).tolist()
    bits = [list(range(e - n, e)) for e, n in zip(ends, BLOCKS, strict=True)]
    out = []
    for free in combinations(range(len(BLOCKS)), FREE):
        loose = [b for k in free for b in bits[k]]
        flips = [sum(1 << b for b in c) for k in range(1, MAX_BITS + 1) for c in combinations(loose, k)]
        out.append((~sum(1 << b for b in loose) & (1 << 64) - 1, flips))
    return out


TABLES = _tables()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_links(table: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and a smaller linked position for each, over whole buckets sorted by table and shared bits.

    The edges span every component of each bucket; their number is below that of the rows, however dense the links are.
    """
    masks = np.array([m for m, _ in TABLES], np.uint64)
    shared = fps & masks[table]
    first = np.r_[True, (table[1:] != table[:-1]) | (shared[1:] != shared[:-1])]
    run = np.cumsum(first) - 1
    start = np.flatnonzero(first)
    length = np.diff(np.r_[start, len(fps)])
    i, j = [], []
    for d in range(1, int(min(length.max(), SHORT_RUN))):
        at = np.flatnonzero((run[d:] == run[:-d]) & (length[run[d:]] <= SHORT_RUN))
        at = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= MAX_BITS]
        i.append(at)
        j.append(at + d)
    label = components_of(len(fps), np.concatenate(i or [np.empty(0, int)]), np.concatenate(j or [np.empty(0, int)]))
    for k in np.flatnonzero(length > SHORT_RUN):
        s, n = int(start[k]), int(length[k])
        order = np.argsort(fps[s : s + n], kind="stable")
        own, lab = fps[s : s + n][order], np.arange(n)
        for flip in TABLES[int(table[s])][1]:
            to = own ^ np.uint64(flip)
            at = np.minimum(np.searchsorted(own, to), n - 1)
            hit = np.flatnonzero(own[at] == to)
            lab = components_of(n, hit, at[hit], lab)
        label[s + order] = s + order[lab]
    node = np.flatnonzero(label != np.arange(len(fps)))
    return node, label[node]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between the representatives of linked fingerprints, from rows sorted by table and bucket key.

    One bucket at most is held over from batch to batch, as a list of pieces that is joined once when the bucket ends."""

    def done(pieces: list[list[np.ndarray]]) -> pa.RecordBatch:
        table, _, fps, reps = (np.concatenate(x) for x in zip(*pieces, strict=True))
        node, to = bucket_links(table, fps.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(reps[node]), pa.array(reps[to])], names=["a", "b"])

    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        now = [b.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        last = (now[0][-1], now[1][-1])
        cut = int(np.argmax((now[0] == last[0]) & (now[1] == last[1])))  # the last bucket may go on in the next batch
        if cut or (held and last != (held[-1][0][-1], held[-1][1][-1])):
            yield done([*held, [x[:cut] for x in now]])
            held = []
        held.append([x[cut:] for x in now])
    if held:
        yield done(held)


def linked(fingerprints: DataFrame) -> DataFrame:
    """(id, fp, component_id) for each row of (id long, fp long): component_id is the smallest id that is reachable
    through fingerprints which differ in 2 bits or fewer, itself included. Rows with a null id link with nothing and have
    a null component_id. Repeated ids are one node for each of their fingerprints, so those fingerprints are joined."""
    reps = materialize(fingerprints.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep")), "simhash-reps")
    spread = reps.select("rep", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m, _ in TABLES])).alias("table", "key"))
    edges = (
        spread.select("table", "key", "fp", "rep")
        .repartition("table", "key")
        .sortWithinPartitions("table", "key")
        .mapInArrow(_links, "a long, b long")
    )
    found = connected_components(edges, lambda df: materialize(df, "simhash-edges"))
    found = reps.join(found, reps["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = fingerprints.join(found, "fp", "left")
    return out.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of docs; fingerprint has 16 lower-case hex digits.

    Null and empty texts have fingerprint zero and are linked like any other. An empty table gives no rows. Columns
    other than the two named are not read, so clashing names do no harm.
    """
    fps = materialize(with_fingerprint(docs, id_col, text_col, width).withColumn("id", F.col("id").cast("long")), "simhash-fps")
    return linked(fps).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """The rows of docs, one for each group of near-duplicates: that with the smallest id. All rows of one id are one group;
    of those with the smallest id the one with the least text hash stays, then the least text, so reruns agree. Rows with a
    null id are all kept, and any other columns, whatever their names."""
    gone = near_duplicates(docs, id_col, text_col, width).where(F.col(id_col) > F.col("component_id")).select(F.col(id_col)).distinct()
    return one_row_each(docs, gone, id_col, text_col)
