"""Token ids in binary files: frequency-ranked ids in byte-aligned variable-length coding with control bytes apart."""

from __future__ import annotations

import gc
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import Known, blocks, chunked, per_text, spread
from .common import discard, filesystem, materialize, shared_dir, small_batches

MAGIC = b"RKSV1\0\0\0"
#: Values of 1 to 4 bytes, little-endian; four 2-bit lengths (less one) to a control byte, the first value's lowest.
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
_SUMS = _LENGTHS.sum(axis=1)
#: An encoded file has so many tokens at most, unless one document has more; a write task holds one such block.
FILE_TOKENS = 8 << 20
DOC_TOKENS_PER_PARTITION = 4 << 20


def encode_stream(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    used = np.arange(4) < size[:, None]
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_stream(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values again: lengths come from a table of 256 control bytes, data bytes are gathered at their sums."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    start = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    out = np.zeros(n, np.uint32)
    for k in range(4):
        at = size > k
        out[at] |= raw[start[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack(doc_ids: list[int | None], ids: list[np.ndarray], rank: np.ndarray) -> bytes:
    """A file: header, table of documents (id, null flag, tokens), control bytes, data bytes of the ids' ranks."""
    counts = np.array([len(x) for x in ids], "<i8")
    control, data = encode_stream(rank[np.concatenate(ids)] if len(ids) else np.empty(0, np.uint32))
    table = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes() + counts.tobytes()
    return MAGIC + struct.pack("<QQQQ", len(ids), int(counts.sum()), len(control), len(data)) + table + control + data


def unpack(raw: bytes, by_rank: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a file, in order."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, tokens, n_control, n_data = struct.unpack_from("<QQQQ", raw, 8)
    at = 40
    doc_ids = np.frombuffer(raw, "<i8", docs, at)
    null = np.frombuffer(raw, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(raw, "<i8", docs, at + 9 * docs)
    at += 17 * docs
    ids = by_rank[decode_stream(raw[at : at + n_control], raw[at + n_control : at + n_control + n_data], tokens)]
    ends = np.cumsum(counts)
    for d, z, n, e in zip(doc_ids.tolist(), null.tolist(), counts.tolist(), ends.tolist(), strict=True):
        yield None if z else d, ids[e - n : e]


#: Chunks of these characters are in normal form and have one lower case; in them the tokenizer's word pattern is _WORD.
_PLAIN = re.compile("[!-~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]*")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")
#: A chunk of letters and one of these is those two words.
_STOPS = frozenset(".,;:!?)")


class ChunkEncoder:
    """The tokenizers library over whole texts, each text cut at ASCII white space first.

    The cut changes no id for a tokenizer that drops white space and never joins over it, as word_bpe_49k.json, and lets
    frequent chunks be encoded once. With that tokenizer's word pattern, words of plain chunks go straight to the library's
    model and are kept too; all other chunks pass the whole library. Other tokenizers get whole texts (cut=False).
    """

    def __init__(self, path: str, cut: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cut, self.known, self.words = Tokenizer.from_file(path), cut, Known(self._new), Known(self._new_words)
        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b > 173]  # byte-level: these show as themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: 256 + k for k, b in enumerate(hidden)}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters_only = not any(t.isascii() and t.isalpha() for t in self.special)

    def _all(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, chunks: list[str]) -> list[bytes]:
        # A chunk of ASCII letters is one word. Of the rest, plain ones are cut into words and others pass the whole library.
        cut: list = [c.lower() if self.letters_only and c.isascii() and c.isalpha() else None for c in chunks]
        rest = [k for k, w in enumerate(cut) if w is None]
        joined = "\n".join([chunks[k] for k in rest])
        special = [t for t in self.special if t in joined]
        for k in rest:
            c = chunks[k]
            if c[-1] in _STOPS and c[:-1].isascii() and c[:-1].isalpha() and not special:
                cut[k] = (c[:-1].lower(), c[-1])
            elif (c.isascii() and c.isprintable() or _PLAIN.fullmatch(c)) and not (special and any(t in c for t in special)):
                cut[k] = _WORD.findall(c.lower())
        whole = iter(self._all([chunks[k] for k in rest if cut[k] is None]))
        words = {w for w in cut if type(w) is str}
        for k in rest:
            words.update(cut[k] or ())
        known = self.words.all(list(words))
        for k in rest:
            cut[k] = np.array(next(whole), "<u4").tobytes() if cut[k] is None else b"".join([known[w] for w in cut[k]])
        return [known[w] if type(w) is str else w for w in cut]

    def _new_words(self, words: list[str]) -> list[bytes]:
        one, letters = self.tokenizer.model.tokenize, self.letters
        shown = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(letters) for w in words]
        return [array("I", [t.id for t in one(w)]).tobytes() for w in shown]

    def __call__(self, texts: pa.Array, end: int | None) -> list[np.ndarray]:
        if self.cut:
            count, codes, different = chunked(texts)
            values, lengths = self.known(different, "<u4")
            ids, n = spread(values, lengths, codes)
            out = np.split(ids, np.cumsum(per_text(count, n))[:-1]) if len(count) else []
        else:
            out = [np.array(x, "<u4") for x in self._all([x or "" for x in texts.to_pylist()])]
        return out if end is None else [np.append(x, np.uint32(end)) for x in out]


@lru_cache(maxsize=2)
def _encoder(path: str, cut: bool) -> ChunkEncoder:
    gc.set_threshold(200_000)  # the kept chunks hold no cycles, and looking through them costs a twentieth of the time
    return ChunkEncoder(path, cut)


def id_kind(vocab: int) -> str:
    """Ids between the steps take two bytes where the vocabulary allows it."""
    return "<u2" if vocab <= 1 << 16 else "<u4"


def token_table(docs: DataFrame, tokenizer: str, vocab: int, end: int | None = 1, cut: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) for each row; ids little-endian unsigned, as wide as id_kind(vocab). Null text: empty."""
    kind = id_kind(vocab)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer, cut)
        for b in (x for y in batches for x in blocks(y, 1)):
            ids = enc(b.column(1), end)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def ranks(tokens: DataFrame, vocab: int) -> np.ndarray:
    """ids by falling frequency over all documents, ties by id: by_rank[r] is an id. vocab bounds what the driver gets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(vocab, np.int64)
        for b in batches:
            if b.num_rows:
                n += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), id_kind(vocab)), minlength=vocab)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["id", "n"])

    freq = np.zeros(vocab, np.int64)
    for r in tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        freq[r["id"]] = r["n"]
    return np.argsort(-freq, kind="stable").astype(np.uint32)


def write_token_files(tokens: DataFrame, by_rank: np.ndarray, folder: str) -> DataFrame:
    """Write files in ascending doc_id order (nulls first) and return their index (part, file, docs, tokens), stored in
    the shared folder. part and the order within it give the global order. Names are new for each attempt at a task, and
    only those in the index count."""
    spark = tokens.sparkSession
    rank = np.empty(len(by_rank), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    kind = id_kind(len(by_rank))
    shared = spark.sparkContext.broadcast(rank)  # as long as the vocabulary
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(2 * spark.sparkContext.defaultParallelism, total // DOC_TOKENS_PER_PARTITION + 1)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        doc_ids, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"{folder}/{part:08d}-{at:06d}-{uuid.uuid4().hex}.tok"
            fs, path = filesystem(name)
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(path, compression=None) as f:
                f.write(pack(doc_ids, ids, shared.value))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in (([part], pa.int32()), ([at], pa.int32()), ([name], pa.string()), ([len(ids)], pa.int64()), ([held], pa.int64()))], names=["part", "nth", "file", "docs", "tokens"])

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc_ids.append(d)
                ids.append(np.frombuffer(x.as_buffer(), kind))
                held += len(ids[-1])
                if held >= FILE_TOKENS:
                    yield flush()
                    at, doc_ids, ids, held = at + 1, [], [], 0
        if ids:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.col("n_tokens"), F.xxhash64("ids")]
    dealt = tokens.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).select("doc_id", "ids")
    return materialize(dealt.mapInArrow(write, "part int, nth int, file string, docs long, tokens long"), "token-index")


def read_token_files(index: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files: start counts the ids of all documents before."""
    shared = index.sparkSession.sparkContext.broadcast(by_rank)
    # One row per file, each of millions of tokens: sums over a few parts of the parts first, then within each part.
    w = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    inside = index.withColumn("in_part", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    sums = index.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = sums.withColumn("before", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    files = inside.join(before.select("part", "before"), "part").select("file", (F.col("before") + F.col("in_part")).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, path = filesystem(name)
                with fs.open_input_file(path) as f:
                    raw = f.read()
                rows = []
                for doc_id, ids in unpack(raw, shared.value):
                    rows.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, min(index.count(), 4 * index.sparkSession.sparkContext.defaultParallelism))
    return files.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, vocab: int, end: int | None = 1, cut: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, write the files, read them back.

    Empty and null texts have the end id alone. Rows with a null id come first; repeated ids are ordered by length, then by
    a hash of their ids. An empty table gives no rows. Other columns aren't read.
    """
    tokens = materialize(token_table(docs, tokenizer, vocab, end, cut, id_col, text_col), "tokens")
    by_rank = ranks(tokens, vocab)
    index = write_token_files(tokens, by_rank, shared_dir(docs.sparkSession, "token-files"))
    discard(tokens)
    return read_token_files(index, by_rank)
