"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces, with byte fallback."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import BLOCK_BYTES, Known, spread
from .common import small_batches

#: The white-space marker that stands for a blank inside pieces.
MARK = "▁"
_MARK = MARK.encode()
#: Longer units than this many bytes are searched one by one, so that one long word doesn't make a step of each byte.
LONG_UNIT = 512


class DoubleArrayTrie:
    """Byte strings -> values: from state s, byte b leads to base[s] + b + 1 if check there is s; value[s] is -1 inside."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        keys = [keys[k] for k in order]
        base, check, value = [0], [0], [-1]
        hole, dense, todo = 258, 258, [(0, 0, 0, len(keys))]  # a byte leads 256 beyond a base at most, and bases are positive
        while todo:
            state, depth, lo, hi = todo.pop()
            if lo < hi and len(keys[lo]) == depth:
                value[state] = order[lo]
                while lo < hi and len(keys[lo]) == depth:
                    lo += 1
            if lo == hi:
                continue
            starts = [lo] + [k for k in range(lo + 1, hi) if keys[k][depth] != keys[k - 1][depth]]
            codes = [keys[k][depth] + 1 for k in starts]
            at = (hole if len(codes) == 1 else dense) - codes[0]
            tries = 0
            while True:
                if at + 257 >= len(check):
                    more = len(check) + 512
                    base, check, value = base + [0] * more, check + [-1] * more, value + [-1] * more
                if all(check[at + c] < 0 for c in codes):
                    break
                at, tries = at + 1, tries + 1
            if tries > 200 and len(codes) > 1:  # crowded: later branches look further on, single steps fill the holes
                dense = at + codes[0]
            base[state] = at
            for c, a, b in zip(codes, starts, [*starts[1:], hi], strict=True):
                check[at + c] = state
                todo.append((at + c, depth + 1, a, b))
            while hole < len(check) and check[hole] >= 0:
                hole += 1
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))
        self.depth = max(map(len, keys), default=0)

    def matches(self, data: np.ndarray, stop: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, value) of every key at the given starts of a byte array, sorted by start, then end; no match passes
        stop[start]. All starts walk the trie at the same time."""
        found = []
        state, at = np.zeros(len(starts), np.int64), starts.astype(np.int64)
        own = at.copy()
        for _ in range(self.depth):
            go = at < stop[own]
            own, at, state = own[go], at[go], state[go]
            if not len(own):
                break
            to = self.base[state] + data[at].astype(np.int64) + 1
            ok = (to < len(self.check)) & (self.check[np.minimum(to, len(self.check) - 1)] == state)
            own, at, state = own[ok], at[ok] + 1, to[ok]
            v = self.value[state]
            hit = v >= 0
            found.append((own[hit], at[hit], v[hit]))
        s, e, v = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3))
        order = np.lexsort((e, s))
        return s[order], e[order], v[order]


class Unigram:
    """Pieces with log scores. pieces[k] is the text of id k or None for control ids; bytes_[b] is the id of byte b.

    The best segmentation has the largest sum of scores; of equal ones the one whose last piece that differs starts first.
    A character that no piece covers, and a marker that stands in the text itself, is written as its UTF-8 bytes, so
    decode(encode(x)) == x for every text that UTF-8 can hold.
    """

    def __init__(self, pieces: list[str | None], scores: list[float], bytes_: list[int], byte_score: float, dummy_prefix: bool = True):
        self.ids = [k for k, p in enumerate(pieces) if p]
        keys = [pieces[k].encode() for k in self.ids]
        if any(MARK in pieces[k].lstrip(MARK) for k in self.ids):
            raise ValueError("a piece has a marker after another character: texts can't be cut before markers")
        self.trie = DoubleArrayTrie(keys)
        self.scores = [scores[k] for k in self.ids]
        self.bytes_, self.byte_score, self.dummy_prefix = bytes_, byte_score, dummy_prefix
        self.text: dict[int, bytes] = dict(zip(self.ids, keys, strict=True)) | {k: bytes([b]) for b, k in enumerate(bytes_)}
        self.is_byte = set(bytes_)
        self.known = Known(self._new)

    @classmethod
    def from_model(cls, path: str) -> Unigram:
        """A model file's vocabulary. A BPE model's scores are ranks below zero; by Zipf's law their log score is
        -ln(1 + rank). A unigram model's scores are log scores already. Bytes score below every piece."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        bytes_ = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [not (m.is_control(k) or m.is_unknown(k) or m.is_byte(k) or m.is_unused(k)) for k in range(n)]
        raw = [m.get_score(k) for k in range(n)]
        ranked = all(raw[k] == round(raw[k]) for k in range(n) if plain[k])
        scores = [-float(np.log1p(-r)) if ranked else r for r in raw]
        return cls([m.id_to_piece(k) if plain[k] else None for k in range(n)], scores, bytes_, min(s for s, p in zip(scores, plain, strict=True) if p) - 1)

    def _new(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks; a chunk is markers and then no marker, so no piece crosses from one to the next."""
        out: list[bytes] = []
        for at in range(0, len(chunks), 20_000):
            out += self._segment([c.encode("utf-8", "surrogatepass") for c in chunks[at : at + 20_000]])
        return out

    def _segment(self, chunks: list[bytes]) -> list[bytes]:
        """Viterbi over all chunks at the same time. Every way passes a byte that no piece spans, so chunks are cut there
        into units; step p extends the best ways that end at byte p of each unit, and long units go one by one."""
        literal = [k for k, c in enumerate(chunks) if c.startswith(b"\0")]  # a marker or NUL of the text itself
        size = np.array([len(c) for c in chunks], np.int64)
        data = np.frombuffer(b"".join(chunks), np.uint8)
        if not len(data):
            return [b""] * len(chunks)
        first = np.cumsum(size) - size
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        s, e, v = self.trie.matches(data, np.repeat(first + size, size), starts)
        lead = data[starts]
        width = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
        whole = np.zeros(len(data) + 1, bool)
        whole[s[e - s == (width[np.searchsorted(starts, s)] if len(s) else 0)]] = True
        bare = ~whole[starts]
        gain = np.concatenate([np.array(self.scores)[v], self.byte_score * width[bare]])
        s, e = np.concatenate([s, starts[bare]]), np.concatenate([e, (starts + width)[bare]])
        v = np.concatenate([v, np.full(bare.sum(), -1)])
        spans = np.cumsum(np.bincount(s + 1, minlength=len(data) + 1) - np.bincount(e, minlength=len(data) + 1))
        cut = spans[:-1] == 0
        cut[first[size > 0]] = True
        own = np.cumsum(cut) - 1
        begin = np.flatnonzero(cut)
        length = np.diff(np.r_[begin, len(data)])
        rel = s - begin[own[s]]
        order = np.argsort(rel, kind="stable")
        rel, gain, v, unit = rel[order], gain[order], v[order], own[s][order]
        frm, to = s[order] + unit, e[order] + unit  # each unit has a slot more than bytes, for its end
        slots = len(data) + len(begin)
        best, back, piece = np.full(slots, -np.inf), np.zeros(slots, np.int64), np.full(slots, -1)
        begin = begin + np.arange(len(begin))
        best[begin] = 0
        for k in np.flatnonzero(length > LONG_UNIT).tolist():
            self._long(np.flatnonzero(unit == k), int(begin[k]), int(length[k]), frm, to, gain, v, back, piece)
        short = np.flatnonzero(length[unit] <= LONG_UNIT)
        at_step = np.searchsorted(rel[short], np.arange(int(length[length <= LONG_UNIT].max(initial=0)) + 1))
        for lo, hi in zip(at_step[:-1].tolist(), at_step[1:].tolist(), strict=True):
            # ends are different within a step, as each start has one key of a length
            now = short[lo:hi]
            new = best[frm[now]] + gain[now]
            better = np.flatnonzero(new > best[to[now]])
            now = now[better]
            at = to[now]
            best[at], back[at], piece[at] = new[better], frm[now], v[now]
        at, which, steps = begin + length, np.arange(len(begin)), []
        while len(at := at[go := at > begin[which]]):
            which = which[go]
            steps.append((which, back[at], at, piece[at]))
            at = back[at]
        which, frm, to, v = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.argsort(frm, kind="stable")
        which, frm, to, v = which[order], frm[order], to[order], v[order]
        n = np.where(v < 0, to - frm, 1)
        ids = np.repeat(np.array(self.ids)[v], n)
        raw = np.repeat(v < 0, n)
        byte = np.repeat(frm - which, n) + (np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n))
        ids[raw] = np.array(self.bytes_)[data[byte[raw]]]
        flat = ids.astype("<u4").tobytes()
        chunk = np.repeat(np.arange(len(chunks)), size)[frm - which]
        ends = (4 * np.cumsum(np.bincount(chunk, n, len(chunks)))).astype(np.int64).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for k in literal:
            out[k] = array("I", [self.bytes_[b] for b in (_MARK if chunks[k] == b"\0M" else chunks[k])]).tobytes()
        return out

    @staticmethod
    def _long(matches: np.ndarray, begin: int, length: int, frm: np.ndarray, to: np.ndarray, gain: np.ndarray, v: np.ndarray, back: np.ndarray, piece: np.ndarray) -> None:
        """The best ways of one unit, match by match in order of their starts; fills its slots of back and piece."""
        best, came, by = [-float("inf")] * (length + 1), [0] * (length + 1), [-1] * (length + 1)
        best[0] = 0.0
        for f, t, g, p in zip((frm[matches] - begin).tolist(), (to[matches] - begin).tolist(), gain[matches].tolist(), v[matches].tolist(), strict=True):
            new = best[f] + g
            if new > best[t]:
                best[t], came[t], by[t] = new, f, p
        back[begin : begin + length + 1] = np.array(came, np.int64) + begin
        piece[begin : begin + length + 1] = by

    def chunks(self, text: str) -> list[str]:
        """Blanks become markers, then the text is cut before each run of markers. A marker or NUL of the text itself is a
        chunk of its own, led by NUL."""
        if self.dummy_prefix and text:
            text = " " + text
        if MARK not in text and "\0" not in text:
            return _cut(text)
        out: list[str] = []
        for k, part in enumerate(text.replace("\0", "\0N\0").replace(MARK, "\0M\0").split("\0")):
            out += ["\0" if part == "N" else "\0M"] if k % 2 else _cut(part)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.chunks(t) for t in texts]
        code: dict[str, int] = {}
        codes = np.fromiter((code.setdefault(c, len(code)) for cs in cut for c in cs), np.int64)
        values, lengths = self.known(list(code), "<u4")
        ids, n = spread(values, lengths, codes)
        ends = np.r_[0, np.cumsum(n)][np.cumsum([len(cs) for cs in cut])] if cut else []
        return np.split(ids, ends[:-1]) if cut else []

    def decode(self, ids: np.ndarray) -> str:
        """Pieces with their markers as blanks, bytes as they are, less the prefix that encoding added."""
        text, bytes_, blanks = self.text, self.is_byte, self._blanks()
        raw = b"".join([text[i] if i in bytes_ else blanks[i] for i in ids.tolist()])
        return (raw[1:] if self.dummy_prefix and raw[:1] == b" " else raw).decode("utf-8", "surrogatepass")

    def _blanks(self) -> dict[int, bytes]:
        if not hasattr(self, "_blank"):
            self._blank = {k: t.replace(_MARK, b" ") for k, t in self.text.items()}
        return self._blank


def _cut(text: str) -> list[str]:
    """Pieces of a text without markers: runs of blanks go with what follows them."""
    words = text.split(" ")
    out, blanks = [words[0]] if words[0] else [], 0
    for w in words[1:]:
        blanks += 1
        if w:
            out.append(MARK * blanks + w)
            blanks = 0
    if blanks:
        out.append(MARK * blanks)
    return out


def shared_model(df: DataFrame, path: str):
    """The model, read and built once on the driver and broadcast: as large as its vocabulary."""
    small_batches(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(Unigram.from_model(path))


def _parts(texts: list[str]) -> Iterator[slice]:
    at, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > BLOCK_BYTES:
            yield slice(at, k)
            at, held = k, 0
        held += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def _texts(column: pa.Array) -> list[str | None]:
    return column.to_numpy(zero_copy_only=False).tolist()


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of every whole text; null and empty texts have no ids. Other columns aren't read."""
    shared = shared_model(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = [x or "" for x in _texts(b.column(1))]
            for part in _parts(texts):
                ids = m.encode(texts[part])
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                ends = pa.array(np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(part.start, part.stop - part.start), pa.ListArray.from_arrays(ends, flat)], names=["id", "ids"])

    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) of every list of ids; a null list gives a null text."""
    shared = shared_model(tokens, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x.as_py() is None else m.decode(x.values.to_numpy()) for x in b.column(1)], pa.string())], names=["id", "text"])

    kind = tokens.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col)).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_pieces, ids_crc32, n_chars, same, ids, decoded) for every row: number of pieces of the whole text, unsigned
    crc32 of the ids as little-endian unsigned 32-bit integers, characters of the decoded text, whether it equals the text
    (null: empty), the ids themselves and the decoded text. One narrow pass; every list of ids is decoded again.

    Null ids and repeated rows give a row each, an empty table none. Columns other than the two named aren't read."""
    shared = shared_model(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = [x or "" for x in _texts(b.column(1))]
            for part in _parts(texts):
                rows, coded = [], m.encode(texts[part])
                for text, ids in zip(texts[part], coded, strict=True):
                    back = m.decode(ids)
                    rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(back), back == text, back))
                *cols, decoded = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()), strict=True)]
                ends = pa.array(np.r_[0, np.cumsum([len(x) for x in coded])].astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(coded).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(part.start, part.stop - part.start), *cols, lists, decoded], names=["id", "n_pieces", "ids_crc32", "n_chars", "same", "ids", "decoded"])

    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, n_pieces long, ids_crc32 long, n_chars long, same boolean, ids array<int>, decoded string").withColumnRenamed("id", id_col)
