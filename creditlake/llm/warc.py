"""WARC archives: write with an index of every record, read back selected records by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, materialize, shared_dir, small_batches

CRLF = b"\r\n"
#: A file is closed beyond this size, so that a task holds one file open and readers get even shares.
FILE_BYTES = 256 << 20
#: Ranges that are nearer than this are read at once, up to this much.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Records are dealt to read tasks by stretches of a file; a task reads about so much.
STRETCH_BYTES, TASK_BYTES, MOST_TASKS = 4 << 20, 64 << 20, 1 << 17
INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit (refers_to given) has no body but names the payload's digest and length."""
    safe = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    body = payload if refers_to is None else b""
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{_uri(page_id)}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": safe,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Refers-To": None if refers_to is None else f"<{_uri(refers_to)}>",
        "WARC-Profile": None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": str(len(body)),
    }
    lines = b"WARC/1.1" + CRLF + b"".join(f"{k}: {v}".encode() + CRLF for k, v in head.items() if v is not None)
    return lines + CRLF + body + CRLF + CRLF


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and body of one record; raises ValueError on damage."""
    head, _, rest = raw.partition(CRLF + CRLF)
    first, *lines = head.split(CRLF)
    fields = dict(x.decode().split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if not first.startswith(b"WARC/") or rest[n:] != CRLF + CRLF:
        raise ValueError("not a whole WARC record")
    return fields, rest[:n]


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, ""
        for b in batches:
            rows = []
            for r in zip(*(b.column(k) for k in range(5)), strict=True):
                page_id, url, html, digest, refers_to = (x.as_py() for x in r)
                if out is None or at >= FILE_BYTES:
                    if out:
                        out.close()
                    # A name of its own for each attempt: a task that is run again never writes into a file that an index
                    # names already. Files of lost attempts are in no index.
                    name, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    fs, path = filesystem(name)
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                payload = (html or "").encode("utf-8", "surrogatepass")
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = z.compress(record(page_id, url, payload, digest, refers_to)) + z.flush()
                out.write(member)
                rows.append((name, at, len(member), page_id, url, digest, "response" if refers_to is None else "revisit"))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)
        if out:
            out.close()

    return run


_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_TYPES = [pa.int64() if x.endswith("long") else pa.string() for x in INDEX.split(", ")]


def write_archives(pages: DataFrame, folder: str, min_dedup_bytes: int = 0) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) and return the index, itself stored in the shared folder.

    Of rows with equal payloads of at least min_dedup_bytes, that with the largest page_id is the response and the others
    revisit it. Null html is an empty payload, a null url is left out. A row without page_id can't be referred to; it
    revisits like any other. Repeated rows with the largest page_id are responses all. An empty table gives an empty index.
    Other columns are ignored.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.unhex(F.sha1(html.cast("binary"))).alias("sha"), F.octet_length(html).alias("n"))
    # The digests alone are grouped, with map-side combining; the join is an ordinary one, which AQE splits at hot digests.
    last = hashed.where(F.col("n") >= min_dedup_bytes).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1")
    joined = hashed.join(last.select("sha", "last"), "sha", "left").select(
        "page_id", "url", "html", F.col("sha"), F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to")
    )
    rows = joined.select("page_id", "url", "html", F.col("sha"), "refers_to")

    def with_digest(batches):
        for b in batches:
            digest = pa.array([base64.b32encode(x.as_py()).decode() for x in b.column(3)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), digest, b.column(4)], names=list("abcde"))

    write = _write(folder)
    return materialize(rows.mapInArrow(lambda batches: write(with_digest(batches)), INDEX), "warc-index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read index rows sorted by file and offset: neighbours are fetched by one read, then cut and parsed."""

    def parsed(part: list[dict]) -> pa.RecordBatch:
        out, k = [], 0
        while k < len(part):
            e, end = k, part[k]["offset"] + part[k]["length"]
            while e + 1 < len(part) and part[e + 1]["file"] == part[k]["file"] and 0 <= part[e + 1]["offset"] - end <= GAP_BYTES and part[e + 1]["offset"] + part[e + 1]["length"] - part[k]["offset"] <= READ_BYTES:
                e += 1
                end = part[e]["offset"] + part[e]["length"]
            fs, path = filesystem(part[k]["file"])
            with fs.open_input_file(path) as f:
                data = f.read_at(end - part[k]["offset"], part[k]["offset"])
            for r in part[k : e + 1]:
                at = r["offset"] - part[k]["offset"]
                head, body = parse(zlib.decompress(data[at : at + r["length"]], 31))
                digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                if kind == "response" and base32_sha1(body) != digest:
                    raise ValueError(f"payload digest of {head['WARC-Record-ID']} does not hold")
                ids = [None if x is None or x == "none" else int(x) for x in (head[h][1:-1].rsplit(":", 1)[1] if h in head else None for h in ("WARC-Record-ID", "WARC-Refers-To"))]
                out.append((ids[0], head.get("WARC-Target-URI"), len(body) if kind == "response" else int(head["X-Payload-Length"]), digest, kind, ids[1], body if kind == "response" else None))
            k = e + 1
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    for b in batches:
        rows = b.to_pylist()
        size, at = 0, 0
        for k, r in enumerate(rows):  # bounds what is held at once, whatever the batch's size
            size += r["length"]
            if size > 2 * READ_BYTES or k + 1 == len(rows):
                yield parsed(rows[at : k + 1])
                size, at = 0, k + 1


def read_records(index: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Read the records that (a selection of) the index names, checking each response against its digest.

    The index rows are dealt by stretches of a file and sorted, so that each task reads forward and neighbours share a read.
    """
    # A given number of partitions, from the bytes to be read: by the size of the index rows, AQE would merge them to one task.
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    dealt = index.select("file", "offset", "length").repartition(int(min(tasks, MOST_TASKS)), "file", stretch).sortWithinPartitions("file", "offset")
    read = dealt.mapInArrow(_read, READ)
    if keep_payload:
        return read
    return dealt.mapInArrow(lambda batches: (b.drop_columns(["payload"]) for b in _read(batches)), READ.replace(", payload binary", ""))


def round_trip(pages: DataFrame, min_dedup_bytes: int = 0) -> DataFrame:
    """Archive pages and read every record back, without the payloads."""
    index = write_archives(pages, shared_dir(pages.sparkSession, "warc"), min_dedup_bytes)
    return read_records(index, keep_payload=False)
