import base64
import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import xxhash

from creditlake.llm import ann, licenses, mixing, near_vectors, pieces, quality, simhash, token_files, toxicity, warc
from creditlake.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, source string, path string, id string, label int"
TEXTS = [None, "", " \t\n", "One two", "one TWO", "a b c d e f g", "a b c d e f g", "é" * 5000 + " x", "w " * 30000, "▁ \0 tab\t nbsp x\u001cy", "Licensed under CC BY-NC 4.0.", "idiot " + "plain words here " * 20]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, [None, "s", "t"][k % 3], None, "x", 1) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[5], (None, "a b c d e f g", "s", None, "x", 1)], DOCS)


def test_warc(spark):
    pages = spark.createDataFrame([(1, "u\r\nX", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "é"), (5, "u", "é"), (None, "u", "same")], "page_id long, url string, html string")
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()))
    d = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert got == sorted([(0, 4, d("same"), "revisit", 2), (1, 4, d("same"), "revisit", 2), (2, 4, d("same"), "response", None), (3, 0, d(""), "revisit", 4), (4, 0, d(""), "response", None), (5, 2, d("é"), "response", None), (5, 2, d("é"), "response", None)], key=lambda x: x[:3])
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_apportion_by_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        w, seats = [rng.randrange(0, 50) for _ in range(rng.randrange(1, 8))], rng.randrange(0, 60)
        caps, got = [rng.randrange(0, 30) for _ in w], [0] * len(w)
        for _ in range(min(seats, sum(c for c, x in zip(caps, w, strict=True) if x))):
            got[max((k for k in range(len(w)) if w[k] and got[k] < caps[k]), key=lambda k: (Fraction(w[k], 2 * got[k] + 1), -k))] += 1
        assert mixing.apportion(w, seats, caps) == got


def test_mix(spark, docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(TEXTS) + 2 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for s in (None, "s", "t"):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1 + 0.01 * own[0]["target"]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] != 8:
            assert r["fingerprint"] == f"{brute_fingerprint(TEXTS[r['doc_id']]):016x}"
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[0] == by[1] == by[2] == 0 and by[4] == 3 and by[6] == 5 and by[None] is None
    assert simhash.drop_near_duplicates(docs).where("doc_id = 5").count() == 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_links_by_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 150, np.int64)
    fps = [int(b) ^ sum(1 << int(x) for x in rng.choice(62, rng.integers(0, 4), False)) for b in base for _ in range(4)]
    fps += [int(base[0]) ^ (k << 40) for k in range(300)]  # a dense bucket
    got = {r["id"]: r["component_id"] for r in simhash.linked(spark.createDataFrame(list(enumerate(fps)), "id long, fp long")).collect()}
    u = np.array(fps, np.uint64)
    i, j = np.nonzero(np.bitwise_count(u[:, None] ^ u[None]) <= 2)
    label = list(range(len(u)))
    while (new := [min(label[b] for b in j[i == a]) for a in range(len(u))]) != label:
        label = [new[x] for x in new]
    assert got == dict(enumerate(label))


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t, start = Tokenizer.from_file(path), 0
    got = sorted(token_files.round_trip(docs.where("doc_id IS NOT NULL"), path, 49408).collect(), key=lambda r: r["start"])
    for r in got:
        ids = t.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r["doc_id"] for r in got] == sorted([*range(len(TEXTS)), 5])
    v = np.random.default_rng(1).integers(0, 2**32, 1001, np.uint64).astype(np.uint32) >> np.arange(1001).astype(np.uint32) % 32
    assert (token_files.decode_stream(*token_files.encode_stream(v), len(v)) == v).all()


def test_pieces(spark, docs):
    got = pieces.round_trip(docs, P.path("piece_bpe_32k.model")).collect()
    assert len(got) == len(TEXTS) + 2 and all(r["same"] for r in got)
    m = pieces.Unigram([None, "a", "ab", "b", "▁", "▁a"], [0, -1.0, -1.5, -1.2, -0.7, -1.1], [-1] * 256, -9.0)
    assert m.encode(["ab"])[0].tolist() == [4, 2]  # -0.7 - 1.5 beats -1.1 - 1.2


def test_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 16))
    x[200:300] = x[:100] + 0.05 * rng.standard_normal((100, 16))
    x[300:350] = x[0]
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, []), (404, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.95) & ~np.eye(400, dtype=bool)
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(df).collect()}
    assert len(got) == 405 and [got[k]["n_links"] for k in range(400)] == link.sum(axis=1).tolist()
    assert all(got[k]["kept"] and got[k]["n_links"] == 0 for k in range(400, 405))
    near: dict = {}
    for r in ann.nearest(df, k=5).collect():
        near.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in range(0, 400, 20):
        s = x @ x[q]
        want = sorted((k for k in range(400) if k != q), key=lambda k: (-round(s[k], 9), k))[:5]
        assert [v for _, v in sorted(near[q])] == want


def test_classifiers_and_licenses(spark, docs):
    rows = [(k, f"idiot ### word{k % 7} | junk | list" if k % 3 == 0 else f"word{k % 7} plain text of some length", k % 3 == 0) for k in range(120)]
    d = spark.createDataFrame([(k, t, "s") for k, t, _ in rows], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(k, 1 - int(y), int(y)) for k, _, y in rows], "doc_id long, quality int, toxic int")
    for f, c in ((toxicity.toxicity, 1), (quality.quality, 0)):
        got = f(d, labels).collect()
        assert all(r["predicted"] == (c if r["doc_id"] % 3 == 0 else 1 - c) for r in got) and any(r["held_out"] for r in got)
        assert all(0 <= r["score"] <= 1 for r in f(docs, labels.limit(0)).collect())
    texts = [("a/b/LICENSE", "Released under the MIT License."), ("a/b/c/x", "plain text"), ("a/y", "plain"), ("a/b/z", " ".join(f"word{k}" for k in range(60)) + "\nLicensed under the Apache License, Version 2.0."), (None, None), ("a/b/c/x", "plain text")]
    got = {r["path"]: (r["license"], r["origin"]) for r in licenses.scan(spark.createDataFrame(texts, "path string, text string")).collect()}
    assert got == {"a/b/LICENSE": ("MIT", "file"), "a/b/c/x": ("MIT", "inherited"), "a/y": (None, None), "a/b/z": ("Apache-2.0", "header"), None: (None, None)}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_duckdb(spark, name, sf):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    df = QUERIES[name](spark, f"/root/testdata/{sf}")
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, df.select(*names).toPandas().astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None))) == sorted(map(str, want.fetchdf().astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None)))


def test_chunk_encoder_against_the_library():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole, enc, r = Tokenizer.from_file(path), token_files.ChunkEncoder(path), random.Random(3)
    parts = ["Hello", "WORLD", "don't", "it'S", "'", "x", "É", "ß", "İ", "ª", "12", "_", ",", ".", ")", "!?", "...", " ", "\t", " ", "\0", "\x1f", *enc.special, "日本", "é"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(4000)]
    got = enc(token_files.pa.array(texts), None)
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids, t
