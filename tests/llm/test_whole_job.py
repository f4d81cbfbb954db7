import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from creditlake.llm import ann, licenses, mixing, pieces, similar

WORDS = [f"w{k}" for k in range(5000)]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_similar_documents_by_brute_force(spark):
    r, texts = random.Random(5), [None, "", "One two", "one TWO", "a b c d e f", "a b c d e f"]
    for n in (12, 40, 300, 300, 300, 3000):
        base = [r.choice(WORDS) for _ in range(n)]
        for changed in (0, 1, 3, 5, 8, 12):
            copy = list(base)
            for at in r.sample(range(n), min(changed, n)):
                copy[at] = "new" + r.choice(WORDS)
            texts.append(" ".join(copy))
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    near = [[b for b in label if (not sets[a] and not sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0] for a in label]
    while (new := [min(label[b] for b in near[a]) for a in range(len(texts))]) != label:
        label = new
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[-1]), (8, texts[8])], "doc_id long, text string")
    got = {x["id"]: x["component_id"] for x in similar.groups(docs).collect()}
    assert got == dict(enumerate(label))
    assert len(set(label)) < len(texts) - 15
    kept = sorted(str(x["doc_id"]) for x in similar.drop_similar(docs).collect())
    assert kept == sorted([*map(str, sorted(set(label))), "None"])
    assert similar.drop_similar(docs.limit(0)).count() == 0


def test_wrapped_headers_and_whole_licenses(spark):
    r, code = random.Random(2), []
    for _ in range(200):
        code.append(" ".join(r.choice(WORDS) for _ in range(6)))
    mit, bsd = licenses.WHOLE_TEXTS["MIT"][0], licenses.WHOLE_TEXTS["BSD-3-Clause"][0]
    gpl = "This program is free software{} you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation{} either version {} of the License, or\n(at your option) any later version."
    grant = lambda text, at: "\n".join(text[text.index(at) :].split("\n")[:6])
    heads = {"MIT": grant(mit, "Permission is"), "BSD-3-Clause": grant(bsd, "Redistribution and"), "GPL-3.0": gpl.format(":", "", ",", 3), "GPL-2.0": gpl.format(";", "", ";", 2), "LGPL-3.0": gpl.format(":", "Lesser ", ",", 3)}
    rows, want = [(f"p/{k}", "\n".join(r.sample(code, 20))) for k in range(40)], {f"p/{k}": (None, None) for k in range(40)}
    for n, mark in enumerate(("# ", " * ", "// ", "")):
        for name, head in heads.items():
            lines = ["Copyright 2020 The Authors", "", *head.split("\n")]
            rows.append((f"h/{n}{name}", "\n".join([*(mark + x for x in lines), *code])))
            want[f"h/{n}{name}"] = (name, "header")
    rows.append(("h/long", "\n".join([heads["MIT"].replace("\n", " "), *code])))
    want["h/long"] = ("MIT", "header")
    for name, (text,) in licenses.WHOLE_TEXTS.items():
        rows += [(f"w/{name}/LICENSE", f"Copyright (c) 2021 Some Body\n\n{text}"), (f"w/{name}/src/x", code[0])]
        want |= {f"w/{name}/LICENSE": (name, "file"), f"w/{name}/src/x": (name, "inherited")}
    got = {x["path"]: (x["license"], x["origin"]) for x in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("shard", [8192, 3])
def test_whole_rows_meet_each_source_target(spark, monkeypatch, shard):
    monkeypatch.setattr(mixing, "SHARD_DOCUMENTS", shard)
    r, rows = random.Random(7), []
    for s in [f"s{k}" for k in range(12)] + [None]:
        for _ in range(r.choice([60, 200])):
            rows.append((len(rows), "w " * r.randrange(1, 400), s))
    rows += [(len(rows) + k, "long " * 9000, "few") for k in range(3)]
    rows += [(None, "same id", "s1"), (None, "other text", "s1"), (3, "same id", "s2"), (5, None, "s3"), (6, "", "zero")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = {s: [len((t or "").split()) for _, t, x in rows if x == s] for s in {x for _, _, x in rows}}
    plan = mixing.source_plan(list(words), [sum(w) for w in words.values()], block_tokens=1)
    target = {None if s is None or s != s else s: t for s, t in zip(plan["source"], plan["target"], strict=True)}
    got = mixing.mixed_documents(docs).collect()
    for s, sizes in words.items():
        took = sum(len((x["text"] or "").split()) for x in got if x["source"] == s)
        assert abs(took - target[s]) <= max(sizes) / 2 + 1, s
    often = {}
    for x in got:
        often[x] = often.get(x, 0) + 1
    assert max(often.values()) <= 3 and {tuple(x) for x in got} <= set(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_documents(docs).collect()))
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_piece_ids_and_texts_are_returned(spark):
    texts = {1: "One two  three", 2: "é ▁ \0 x", 3: "", 4: None, 5: "word " * 500}
    docs = spark.createDataFrame([(k, t, "s") for k, t in texts.items()], "doc_id long, text string, source string")
    model = pieces.Unigram.from_model(P.path("piece_bpe_32k.model"))
    for got in (pieces.round_trip(docs, P.path("piece_bpe_32k.model")), corpus_pipeline.encode(spark, docs, "")):
        rows = {x["doc_id"]: x for x in got.collect()}
        assert sorted(rows) == sorted(texts)
        for k, text in texts.items():
            assert rows[k]["ids"] == model.encode([text or ""])[0].tolist() and rows[k]["decoded"] == (text or "")
            assert len(rows[k]["ids"]) == rows[k]["n_pieces"]
            assert zlib.crc32(np.array(rows[k]["ids"], "<u4").tobytes()) == rows[k]["ids_crc32"]


def test_more_neighbours_than_the_beam(spark):
    x = np.random.default_rng(4).normal(size=(600, 8))
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(vectors, k=200, every=100).groupBy("query_id").count().collect()
    assert len(got) == 6 and all(r["count"] == 200 for r in got)
