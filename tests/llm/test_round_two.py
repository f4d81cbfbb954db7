import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

import corpus_pipeline
from creditlake.llm import ann, chunks, licenses, mixing, near_vectors, pieces, quality, similar, simhash, token_files, toxicity, warc
from creditlake.llm.common import free_name

ODD = "doc_id long, text string, source string, __nth int, again int, skey string, label int, score double, id string"


def test_small_blocks_of_a_source(spark):
    """Words per source end at the target, two documents at most are cut for each block, and reruns agree."""
    r, rows = random.Random(3), []
    for s, n in (("a", 300), ("b", 40), ("c", 5), (None, 60)):
        rows += [(len(rows) + k, "w " * r.randrange(0, 900), s) for k in range(n)]
    rows += [(len(rows), "long " * 40_000, "b"), (None, "x y z", "a"), (None, "x y z", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for shard, block in ((1 << 18, 1024), (4096, 64)):
        got = mixing.mix(docs, block_tokens=block, shard_tokens=shard).collect()
        assert len(got) == len(rows) and all(0 <= x["taken"] <= 3 * x["size"] for x in got)
        for s in ("a", "b", "c", None):
            own = [x for x in got if x["source"] == s]
            assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 1
            shards = max(1, sum(x["size"] for x in got) // shard)
            cut = sum(x["taken"] % x["size"] > 0 for x in own if x["size"])
            assert cut <= 2 * (sum(x["taken"] for x in own) // block + 1) + shards
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, block_tokens=block, shard_tokens=shard).collect()))


def test_shard_words_by_brute_force():
    r = random.Random(9)
    for _ in range(300):
        tokens = [r.randrange(0, 60) for _ in range(r.randrange(1, 7))]
        words, block = r.randrange(0, 3 * sum(tokens) + 1), r.randrange(1, 9)
        quota = min(words // block + r.randrange(-1, 2), sum(3 * t // block for t in tokens))
        take = mixing.shard_words(tokens, max(0, quota), words, 3, block)
        assert sum(take) == words and all(0 <= x <= 3 * t for x, t in zip(take, tokens, strict=True))


def test_pairs_that_tell_only_together(spark):
    r, rows = random.Random(4), []
    for k in range(1500):
        words = [f"w{r.randrange(300)}" for _ in range(40)]
        insult, group = r.random() < 0.5, r.random() < 0.5
        words += ["blockhead"] * insult + ["northerners"] * group
        r.shuffle(words)
        rows.append((k, " ".join(words), int(insult == group)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    got = [x for x in toxicity.toxicity(docs, labels).collect() if x["held_out"]]
    right = [x["predicted"] == rows[x["doc_id"]][2] for x in got]
    assert sum(right) > 0.9 * len(right)


def test_repeated_ids_stay_bounded(spark):
    docs = spark.createDataFrame([(1, f"idiot text {k % 7}") for k in range(300)] + [(k, f"calm words {k}") for k in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k == 1), int(k != 1)) for k in range(1, 40)], "doc_id long, toxic int, quality int")
    assert toxicity.score(docs, toxicity.train(docs, labels, sample=20)).count() == 338
    assert len(quality.train(docs, labels, sample=20).y) <= 20


def test_ties_all_vote():
    known = np.arange(4)
    same = (np.array([0, 1]), np.array([1.0, 2.0]))
    m = quality.LatentVotes(known, np.ones(4), [same] * 40 + [(np.array([2]), np.array([1.0]))], np.array([1.0, 0.0] * 20 + [0.0]))
    x = m.vectors(1, np.array([0, 0, 0]), np.array([0, 1, 1]))
    assert m.score(np.repeat(x, 700, axis=0)).tolist() == [0.5] * 700


def _best(voc, byte, text):
    """Best sum of scores of a text, by trying every segmentation."""
    best = [0.0] + [-np.inf] * len(text)
    for at in range(len(text)):
        for p, s in voc.items():
            if text.startswith(p, at):
                best[at + len(p)] = max(best[at + len(p)], best[at] + s)
        if text[at] not in voc:
            best[at + 1] = max(best[at + 1], best[at] + byte * len(text[at].encode()))
    return best[-1]


@pytest.mark.parametrize("long_unit", [2, 512])
def test_viterbi_by_brute_force(monkeypatch, long_unit):
    monkeypatch.setattr(pieces, "LONG_UNIT", long_unit)
    r = random.Random(1)
    voc = {p: -r.randint(1, 12) / 4 for p in ("a", "b", "ab", "ba", "aab", "▁", "▁a", "▁ab", "é", "bé")}
    m = pieces.Unigram([None, *voc], [0, *voc.values()], [-(b + 1) for b in range(256)], -9.0, dummy_prefix=False)
    score = dict(enumerate(voc.values(), 1))
    for _ in range(400):
        text = "".join(r.choice("aab bé?z ") for _ in range(r.randint(0, 12)))
        ids = m.encode([text])[0].astype(np.int32).tolist()
        assert abs(sum(score.get(k, -9.0) for k in ids) - _best(voc, -9.0, text.replace(" ", "▁"))) < 1e-9
        assert m.decode(np.array(ids)) == text


def test_one_long_word_of_each_kind():
    m = pieces.Unigram.from_model(P.path("piece_bpe_32k.model"))
    for word in ("日本語" * 30_000, "ab" * 50_000, "#" * 80_000):
        assert m.decode(m.encode([word])[0]) == word
    known = chunks.Known(lambda cs: [b"x" * len(c) for c in cs])
    known(["y" * (1 << 20), "short"], "u1")
    assert list(known.kept) == ["short"]


def test_neighbours_of_copies_and_ties_over_shards(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1200, 12))
    x[1000:1100] = x[:100]  # each of a hundred vectors twice
    x[1100:1160] = np.c_[np.full(60, 3.0), rng.standard_normal((60, 11))]  # sixty equal scores for the query below
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(0, x[0].tolist()), (20_000, [9.0] + [0.0] * 11), (20_020, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.build_index(df, 20, shard_rows=256)
    assert index.count() >= 4
    got: dict = {}
    for r in ann.nearest(df, k=20, shard_rows=256).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = np.r_[np.arange(1200), 20_000]
    y = np.r_[x, [[9.0] + [0.0] * 11]]
    hits = total = 0
    for q in [*range(0, 1200, 20), 20_000]:
        s = (y * y[list(ids).index(q)]).sum(axis=1)
        want = sorted((k for k in range(len(ids)) if ids[k] != q), key=lambda k: (-s[k], ids[k]))[:20]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and len({v for _, v, _ in mine}) == 20
        hits += len({v for _, v, _ in mine} & {int(ids[k]) for k in want})
        total += 20
    print("recall over shards", hits / total)
    assert hits >= 0.99 * total
    assert [v for _, v, _ in sorted(got[20_000])] == sorted(v for _, v, _ in got[20_000])[:20] or len({s for _, _, s in got[20_000]}) > 1


def test_one_bucket_over_many_batches(spark):
    """A hot bucket that is dealt over many batches gives the links of one batch."""
    rng = np.random.default_rng(7)
    base = np.uint64(rng.integers(0, 1 << 63))
    fps = np.unique(base ^ (rng.integers(0, 1 << 20, 3000).astype(np.uint64) << np.uint64(2)))
    mask = np.uint64(simhash.TABLES[0][0])
    table, key = np.zeros(len(fps), np.int32), (fps & mask).view(np.int64)
    order = np.argsort(key, kind="stable")
    cols = [table, key[order], fps[order].view(np.int64), np.arange(len(fps))]

    def groups(size):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[at : at + size]) for c in cols], names=["table", "key", "fp", "rep"]) for at in range(0, len(fps), size)]
        label = np.arange(len(fps))
        for out in simhash._links(iter(batches)):
            a, b = out.column(0).to_numpy(), out.column(1).to_numpy()
            label = simhash.components_of(len(fps), a, b, label)
        return label.tolist()

    assert groups(len(fps)) == groups(37)


def test_block_links_by_brute_force():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 400, 60).astype(np.uint64)) for _ in range(40)]
    for k in range(0, 40, 4):
        sets[k + 1] = np.unique(np.r_[sets[k][2:], np.uint64(9000 + k)])
    sets.append(np.empty(0, np.uint64))
    for side in (np.zeros(41, int), np.arange(41) % 2):
        i, j = similar.linked_sets(sets, side)
        want = {(a, b) for a in range(41) for b in range(a + 1, 41) if (len(set(side)) == 1 or side[a] != side[b]) and similar.similar(sets[a], sets[b])}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_a_group_of_texts_below_the_similarity(spark, monkeypatch):
    """Texts that share most words but less than 0.8: the links among them are those of an exact search, in many cells."""
    monkeypatch.setattr(similar, "CELL_ROWS", 16)
    r = random.Random(8)
    base, texts = [f"b{k}" for k in range(200)], []
    for k in range(150):
        words = list(base)
        for at in r.sample(range(200), r.choice([1, 3, 4, 5])):
            words[at] = f"n{k}-{at}"
        texts.append(" ".join(words))
    sets = [similar.shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    near = [[b for b in range(len(texts)) if similar.similar(sets[a], sets[b])] for a in range(len(texts))]
    while (new := [min(label[b] for b in near[a]) for a in range(len(texts))]) != label:
        label = new
    got = {x["id"]: x["component_id"] for x in similar.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(label)) and len(set(label)) > 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, path string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    frames = [toxicity.toxicity(docs, labels), quality.quality(docs, labels), token_files.round_trip(docs, P.path("word_bpe_49k.json"), 49408), pieces.round_trip(docs, P.path("piece_bpe_32k.model")), near_vectors.near_vectors(vectors), ann.nearest(vectors), licenses.scan(docs), toxicity.drop_toxic(docs, labels), quality.drop_poor(docs, labels)]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_clashing_columns_and_nulls(spark):
    rows = [(k, t, s, k, k, "x", 1, 0.5, "i") for k, t, s in ((1, "same words here for all", "a"), (1, "other words of the same id", "a"), (2, "same words here for all", None), (3, None, "b"), (None, "no id at all", "b"), (None, None, None))]
    docs = spark.createDataFrame(rows, ODD)
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (3, None, None), (None, 1, 0)], "doc_id long, toxic int, quality int")
    assert free_name(docs, "again") == "again_"
    for out in (similar.drop_similar(docs), simhash.drop_near_duplicates(docs), mixing.mixed_documents(docs), toxicity.drop_toxic(docs, labels), quality.drop_poor(docs, labels)):
        assert out.columns == docs.columns and {tuple(x) for x in out.collect()} <= set(rows)
    kept = [x for x in similar.drop_similar(docs).collect() if x["doc_id"] is not None]
    assert sorted(x["doc_id"] for x in kept) == [1, 3]
    assert kept == [x for x in similar.drop_similar(docs).collect() if x["doc_id"] is not None]


def test_warc_with_other_columns_and_least_size(spark):
    pages = spark.createDataFrame([(k, f"u{k}", "tiny" if k % 2 else "x" * 50, 0, "f") for k in range(1, 9)], "page_id long, url string, html string, sha int, last string")
    kinds = {x["page_id"]: (x["record_type"], x["refers_to"]) for x in warc.round_trip(pages, min_dedup_bytes=10).collect()}
    assert all(kinds[k] == ("response", None) for k in (1, 3, 5, 7, 8)) and all(kinds[k] == ("revisit", 8) for k in (2, 4, 6))


def test_licence_paths_and_nulls(spark):
    mit = "Released under the MIT License."
    rows = [(1, "a%2Fb/0/0/1", mit, 7), (2, "a%2Fb/0/0/2", "code", 7), (3, "a/b/0/0/3", "code", 7), (None, None, mit, 7), (None, None, "text", 7), (4, "a/4", None, 7)]
    got = {(x["doc_id"], x["license"], x["origin"]) for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string, license int"), keep=("doc_id",)).collect()}
    assert got == {(1, "MIT", "file"), (2, "MIT", "inherited"), (3, None, None), (None, "MIT", "file"), (None, None, None), (4, None, None)}


def test_versions_are_told_apart(spark):
    """Whole licences of versions that have most words in common, and a text that is near none."""
    rows = [(f"{n}/LICENSE", t) for n, (t,) in licenses.WHOLE_TEXTS.items()] + [("x/LICENSE", "\n".join(f"clause {k} says something else about the work {k * k}" for k in range(400)))]
    got = {x["path"]: (x["license"], x["origin"]) for x in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {f"{n}/LICENSE": (n, "file") for n in licenses.WHOLE_TEXTS} | {"x/LICENSE": (None, None)}


def test_pipeline_end_to_end(spark, tmp_path):
    """Each stage's decision takes effect: what is kept is what the stages keep by themselves, one after the other."""
    r = random.Random(2)
    rows = []
    for k in range(400):
        text = " ".join(r.choice(("alpha", "beta", "gamma", "delta", "eps", "zeta")) + str(r.randrange(90)) for _ in range(60))
        rows.append((k, "idiot clown " + text if k % 8 == 0 else "### | %%% " * 40 + text if k % 9 == 1 else text, "en", f"s{k % 3}", len(text)))
    rows += [(400 + k, rows[k][1], "en", "s1", 1) for k in (2, 3, 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 9 != 1), int(k % 8 == 0)) for k in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
    ids = {x["doc_id"] for x in docs.collect()}
    assert not any(k % 8 == 0 for k in ids) and not any(k % 9 == 1 for k in ids) and not ids & {402, 403, 404}
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] and len(ids) == len([k for k in range(400) if k % 8 and k % 9 != 1])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in out} <= ids and all(x["same"] for x in out)
    model, texts = pieces.Unigram.from_model(P.path("piece_bpe_32k.model")), {x[0]: x[1] for x in rows}
    for x in out[:20]:
        assert x["ids"] == model.encode([texts[x["doc_id"]]])[0].tolist()
        assert x["ids_crc32"] == zlib.crc32(np.array(x["ids"], "<u4").tobytes())
