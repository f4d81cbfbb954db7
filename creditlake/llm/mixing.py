"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, then seeded selection in each shard."""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import floor

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: No document is taken more often than this.
REPEATS = 3
#: Tokens of a shard on average, and the most shards. Each source is dealt over all shards by hash, so a source with a third
#: of all rows is spread like the rest.
SHARD_TOKENS, MOST_SHARDS = 1 << 18, 1 << 16
#: Documents of a shard on average where whole rows are taken.
SHARD_DOCUMENTS = 1024
#: Tokens of a block, at every size of the table.
BLOCK_TOKENS = 1024
#: Steps of the seeded walks through a line's blocks.
STEPS = (1_000_003, 1_000_033, 1_000_037, 1_000_039)
#: One row per source goes to the driver; beyond this bound an error is raised instead.
MOST_SOURCES = 100_000


def apportion(weights: list[Fraction | int], seats: int, caps: list[int] | None = None) -> list[int]:
    """Sainte-Lague: seats go one by one to the highest quotient weight / (2 * got + 1); ties to the first; none above its cap.

    Seats that are sure are given at once: for any d not below the last seat's quotient, weight w has floor(w / d + 1/2).
    """
    n, weights = len(weights), [Fraction(w) for w in weights]
    caps = [seats if w else 0 for w in weights] if caps is None else [c if w else 0 for c, w in zip(caps, weights, strict=True)]
    got, live, left = [0] * n, [k for k in range(n) if caps[k]], min(seats, sum(caps))
    while live and left > Fraction(len(live), 2):
        d = sum(weights[k] for k in live) / (left - Fraction(len(live), 2))  # not below the last seat's quotient
        sure = {k: floor(weights[k] / d + Fraction(1, 2)) for k in live}
        full = [k for k in live if sure[k] >= caps[k]]
        for k in full or live:
            got[k] = min(caps[k], sure[k])
            left -= got[k]
        if not full:
            break
        live = [k for k in live if sure[k] < caps[k]]
    heap = [(-weights[k] / (2 * got[k] + 1), k) for k in live if got[k] < caps[k]]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, k = heapq.heappop(heap)
        got[k] += 1
        left -= 1
        if got[k] < caps[k]:
            heapq.heappush(heap, (-weights[k] / (2 * got[k] + 1), k))
    return got


def targets(sizes: list[int], weights: list[int], repeats: int = REPEATS) -> list[Fraction]:
    """Shares of all sizes by weight; a target stops at `repeats` times its source's size and the excess is shared again
    by weight until none is above."""
    out: list[Fraction | None] = [None] * len(sizes)
    rest, live = Fraction(sum(sizes)), list(range(len(sizes)))
    while live:
        w = sum(weights[k] for k in live)
        over = [k for k in live if rest * weights[k] / w > repeats * sizes[k]]
        if not over:
            for k in live:
                out[k] = rest * weights[k] / w
            break
        for k in over:
            out[k] = Fraction(repeats * sizes[k])
        rest -= sum(out[k] for k in over)
        live = [k for k in live if out[k] is None]
    return out


def source_plan(sources: list[str | None], sizes: list[int], repeats: int = REPEATS, block_tokens: int = BLOCK_TOKENS) -> pd.DataFrame:
    """A row for each source in code point order, null last: weight, size, target, quota in blocks, and words to take.

    Weights are 1, 2, 3, repeating. Blocks go to sources by highest quotients, and so do words, which are within one of the
    target; what words and blocks differ by is a part of a block. Neither exceeds `repeats` times the size."""
    order = sorted(range(len(sources)), key=lambda k: (sources[k] is None, (sources[k] or "").encode("utf-8", "surrogatepass")))
    sources, sizes = [sources[k] for k in order], [sizes[k] for k in order]
    target = targets(sizes, [k % 3 + 1 for k in range(len(sizes))], repeats)
    total = floor(sum(target, Fraction(0)))
    quota = apportion(target, total // block_tokens, [repeats * s // block_tokens for s in sizes])
    words = apportion(target, total, [repeats * s for s in sizes])
    return pd.DataFrame({"source": sources, "source_size": sizes, "target": [float(t) for t in target], "quota": quota, "words": words})


def shard_words(tokens: list[int], quota: int, words: int, repeats: int = REPEATS, block: int = BLOCK_TOKENS) -> list[int]:
    """Words that each shard of a source takes: its quota of blocks by highest quotients, none above its repeats. What the
    source's words are more or less goes, a block's part at a time, to the shards that are next, or from those that were last."""
    got = apportion(tokens, quota, [repeats * t // block for t in tokens])
    take = [g * block for g in got]
    spare = words - sum(take)
    if spare > 0:
        turns = [(-Fraction(t, 2 * g + 1), k) for k, (t, g) in enumerate(zip(tokens, got, strict=True)) if t]
        heapq.heapify(turns)
        while spare and turns:
            _, k = heapq.heappop(turns)
            more = min(spare, block, repeats * tokens[k] - take[k])
            take[k] += more
            spare -= more
            if more:
                heapq.heappush(turns, (-Fraction(tokens[k], 2 * (take[k] // block) + 1), k))
    while spare < 0:
        k = min((k for k in range(len(take)) if take[k]), key=lambda k: (Fraction(tokens[k], 2 * -(-take[k] // block) - 1), -k))
        less = min(-spare, (take[k] - 1) % block + 1)
        take[k] -= less
        spare += less
    return take


def _shard_quotas(repeats: int, block: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        take = shard_words([int(x) for x in rows["tokens"]], int(rows["quota"].iloc[0]), int(rows["words"].iloc[0]), repeats, block)
        return pd.DataFrame({"skey": key[0], "shard": rows["shard"].to_numpy(), "tokens": rows["tokens"].to_numpy(), "take": take})

    return run


def mix(docs: DataFrame, seed: int = 7, repeats: int = REPEATS, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs (doc_id, text, source).

    Size counts words `[^ \\t-\\r]+`, null and empty texts 0. Each source's words are dealt to shards by a hash of the id;
    each shard lays its documents in a line in seeded order and cuts it into blocks of block_tokens words, the last one
    shorter. Its words are some full rounds of the line, then whole blocks in a seeded order of the blocks, then a part of
    the next one. So two documents at most are cut for each block that is taken. No document exceeds `repeats` times its
    size. Null ids are ids like any other; repeated rows are rows of their own. An empty table gives no rows. Reruns on the
    same rows agree. Other columns aren't read.
    """
    spark = docs.sparkSession
    skey = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), "source", skey.alias("skey"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    by_source = sized.groupBy("source", "skey").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(by_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if not by_source:
        return sized.select("doc_id", "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    plan = source_plan([r["source"] for r in by_source], [r["size"] for r in by_source], repeats, block_tokens)
    plan["skey"] = ["-" if s is None else f"+{s}" for s in plan["source"]]
    sources = spark.createDataFrame(list(plan[["skey", "source_size", "target", "quota", "words"]].itertuples(index=False, name=None)), "skey string, source_size long, target double, quota long, words long")
    shards = max(1, min(MOST_SHARDS, sum(r["size"] for r in by_source) // shard_tokens))
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.lit(shards)).cast("int"))
    lines = dealt.groupBy("skey", "shard").agg(F.sum("size").alias("tokens"))
    quotas = lines.join(F.broadcast(sources), "skey").groupBy("skey").applyInPandas(_shard_quotas(repeats, block_tokens), "skey string, shard int, tokens long, take long")
    w = Window.partitionBy("skey", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    j = dealt.withColumn("upto", F.sum("size").over(w)).join(quotas, ["skey", "shard"]).join(F.broadcast(sources.select("skey", "source_size", "target")), "skey")
    line = F.greatest("tokens", F.lit(1))
    j = j.withColumn("blocks", F.expr(f"tokens div {block_tokens}")).withColumn("rounds", F.expr("take div greatest(tokens, 1)")).withColumn("rest", F.col("take") % line)
    j = j.withColumn("whole", F.expr(f"rest div {block_tokens}")).withColumn("part", F.col("rest") % block_tokens)
    # A seeded walk visits every whole block once: its step is a prime that doesn't divide their number.
    step = F.element_at(F.array(*[F.lit(x) for x in STEPS]), (F.pmod(F.xxhash64("skey", "shard", F.lit(seed + 2)), F.lit(len(STEPS))) + 1).cast("int"))
    j = j.withColumn("step", F.when(F.col("blocks") % step == 0, F.lit((1 << 31) - 1)).otherwise(step).cast("long")).withColumn("first", F.pmod(F.xxhash64("skey", "shard", F.lit(seed)), F.greatest("blocks", F.lit(1))))

    def words_of(block):  # taken from a block in the last round; the short block comes last
        turn = F.when(block < F.col("blocks"), (block * F.col("step") + F.col("first")) % F.greatest("blocks", F.lit(1))).otherwise(F.col("blocks"))
        return F.when(turn < F.col("whole"), F.lit(block_tokens)).when(turn == F.col("whole"), F.col("part")).otherwise(0)

    def overlap(block):  # of the document's stretch [upto - size, upto) with what is taken of the block
        at = block * block_tokens
        return F.greatest(F.least(F.col("upto"), at + words_of(block)) - F.greatest(F.col("upto") - F.col("size"), at), F.lit(0).cast("long"))

    span = F.sequence(F.expr(f"(upto - size) div {block_tokens}"), F.expr(f"(upto - 1) div {block_tokens}"))
    last = F.when(F.col("size") > 0, F.aggregate(span, F.lit(0).cast("long"), lambda acc, block: acc + overlap(block))).otherwise(0)
    return j.select("doc_id", "source", "size", "source_size", "target", (F.col("rounds") * F.col("size") + last).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 7, repeats: int = REPEATS, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it, as whole rows.

    Each source lays its documents in one line in seeded order. Its target, in whole words, is some full rounds of the line
    and the line up to some word: a document is taken once for each round, and once more if that word is beyond its middle.
    So a source's words miss its target by half a document at most; only a source whose target is less than half of its
    first document gets that one whole. Rows that share id, source and text count as one document. Documents without
    words are not taken. The line is cut into shards as the source has documents, and the shards' words are summed up.
    Null ids and sources are values like any other; other columns are kept, whatever their names. An empty table stays empty.
    """
    skey = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    key = [skey.alias("skey"), F.col(id_col).alias("id"), F.xxhash64("text").alias("hash")]
    sized = docs.select("source", *key, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")).where("size > 0")
    units = materialize(sized.groupBy("source", "skey", "id", "hash").agg(F.sum("size").alias("size")), "mix-units")
    by_source = units.groupBy("source", "skey").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(by_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if not by_source:
        return docs.limit(0)
    # Sources of documents without words keep their place in the order that weights follow.
    bare = docs.select("source").distinct().limit(MOST_SOURCES + 1).collect()
    sizes = {r["source"]: 0 for r in bare} | {r["source"]: r["size"] for r in by_source}
    plan = source_plan(list(sizes), list(sizes.values()), repeats)
    quota = {None if pd.isna(s) else s: int(q) for s, q in zip(plan["source"], plan["words"], strict=True)}
    rows = [(r["skey"], max(1, min(MOST_SHARDS, r["n"] // SHARD_DOCUMENTS)), quota[r["source"]] // r["size"], quota[r["source"]] % r["size"]) for r in by_source]
    sources = docs.sparkSession.createDataFrame(rows, "skey string, shards long, rounds long, rest long")
    place = F.xxhash64("id", "hash", F.lit(seed + 1))
    # The shard is the place's top 31 bits cut into equal stretches, so shards follow each other along the line.
    top = F.shiftrightunsigned(place.bitwiseXOR(F.lit(-(1 << 63))), 33)
    placed = units.drop("source").join(F.broadcast(sources), "skey").withColumn("place", place).withColumn("shard", F.shiftright(top * F.col("shards"), 31).cast("int"))
    lines = placed.groupBy("skey", "shard").agg(F.sum("size").alias("words"))
    before = lines.select("skey", "shard", (F.sum("words").over(Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).alias("before"))
    w = Window.partitionBy("skey", "shard").orderBy("place", "id", "hash").rowsBetween(Window.unboundedPreceding, 0)
    ended = placed.withColumn("in", F.sum("size").over(w)).join(before, ["skey", "shard"]).withColumn("end", F.col("before") + F.col("in"))
    only = (F.col("rounds") == 0) & (F.col("rest") > 0) & (F.col("end") == F.col("size"))
    more = (2 * F.col("end") - F.col("size") < 2 * F.col("rest")) | only
    times = ended.select("skey", "id", "hash", (F.col("rounds") + more.cast("int")).cast("int").alias("times")).where("times > 0")
    # The rows taken get names that docs doesn't have.
    cols, names = docs.columns, [free_name(docs, n) for n in ("skey", "mix_id", "mix_hash", "times", "again")]
    times = times.toDF(*names[:4])
    out = docs.join(times, (skey == F.col(names[0])) & F.col(id_col).eqNullSafe(F.col(names[1])) & (F.xxhash64("text") == F.col(names[2])))
    return out.withColumn(names[4], F.explode(F.sequence(F.lit(1), F.col(names[3])))).select(*cols)
