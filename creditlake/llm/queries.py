"""One query for each operator of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, license_sql, licenses, mixing, near_vectors, pieces, quality, simhash, token_files, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), vocab=49_408, end=1)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths; a document stands at source / ten thousands / hundreds / id, slashes of a source escaped. A
    document without id has no path."""
    docs = _table(spark, sf_dir, "documents")
    folder = F.regexp_replace(F.regexp_replace(F.coalesce("source", F.lit("none")), "%", "%25"), "/", "%2F")
    path = F.when(F.col("doc_id").isNotNull(), F.concat_ws("/", folder, F.floor(F.col("doc_id") / 10_000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string")))
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"), keep=("doc_id",))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_mixing, op3_toxicity, op4_quality, op5_token_files, op6_sentencepiece, op7_near_vectors, op8_nearest, op9_simhash, op10_license)
}
_HEX = "instr('0123456789abcdef', substr(x, {}, 1)) - 1"
_BASE32 = f"array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((({_HEX.format('j * 5 // 4 + 1')}) * 16 + {_HEX.format('j * 5 // 4 + 2')}) >> (3 - j * 5 % 4)) & 31) + 1), 1) for j in range(32)], '')"
#: The operators that SQL can express on whole tables; tests hold the others against brute force or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op10_license": license_sql.SQL,
    "op1_warc": f"""WITH s AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS bytes, sha1(coalesce(html, '')) AS x FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS last FROM s)
        SELECT page_id, url, cast(bytes AS bigint) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM g""",
    "op7_near_vectors": """WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN list_count(embedding) = len(embedding) THEN [cast(x AS double) for x in embedding] END AS e FROM embeddings),
        f AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len([x for x in e if NOT isfinite(x)]) = 0),
        n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM f),
        links AS (SELECT a.vec_id AS i, b.vec_id AS j FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
        reach AS (SELECT vec_id AS i, vec_id AS j FROM embeddings UNION SELECT r.i, l.j FROM reach r JOIN links l ON r.j = l.i)
        SELECT r.i AS vec_id, cast(coalesce(d.n, 0) AS bigint) AS n_links, r.component_id, r.i = r.component_id AS kept
        FROM (SELECT i, min(j) AS component_id FROM reach GROUP BY i) r LEFT JOIN (SELECT i, count(*) AS n FROM links GROUP BY i) d ON r.i = d.i""",
}
