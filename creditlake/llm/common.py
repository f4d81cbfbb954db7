"""What the operators share: folders that all executors see, bounded Arrow batches, file access by URI."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_unset: list[str] = []


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder's URI below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is unset and the master is local, as in tests, a folder of this machine stands in for it; on a
    cluster its executors would each write to their own disk, so there an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _unset:
            _unset.append("file://" + tempfile.mkdtemp(prefix="creditlake-"))
        base = _unset[0]
    base = base if "://" in base or base.startswith("file:") else f"file://{base}"
    return f"{base.rstrip('/')}/creditlake/{tag}-{uuid.uuid4().hex}"


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that materialize() made and that no later read needs."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch to Python in this session, from now on, as frames are run after they are returned:
    ten thousand texts of a few kilobytes a batch cost each executor some 300 MB. A smaller bound stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path of a URI: file, hdfs, s3 and gs all work, as long as all machines reach it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def one_row_each(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of docs without the ids in `gone`, one of each other id, and all without id."""
    nth = free_name(docs, "nth")
    order = F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col), text_col))
    kept = docs.where(F.col(id_col).isNotNull()).join(gone, id_col, "left_anti").withColumn(nth, order).where(F.col(nth) == 1)
    return kept.select(*docs.columns).unionAll(docs.where(F.col(id_col).isNull()))


def components_of(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable position for each of n positions under the edges (i, j); label: a start that is refined."""
    label = np.arange(n) if label is None else label
    while len(i):
        a, b = label[i], label[j]
        np.minimum.at(label, a, b)
        np.minimum.at(label, b, a)
        while not np.array_equal(up := label[label], label):
            label = up
        left = label[i] != label[j]
        i, j = i[left], j[left]
    return label
