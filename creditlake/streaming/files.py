"""Declarations as they arrive: each micro-batch of files is validated and loaded; late and repeated files add nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validation import validate
from ..sources import declarations as decl


def start(spark: SparkSession, incoming: str, table: str, checkpoint: str, registry: DataFrame):
    """A query that loads what validation accepts of files dropped in a folder, once for everything that is there.

    Rules look at one file at a time, so a batch's files are judged as they would be together. The load is a check, then an
    append: one such query a table. A batch that runs again finds its own rows there and adds none."""
    files = spark.readStream.format("text").schema("value string").option("wholetext", True).load(incoming)
    files = files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))

    def batch(df: DataFrame, _: int) -> None:
        parsed = decl.parse(df)
        accepted = validate(decl.headers(parsed), decl.borrowers(parsed), decl.contracts(parsed), registry, ["file"]).loadable()[1]
        decl.load(decl.typed(accepted), table, ["declarant", "id_contrat_source", "date_arrete"], ["file", "pos"])

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
