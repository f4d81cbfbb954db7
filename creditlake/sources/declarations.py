"""Declaration files in XML: scan with a fixed schema, write, and load of accepted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strict_date, strict_int, strict_number

# Element names of the file format, in its order.
BORROWER = "id_emprunteur_source type_personne nom prenom raison_sociale date_naissance sexe type_piece numero_piece nif telephone ville pays".split()
CONTRACT = "id_contrat_source id_emprunteur_source type_credit date_octroi date_echeance montant_octroye devise taux_interet periodicite type_garantie montant_garantie date_arrete encours montant_impaye jours_retard classification".split()
HEADER = "code_declarant date_arrete nombre_enregistrements horodatage".split()


def _struct(names: list[str]) -> str:
    return "struct<" + ", ".join(f"{n}: string" for n in names) + ">"


SCHEMA = f"entete {_struct(HEADER)}, emprunteurs struct<emprunteur: array<{_struct(BORROWER)}>>, contrats struct<contrat: array<{_struct(CONTRACT)}>>, _corrupt_record string"


def parse(files: DataFrame) -> DataFrame:
    """(file, d, malformed) of (file, content): text kept untrimmed, '' for empty and null for missing elements. The
    sender is known from the file's name; the header's code stands in for it."""
    d = F.from_xml("content", SCHEMA, {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"})
    out = files.withColumn("d", d)
    sender = F.nullif(F.regexp_extract("file", r"([^/_]+)_\d{8}\.xml$", 1), F.lit(""))
    bad = F.col("d._corrupt_record").isNotNull() | F.col("d.entete").isNull()
    return out.select("file", "d", bad.alias("malformed"), F.when(bad, F.lit("?")).otherwise(F.coalesce(sender, F.nullif("d.entete.code_declarant", F.lit("")))).alias("declarant"))


def scan(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("text").option("wholetext", True).load(path)
    return parse(files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content")))


def contracts(parsed: DataFrame) -> DataFrame:
    """One row for each contract with its place in the file, which duplicate rules need."""
    return parsed.where("NOT malformed").select("file", "declarant", F.posexplode("d.contrats.contrat").alias("pos", "c")).select("file", "declarant", "pos", "c.*")


def borrowers(parsed: DataFrame) -> DataFrame:
    return parsed.where("NOT malformed").select("file", "declarant", F.posexplode("d.emprunteurs.emprunteur").alias("pos", "e")).select("file", "declarant", "pos", "e.*")


def headers(parsed: DataFrame) -> DataFrame:
    """(file, declarant, malformed, header fields) of every file; a malformed one has null fields."""
    return parsed.select("file", "declarant", "malformed", *[F.when(~F.col("malformed"), F.col(f"d.entete.{n}")).alias(n) for n in HEADER])


def typed(contracts: DataFrame) -> DataFrame:
    """Contracts as the tables hold them: '' is null, dates, amounts of two decimals and day counts have their types. What
    can't be read is null; rules reject such contracts before. Columns that aren't there are left out."""
    dates, amounts = ("date_octroi", "date_echeance", "date_arrete"), ("montant_octroye", "taux_interet", "montant_garantie", "encours", "montant_impaye")
    kinds = {n: strict_date(F.col(n)) for n in dates} | {n: strict_number(F.col(n)).cast("decimal(18,2)") for n in amounts} | {"jours_retard": strict_int(F.col("jours_retard")).cast("int")}
    text = lambda n: F.nullif(F.col(n), F.lit("")) if n in CONTRACT else F.col(n)
    return contracts.select(*[(kinds[n] if n in kinds else text(n)).alias(n) for n in contracts.columns])


def emptied(borrowers: DataFrame) -> DataFrame:
    """Borrowers as the tables hold them: '' is null, the birth date is a date."""
    text = lambda n: F.nullif(F.col(n), F.lit("")) if n in BORROWER else F.col(n)
    return borrowers.select(*[(strict_date(F.col(n)) if n == "date_naissance" else text(n)).alias(n) for n in borrowers.columns])


def to_xml(files: DataFrame) -> DataFrame:
    """(file, content) of (file, entete, emprunteurs, contrats)."""
    return files.select("file", F.to_xml(F.struct("entete", F.struct(F.col("emprunteurs").alias("emprunteur")).alias("emprunteurs"), F.struct(F.col("contrats").alias("contrat")).alias("contrats")), {"rowTag": "declaration", "indent": ""}).alias("content"))


def new_rows(incoming: DataFrame, target: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows to append: the first of each key in the given order, where the target has none yet. First versions stay."""
    from pyspark.sql import Window

    first = incoming.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__nth = 1").drop("__nth")
    return first.join(target.select(*keys), keys, "left_anti")


def load(incoming: DataFrame, path: str, keys: list[str], order: list[str]) -> int:
    """Append the new rows to a Parquet table; a second load of the same rows adds none. Returns the rows added."""
    spark = incoming.sparkSession
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath):
        rows = new_rows(incoming, spark.read.parquet(path), keys, order)
    else:
        rows = new_rows(incoming, incoming.limit(0), keys, order)
    rows = rows.persist()
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    rows.unpersist()
    return n
