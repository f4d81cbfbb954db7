"""Validation of declarations: structural checks, rules, decisions and reports, as one dataflow over any number of files.

A file is known by its keys. Three frames hold what all files declare, every field text: headers (keys, sender, header
fields), borrowers and contracts (keys, pos, fields). A missing element is null, an empty one ''.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strict_date
from ..sources.declarations import BORROWER, CONTRACT, HEADER
from . import rules

# The format's enumerations, and the rule code that stands for a structural error of an element, for a value
# that can't be read and for one that breaks a facet (range, pattern, enumeration).
ENUMERATIONS = {
    "type_personne": ("PP", "PM"),
    "devise": ("XOF",),
    "type_credit": ("court_terme", "moyen_terme", "long_terme", "decouvert", "credit_bail", "engagement_signature"),
    "periodicite": ("mensuelle", "trimestrielle", "semestrielle", "annuelle", "in_fine"),
    "type_garantie": ("hypotheque", "nantissement", "caution", "gage", "aucune"),
    "classification": ("sain", "sensible", "douteux", "contentieux"),
}
LEXICAL = {
    "date_naissance": "E002",
    "date_octroi": "E002",
    "date_echeance": "E002",
    "date_arrete": "E002",
    "montant_octroye": "E003",
    "encours": "E003",
    "montant_impaye": "E003",
    "taux_interet": "E003",
    "montant_garantie": "E003",
}
FACET = {"encours": "E004", "devise": "E006", "numero_piece": "E010", "telephone": "E014"}
#: So many files at most, of some 100 bytes each, are broadcast; beyond, records and files meet by a shuffle.
FEW_FILES = 100_000
AMOUNTS = ("montant_octroye", "montant_garantie", "encours", "montant_impaye")
DATES = ("date_octroi", "date_echeance", "date_arrete")


def code_of(element: str, facet: bool) -> str:
    """Facet errors by the facet table, then lexical ones, then the facet table, else E000."""
    return (FACET.get(element) if facet else None) or LEXICAL.get(element) or FACET.get(element, "E000")


def _xml_date(x: Column) -> Column:
    """Whether a text is an xs:date: blanks around it and a time zone are allowed."""
    day = F.regexp_extract(x, r"\A\s*(\d{4}-\d{2}-\d{2})(Z|[+-]\d{2}:\d{2})?\s*\z", 1)
    return F.try_to_date(F.nullif(day, F.lit("")), "yyyy-MM-dd").isNotNull()


def _checks(element: str) -> list[tuple[bool, Column]]:
    """(whether it is a facet, whether the value breaks it) for an element; the first that holds counts."""
    v = F.col(element)
    if element in ENUMERATIONS:
        return [(True, ~v.isin(*ENUMERATIONS[element]))]
    if element == "date_naissance":
        return [(False, (v != "") & ~_xml_date(v))]
    if element in DATES:
        return [(False, ~_xml_date(v))]
    if element in AMOUNTS:
        return [(False, ~v.rlike(r"\A\s*[+-]?(\d+(\.\d*)?|\.\d+)\s*\z")), (True, (v.rlike(r"\A\s*-") & v.rlike("[1-9]")) | v.rlike(r"\.\d{2}\d*[1-9]"))]
    if element == "taux_interet":
        return [(False, ~v.rlike(r"\A\s*[+-]?(\d+(\.\d*)?|\.\d+)\s*\z"))]
    if element in ("jours_retard", "nombre_enregistrements"):
        return [(False, ~v.rlike(r"\A\s*(\+?\d+|-0+)\s*\z"))]
    if element == "numero_piece":
        return [(True, ~v.rlike(r"\A([A-Z]{2}-[A-Z]+-\p{Nd}{8})?\z"))]
    if element == "telephone":
        return [(True, ~v.rlike(r"\A\+\p{Nd}{3}\p{Nd}{8}\z"))]
    if element == "code_declarant":
        return [(True, v == "")]
    return []


def _broken(names: list[str]) -> Column:
    """(ord, element, code) of each element of a record that breaks its type or is missing, in order."""

    def error(k: int, element: str) -> Column:
        at = lambda code: F.struct(F.lit(k).alias("ord"), F.lit(element).alias("element"), F.lit(code).alias("code"))
        out = F.when(F.col(element).isNull(), at("E000"))
        for facet, broken in _checks(element):
            out = out.when(broken, at(code_of(element, facet)))
        return out

    return F.filter(F.array(*[error(k, n) for k, n in enumerate(names)]), lambda x: x.isNotNull())


def _first_code(names: list[str]) -> Column:
    """The code of a record's first structural error, null without any; one plain expression, so that it is compiled."""
    each = []
    for element in names:
        code = F.when(F.col(element).isNull(), "E000")
        for facet, broken in _checks(element):
            code = code.when(broken, code_of(element, facet))
        each.append(code)
    return F.coalesce(*each)


def _sections(headers: DataFrame, borrowers: DataFrame, contracts: DataFrame, keys: list[str], name: str, of: Callable[[list[str]], Column]) -> DataFrame:
    """(keys, section, pos, name) of every record. Nothing filters on `name` here: a filter would work it out twice."""
    out = None
    for k, (df, names) in enumerate(((headers.where("NOT malformed").withColumn("pos", F.lit(0).cast("long")), HEADER), (borrowers, BORROWER), (contracts, CONTRACT))):
        rows = df.select(*keys, F.lit(k).alias("section"), F.col("pos").cast("long").alias("pos"), of(names).alias(name))
        out = rows if out is None else out.unionAll(rows)
    return out


@dataclass(frozen=True)
class Validated:
    """errors: structural ones in document order (section, pos, ord). findings: what the report of each file shows.
    files: one row each, with the sender, whether the structure holds and whether the header is vetoed. contracts: the
    records of files whose structure holds, with decision; borrowers: the records of these files."""

    errors: DataFrame
    findings: DataFrame
    files: DataFrame
    contracts: DataFrame
    borrowers: DataFrame
    keys: list[str]

    def reports(self) -> DataFrame:
        """Counters of each file. A file whose structure fails has an unknown sender and counts nothing."""
        k = self.keys
        one = lambda d: F.count_if(F.col("decision") == d)
        c = self.contracts.groupBy(*k).agg(F.count("*").alias("contrats"), one("ACCEPTE").alias("acceptes"), one("ACCEPTE_AVEC_RESERVE").alias("reserves"), one("REJETE").alias("rejetes"))
        b = self.borrowers.groupBy(*k).agg(F.count("*").alias("emprunteurs"))
        out = self.files.select(*k, "declarant", "sound", "vetoed").join(b, k, "left").join(c, k, "left")
        n = {x: F.coalesce(x, F.lit(0)) for x in ("emprunteurs", "contrats", "acceptes", "reserves", "rejetes")}
        rate = F.when(n["contrats"] > 0, (n["acceptes"] + n["reserves"]) / n["contrats"]).otherwise(0.0)
        return out.select(*k, F.when(F.col("sound"), F.col("declarant")).otherwise("?").alias("declarant"), *[v.alias(x) for x, v in n.items()], rate.alias("taux"), (~F.col("sound") | F.col("vetoed")).alias("fichier_rejete"))

    def loadable(self) -> tuple[DataFrame, DataFrame]:
        """(borrowers, contracts) to load: contracts that aren't rejected, and the borrowers that such a contract names."""
        c = self.contracts.where("decision <> 'REJETE'")
        return self.borrowers.join(c.select(*self.keys, "id_emprunteur_source").distinct(), [*self.keys, "id_emprunteur_source"], "left_semi"), c


def validate(headers: DataFrame, borrowers: DataFrame, contracts: DataFrame, registry: DataFrame, keys: list[str], date_reference: str | None = None, save: Callable[[DataFrame], DataFrame] = lambda df: df) -> Validated:
    """headers: (keys, declarant, malformed, header fields); registry: (code_declarant), distinct.

    The reference date of a file is date_reference, else its header's date; without either ages are not judged. A file that
    isn't XML, or whose first structural error has no rule code, is rejected whole: one E000 finding and no counters. Other
    structural errors are findings only where no rule covers them. A finding that rejects counts for all records of the file
    with the same identifier, borrowers and contracts alike; a header finding that rejects, for all records of the file.
    Repeated rows are rows of their own, as in a file. Empty frames give empty ones.
    save: stores the frame of files, one small row each, which all others are joined with.
    """
    errors = _sections(headers, borrowers, contracts, keys, "errors", _broken).select(*keys, "section", "pos", F.inline_outer("errors")).where("code IS NOT NULL")
    first = _sections(headers, borrowers, contracts, keys, "code", _first_code)
    gate = first.groupBy(*keys).agg(F.min_by("code", F.when(F.col("code").isNotNull(), F.struct("section", "pos"))).alias("first_code"))
    files = headers.join(registry.select("code_declarant", F.lit(True).alias("registered")), "code_declarant", "left").join(gate, keys, "left")
    files = files.withColumn("registered", F.coalesce("registered", F.lit(False))).withColumn("sound", ~F.col("malformed") & F.coalesce(F.col("first_code") != "E000", F.lit(True)))
    reference = F.lit(date_reference).cast("date") if date_reference else strict_date(F.coalesce("date_arrete", F.lit("")))
    files = save(files.withColumn("date_reference", reference).withColumn("vetoed", F.col("sound") & ~F.col("registered")))
    sound = files.where("sound").select(*keys, "date_reference", "vetoed")
    if files.limit(FEW_FILES + 1).count() <= FEW_FILES:
        sound = F.broadcast(sound)

    people = borrowers.join(sound, keys)
    known = people.select(*keys, "id_emprunteur_source").distinct().withColumn("known", F.lit(True))
    loans = contracts.join(sound, keys).drop("date_reference").join(known, [*keys, "id_emprunteur_source"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    same = Window.partitionBy(*keys, "id_contrat_source")
    loans = loans.withColumn("nth", F.row_number().over(same.orderBy("pos")))

    by_borrower = rules.findings(people, "emprunteur", "id_emprunteur_source", keys)
    by_contract = rules.findings(loans, "contrat", "id_contrat_source", keys)
    by_header = rules.findings(files.where("sound"), "entete", "declarant", keys)
    unread = lambda df: df.select(*keys, F.lit("fichier").alias("entite"), F.lit("?").alias("identifiant"), F.lit("?").alias("champ"), F.lit("E000").alias("code"), F.lit("BLOQUANT").alias("severite"), F.lit("").alias("valeur_recue"), "message")
    whole = unread(files.where("NOT sound").withColumn("message", F.when(F.col("malformed"), "Le fichier n'est pas du XML bien formé").otherwise("La structure du fichier n'est pas celle du format")))
    left = unread(errors.where("code = 'E000'").join(sound, keys).withColumn("message", F.concat(F.lit("Structure à corriger à l'élément "), F.col("element"))))
    found = whole.unionByName(left).unionByName(by_header).unionByName(by_borrower).unionByName(by_contract)

    # All contracts with one identifier share a decision; a borrower's findings count where the identifier is the same text.
    theirs = people.select(*keys, F.col("id_emprunteur_source").alias("id_contrat_source"), rules.rank("emprunteur").alias("other")).groupBy(*keys, "id_contrat_source").agg(F.max("other").alias("other"))
    ranked = loans.withColumn("rank", F.max(rules.rank("contrat")).over(same)).drop("known", "nth").join(theirs, [*keys, "id_contrat_source"], "left")
    worst = F.greatest("rank", F.coalesce("other", F.lit(0)))
    decision = F.when(F.col("vetoed") | (worst == 3), "REJETE").when(worst > 0, "ACCEPTE_AVEC_RESERVE").otherwise("ACCEPTE")
    return Validated(errors, found, files, ranked.withColumn("decision", decision).drop("rank", "other", "vetoed"), people.drop("date_reference", "vetoed"), keys)
