"""The business rules as data: a registry of predicates over the text fields of a record, each one native column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrears_class, blank, strict_date, strict_int, strict_number

#: Severities, the worst first; only the first one rejects.
SEVERITIES = ("BLOQUANT", "MAJEUR", "MINEUR")
RANK = {"BLOQUANT": 3, "MAJEUR": 2, "MINEUR": 1}


@dataclass(frozen=True)
class Rule:
    """A rule of one entity. `broken`, `field` and `remedy` make columns over the entity's fields and its context."""

    code: str
    label: str
    severity: str
    entity: str
    fields: tuple[str, ...]
    broken: Callable[[], Column]
    remedy: Callable[[], Column]
    field: Callable[[], Column] | None = None


def _c(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _bad(name: str, parse: Callable[[Column], Column]) -> Column:
    return (_c(name) != "") & parse(_c(name)).isNull()


def _first_bad(parse: Callable[[Column], Column], first: str, second: str) -> Callable[[], Column]:
    return lambda: F.when(_bad(first, parse), F.lit(first)).otherwise(F.lit(second))


def _age() -> Column:
    return F.datediff(F.col("date_reference"), strict_date(_c("date_naissance"))) / F.lit(365.25)


def _says(*parts: str | Column) -> Callable[[], Column]:
    return lambda: F.concat(*[F.lit(p) if not p.startswith("=") else F.concat(F.lit("« "), _c(p[1:]), F.lit(" »")) for p in parts])


def _over(a: Column, b: Column) -> Column:
    """a > b as for numbers of which none is NaN; NaN exceeds nothing."""
    return (a > b) & ~F.isnan(a)


#: Codes, severities, entities, fields and their order. The words are this package's own.
RULES: tuple[Rule, ...] = (
    Rule("E001", "Nom ou raison sociale absent", "BLOQUANT", "emprunteur", ("nom", "raison_sociale"), lambda: F.when(F.col("type_personne") == "PP", blank(F.col("nom"))).otherwise(blank(F.col("raison_sociale"))), _says("Renseigner le nom (PP) ou la raison sociale, reçu vide pour ", "=id_emprunteur_source"), lambda: F.when(F.col("type_personne") == "PP", "nom").otherwise("raison_sociale")),
    Rule("E002", "Date illisible", "BLOQUANT", "emprunteur", ("date_naissance",), lambda: _bad("date_naissance", strict_date), _says("Écrire la date de naissance année-mois-jour, reçu ", "=date_naissance")),
    Rule("E010", "Numéro de pièce mal formé", "MAJEUR", "emprunteur", ("numero_piece",), lambda: (_c("numero_piece") != "") & ~F.col("numero_piece").rlike(r"\A[A-Z]{2}-[A-Z]+-\p{Nd}{8}\z"), _says("Pièce attendue comme NE-CNI-12345678, reçu ", "=numero_piece")),
    Rule("E011", "Âge invraisemblable", "MAJEUR", "emprunteur", ("date_naissance",), lambda: (_age() < 18) | (_age() > 100), _says("Âge hors de 18 à 100 ans d'après ", "=date_naissance")),
    Rule("E014", "Téléphone mal formé", "MINEUR", "emprunteur", ("telephone",), lambda: (_c("telephone") != "") & ~F.col("telephone").rlike(r"\A\+\p{Nd}{3}\p{Nd}{8}\z"), _says("Téléphone attendu comme +22712345678, reçu ", "=telephone")),
    Rule("E015", "NIF absent", "MAJEUR", "emprunteur", ("nif",), lambda: (F.col("type_personne") == "PM") & blank(F.col("nif")), _says("Une personne morale déclare son NIF, reçu vide pour ", "=id_emprunteur_source")),
    Rule("E002", "Date illisible", "BLOQUANT", "contrat", ("date_octroi", "date_echeance"), lambda: _bad("date_octroi", strict_date) | _bad("date_echeance", strict_date), _says("Écrire les dates année-mois-jour, reçu ", "=date_octroi", " et ", "=date_echeance"), _first_bad(strict_date, "date_octroi", "date_echeance")),
    Rule("E003", "Montant illisible", "BLOQUANT", "contrat", ("montant_octroye", "encours"), lambda: _bad("montant_octroye", strict_number) | _bad("encours", strict_number), _says("Écrire les montants en chiffres, reçu ", "=montant_octroye", " et ", "=encours"), _first_bad(strict_number, "montant_octroye", "encours")),
    Rule("E004", "Encours négatif", "BLOQUANT", "contrat", ("encours",), lambda: strict_number(_c("encours")) < 0, _says("Un encours n'est pas négatif, reçu ", "=encours")),
    Rule("E005", "Encours au-delà de l'octroi", "MAJEUR", "contrat", ("encours", "montant_octroye"), lambda: _over(strict_number(_c("encours")), strict_number(_c("montant_octroye"))), _says("Encours ", "=encours", " au-delà du montant octroyé ", "=montant_octroye")),
    Rule("E006", "Devise refusée", "MAJEUR", "contrat", ("devise",), lambda: _c("devise") != "XOF", _says("Déclarer en XOF, reçu ", "=devise")),
    Rule("E007", "Échéance avant l'octroi", "BLOQUANT", "contrat", ("date_octroi", "date_echeance"), lambda: strict_date(_c("date_echeance")) < strict_date(_c("date_octroi")), _says("Échéance ", "=date_echeance", " avant l'octroi ", "=date_octroi"), lambda: F.lit("date_echeance")),
    Rule("E008", "Emprunteur absent du fichier", "BLOQUANT", "contrat", ("id_emprunteur_source",), lambda: ~F.col("known"), _says("Déclarer dans le même fichier l'emprunteur ", "=id_emprunteur_source")),
    Rule("E009", "Contrat en double", "BLOQUANT", "contrat", ("id_contrat_source",), lambda: F.col("nth") > 1, _says("Le fichier a déjà un contrat ", "=id_contrat_source")),
    Rule("E012", "Classe incohérente", "MAJEUR", "contrat", ("classification", "jours_retard"), lambda: arrears_class(strict_int(_c("jours_retard"))) != _c("classification"), _says("Classe ", "=classification", " pour un retard en jours de ", "=jours_retard")),
    Rule("E013", "Déclarant inconnu", "BLOQUANT", "entete", ("code_declarant",), lambda: ~F.col("registered"), _says("Code de déclarant hors du registre, reçu ", "=code_declarant")),
)


def rules_for(entity: str) -> tuple[Rule, ...]:
    return tuple(r for r in RULES if r.entity == entity)


def catalogue() -> list[tuple[str, str, str, str]]:
    """(code, label, severity, entities) by code; a code's entities stand in the registry's order."""
    out: dict[str, tuple[str, str, str, str]] = {}
    for r in RULES:
        before = out.get(r.code)
        out[r.code] = (r.code, r.label, r.severity, r.entity) if before is None else (*before[:3], before[3] if r.entity in before[3] else f"{before[3]}, {r.entity}")
    return [out[c] for c in sorted(out)]


def findings(records: DataFrame, entity: str, ident: str | Column, keys: list[str]) -> DataFrame:
    """(keys, entite, identifiant, champ, code, severite, valeur_recue, message): one row for each rule that a record breaks,
    in one narrow pass. records has the entity's fields, its keys and its context (date_reference; known, nth; registered)."""

    def finding(r: Rule) -> Column:
        field = r.field() if r.field else F.lit(r.fields[0])
        value = F.coalesce(*[F.when(field == f, _c(f)) for f in r.fields])
        return F.when(F.coalesce(r.broken(), F.lit(False)), F.struct(field.alias("champ"), F.lit(r.code).alias("code"), F.lit(r.severity).alias("severite"), value.alias("valeur_recue"), r.remedy().alias("message")))

    found = F.filter(F.array(*[finding(r) for r in rules_for(entity)]), lambda x: x.isNotNull())
    who = F.col(ident) if isinstance(ident, str) else ident
    # The outer form keeps Spark from adding a filter on the array, which would work out every rule twice.
    return records.select(*keys, F.lit(entity).alias("entite"), who.alias("identifiant"), F.inline_outer(found)).where("code IS NOT NULL")


def rank(entity: str) -> Column:
    """The worst severity that a record's rules give: 3, 2, 1, or 0 for none."""
    return F.greatest(F.lit(0), *[F.when(F.coalesce(r.broken(), F.lit(False)), RANK[r.severity]).otherwise(0) for r in rules_for(entity)])
