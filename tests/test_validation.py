import pytest

from creditlake.operators import rules
from creditlake.operators.validation import code_of, validate
from creditlake.sources import declarations as decl
from creditlake.sources import generator

LENDERS = [("BQ000001",), ("BQ000002",)]
BORROWER = dict.fromkeys(decl.BORROWER, "") | {"id_emprunteur_source": "EMP000001", "type_personne": "PP", "nom": "Issoufou", "prenom": "Awa", "date_naissance": "1985-04-12", "numero_piece": "NE-CNI-12345678", "telephone": "+22790123456"}
CONTRACT = {
    "id_contrat_source": "CNT000001", "id_emprunteur_source": "EMP000001", "type_credit": "court_terme", "date_octroi": "2025-01-15", "date_echeance": "2026-01-15", "montant_octroye": "1000000.00", "devise": "XOF", "taux_interet": "8.50",
    "periodicite": "mensuelle", "type_garantie": "aucune", "montant_garantie": "0.00", "date_arrete": "2025-07-31", "encours": "400000.00", "montant_impaye": "0.00", "jours_retard": "0", "classification": "sain",
}


def xml(spark, borrowers=None, contracts=None, header=None):
    borrowers, contracts = borrowers if borrowers is not None else [BORROWER], contracts if contracts is not None else [CONTRACT]
    head = {"code_declarant": "BQ000001", "date_arrete": "2025-07-31", "nombre_enregistrements": "2", "horodatage": "2025-08-01T00:00:00"} | (header or {})
    schema = f"file string, entete {decl._struct(decl.HEADER)}, emprunteurs array<{decl._struct(decl.BORROWER)}>, contrats array<{decl._struct(decl.CONTRACT)}>"
    return decl.to_xml(spark.createDataFrame([("BQ000001_20250731.xml", head, borrowers, contracts)], schema))


def run(spark, files):
    parsed = decl.parse(files)
    return validate(decl.headers(parsed), decl.borrowers(parsed), decl.contracts(parsed), spark.createDataFrame(LENDERS, "code_declarant string"), ["file"])


def codes(v):
    return sorted((r["entite"], r["code"], r["champ"]) for r in v.findings.collect())


def report(v):
    r = v.reports().first()
    return r["acceptes"], r["reserves"], r["rejetes"], r["fichier_rejete"]


def test_a_clean_file_is_accepted(spark):
    v = run(spark, xml(spark))
    assert codes(v) == [] and report(v) == (1, 0, 0, False) and v.reports().first()["taux"] == 1.0


@pytest.mark.parametrize(
    ("change", "want", "counts"),
    [
        ({"encours": "-50000.00"}, [("contrat", "E004", "encours")], (0, 0, 1, False)),
        ({"devise": "EUR"}, [("contrat", "E006", "devise")], (0, 1, 0, False)),
        ({"encours": "1500000.00"}, [("contrat", "E005", "encours")], (0, 1, 0, False)),
        ({"id_emprunteur_source": "EMP999999"}, [("contrat", "E008", "id_emprunteur_source")], (0, 0, 1, False)),
        ({"jours_retard": "120"}, [("contrat", "E012", "classification")], (0, 1, 0, False)),
        ({"date_octroi": "31/02/2024"}, [("contrat", "E002", "date_octroi")], (0, 0, 1, False)),
        ({"montant_octroye": "1_000.5e3"}, [], (1, 0, 0, False)),
        ({"encours": "N/A"}, [("contrat", "E003", "encours")], (0, 0, 1, False)),
        ({"date_echeance": "2024-12-01"}, [("contrat", "E007", "date_echeance")], (0, 0, 1, False)),
        ({"type_credit": "prive"}, [("fichier", "E000", "?")], (0, 0, 0, True)),
    ],
)
def test_contract_rules_through_xml(spark, change, want, counts):
    v = run(spark, xml(spark, contracts=[CONTRACT | change]))
    assert codes(v) == want and report(v) == counts


def test_borrower_rules_through_xml(spark):
    people = [BORROWER, BORROWER | {"id_emprunteur_source": "E2", "nom": "  "}, BORROWER | {"id_emprunteur_source": "E3", "type_personne": "PM", "date_naissance": "", "numero_piece": ""}, BORROWER | {"id_emprunteur_source": "E4", "date_naissance": "1990-02-30", "numero_piece": "x", "telephone": "06"}, BORROWER | {"id_emprunteur_source": "E5", "date_naissance": "2020-01-01"}]
    v = run(spark, xml(spark, borrowers=people))
    got = sorted((r["identifiant"], r["code"], r["champ"], r["valeur_recue"]) for r in v.findings.collect())
    assert got == [("E2", "E001", "nom", "  "), ("E3", "E001", "raison_sociale", ""), ("E3", "E015", "nif", ""), ("E4", "E002", "date_naissance", "1990-02-30"), ("E4", "E010", "numero_piece", "x"), ("E4", "E014", "telephone", "06"), ("E5", "E011", "date_naissance", "2020-01-01")]
    assert report(v) == (1, 0, 0, False)  # a borrower's findings reject no contract


def test_unknown_lender_rejects_the_file(spark):
    v = run(spark, xml(spark, header={"code_declarant": "ZZ999999"}))
    assert codes(v) == [("entete", "E013", "code_declarant")] and report(v) == (0, 0, 1, True)
    assert v.loadable()[1].count() == 0


def test_duplicates_share_a_decision(spark):
    v = run(spark, xml(spark, contracts=[CONTRACT, CONTRACT, CONTRACT | {"id_contrat_source": "C2"}]))
    assert codes(v) == [("contrat", "E009", "id_contrat_source")]
    assert sorted(r["decision"] for r in v.contracts.collect()) == ["ACCEPTE", "REJETE", "REJETE"]


def test_a_later_structural_error_is_a_finding(spark):
    v = run(spark, xml(spark, contracts=[CONTRACT | {"devise": "EUR"}, CONTRACT | {"id_contrat_source": "C2", "periodicite": "jamais"}]))
    assert codes(v) == [("contrat", "E006", "devise"), ("fichier", "E000", "?")] and report(v) == (1, 1, 0, False)


def test_malformed_and_empty_files(spark):
    bad = spark.createDataFrame([("bad.xml", "<declaration><entete>")], "file string, content string")
    v = run(spark, bad)
    assert codes(v) == [("fichier", "E000", "?")]
    r = v.reports().first()
    assert (r["declarant"], r["contrats"], r["emprunteurs"], r["fichier_rejete"], r["taux"]) == ("?", 0, 0, True, 0.0)
    v = run(spark, xml(spark, borrowers=[], contracts=[]))
    assert codes(v) == [] and report(v) == (0, 0, 0, False)
    v = run(spark, bad.limit(0))
    assert codes(v) == [] and v.reports().count() == 0


def test_structural_codes():
    assert [code_of(e, f) for e, f in (("encours", True), ("encours", False), ("montant_octroye", True), ("devise", False), ("type_credit", True), ("date_octroi", False))] == ["E004", "E003", "E003", "E006", "E000", "E002"]


def test_load_takes_what_is_accepted(spark, tmp_path):
    """An accepted contract and its borrower are loaded, once; a rejected one isn't; empty texts are null, values typed."""
    v = run(spark, xml(spark, borrowers=[BORROWER, BORROWER | {"id_emprunteur_source": "E2"}], contracts=[CONTRACT, CONTRACT | {"id_contrat_source": "C2", "id_emprunteur_source": "E2", "encours": "-1000.00"}]))
    people, loans = v.loadable()
    for _ in range(2):
        decl.load(decl.typed(loans), f"file://{tmp_path}/contracts", ["declarant", "id_contrat_source", "date_arrete"], ["file", "pos"])
        decl.load(decl.emptied(people), f"file://{tmp_path}/borrowers", ["declarant", "id_emprunteur_source"], ["file", "pos"])
    c = spark.read.parquet(f"{tmp_path}/contracts").collect()
    assert [(r["id_contrat_source"], float(r["encours"]), str(r["date_octroi"]), r["jours_retard"]) for r in c] == [("CNT000001", 400000.0, "2025-01-15", 0)]
    b = spark.read.parquet(f"{tmp_path}/borrowers").collect()
    assert [(r["id_emprunteur_source"], r["nom"], r["raison_sociale"]) for r in b] == [("EMP000001", "Issoufou", None)]


def test_generated_files_round_trip(spark):
    """Generate, assemble, corrupt, export, parse and validate: clean files have no findings, corrupted ones their own."""
    people = generator.borrowers(spark, 80, 5)
    clean = generator.assemble(people, generator.snapshots(generator.contracts(people, 120, 80, 5), 5))
    registry = generator.lenders(spark).select("code_declarant")
    parsed = decl.parse(generator.xml_files(clean)).persist()
    v = validate(decl.headers(parsed), decl.borrowers(parsed), decl.contracts(parsed), registry, ["file"])
    assert v.findings.where("code <> 'E011'").count() == 0 and v.contracts.count() == clean.contracts.count()
    head = decl.headers(parsed).selectExpr("sum(cast(nombre_enregistrements AS int)) AS n").first()["n"]
    assert head == clean.contracts.count() + clean.borrowers.count()
    parsed.unpersist()
    bad, truth = generator.inject(clean, 5)
    w = validate(bad.headers, bad.borrowers, bad.contracts, registry, generator.KEYS)
    found = {(r["entite"], r["identifiant"], r["champ"], r["code"]) for r in w.findings.collect()}
    log = {(r["entite"], r["ligne"], r["champ"], r["code"]) for r in truth.collect()}
    assert {c for *_, c in log} >= {"E002", "E009", "E013"} and len(log & found) > 0.8 * len(log)


def test_catalogue_and_rules_by_entity():
    assert [c for c, *_ in rules.catalogue()] == [f"E{k:03}" for k in range(1, 16)]
    assert dict((c, e) for c, _, _, e in rules.catalogue())["E002"] == "emprunteur, contrat"
    assert len(rules.rules_for("contrat")) == 9 and len(rules.RULES) == 16


def test_files_that_arrive_are_validated_and_loaded_once(spark, tmp_path):
    from creditlake.streaming import files

    (tmp_path / "in").mkdir()
    registry = spark.createDataFrame(LENDERS, "code_declarant string")

    def drop(name, **change):
        (tmp_path / "in" / name).write_text(xml(spark, contracts=[CONTRACT | change]).first()["content"])
        files.start(spark, f"{tmp_path}/in", f"file://{tmp_path}/table", f"{tmp_path}/state", registry).awaitTermination()
        return sorted(r["id_contrat_source"] for r in spark.read.parquet(f"{tmp_path}/table").collect())

    assert drop("BQ000001_20250731.xml") == ["CNT000001"]
    assert drop("BQ000001_20250732.xml") == ["CNT000001"]  # the same contract and month again
    assert drop("BQ000001_20250733.xml", id_contrat_source="C2", encours="-1.00") == ["CNT000001"]  # rejected
    assert drop("BQ000001_20250734.xml", id_contrat_source="C3") == ["C3", "CNT000001"]
