import json

from pyspark.sql import functions as F

from creditlake import cli
from creditlake.sources import generator as g


def test_borrowers_are_shared_and_repeatable(spark):
    people = g.borrowers(spark, 2000, 42)
    rows = people.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, g.borrowers(spark, 2000, 42).collect()))
    assert sorted(map(tuple, rows)) != sorted(map(tuple, g.borrowers(spark, 2000, 43).collect()))
    assert 2000 <= len(rows) <= 2150
    by = {}
    for r in rows:
        by.setdefault(r["identite"], []).append(r["l"])
    assert all(len(v) == len(set(v)) for v in by.values())
    assert 0.1 < sum(len(v) > 1 for v in by.values()) / len(by) < 0.2
    assert 0.75 < sum(r["type_personne"] == "PP" for r in rows) / len(rows) < 0.85


def test_grid_of_snapshots(spark):
    people = g.borrowers(spark, 300, 7)
    loans = g.contracts(people, 500, people.count(), 7)
    assert 430 < loans.count() < 570
    assert loans.where("cents NOT BETWEEN 20000000 AND 2500000000 OR garantie_c > cents * 1.2 + 1").count() == 0
    snaps = g.snapshots(loans, 7)
    assert snaps.where("date_arrete < date_octroi OR date_arrete > date_echeance OR encours_c < 0 OR encours_c > cents OR jours_retard > 365").count() == 0
    assert snaps.select("m").distinct().count() == 12
    assert snaps.where("jours_retard = 0 AND classification <> 'sain'").count() == 0
    late: dict = {}
    for r in snaps.orderBy("m").collect():
        late.setdefault((r["l"], r["id_contrat_source"]), []).append(r["jours_retard"])
    steps = [b - a for v in late.values() for a, b in zip([0, *v], v, strict=False) if b]
    assert steps and max(steps) <= 35 and sum(15 <= x for x in steps) > 0.9 * len(steps) and len(set(steps)) > 5
    assert 0.1 < sum(max(v) > 0 for v in late.values()) / len(late) < 0.3


def test_anomalies_follow_the_lender(spark):
    people = g.borrowers(spark, 1500, 42)
    clean = g.assemble(people, g.snapshots(g.contracts(people, 2500, people.count(), 42), 42))
    dirty, truth = g.inject(clean, 42)
    n = {r["l"]: r["n"] for r in clean.contracts.groupBy("l").agg(F.count("*").alias("n")).collect()}
    bad = {r["declarant"]: r["n"] for r in truth.where("entite = 'contrat' AND code <> 'E009'").groupBy("declarant").agg(F.count("*").alias("n")).collect()}
    for quality, rate in {"excellent": 0.01, "moyen": 0.08, "defaillant": 0.25}.items():
        mine = [(k, c) for k, (c, _, q) in enumerate(g.LENDERS) if q == quality]
        assert abs(sum(bad.get(c, 0) for _, c in mine) / sum(n[k] for k, _ in mine) - rate) < 0.02
    assert dirty.contracts.count() == clean.contracts.count() and dirty.borrowers.count() == clean.borrowers.count()
    codes = {(r["entite"], r["code"]) for r in truth.select("entite", "code").distinct().collect()}
    assert codes >= {("contrat", c) for c in g.CONTRACT_CODES} | {("emprunteur", c) for c in [*g.BORROWER_CODES, "E015"]} | {("entete", "E013"), ("contrat", "E009")}


def test_command_line(spark, tmp_path):
    made = cli.generate(spark, str(tmp_path / "made"), 60, 90, 1)
    assert made["contracts"].count() > 0 and (tmp_path / "made" / "declarations").exists()
    v = cli.check(spark, f"{tmp_path}/made/declarations", str(tmp_path / "checked"))
    assert v.contracts.count() <= made["contracts"].count()
    loaded = spark.read.parquet(f"{tmp_path}/checked/tables/contrats").count()
    assert loaded == v.loadable()[1].select("declarant", "id_contrat_source", "date_arrete").distinct().count()
    assert list((tmp_path / "checked" / "rejections-html").glob("*.html"))
    metrics = json.loads(cli.score(spark, "/root/testdata/sf0.001", str(tmp_path / "out"), borrower=1))
    assert set(metrics) == {"auc", "gini", "ks"} and (tmp_path / "out" / "metrics.json").exists()
