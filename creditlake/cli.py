"""Command line: `python -m creditlake.cli generate | check | score | pipeline`."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from . import queries
from .operators import reports
from .operators.validation import Validated, validate
from .sources import declarations as decl
from .sources import generator
from .sources.files import write_texts

#: Small aggregates of the dashboard: one row for each code, lender, month, band or bin.
DASHBOARD = ["q_global_totals", "q_lender_ranking", "q_top_errors", "q_severity_split", "q_monthly_grid", "q_completeness", "v_detection_recall", "i_pairwise_metrics", "i_cluster_sizes", "s_auc_ks", "s_selection", "s_bands", "s_histogram", "s_gains", "s_curve_sixty"]


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file by Spark's file systems, so that any URI works."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(text.encode())
    out.close()


def generate(spark: SparkSession, output: str, n_borrowers: int, n_contracts: int, seed: int) -> dict[str, DataFrame]:
    """A declaration in XML for each lender and month, and both ground truths as CSV. Returns the frames."""
    people = generator.borrowers(spark, n_borrowers, seed)
    snaps = generator.snapshots(generator.contracts(people, n_contracts, people.count(), seed), seed)
    declared, truth = generator.inject(generator.assemble(people, snaps), seed)
    write_texts(generator.xml_files(declared), f"{output}/declarations")
    truth.select("declarant", "entite", "ligne", "champ", "code").write.mode("overwrite").option("header", True).csv(f"{output}/truth-anomalies")
    generator.identity_truth(people).write.mode("overwrite").option("header", True).csv(f"{output}/truth-identities")
    return {"people": people, "contracts": declared.contracts, "truth": truth}


def check(spark: SparkSession, declarations: str, output: str, date_reference: str | None = None) -> Validated:
    """Validate the XML files of a folder: rejections by file as CSV and HTML, and load what is accepted, once."""
    parsed = decl.scan(spark, declarations)
    v = validate(decl.headers(parsed), decl.borrowers(parsed), decl.contracts(parsed), generator.lenders(spark).select("code_declarant"), ["file"], date_reference, queries._save(spark))
    reports.write_rejections(v, f"{output}/rejections")
    write_texts(reports.rejection_pages(v), f"{output}/rejections-html")
    people, loans = v.loadable()
    decl.load(decl.typed(loans), f"{output}/tables/contrats", ["declarant", "id_contrat_source", "date_arrete"], ["file", "pos"])
    decl.load(decl.emptied(people), f"{output}/tables/emprunteurs", ["declarant", "id_emprunteur_source"], ["file", "pos"])
    return v


def score(spark: SparkSession, tables: str, output: str, train: bool = False, borrower: int | None = None) -> str:
    """Scores as Parquet and the metrics auc, gini and ks as JSON; train: the fitted coefficients too; borrower: the page of
    one customer."""
    queries.QUERIES["s_score_woe"](spark, tables).write.mode("overwrite").parquet(f"{output}/scores")
    metrics = json.dumps(queries.QUERIES["s_auc_ks"](spark, tables).first().asDict())
    _write_text(spark, f"{output}/metrics.json", metrics)
    if train:
        queries.QUERIES["s_scorecard_fit"](spark, tables).write.mode("overwrite").parquet(f"{output}/model")
    if borrower is not None:
        _write_text(spark, f"{output}/solvency-{borrower}.html", reports.solvency_page(spark, tables, borrower))
    return metrics


def pipeline(spark: SparkSession, tables: str, output: str) -> str:
    """Rejections as CSV, scores, and the dashboard as JSON."""
    queries.QUERIES["q_rejections"](spark, tables).write.mode("overwrite").partitionBy("l", "m").option("header", True).csv(f"{output}/rejections")
    score(spark, tables, output)
    page = reports.dashboard({n: queries.QUERIES[n](spark, tables) for n in DASHBOARD})
    _write_text(spark, f"{output}/dashboard.json", page)
    return page


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="creditlake")
    commands = parser.add_subparsers(dest="command", required=True)
    g = commands.add_parser("generate")
    g.add_argument("--seed", type=int, default=42)
    g.add_argument("--n-borrowers", type=int, default=3000)
    g.add_argument("--n-contracts", type=int, default=5000)
    for name in ("score", "pipeline"):
        commands.add_parser(name).add_argument("--tables", required=True)
    commands.choices["score"].add_argument("--train", action="store_true")
    commands.choices["score"].add_argument("--report", type=int, help="number of a customer whose page is written")
    c = commands.add_parser("check")
    c.add_argument("--declarations", required=True)
    c.add_argument("--date-reference")
    for c in commands.choices.values():
        c.add_argument("--output", required=True)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("creditlake").getOrCreate()
    if a.command == "generate":
        generate(spark, a.output, a.n_borrowers, a.n_contracts, a.seed)
    elif a.command == "check":
        check(spark, a.declarations, a.output, a.date_reference)
    elif a.command == "score":
        print(score(spark, a.tables, a.output, a.train, a.report))
    else:
        print(pipeline(spark, a.tables, a.output))


if __name__ == "__main__":
    main()
