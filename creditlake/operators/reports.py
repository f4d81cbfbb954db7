"""Reports from small aggregates: rejection CSV and HTML, solvency HTML, dashboard JSON."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import escape_html
from .validation import Validated


def write_rejections(v: Validated, path: str) -> None:
    """CSV of findings by sender and month end: identifier as `ligne`, field, code, severity, value received, remedy."""
    who = v.reports().select(*v.keys, "declarant").join(v.files.select(*v.keys, "date_arrete"), v.keys)
    rows = v.findings.join(who, v.keys).withColumn("date_arrete", F.coalesce("date_arrete", F.lit("?")))
    out = rows.select("declarant", "date_arrete", "entite", F.col("identifiant").alias("ligne"), "champ", "code", "severite", "valeur_recue", F.col("message").alias("message_correction"))
    out.write.mode("overwrite").partitionBy("declarant", "date_arrete").option("header", True).csv(path)


def rejection_pages(v: Validated, top: int = 5) -> DataFrame:
    """(file, content): a page for each file with its counters, its most frequent codes (ties by code) and all findings, made
    from columns; all values are escaped. A page holds its file's findings, so they meet in one task."""
    cell = lambda c: F.concat(F.lit("<td>"), escape_html(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>"))
    line = F.concat(F.lit("<tr>"), *[cell(c) for c in ("entite", "identifiant", "champ", "code", "severite", "valeur_recue", "message")], F.lit("</tr>"))
    rows = v.findings.select(*v.keys, "code", F.struct("code", "identifiant", line.alias("html")).alias("r")).groupBy(*v.keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["html"]), "").alias("table"))
    n = v.findings.groupBy(*v.keys, "code").agg(F.count("*").alias("n")).groupBy(*v.keys).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "code"))), 1, top).alias("top"))
    heads = ("declarant", "emprunteurs", "contrats", "acceptes", "reserves", "rejetes", "taux", "fichier_rejete")
    counters = F.concat(*[F.concat(F.lit(f"<li>{h}: "), escape_html(F.col(h).cast("string")), F.lit("</li>")) for h in heads])
    codes = F.array_join(F.transform(F.coalesce("top", F.array().cast("array<struct<less: bigint, code: string>>")), lambda x: F.concat(F.lit("<li>"), x["code"], F.lit(": "), (-x["less"]).cast("string"), F.lit("</li>"))), "")
    page = F.concat(F.lit("<!DOCTYPE html><html><body><ul>"), counters, F.lit("</ul><ol>"), codes, F.lit("</ol><table>"), F.coalesce("table", F.lit("")), F.lit("</table></body></html>"))
    name = F.concat(F.regexp_replace(F.concat_ws("_", *[F.col(k).cast("string") for k in v.keys]), r"[^\w.-]", "_"), F.lit(".html"))
    return v.reports().join(rows, v.keys, "left").join(n, v.keys, "left").select(name.alias("file"), page.alias("content"))


def solvency_page(spark: SparkSession, tables: str, borrower: int) -> str:
    """The page of one customer: score, band, factors, commitments at the last month, twelve months of arrears."""
    from .. import queries

    rows = {n: queries.QUERIES[n](spark, tables).where(F.col("b") == borrower) for n in ("s_score_woe", "s_contributions", "r_engagements", "r_arrears_history")}
    found = rows["s_score_woe"].first()
    if found is None:
        raise ValueError(f"no scored customer {borrower}")
    bounds = queries.QUERIES["s_score_woe"](spark, tables).agg(F.percentile("score", F.array(F.lit(0.8), F.lit(0.6), F.lit(0.4), F.lit(0.2))).alias("c")).first()["c"]
    band = next((x for x, c in zip("ABCD", bounds, strict=True) if found["score"] >= c), "E")
    loans = [{"lender": r["l"], "contract": r["k"], "owed": r["encours_c"] / 100, "days": r["jr"]} for r in rows["r_engagements"].orderBy("k").collect()]
    late = [(str(r["m"]), r["jr"]) for r in rows["r_arrears_history"].orderBy("m").collect()]
    return solvency_html(str(borrower), found["score"], band, [(r["variable"], r["points"]) for r in rows["s_contributions"].collect()], loans, late)


def solvency_html(borrower: str, score: float, band: str, factors: list[tuple[str, float]], engagements: list[dict], arrears: list[tuple[str, int]]) -> str:
    rows = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in e.values()) + "</tr>" for e in engagements)
    best = "".join(f"<li>{html.escape(n)}: {p:+.1f}</li>" for n, p in sorted(factors, key=lambda x: (-abs(x[1]), x[0]))[:3])
    late = "".join(f"<li>{html.escape(str(m))}: {d}</li>" for m, d in arrears[-12:])
    return f"<!DOCTYPE html><html><body><h1>{html.escape(borrower)}</h1><p>{score:.0f} {html.escape(band)}</p><ol>{best}</ol><table>{rows}</table><ul>{late}</ul></body></html>"


def dashboard(parts: dict[str, DataFrame], most_rows: int = 10_000) -> str:
    """JSON of small aggregates; a part above most_rows is an error, not a cut."""
    out = {}
    for name, df in parts.items():
        rows = df.limit(most_rows + 1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{name} is no small aggregate")
        out[name] = [json.loads(r["j"]) for r in rows]
    return json.dumps(out, ensure_ascii=False, indent=2)
