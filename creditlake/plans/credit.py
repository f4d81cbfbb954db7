"""Declarations, rules, decisions, identities, features and reports as statements over a projection of `orders`.

Every plan is one declarative statement, so Catalyst prunes, pushes down and picks joins. Money is in integer cents.
Each lender (l) sends a file for each month (m). Codes, severities and class names are fixed by the data format.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from . import scoring
from .dialect import Spark

# Month ends of the projection, classes of arrears, the lenders' register in its order (code, type, quality).
MONTH_ENDS = ["2000-08-31", "2000-09-30", "2000-10-31", "2000-11-30", "2000-12-31", "2001-01-31", "2001-02-28", "2001-03-31", "2001-04-30", "2001-05-31", "2001-06-30", "2001-07-31"]
CLASSES = ["sain", "sensible", "douteux", "contentieux"]
LENDERS = [
    ("BQ000001", "banque", "excellent"),
    ("BQ000002", "banque", "excellent"),
    ("EF000001", "etablissement_financier", "excellent"),
    ("BQ000003", "banque", "moyen"),
    ("BQ000004", "banque", "moyen"),
    ("BQ000005", "banque", "moyen"),
    ("EF000002", "etablissement_financier", "moyen"),
    ("EF000003", "etablissement_financier", "moyen"),
    ("SF000001", "sfd", "moyen"),
    ("BQ000006", "banque", "defaillant"),
    ("EF000004", "etablissement_financier", "defaillant"),
    ("SF000002", "sfd", "defaillant"),
]
PROFILES = ["excellent", "moyen", "defaillant"]
CREDIT_TYPES = ["court_terme", "moyen_terme", "long_terme", "decouvert", "credit_bail", "engagement_signature"]
PERIODS = ["mensuelle", "trimestrielle", "semestrielle", "annuelle", "in_fine"]
SECURITIES = ["hypotheque", "nantissement", "caution", "gage", "aucune"]
# Names of the projection are made of these: two parts for a surname, some with particles or sounds that normal forms change.
HEADS = ["Ada", "Béchi", "Cissé", "Dial", "Émi", "Fofa", "Gar", "Hama", "Idri", "Kané", "Lao", "Mou", "Philip", "De Sou", "Ben Sa", "El Ha", "Phara", "Quen", "Binti O", "Soule"]
TAILS = ["mou", "r", "kko", "lo", "le", "na", "ba", "ni", "ssa", "ra", "uali", "ssa", "pe", "za", "lah", "dji", "y", "tin", "mar", "ye", "tou", "bé", "ga"]
FIRST_NAMES = ["Aïcha", "Boubacar", "Céline", "Daouda", "Fatima", "Hélène", "Ibrahim", "Jacques", "Philomène", "Raphaël", "Zeïnabou"]


def _pick(index: str, values: list[str]) -> str:
    return f"(CASE {index} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END)"


def _money(c: str, d: Spark) -> str:
    return f"concat(cast({d.idiv(c, 100)} AS varchar(30)), '.', lpad(cast({c} % 100 AS varchar(30)), 2, '0'))"


def _arrears(m: str) -> str:
    return f"(CASE WHEN k % 5 = 0 AND {m} >= k % 12 THEN least(365, 25 * ({m} - k % 12 + 1)) ELSE 0 END)"


def _owed(d: Spark, arrete: str) -> str:
    return d.idiv("cents * (days - " + d.days("octroi", arrete) + ")", "days")


def _with(d: Spark) -> dict[str, str]:
    """Named steps, in order; a plan takes those up to what it needs and unused ones are pruned."""
    months = ", ".join(f"({k}, DATE '{x}')" for k, x in enumerate(MONTH_ENDS))
    lenders = ", ".join(f"({k}, '{c}', '{t}', '{q}')" for k, (c, t, q) in enumerate(LENDERS))
    jr = _arrears("m")
    cl = f"(CASE WHEN {jr} = 0 THEN 0 WHEN {jr} <= 30 THEN 1 WHEN {jr} <= 90 THEN 2 ELSE 3 END)"
    born = "(CASE WHEN v = 4 THEN " + d.plus("birth0", 1) + " ELSE birth0 END)"
    return {
        "months": f"SELECT * FROM (VALUES {months}) AS t(m, arrete)",
        "lenders": f"SELECT * FROM (VALUES {lenders}) AS t(l, code_declarant, type_etablissement, qualite)",
        "grants": f"SELECT o_orderkey AS k, o_custkey AS b, cast(o_orderkey % 12 AS int) AS l, cast(o_orderdate AS date) AS octroi, cast(round(o_totalprice * 100) AS bigint) AS cents, 30 * (o_orderkey % 60 + 1) AS days, CASE WHEN o_orderkey % 5 < 3 THEN {d.idiv('cast(round(o_totalprice * 100) AS bigint) * (o_orderkey % 4 + 1)', 4)} ELSE 0 END AS garantie_c FROM orders",
        "snap": f"SELECT g.*, m, arrete, {d.plus('octroi', 'days')} AS echeance, {_owed(d, 'arrete')} AS encours_c, {jr} AS jr, {cl} AS cl, (k * 31 + m * 17) % 40 AS dirt FROM grants g CROSS JOIN months WHERE octroi <= arrete AND arrete <= {d.plus('octroi', 'days')}",
        # What lenders declare: every field is text, errors included. A file is a lender's month; pos is the contract's own number.
        "raw_contract": f"""SELECT l, m, k AS pos, concat('CNT', cast(CASE WHEN (k * 7 + m) % 97 = 0 THEN k - 12 ELSE k END AS varchar(30))) AS id_contrat_source,
            concat('EMP', cast(CASE WHEN dirt = 6 THEN b + 1 ELSE b END AS varchar(30))) AS id_emprunteur_source,
            CASE WHEN dirt = 8 AND k % 7 = 3 THEN 'prive' ELSE {_pick('(k % 6)', CREDIT_TYPES)} END AS type_credit,
            CASE WHEN dirt = 0 THEN '31/02/2024' WHEN dirt = 12 THEN replace({d.iso('octroi')}, '-', '') ELSE {d.iso('octroi')} END AS date_octroi,
            CASE WHEN dirt = 5 THEN {d.iso(d.plus('octroi', -30))} ELSE {d.iso('echeance')} END AS date_echeance,
            CASE WHEN dirt = 1 THEN 'N/A' WHEN dirt = 10 THEN concat(' ', cast({d.idiv('cents', 100)} AS varchar(30)), 'e0 ') ELSE {_money('cents', d)} END AS montant_octroye,
            CASE WHEN dirt = 4 THEN 'EUR' ELSE 'XOF' END AS devise, concat(cast(5 + k % 10 AS varchar(30)), '.5') AS taux_interet,
            {_pick('(k % 5)', PERIODS)} AS periodicite, {_pick('(k % 5)', SECURITIES)} AS type_garantie, {_money('garantie_c', d)} AS montant_garantie, {d.iso('arrete')} AS date_arrete,
            CASE WHEN dirt = 2 THEN concat('-', {_money('(encours_c + 100000)', d)}) WHEN dirt = 3 THEN {_money('(' + d.idiv('cents * 3', 2) + ')', d)} WHEN dirt = 11 THEN '.5' ELSE {_money('encours_c', d)} END AS encours,
            {_money('(CASE WHEN jr > 0 THEN ' + d.idiv('encours_c * jr', 365) + ' ELSE 0 END)', d)} AS montant_impaye,
            CASE WHEN dirt = 13 THEN 'x' ELSE cast(jr AS varchar(30)) END AS jours_retard, {_pick('(CASE WHEN dirt = 7 THEN (cl + 1) % 4 ELSE cl END)', CLASSES)} AS classification FROM snap""",
        "raw_header": f"SELECT l, m, x.code_declarant AS declarant, (l * 7 + m * 5) % 71 = 0 AS malformed, CASE WHEN (l * 5 + m * 3) % 29 = 0 THEN 'ZZ999999' ELSE x.code_declarant END AS code_declarant, {d.iso('arrete')} AS date_arrete, CASE WHEN (l + m * 4) % 37 = 5 THEN 'many' ELSE '0' END AS nombre_enregistrements, '2001-08-01T00:00:00' AS horodatage FROM lenders x CROSS JOIN months",
        "pairs_lb": f"SELECT DISTINCT l, b, cast((b * 7 + l) % 5 AS int) AS v, {d.plus(chr(68) + 'ATE ' + chr(39) + '1950-01-01' + chr(39), '(b * 7919) % 18000')} AS birth0, concat({_pick('((b * 31) % 20)', HEADS)}, {_pick('((b * 17) % 23)', TAILS)}) AS sn, {_pick('(b % 11)', FIRST_NAMES)} AS fn FROM grants",
        "borrower": f"""SELECT l, b, concat(x.code_declarant, ':EMP', cast(b AS varchar(30))) AS cle, CASE WHEN b % 5 = 4 THEN 'PM' ELSE 'PP' END AS type_personne,
            CASE WHEN b % 5 = 4 THEN '' WHEN v = 1 THEN upper(sn) WHEN v = 2 THEN fn ELSE sn END AS nom,
            CASE WHEN b % 5 = 4 THEN '' WHEN v = 2 THEN sn WHEN v = 3 THEN concat(substr(fn, 1, 1), '.') ELSE fn END AS prenom,
            CASE WHEN b % 5 <> 4 THEN '' WHEN v = 1 THEN concat('STE ', upper(sn), ' & Fils') ELSE concat('Sté ', sn, ' et Fils') END AS raison_sociale,
            CASE WHEN b % 5 = 4 THEN '' ELSE {d.iso(born)} END AS date_naissance, CASE WHEN b % 5 = 4 OR b % 11 = 0 THEN '' ELSE concat('NE-CNI-', lpad(cast(b AS varchar(30)), 8, '0')) END AS numero_piece,
            CASE WHEN b % 5 <> 4 OR b % 17 = 0 THEN '' WHEN v = 3 THEN concat('nif ', cast(b AS varchar(30))) ELSE concat('NIF-', cast(b AS varchar(30))) END AS nif, b % 4 AS town
            FROM pairs_lb p JOIN lenders x USING (l)""",
        "raw_borrower": f"""SELECT f.l, f.m, f.b AS pos, concat('EMP', cast(f.b AS varchar(30))) AS id_emprunteur_source, type_personne,
            CASE WHEN t = 0 THEN ' ' ELSE nom END AS nom, prenom, CASE WHEN t = 0 THEN '' ELSE raison_sociale END AS raison_sociale,
            CASE WHEN t = 1 THEN '1990-02-30' WHEN t = 2 THEN '1999-05-17' ELSE date_naissance END AS date_naissance, CASE WHEN type_personne = 'PP' THEN 'M' ELSE '' END AS sexe, CASE WHEN type_personne = 'PP' THEN 'CNI' ELSE '' END AS type_piece,
            CASE WHEN t = 3 THEN concat('x', numero_piece) ELSE numero_piece END AS numero_piece, nif,
            CASE WHEN t = 4 THEN '0612345678' ELSE concat('+227', lpad(cast(f.b AS varchar(30)), 8, '9')) END AS telephone,
            {_pick('town', ['Niamey', 'Zinder', 'Maradi', 'Agadez'])} AS ville, 'NE' AS pays
            FROM (SELECT DISTINCT l, m, b, (b * 13 + l * 5 + m) % 113 AS t FROM snap) f JOIN borrower o ON f.l = o.l AND f.b = o.b""",
        "truth": f"""SELECT l, 'contrat' AS entite, id_contrat_source AS ident, 'id_contrat_source' AS champ, 'E009' AS code FROM raw_contract WHERE id_contrat_source <> concat('CNT', cast(pos AS varchar(30)))
            UNION SELECT l, 'contrat', id_contrat_source, champ, code FROM (SELECT l, id_contrat_source, (pos * 31 + m * 17) % 40 AS dirt FROM raw_contract) r JOIN (VALUES (0, 'date_octroi', 'E002'), (1, 'montant_octroye', 'E003'), (2, 'encours', 'E004'), (3, 'encours', 'E005'), (4, 'devise', 'E006'), (5, 'date_echeance', 'E007'), (6, 'id_emprunteur_source', 'E008'), (7, 'classification', 'E012')) AS i(d, champ, code) ON r.dirt = i.d
            UNION SELECT l, 'entete', declarant, 'code_declarant', 'E013' FROM raw_header WHERE (l * 5 + m * 3) % 29 = 0
            UNION SELECT l, 'emprunteur', id_emprunteur_source, CASE WHEN t > 0 THEN champ WHEN type_personne = 'PP' THEN 'nom' ELSE 'raison_sociale' END, code FROM (SELECT l, id_emprunteur_source, type_personne, (pos * 13 + l * 5 + m) % 113 AS t FROM raw_borrower) r JOIN (VALUES (0, 'nom', 'E001'), (1, 'date_naissance', 'E002'), (2, 'date_naissance', 'E011'), (3, 'numero_piece', 'E010'), (4, 'telephone', 'E014')) AS i(d, champ, code) ON r.t = i.d
            UNION SELECT l, 'emprunteur', id_emprunteur_source, 'nif', 'E015' FROM raw_borrower WHERE type_personne = 'PM' AND nif = ''""",
        "obs": "SELECT s.b, l, k, m, arrete, octroi, cents, encours_c, jr, cl FROM snap s WHERE m <= 5",
        "latest": "SELECT b, max(m) AS last_m FROM obs GROUP BY b",
        "features": f"""SELECT o.b, sum(CASE WHEN o.m = x.last_m THEN encours_c ELSE 0 END) AS encours_total, count(DISTINCT l) AS nb_declarants, count(DISTINCT k) AS nb_contrats, count(DISTINCT k % 6) AS nb_types, max(jr) AS max_retard,
            sum(CASE WHEN cl >= 2 THEN 1 ELSE 0 END) AS nb_douteux, max({d.days('octroi', "DATE '2001-01-31'")}) AS anciennete FROM obs o JOIN latest x ON o.b = x.b GROUP BY o.b""",
        "target": "SELECT f.*, CASE WHEN t.worst > 90 THEN 1 ELSE 0 END AS defaut FROM features f LEFT JOIN (SELECT b, max(jr) AS worst FROM snap WHERE m >= 6 GROUP BY b) t ON f.b = t.b",
        "edges": f"SELECT {', '.join(d.quantile('cast(encours_total AS double)', q) + f' AS q{k}' for k, q in enumerate((0.2, 0.4, 0.6, 0.8)))} FROM features",
        "binned": "SELECT t.b, defaut, CASE WHEN encours_total <= q0 THEN 0 WHEN encours_total <= q1 THEN 1 WHEN encours_total <= q2 THEN 2 WHEN encours_total <= q3 THEN 3 ELSE 4 END AS bin FROM target t CROSS JOIN edges",
        "bin_counts": "SELECT bin, greatest(cast(sum(1 - defaut) AS double), cast(0.5 AS double)) AS good, greatest(cast(sum(defaut) AS double), cast(0.5 AS double)) AS bad, count(*) AS n FROM binned GROUP BY bin",
        "bin_totals": "SELECT greatest(cast(sum(1 - defaut) AS double), cast(1 AS double)) AS goods, greatest(cast(sum(defaut) AS double), cast(1 AS double)) AS bads FROM binned",
        "woe": "SELECT bin, n, ln((good / goods) / (bad / bads)) AS woe, (good / goods - bad / bads) * ln((good / goods) / (bad / bads)) AS iv FROM bin_counts CROSS JOIN bin_totals",
        "bounds": f"SELECT {', '.join(d.quantile('score', q) + f' AS c{k}' for k, q in enumerate((0.8, 0.6, 0.4, 0.2)))}, min(score) AS lo, max(score) AS hi FROM scored",
        "by_score": "SELECT score, sum(defaut) AS bad, sum(1 - defaut) AS good FROM scored GROUP BY score",
        "roc": "SELECT score, cast(sum(bad) OVER (ORDER BY score) AS double) / sum(bad) OVER () AS tpr, cast(sum(good) OVER (ORDER BY score) AS double) / sum(good) OVER () AS fpr, cast(bad AS double) / sum(bad) OVER () AS dt, cast(good AS double) / sum(good) OVER () AS df FROM by_score",
    }


def _plans(d: Spark) -> dict[str, str]:
    spent = "CASE WHEN k % 5 = 0 AND m >= k % 12 THEN 25 ELSE 0 END"
    return {
        "v_natural_maturity_before_grant": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE cast(l_shipdate AS date) < cast(o_orderdate AS date) GROUP BY l_orderkey, l_linenumber",
        "v_natural_amount_excess": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_extendedprice > o_totalprice GROUP BY l_orderkey, l_linenumber",
        "v_natural_duplicate_key": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
        "s_features": "SELECT b, encours_total, nb_declarants, nb_contrats, nb_types, max_retard, nb_douteux, anciennete FROM features",
        "s_target": "SELECT b, defaut FROM target",
        "s_bin_edges": "SELECT round(q0, 3) AS q0, round(q1, 3) AS q1, round(q2, 3) AS q2, round(q3, 3) AS q3 FROM edges",
        "s_woe_iv": "SELECT bin, n, round(woe, 6) AS woe, round(iv, 6) AS iv FROM woe",
        "s_selected": "SELECT 'encours_total' AS variable, round(sum(iv), 6) AS iv, sum(iv) BETWEEN 0.02 AND 0.5 AS retenue FROM woe",
        "s_score_fixed_model": "SELECT b, round(score, 6) AS score FROM scored",
        "s_bands": "SELECT t.bande, coalesce(n, 0) AS n, coalesce(taux, 0) AS taux, coalesce(score_min, 0) AS score_min FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS t(bande) LEFT JOIN (SELECT bande, count(*) AS n, round(avg(cast(defaut AS double)), 6) AS taux, round(min(score), 6) AS score_min FROM (SELECT s.*, CASE WHEN score >= c0 THEN 'A' WHEN score >= c1 THEN 'B' WHEN score >= c2 THEN 'C' WHEN score >= c3 THEN 'D' ELSE 'E' END AS bande FROM scored s CROSS JOIN bounds) x GROUP BY bande) c ON t.bande = c.bande",
        "s_histogram": f"SELECT t.bin, coalesce(n, 0) AS n FROM (VALUES {', '.join(f'({k})' for k in range(24))}) AS t(bin) LEFT JOIN (SELECT bin, count(*) AS n FROM (SELECT CASE WHEN hi = lo THEN 0 ELSE greatest(cast(ceil((score - lo) * 24 / (hi - lo)) AS int), 1) - 1 END AS bin FROM scored CROSS JOIN bounds) x GROUP BY bin) c ON t.bin = c.bin WHERE t.bin = 0 OR (SELECT hi > lo FROM bounds)",
        "s_auc_ks": "SELECT round(sum(df * (tpr - dt / 2)), 6) AS auc, round(2 * sum(df * (tpr - dt / 2)) - 1, 6) AS gini, round(greatest(max(tpr - fpr), 0), 6) AS ks FROM roc",
        "s_roc": "SELECT round(score, 6) AS score, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM roc",
        "r_engagements": "SELECT s.b, s.k, s.l, s.m, encours_c, jr FROM snap s JOIN (SELECT b, max(m) AS last_m FROM snap GROUP BY b) x ON s.b = x.b AND s.m = x.last_m",
        "r_arrears_history": "SELECT b, m, jr FROM (SELECT b, m, max(jr) AS jr, row_number() OVER (PARTITION BY b ORDER BY m DESC) AS nth FROM snap GROUP BY b, m) x WHERE nth <= 12",
        "g_arrears_recurrence": f"SELECT k, m, least(365, sum({spent}) OVER (PARTITION BY k ORDER BY m)) AS jr FROM snap",
        "i_truth_sizes": "SELECT taille, count(*) AS n FROM (SELECT b, count(*) AS taille FROM borrower GROUP BY b) x GROUP BY taille",
        "g_months": f"SELECT m, {d.iso('arrete')} AS arrete FROM months",
    }


def statements(d: Spark) -> dict[str, str]:
    steps = _with(d) | scoring.steps(d)
    return {name: closure(steps, body) for name, body in (_plans(d) | scoring.plans(d)).items()}


def closure(steps: dict[str, str], body: str) -> str:
    """The body behind the steps that it needs, each after those that it needs itself."""
    done: dict[str, str] = {}

    def visit(text: str) -> None:
        for name in _named(text):
            if name in steps and name not in done:
                visit(steps[name])
                done[name] = steps[name]

    visit(body)
    ctes = ", ".join(f"{s} AS ({t})" for s, t in done.items())
    return f"WITH {ctes} {body}" if ctes else body


def declared(d: Spark, step: str) -> str:
    """The rows of one step."""
    return closure(_with(d), f"SELECT * FROM {step}")


def borrowers(spark, lent):
    """The rows of step `borrower` for the different (l, b) of a frame: pairs_lb without its DISTINCT, which would deal out
    each pair with the names that follow from it."""
    steps = _with(Spark())
    steps["pairs_lb"] = steps["pairs_lb"].replace("DISTINCT ", "", 1).replace("FROM grants", "FROM lent")
    return spark.sql(closure(steps, "SELECT * FROM borrower").replace("FROM lent", "FROM {lent}"), lent=lent)


def loans() -> str:
    """Contracts, each with its rows of step `snap` in an array, so that these need not be gathered again."""
    d = Spark()
    months = ", ".join(f"named_struct('m', {k}, 'arrete', DATE '{x}')" for k, x in enumerate(MONTH_ENDS))
    rows = f"filter(array({months}), x -> octroi <= x.arrete AND x.arrete <= {d.plus('octroi', 'days')})"
    body = f"SELECT *, transform({rows}, x -> named_struct('arrete', x.arrete, 'encours_c', {_owed(d, 'x.arrete')}, 'jr', {_arrears('x.m')})) AS snaps FROM grants"
    return closure(_with(d), body)


def _named(text: str) -> list[str]:
    return re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text)


def runner(sql: str) -> Callable:
    """A query (spark, sf_dir) that reads the tables the statement names."""
    tables = [t for t in ("orders", "lineitem") if re.search(rf"\b{t}\b", sql)]

    def run(spark, sf_dir):
        frames = {f"t_{t}": spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
        text = sql
        for t in tables:
            text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{t_{t}}}", text.replace("{", "{{").replace("}", "}}") if t == tables[0] else text)
        return spark.sql(text, **frames) if tables else spark.sql(text)

    return run
