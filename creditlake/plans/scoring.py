"""Statements on top of the credit steps: nine features, their bins, split, gains, curve, structural errors, reports."""

from __future__ import annotations

from math import log

from .dialect import Spark

#: The features of the scorecard, in their fixed order.
FEATURES = ["encours_total", "nb_declarants", "nb_contrats", "nb_types", "max_retard", "nb_douteux", "ratio_impaye", "taux_couverture", "anciennete"]
# Fixed values of the points: 600 at odds of 50 to 1, 20 to double them.
FACTOR = 20 / log(2)
OFFSET = 600 - FACTOR * log(50)
#: The model that the fixed-model queries score with: log odds of default from the weights of evidence.
COEFFICIENTS = {x: -0.3 - 0.05 * k for k, x in enumerate(FEATURES)}
INTERCEPT = -1.5


def n(x: float) -> str:
    """A double in both dialects."""
    return f"cast({x!r} AS double)"


def steps(d: Spark) -> dict[str, str]:
    coefs = ", ".join(f"('{x}', {n(c)})" for x, c in COEFFICIENTS.items())
    names = ", ".join(f"('{n}')" for n in FEATURES)
    value = "(CASE v.variable " + " ".join(f"WHEN '{n}' THEN cast({n} AS double)" for n in FEATURES) + " END)"
    edges = ", ".join(f"{d.quantile('x', q)} AS q{k}" for k, q in enumerate((0.2, 0.4, 0.6, 0.8), 1))
    inner = " + ".join(f"CASE WHEN q{k} > lo AND q{k} < hi AND q{k} < x" + (f" AND q{k} <> q{k - 1}" if k > 1 else "") + " THEN 1 ELSE 0 END" for k in range(1, 5))
    tenths = ", ".join(f"{d.quantile('score', k / 10)} AS d{k}" for k in range(11))
    above = " + ".join(f"CASE WHEN d{k} < score" + (f" AND d{k} <> d{k - 1}" if k else "") + " THEN 1 ELSE 0 END" for k in range(11))
    ratio = "(good / goods) / (bad / bads)"
    return {
        "obs9": f"SELECT b, l, k, m, octroi, cents, encours_c, jr, cl, CASE WHEN jr > 0 THEN {d.idiv('encours_c * jr', 365)} ELSE 0 END AS impaye_c, garantie_c FROM snap WHERE m <= 5",
        "contract9": "SELECT b, k, max(l) AS l, max(cents) AS cents, max(garantie_c) AS garantie_c, min(octroi) AS octroi, max(jr) AS jr, sum(CASE WHEN cl >= 2 THEN 1 ELSE 0 END) AS douteux FROM obs9 GROUP BY b, k",
        "whole9": f"SELECT b, count(DISTINCT l) AS nb_declarants, count(*) AS nb_contrats, count(DISTINCT k % 6) AS nb_types, max(jr) AS max_retard, sum(douteux) AS nb_douteux, max({d.days('octroi', 'DATE ' + chr(39) + '2001-01-31' + chr(39))}) AS anciennete, CASE WHEN sum(cents) > 0 THEN least(1, cast(sum(garantie_c) AS double) / sum(cents)) ELSE 0 END AS taux_couverture FROM contract9 GROUP BY b",
        "month9": "SELECT b, m, sum(encours_c) AS encours_total, sum(impaye_c) AS impaye_total FROM obs9 GROUP BY b, m",
        "last9": "SELECT x.* FROM month9 x JOIN (SELECT b, max(m) AS m FROM month9 GROUP BY b) y ON x.b = y.b AND x.m = y.m",
        "features9": "SELECT w.*, z.encours_total, CASE WHEN z.encours_total > 0 THEN cast(z.impaye_total AS double) / z.encours_total ELSE 0 END AS ratio_impaye FROM whole9 w JOIN last9 z ON w.b = z.b",
        "target9": "SELECT f.*, CASE WHEN t.worst > 90 THEN 1 ELSE 0 END AS defaut FROM features9 f LEFT JOIN (SELECT b, max(jr) AS worst FROM snap WHERE m >= 6 GROUP BY b) t ON f.b = t.b",
        "long9": f"SELECT b, defaut, v.variable, {value} AS x FROM target9 CROSS JOIN (VALUES {names}) AS v(variable)",
        "edges9": f"SELECT variable, {edges}, min(x) AS lo, max(x) AS hi FROM long9 GROUP BY variable",
        "binned9": f"SELECT b, defaut, g.variable, {inner} AS bin FROM long9 g JOIN edges9 e ON g.variable = e.variable",
        "counts9": "SELECT variable, bin, count(*) AS n, sum(1 - defaut) AS g, sum(defaut) AS d FROM binned9 GROUP BY variable, bin",
        "shares9": "SELECT variable, bin, n, greatest(cast(g AS double), cast(0.5 AS double)) AS good, greatest(cast(d AS double), cast(0.5 AS double)) AS bad, greatest(cast(sum(g) OVER (PARTITION BY variable) AS double), cast(1 AS double)) AS goods, greatest(cast(sum(d) OVER (PARTITION BY variable) AS double), cast(1 AS double)) AS bads FROM counts9",
        "woe9": f"SELECT variable, bin, n, ln({ratio}) AS woe, (good / goods - bad / bads) * ln({ratio}) AS iv FROM shares9",
        "iv9": "SELECT variable, round(sum(iv), 9) AS iv FROM woe9 GROUP BY variable",
        "kept9": "SELECT variable, iv, iv BETWEEN 0.02 AND 0.5 OR (nth = 1 AND good = 0) AS retenue FROM (SELECT variable, iv, row_number() OVER (ORDER BY iv DESC, variable) AS nth, sum(CASE WHEN iv BETWEEN 0.02 AND 0.5 THEN 1 ELSE 0 END) OVER () AS good FROM iv9) x",
        "coefs": f"SELECT * FROM (VALUES {coefs}) AS t(variable, coef)",
        "terms9": "SELECT g.b, g.defaut, g.variable, c.coef * w.woe AS term FROM binned9 g JOIN woe9 w ON g.variable = w.variable AND g.bin = w.bin JOIN coefs c ON g.variable = c.variable",
        "points9": f"SELECT b, variable, round(-(term + {n(INTERCEPT / len(FEATURES))}) * {n(FACTOR)}, 6) AS points FROM terms9",
        "scored": f"SELECT b, max(defaut) AS defaut, cast(least(850, greatest(300, {d.half_even(f'{n(OFFSET)} - {n(FACTOR)} * (sum(term) + {n(INTERCEPT)})')})) AS double) AS score FROM terms9 GROUP BY b",
        "split_keys": "SELECT b, defaut, (b % 1000003) * 7919 % 1000003 AS h FROM target",
        "split_runs": f"SELECT defaut, {d.idiv('h', 1000)} AS run, count(*) AS n FROM split_keys GROUP BY defaut, {d.idiv('h', 1000)}",
        "split_before": "SELECT defaut, run, sum(n) OVER (PARTITION BY defaut ORDER BY run) - n AS before, sum(n) OVER (PARTITION BY defaut) AS total FROM split_runs",
        "split": f"SELECT s.b, s.defaut, CASE WHEN p.before + row_number() OVER (PARTITION BY s.defaut, p.run ORDER BY s.h, s.b) <= {d.idiv('(3 * p.total + 5)', 10)} THEN 'test' ELSE 'train' END AS part FROM split_keys s JOIN split_before p ON s.defaut = p.defaut AND {d.idiv('s.h', 1000)} = p.run",
        "tenths": f"SELECT {tenths} FROM scored",
        "deciles": f"SELECT b, defaut, greatest({above}, 1) - 1 AS decile FROM scored CROSS JOIN tenths",
        "curve": "SELECT score, tpr, fpr, row_number() OVER (ORDER BY score) - 1 AS spot, count(*) OVER () AS n FROM roc",
    }


def plans(d: Spark) -> dict[str, str]:
    points = ", ".join(f"({k})" for k in range(60))
    place = d.half_even("i * (n - 1) / cast(59 AS double)")
    return {
        "s_features_nine": "SELECT b, " + ", ".join(f"round({n}, 9) AS {n}" if n in ("ratio_impaye", "taux_couverture") else n for n in FEATURES) + ", defaut FROM target9",
        "s_edges_all": "SELECT variable, round(lo, 6) AS lo, " + ", ".join(f"round(q{k}, 6) AS q{k}" for k in range(1, 5)) + ", round(hi, 6) AS hi FROM edges9",
        "s_woe_all": "SELECT variable, bin, n, round(woe, 6) AS woe, round(iv, 6) AS iv FROM woe9",
        "s_selection": "SELECT variable, round(iv, 6) AS iv, retenue FROM kept9 ORDER BY iv DESC, variable",
        "s_woe_lookup": "SELECT g.b, g.variable, round(w.woe, 6) AS woe FROM binned9 g JOIN woe9 w ON g.variable = w.variable AND g.bin = w.bin",
        "s_contributions": "SELECT b, variable, points FROM (SELECT b, variable, points, row_number() OVER (PARTITION BY b ORDER BY abs(points) DESC, variable) AS nth FROM points9) x WHERE nth <= 3",
        "s_split": "SELECT b, defaut, part FROM split",
        "s_gains": "SELECT decile, count(*) AS n, sum(defaut) AS defauts, round(avg(cast(defaut AS double)), 6) AS taux FROM deciles GROUP BY decile ORDER BY decile DESC",
        "s_default_rate": "SELECT count(*) AS n, round(avg(cast(defaut AS double)), 6) AS taux FROM target",
        "s_curve_sixty": f"SELECT DISTINCT spot, round(score, 6) AS score, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM curve CROSS JOIN (VALUES {points}) AS p(i) WHERE n <= 60 OR spot = {place}",
        "i_truth_sizes": "SELECT taille, count(*) AS n FROM (SELECT b, count(*) AS taille FROM borrower GROUP BY b) x GROUP BY taille",
    }
