import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditlake import functions as fn
from creditlake.operators import features, identity, scorecard


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


@pytest.mark.parametrize(("name", "want"), [("Binti Ould Amadou", "OULD AMADOU"), ("  de la Fontaïne-Roux ", "FONTAINE ROUX"), ("Él Hadj  Moussa", "HADJ MOUSSA"), ("", ""), ("O'Néil_2", "O NEIL_2")])
def test_names(spark, name, want):
    assert one(spark, fn.normal_name(F.col("x")), x=name) == want


@pytest.mark.parametrize(("word", "want"), [("PHILIPPE", "FLP"), ("BOUBACAR", "BBKR"), ("BOUBAKAR", "BBKR"), ("QUENNY", "KN"), ("", ""), ("ALPHA", "ALF")])
def test_sounds(spark, word, want):
    assert one(spark, fn.phonetic_key(F.col("x")), x=word) == want


@pytest.mark.parametrize(("text", "want"), [(" 1.5 ", 1.5), (".5", 0.5), ("1e3", 1000.0), ("1_000", 1000.0), ("-7.", -7.0), ("1.0d", None), ("N/A", None), ("", None), ("_1", None), ("1__0", None), ("inf", math.inf), ("1 0", None)])
def test_numbers(spark, text, want):
    assert one(spark, fn.strict_number(F.col("x")), x=text) == want


@pytest.mark.parametrize(("text", "want"), [("2024-01-31", "2024-01-31"), ("20240131", "2024-01-31"), ("2024-02-31", None), ("31/02/2024", None), ("2024-1-5", None), ("2024", None), (" 2024-01-31", None)])
def test_dates(spark, text, want):
    got = one(spark, fn.strict_date(F.col("x")), x=text)
    assert (None if got is None else str(got)) == want


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_similarity_by_brute_force(spark):
    names = ["AMADOU ISSOUFOU", "A ISSOUFOU", "ISSOUFOU AMADOU", "", "X", "BOUBACAR DIALLO", "BOUBAKAR DIALO", "DIALLO B"]
    rows = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    for r in rows.select("a", "b", fn.token_sort_similarity(F.col("a"), F.col("b")).alias("s")).collect():
        a, b = (" ".join(sorted(r[x].split())) for x in "ab")
        assert abs(r["s"] - (200 * lcs(a, b) / (len(a) + len(b)) if a and b else 0)) < 1e-9


def test_identities(spark):
    rows = [("L1:a", "PP", "Diallo", "Boubacar", "", "1980-01-01", "NE-CNI-1", ""), ("L2:a", "PP", "DIALLO", "Boubakar", "", "1980-01-01", "", ""), ("L3:a", "PP", "Autre", "Nom", "", "1970-05-05", "ne cni 1", ""), ("L1:b", "PM", "", "", "Société Alpha", "", "", "NIF-7"), ("L2:b", "PM", "", "", "Alpha Ste", "", "", "nif 7"), ("L1:c", "PP", "Diallo", "Boubacar", "", "1981-01-01", "", "")]
    records = spark.createDataFrame(rows, "cle string, type_personne string, nom string, prenom string, raison_sociale string, date_naissance string, numero_piece string, nif string")
    prepared = identity.prepare(records)
    got = {(r["a"], r["z"]): r["decision"] for r in identity.match(prepared, identity.candidates(prepared)).collect()}
    assert got[("L1:a", "L2:a")] == "probable" and got[("L1:a", "L3:a")] == "certaine" and got[("L1:b", "L2:b")] == "certaine"
    assert all("L1:c" not in pair or d in ("aucune", "a_revoir") for pair, d in got.items())


def test_too_few_months():
    with pytest.raises(ValueError):
        features.windows(list(range(11)))
    assert features.windows(list(range(13, 0, -1))) == ([1, 2, 3, 4, 5, 6], [7, 8, 9, 10, 11, 12])


def test_fit_against_newton_steps(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [0.8, -0.5, 0.1] - 0.7)))).astype(float)
    b = np.zeros(4)
    z = np.c_[x, np.ones(400)]
    for _ in range(50):  # sum of log losses and half the squared coefficients, intercept free
        p = 1 / (1 + np.exp(-z @ b))
        g = z.T @ (p - y) + np.r_[b[:3], 0]
        b -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag([1, 1, 1, 0]), g)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)], "u double, v double, w double, defaut int")
    c, intercept = scorecard.fit(df, ["u", "v", "w"])
    assert np.allclose([*c, intercept], b, atol=1e-5)
    s = scorecard.score(df, ["u", "v", "w"], c, intercept).first()
    want = 600 - 20 / math.log(2) * (math.log(50) + x[0] @ c + intercept)
    assert s["score"] == min(850, max(300, round(want))) and len(s["facteurs"]) == 3
    parts = sum(-(k * v + intercept / 3) * scorecard.FACTOR for k, v in zip(c, x[0], strict=True))
    assert abs(parts - (want - scorecard.OFFSET)) < 1e-6
