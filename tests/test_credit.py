import duckdb
import pytest

from creditlake import queries as credit
from creditlake.operators.components import connected_components
from creditlake.sources import declarations as decl

SF = "/root/testdata/sf0.001"


def rows(names, data, order):
    at = [names.index(c) for c in order]
    plain = lambda x: str(float(x)) if isinstance(x, int | float) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else str(x)
    return sorted(tuple(plain(r[i]) for i in at) for r in data)


@pytest.mark.parametrize("name", sorted(credit.ORACLE_SQL))
def test_same_rows_as_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = credit.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    want = con.execute(credit.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == order
    assert rows(df.columns, df.collect(), order) == rows(names, want.fetchall(), order)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_match_decisions_by_brute_force(spark):
    rec = {r["cle"]: r for r in credit.QUERIES["i_normalise"](spark, SF).collect()}
    for r in credit.QUERIES["i_match"](spark, SF).collect():
        x, y = rec[r["a"]], rec[r["z"]]
        p, q = (" ".join(sorted(v["nom_complet"].split())) for v in (x, y))
        s = 200 * lcs(p, q) / (len(p) + len(q)) if p and q else 0
        want = "certaine" if x["ident"] and x["ident"] == y["ident"] else "probable" if s >= 88 and x["naissance"] and x["naissance"] == y["naissance"] else "a_revoir" if 75 <= s < 88 else "aucune"
        assert r["decision"] == want


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, tmp_path, one_task):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    e = [("b", "a"), ("b", "c"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "z"), (None, "a")] + [(f"n{k:02}", f"n{k + 1:02}") for k in range(20)]
    got = connected_components(spark.createDataFrame(e, "u string, v string"), lambda d: d.checkpoint(), one_task)
    want = {"b": "a", "c": "a", "d": "a", "y": "x"} | {f"n{k:02}": "n00" for k in range(1, 21)}
    assert {r["node"]: r["component"] for r in got.collect()} == want


def test_declarations_round_trip_and_load(spark, tmp_path):
    c = {n: f" {n} " if n == "type_credit" else "" for n in decl.CONTRACT} | {"id_contrat_source": "C1", "date_arrete": "2024-01-31"}
    head = {n: "L01" for n in decl.HEADER}
    schema = f"file string, entete {decl._struct(decl.HEADER)}, emprunteurs array<{decl._struct(decl.BORROWER)}>, contrats array<{decl._struct(decl.CONTRACT)}>"
    xml = decl.to_xml(spark.createDataFrame([("x/L09_20240131.xml", head, [], [c, c])], schema)).unionByName(spark.createDataFrame([("bad.xml", "<declaration><entete>")], "file string, content string"))
    parsed = decl.parse(xml)
    assert {r["declarant"]: r["malformed"] for r in parsed.collect()} == {"L09": False, "?": True}
    got = decl.contracts(parsed)
    assert [r["type_credit"] for r in got.collect()] == [" type_credit "] * 2
    path, keys = f"file://{tmp_path}/t", ["declarant", "id_contrat_source", "date_arrete"]
    assert [decl.load(got, path, keys, ["file", "pos"]) for _ in range(2)] == [1, 0]
