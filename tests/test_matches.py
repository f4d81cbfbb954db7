import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from creditlake import functions as fn
from creditlake import queries as credit
from creditlake.operators import identity
from creditlake.operators.similarity import alike, similarities

NAMES = ["DIALLO BOUBACAR", "DIALLO BOUBAKAR", "QUENTIN ABDOU", "KUENTIN ABDOU", "CUENTIN ABDOU", "PHARA ZED", "FARA ZED", "PARA ZED", "DIALLO B", ""]
DAYS = ["", "1980-01-01", "1980-01-02", "1981-05-01"]


def test_similarities_are_those_of_the_column_function(spark):
    words = ["", "A", "AB BA", "ÉLAN ÀB", "字 AB 漢字", "😀 AB", "ABAB " * 12 + "B", "AB" * 32, "BA" * 32 + "A", "A" * 200, "ÿþ AB"]
    pairs = spark.createDataFrame([(x, y) for x in words for y in words], "x string, y string")
    by_words = [F.array_join(F.sort_array(F.split(c, " ")), " ") for c in "xy"]
    for r in pairs.select(alike(*by_words).alias("s"), fn.token_sort_similarity(F.col("x"), F.col("y")).alias("want")).collect():
        assert r["s"] == r["want"]
    assert list(similarities(pa.array(["?", "A", None]).slice(1), pa.array(["?", "A", "B"]).slice(1))) == [100.0, 0.0]
    assert similarities(pa.array([], pa.string()), pa.array([], pa.string())).dtype == np.float64


def test_links_are_neither_folded_nor_dealt_out(spark):
    """At 60 times sf0.1 a fold for each pair of names, and all rows once more for a distinct, took all the time."""
    credit_rows = credit.QUERIES["i_match"](spark, "/root/testdata/sf0.001")
    plan = credit_rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Distinct" not in plan and "aggregate(" not in plan


def test_no_link_comes_twice(spark):
    """A birth date's class is part of its year's, and papers join records of one name: each pair has one row all the same."""
    ids = ["", "", "ID1", "ID2", "ID3", "ID4"]
    rows = [(f"L{k:03}", ids[k * 5 % 6] if k % 4 else f"ID{k % 9}", NAMES[k * k % 97 % 10], DAYS[k * 11 % 31 % 4]) for k in range(240)]
    people = spark.createDataFrame([*rows, (None, "ID1", NAMES[0], DAYS[1])], "cle string, ident string, nom_complet string, naissance string")
    got = [tuple(r) for r in identity.matches(people, credit._stored(spark)).collect()]
    assert len({(a, z) for a, z, _, _ in got}) == len(got)
    true = {(r["a"], r["z"]): (r["score"], r["decision"]) for r in identity.match(people, identity.candidates(people)).collect()}
    assert all(true[a, z] == (s, d) for a, z, s, d in got) and {d for *_, d in got} == {d for _, d in true.values()}
