"""License scans: sparse TF-IDF cosine of lines, runs of lines and whole texts to templates and whole licences, then
inheritance from the nearest directory.

DataFrame functions only. Lines are compared once for all documents that share them.
"""

from __future__ import annotations

import pkgutil
import re
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

# Opening words that licences themselves prescribe, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-1.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.0": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
#: Licences whose whole texts lie in license_texts; older versions are there so that they aren't taken for later ones.
WHOLE = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0"]
#: A term is a run of ASCII letters and digits, or of letters outside ASCII with them.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Least cosines of a line or a run of lines, of a whole text to opening words, and of a whole text to a whole licence, and
#: how far the best whole licence must be ahead of the next one.
LINE_COSINE, FILE_COSINE, WHOLE_COSINE, MARGIN = 0.8, 0.8, 0.92, 0.002
#: So many of a whole licence's heaviest terms tell whether a text can reach the least cosine.
HEAVY = 40
#: Marks the first term of a line (a private character).
LINE = "\uE000"


def python_terms(text: str) -> list[str]:
    return [t for t in re.split(BETWEEN, text.lower()) if t]


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BETWEEN), lambda x: x != "")


VOCABULARY = sorted({t for ts in TEMPLATES.values() for x in ts for t in python_terms(x)})
WHOLE_TEXTS = {x: [pkgutil.get_data(__package__, f"license_texts/{x}.txt").decode()] for x in WHOLE}
WHOLE_VOCABULARY = sorted({t for ts in WHOLE_TEXTS.values() for x in ts for t in python_terms(x)})
#: idf among the whole licences: what tells them apart weighs most, and so does a term that none of them has.
WHOLE_IDF = {t: log((1 + len(WHOLE)) / (1 + sum(t in python_terms(x) for ts in WHOLE_TEXTS.values() for x in ts))) + 1 for t in WHOLE_VOCABULARY}
WHOLE_OTHER = log(1 + len(WHOLE)) + 1


def term_weights(docs: DataFrame, text_col: str = "text", vocabulary: list[str] = VOCABULARY) -> tuple[dict[str, float], float]:
    """idf of each template term over all documents, ln((1 + n) / (1 + df)) + 1, and the weight of every other term: their
    mean. The counts that come to the driver are one for each template term, and the documents'."""
    here = F.array_distinct(F.filter(_terms(F.coalesce(F.col(text_col), F.lit(""))), lambda x: x.isin(vocabulary)))
    # The empty term stands for the document itself.
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), here)).alias("term")).groupBy("term").count().collect()
    df = {r["term"]: r["count"] for r in rows}
    n = df.pop("", 0)
    idf = {t: log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}
    return idf, sum(idf.values()) / len(idf)


def _local(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """Rows of words and numbers as a relation in the plan itself."""
    shown = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {shown} AS t({names})")


def _unit_vectors(idf: dict[str, float], templates: dict[str, list[str]]) -> list[tuple[str, int, dict[str, float]]]:
    """(license, number of terms, weights) of each template."""
    out = []
    for license_, texts in sorted(templates.items()):
        for text in texts:
            terms = python_terms(text)
            tf = {t: terms.count(t) for t in sorted(set(terms))}
            norm = sum((c * idf[t]) ** 2 for t, c in tf.items()) ** 0.5
            out.append((license_, len(terms), {t: c * idf[t] / norm for t, c in tf.items()}))
    return out


def template_table(spark: SparkSession, idf: dict[str, float], templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(term, license, template, weight): unit vectors of the templates."""
    rows = [(t, license_, nth, w) for nth, (license_, _, weights) in enumerate(_unit_vectors(idf, templates)) for t, w in weights.items()]
    return _local(spark, rows, "term, license, template, weight")


def _bounds(idf: dict[str, float], whole_idf: dict[str, float]) -> tuple[Column, list[str]]:
    """An array of (k, size, need, terms, squares) for each template and whole licence (size 0), and all their terms here.

    By Cauchy and Schwarz the cosine of a text to a unit vector is at most the root of the vector's squared weights on the
    terms that the text has. So its squares on the heaviest terms, less what the cosine can do without, must be there.
    """
    rows, known = [], set()
    both = [(n, w, LINE_COSINE) for _, n, w in _unit_vectors(idf, TEMPLATES)] + [(0, w, WHOLE_COSINE) for _, _, w in _unit_vectors(whole_idf, WHOLE_TEXTS)]
    for k, (size, weights, cosine) in enumerate(both):
        top = dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[: len(weights) if size else HEAVY])
        known |= set(top)
        need = sum(w * w for w in top.values()) - (1 - cosine**2) - 1e-9
        terms, squares = ", ".join(f"'{t}'" for t in top), ", ".join(f"'{t}', {w * w!r}D" for t, w in top.items())
        rows.append(f"named_struct('k', {k}, 'size', {size}, 'need', {need!r}D, 'terms', array({terms}), 'squares', map({squares}))")
    return F.expr(f"array({', '.join(rows)})"), sorted(known)


def _covers(terms: Column, bound: Column) -> Column:
    return F.aggregate(F.array_intersect(bound["terms"], terms), F.lit(0.0), lambda acc, x: acc + bound["squares"][x]) >= bound["need"]


def _near(docs: DataFrame, idf: dict[str, float], whole_idf: dict[str, float]) -> DataFrame:
    """(doc, text, bounds) of the texts that hold enough of some template or whole licence, with these."""
    bounds, known = _bounds(idf, whole_idf)
    mine = F.transform(F.array(F.array_distinct(F.filter(_terms(F.col("text")), lambda x: x.isin(known)))), lambda terms: F.filter(bounds, lambda b: _covers(terms, b)))[0]
    return docs.where("text IS NOT NULL").select("doc", "text", mine.alias("bounds")).where(F.size("bounds") > 0)


def _runs(near: DataFrame) -> DataFrame:
    """(doc, key, text, kind): for each template that a text may hold, the runs of as many terms that start with a line,
    however the lines are broken, where they hold enough of it."""
    marked = F.regexp_replace("text", "(?:^|\n)" + BETWEEN[:-1] + "*", f" {LINE}")
    rows = near.select("doc", F.filter(_terms(marked), lambda x: x != LINE).alias("terms"), F.explode(F.filter("bounds", lambda b: b["size"] > 0)).alias("b"))

    def run(at: Column) -> Column:
        return F.transform(F.slice("terms", at, F.col("b.size")), lambda x: F.translate(x, LINE, ""))

    starts = F.filter(F.sequence(F.lit(1), F.size("terms")), lambda at: F.startswith(F.get("terms", at - 1), F.lit(LINE)))
    held = F.filter(starts, lambda at: _covers(run(at), F.col("b")))
    rows = rows.where(F.size("terms") > 0).select("doc", F.explode(F.transform(held, lambda at: F.array_join(run(at), " "))).alias("text")).distinct()
    return rows.select("doc", F.sha2("text", 256).alias("key"), "text", F.lit("header").alias("kind"))


def _units(docs: DataFrame, idf: dict[str, float], other: float) -> DataFrame:
    """(doc, key, text, kind): lines and whole texts that can reach the least cosine.

    A template's terms are all known, so cos^2 <= a / (a + b), where a sums the squared weights of a unit's known terms and
    b those of its different other terms, once each: what this leaves out is below the threshold. A looser bound on a, from
    the number of known terms, comes first."""
    lines = docs.select("doc", F.explode(F.split("text", "\n")).alias("text"), F.lit("header").alias("kind"))
    files = docs.select("doc", "text", F.lit("file").alias("kind"))
    least = F.when(F.col("kind") == "header", LINE_COSINE).otherwise(FILE_COSINE) ** 2
    weight = F.create_map(*[F.lit(x) for pair in sorted(idf.items()) for x in pair])

    def may(terms: Column, known: Column) -> Column:
        b = (F.size(F.array_distinct(terms)) - F.size(F.array_distinct(known))) * other**2
        most = (F.size(known) * max(idf.values())) ** 2
        a = F.aggregate(F.array_distinct(known), F.lit(0.0), lambda acc, x: acc + F.pow(F.size(F.filter(known, lambda y: y == x)) * weight[x], F.lit(2.0)))
        return (F.size(known) > 0) & (most >= least * (most + b)) & (a * (1 + 1e-9) >= least * (a + b))

    # The lambdas bind the terms and the known ones, so that each is made once for a unit.
    reach = F.transform(F.array(_terms(F.col("text"))), lambda t: F.transform(F.array(F.filter(t, lambda x: x.isin(VOCABULARY))), lambda k: may(t, k))[0])[0]
    return lines.unionAll(files).where(reach).select("doc", F.sha2("text", 256).alias("key"), "text", "kind")


def _matches(units: DataFrame, idf: dict[str, float], other: float, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(key, license, cosine, lead) of each different unit: its best template, ties to the first licence, and how far it is
    ahead of the best one of another licence. A digest stands for the text wherever rows multiply."""
    spark = units.sparkSession
    weights = F.broadcast(_local(spark, sorted(idf.items()), "term, idf"))  # the template terms
    terms = units.select("key", "text").dropDuplicates(["key"]).select("key", F.explode(_terms(F.col("text"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    terms = terms.join(weights, "term", "left").select("key", "term", (F.col("tf") * F.coalesce("idf", F.lit(other))).alias("w"))
    norm = terms.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = terms.join(F.broadcast(template_table(spark, idf, templates)), "term").groupBy("key", "license", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cos = dots.join(norm, "key").select("key", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine"))
    cos = cos.groupBy("key", "license").agg(F.max("cosine").alias("cosine"))
    best = cos.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("less"), "license"))).alias("all"))  # one for each licence
    return best.select("key", F.col("all")[0]["license"].alias("license"), (-F.col("all")[0]["less"]).alias("cosine"), (F.coalesce(F.get("all", F.lit(1))["less"], F.lit(0.0)) - F.col("all")[0]["less"]).alias("lead"))


def scan(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, *keep, license, origin, cosine, from_path) for every row of docs (path, text); keep names columns to carry.

    origin: 'file' if the whole text is a licence (cosine of at least 0.8 to a template, or 0.92 to a licence's whole text
    and 0.002 ahead of any other), 'header' if a line is, or a run of terms from a line's start that is as long as a template
    (0.8), each the best one, which hang on the text alone; else 'inherited' from the nearest directory above, its own
    first, that holds a licence file (the best of a directory, then the smallest path, then the first licence); else null,
    with a null license. Null and empty texts match nothing but inherit; a null path inherits nothing and passes nothing on.
    Repeated rows give equal rows. An empty table gives none. Other columns aren't read.
    """
    docs = docs.select("path", *(F.col(c).alias(f"keep{k}") for k, c in enumerate(keep)), "text", F.sha2("text", 256).alias("doc"))
    idf, other = term_weights(docs)
    near = materialize(_near(docs, idf, WHOLE_IDF), "license-near")
    units = materialize(_units(docs, idf, other).unionAll(_runs(near)), "license-units")
    lines = materialize(_matches(units, idf, other), "license-lines")
    found = units.drop("text").join(lines, "key").where(F.col("cosine") >= F.when(F.col("kind") == "header", LINE_COSINE).otherwise(FILE_COSINE)).select("doc", "kind", "license", "cosine")
    whole = near.where(F.exists("bounds", lambda b: b["size"] == 0)).select(F.col("doc").alias("key"), "text")
    whole = _matches(whole, WHOLE_IDF, WHOLE_OTHER, WHOLE_TEXTS).where((F.col("cosine") >= WHOLE_COSINE) & (F.col("lead") >= MARGIN))
    found = found.unionAll(whole.select(F.col("key").alias("doc"), F.lit("file").alias("kind"), "license", "cosine"))
    own = found.groupBy("doc").agg(F.min(F.struct("kind", (-F.col("cosine")).alias("less"), "license")).alias("b"))
    own = own.select("doc", F.col("b.kind").alias("kind"), F.col("b.license").alias("license"), (-F.col("b.less")).alias("cosine"))
    own = materialize(own, "license-own")

    def directory(path: str) -> Column:
        return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).when(F.col(path).isNotNull(), F.lit(""))

    files = docs.where("path IS NOT NULL").select("path", "doc").join(own.where("kind = 'file'"), "doc")
    holders = files.groupBy(directory("path").alias("above")).agg(F.min(F.struct((-F.col("cosine")).alias("less"), "path", "license", "cosine")).alias("b"))
    holders = holders.select("above", F.col("b.path").alias("from_path"), F.col("b.license").alias("got"), F.col("b.cosine").alias("got_cosine"))
    dirs = docs.select(directory("path").alias("dir")).where("dir IS NOT NULL").distinct()
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    chain = dirs.select("dir", parts.alias("parts")).select("dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda k: F.array_join(F.slice("parts", F.lit(1), k), "/"))).alias("depth", "above"))
    near = chain.join(holders, "above").groupBy("dir").agg(F.max(F.struct("depth", "from_path", "got", "got_cosine")).alias("n")).select("dir", "n.from_path", "n.got", "n.got_cosine")
    carried = [f"keep{k}" for k in range(len(keep))]
    out = docs.select("path", *carried, "doc", directory("path").alias("dir")).join(own, "doc", "left").join(near, "dir", "left")
    has = F.col("license").isNotNull()
    return out.select(
        "path",
        *(F.col(c).alias(n) for c, n in zip(carried, keep, strict=True)),
        F.coalesce("license", "got").alias("license"),
        F.when(has, F.col("kind")).when(F.col("got").isNotNull(), F.lit("inherited")).alias("origin"),
        F.coalesce("cosine", "got_cosine").alias("cosine"),
        F.when(~has, F.col("from_path")).alias("from_path"),
    )
