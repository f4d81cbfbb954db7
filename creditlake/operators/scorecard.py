"""Logistic scorecard on weight-of-evidence columns: fit, points and contributions."""

from __future__ import annotations

from math import log

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTOR = 20 / log(2)
OFFSET = 600 - FACTOR * log(50)


def fit(rows: DataFrame, woe_columns: list[str], target: str = "defaut") -> tuple[list[float], float]:
    """(coefficients, intercept) of the L2-penalised fit with penalty 1/n, columns as they are."""
    x = VectorAssembler(inputCols=woe_columns, outputCol="x").transform(rows.select(*woe_columns, F.col(target).cast("double").alias("y"))).select("x", "y").persist()
    m = LogisticRegression(featuresCol="x", labelCol="y", regParam=1 / max(1, x.count()), elasticNetParam=0.0, standardization=False, tol=1e-10).fit(x)
    x.unpersist()
    return [float(c) for c in m.coefficients], float(m.intercept)


def score(rows: DataFrame, woe_columns: list[str], coefficients: list[float], intercept: float) -> DataFrame:
    """Adds score, rounded half to even and held in 300 to 850, and the three contributions largest in size."""
    k = len(woe_columns)
    points = [(-(F.lit(c) * F.col(n) + F.lit(intercept / k)) * FACTOR).alias(n) for n, c in zip(woe_columns, coefficients, strict=True)]
    logit = sum((F.lit(c) * F.col(n) for n, c in zip(woe_columns, coefficients, strict=True)), F.lit(intercept))
    each = F.array(*[F.struct((-F.abs(p)).alias("less"), F.lit(n).alias("variable"), p.alias("points")) for n, p in zip(woe_columns, points, strict=True)])
    top = F.transform(F.slice(F.array_sort(each), 1, 3), lambda s: F.struct(s["variable"].alias("variable"), s["points"].alias("points")))
    return rows.withColumn("score", F.greatest(F.lit(300), F.least(F.lit(850), F.rint(F.lit(OFFSET) - FACTOR * logit)))).withColumn("facteurs", top)
