"""Text functions against exact arithmetic."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import functions as F

from knotwork.functions import text as T


def rounded(x, digits):
    d = Decimal(x)  # exact
    return float(d.quantize(Decimal(1).scaleb(d.adjusted() - digits + 1), ROUND_HALF_UP)) if d else 0.0


def test_significant_digits_are_those_of_the_exact_value(spark):
    rng = np.random.default_rng(1)
    xs = [0.0, 1000.0, 999.96, 2794.5, 1902.5, 445.95, 965.45, 27945.0, 279450.0, 1e-9, -445.95, -2794.5, 0.00012345, 0.5, 99999.5]
    xs += (10.0 ** rng.uniform(-9, 9, 3000)).tolist() + (rng.integers(10_000, 10_000_000, 3000) / 100).tolist() + ((rng.integers(1000, 9999, 3000) * 10 + 5) / 100).tolist()
    for digits in (4, 6):
        got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", T.significant(F.col("x"), digits).alias("y")).collect()
        assert [(r.x, r.y) for r in got if r.y != rounded(r.x, digits)] == []
    odd = spark.createDataFrame([(None,), (float("inf"),)], "x double").select(T.significant(F.col("x"), 4).alias("y")).collect()
    assert {r.y for r in odd} <= {None, float("inf")}
