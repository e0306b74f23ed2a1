"""Coordinates of nodes in closed form: rings by hop, groups on a circle, a grid by rank, columns by level; colours and sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distances of rows and columns (fixed values).
GRID, COLUMNS = (96, 62), (210, 52)


def _place(by: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1


def radial(nodes: DataFrame, width: float = 1200, height: float = 800) -> DataFrame:
    """(id, x, y) of (id, hop, degree): a ring for each hop, the higher degree first."""
    w = Window.partitionBy("hop")
    far = F.greatest(F.max("hop").over(Window.partitionBy(F.lit(0))), F.lit(1))
    r = F.when(F.col("hop") == 0, 0.0).otherwise(F.col("hop") / far * (min(width, height) / 2 - 70) + 70)
    a = _place(["hop"], [F.desc("degree"), F.col("id")]) / F.count("*").over(w) * (2 * math.pi)
    return nodes.select("id", r.alias("r"), a.alias("a")).select("id", (F.cos("a") * F.col("r")).alias("x"), (F.sin("a") * F.col("r")).alias("y"))


def concentric(nodes: DataFrame, width: float = 1200, height: float = 800) -> DataFrame:
    """(id, x, y) of (id, community): communities on a circle, the largest first, their members on circles of their own. Ties by number of the community and id."""
    sizes = nodes.groupBy("community").agg(F.count("*").alias("n"))
    # One row for each community; their numbering sorts these alone.
    w = Window.partitionBy(F.lit(0))
    sizes = sizes.select("community", "n", (F.row_number().over(w.orderBy(F.desc("n"), "community")) - 1).alias("g"), F.count("*").over(w).alias("k"))
    big = min(width, height) / 2 - 90
    rows = nodes.join(sizes, "community").withColumn("p", _place(["community"], [F.col("id")]))
    ga, a = F.col("g") / F.col("k") * (2 * math.pi), F.col("p") / F.col("n") * (2 * math.pi)
    far, r = F.when(F.col("k") == 1, 0.0).otherwise(big * 0.62), F.when(F.col("n") == 1, 0.0).otherwise(14 + F.sqrt("n") * 13)
    return rows.select("id", (F.cos(ga) * far + F.cos(a) * r).alias("x"), (F.sin(ga) * far + F.sin(a) * r).alias("y"))


def grid(ranked: DataFrame, total: int) -> DataFrame:
    """(id, x, y) of (id, place from 0): rows of so many columns that the field is wide."""
    cols = max(1, math.ceil(math.sqrt(total * 1.7)))
    rows = math.ceil(total / cols)
    return ranked.select("id", ((F.col("place") % cols - (cols - 1) / 2) * GRID[0]).alias("x"), ((F.floor(F.col("place") / cols) - (rows - 1) / 2) * GRID[1]).alias("y"))


def layered(levels: DataFrame) -> DataFrame:
    """(id, x, y) of (id, level, place): a column for each level that has nodes, in order."""
    sizes = levels.groupBy("level").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0))
    sizes = sizes.select("level", "n", (F.row_number().over(w.orderBy("level")) - 1).alias("col"), F.count("*").over(w).alias("cols"))
    rows = levels.join(sizes, "level")
    return rows.select("id", ((F.col("col") - (F.col("cols") - 1) / 2) * COLUMNS[0]).alias("x"), ((F.col("place") - (F.col("n") - 1) / 2) * COLUMNS[1]).alias("y"))


def hue(key: Column) -> Column:
    """A colour angle from a whole number, by the golden angle."""
    return F.pmod(key * F.lit(137.508), F.lit(360.0))


def text_hash(text: Column) -> Column:
    """A number from a text: each character's code on 31 times what came before, in 32 bits."""
    step = lambda acc, c: F.pmod(acc * 31 + F.ascii(c), F.lit(2**32))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda acc, c: step(acc, c).cast("long"))
