"""Rounding and interpolation as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_even(x: Column, places: int = 0) -> Column:
    """Rounds halves to the even neighbour."""
    return F.bround(x.cast("double"), places)


def linspace(start: Column, stop: Column, n: int) -> Column:
    """Array of n evenly spaced values, both ends included."""
    if n == 1:
        return F.array(start.cast("double"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(k == n - 1, stop.cast("double")).otherwise(start + (stop - start) / (n - 1) * k))


def segments(table: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pieces of the polygon through (x, y) in order of x: x0, x1, y0, y1, and which are the first and the last."""
    w = Window.partitionBy(*keys).orderBy(x)
    out = table.select(*keys, F.col(x).alias("x0"), F.lead(x).over(w).alias("x1"), F.col(y).alias("y0"), F.lead(y).over(w).alias("y1"), F.row_number().over(w).alias("_k"), F.count("*").over(Window.partitionBy(*keys)).alias("_n"))
    return out.where("x1 is not null or _n = 1").withColumn("first", F.col("_k") == 1).withColumn("last", F.col("_k") >= F.col("_n") - 1).drop("_k", "_n")


def interpolate(points: DataFrame, at: str, table: DataFrame, keys: list[str], x: str, y: str, out: str) -> DataFrame:
    """points with `out`, table's y at points' `at`, linear between neighbours and flat outside (a range join per key)."""
    s = segments(table, keys, x, y)
    s = s.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "x0", "x1", "y0", "y1", "first", "last")
    here = F.col(at)
    inside = (F.col("first") | (here >= F.col("x0"))) & (F.col("last") | (here < F.col("x1")))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    value = F.when(F.col("x1").isNull() | (here <= F.col("x0")), F.col("y0")).when(here >= F.col("x1"), F.col("y1")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (here - F.col("x0")) / (F.col("x1") - F.col("x0")))
    return points.join(s, same & inside).withColumn(out, value).select(*points.columns, out)
