"""Roll-ups through the hierarchy: times, flags, signed sums with errors, and the results table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.statistics import mean_ci95, quadrature
from tidewater.schema import SERIES, STAGE

LEVELS = ("all", "calc", "leg", "stage", "lam", "run")


def levels(table: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Sums at every level of the hierarchy, with the level's name; keys below a level are null."""
    names = F.element_at(F.array(*(F.lit(n) for n in ["all", *keys])), (F.lit(len(keys) + 1) - F.bit_count(F.grouping_id())).cast("int"))
    return table.rollup(*keys).agg(F.sum(value).alias(out), names.alias("level"))


def total_simtime(samples: DataFrame, timestep_ns: float, keys: list[str] = SERIES, every: DataFrame | None = None) -> DataFrame:
    """(keys, level, simtime_ns): last step times the timestep, added up to every level; `every` lists series without rows, which count 0."""
    last = samples.groupBy(*keys).agg(F.max("step").alias("_last"))
    if every is not None:
        last = every.select(*keys).distinct().join(last, keys, "left")
    return levels(last.withColumn("_t", F.coalesce("_last", F.lit(0)) * F.lit(timestep_ns)), keys, "_t", "simtime_ns")


def total_gpu_time(gpu: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """(keys, level, gpu_hours) at every level, from one row per series."""
    return levels(gpu, keys, "gpu_hours", "gpu_hours")


def equil_time(windows: DataFrame, keys: list[str] = STAGE) -> DataFrame:
    """(keys, equil_time_ns): sum over windows, per run."""
    return windows.groupBy(*keys).agg(F.sum("equil_time_ns").alias("equil_time_ns"))


def all_equilibrated(windows: DataFrame, keys: list[str] = STAGE) -> DataFrame:
    return windows.groupBy(*keys).agg(F.bool_and("equilibrated").alias("equilibrated"))


def combine_legs(runs: DataFrame, keys: list[str], minus: tuple[str, ...] = ("bound",), leg: str = "leg") -> DataFrame:
    """(keys, run, dg, er): legs added with their signs, errors in quadrature."""
    sign = F.when(F.col(leg).isin(list(minus)), -1.0).otherwise(1.0)
    return runs.groupBy(*keys, "run").agg(F.sum(F.col("dg") * sign).alias("dg"), quadrature("er").alias("er"))


def apply_restraint_correction(runs: DataFrame, corrections: DataFrame, leg: str = "bound", keys: tuple[str, ...] = ("calc", "run")) -> DataFrame:
    """runs with the per-run correction added to one leg; it has no error of its own."""
    extra = corrections.select(*keys, F.col("dg").alias("_corr"))
    add = F.when(F.col("leg") == leg, F.coalesce("_corr", F.lit(0.0))).otherwise(F.lit(0.0))
    return runs.join(extra, list(keys), "left").withColumn("dg", F.col("dg") + add).select(*runs.columns)


def results_table(runs: DataFrame, simtime: DataFrame, gpu: DataFrame, keys: list[str], corrections: DataFrame | None = None, parity: bool = False) -> DataFrame:
    """(keys, node, level, dg, dg_ci, simtime_ns, gpu_hours, gpu_share) of every node.

    runs has (keys, run, dg) of each node to list, keys below its level null; simtime and gpu are roll-ups with the
    same keys. The share divides exact hours by the root's and is then rounded; with parity the rounded hours are
    divided. corrections (calc, run, dg) give a row of their own with zero times.
    """
    ci = mean_ci95(runs, keys, "dg")
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    s, g = simtime.alias("s"), gpu.alias("g")
    root = gpu.where("level = 'all'").select(F.col("gpu_hours").alias("_root")).agg(F.max("_root").alias("_root"))
    joined = ci.alias("c").join(s, same(ci, simtime), "left").join(g, same(ci, gpu), "left").crossJoin(F.broadcast(root))  # the root is one row
    hours = F.col("g.gpu_hours")
    rows = joined.select(*(F.col(f"c.{k}").alias(k) for k in keys), F.concat_ws("/", *(F.col(f"c.{k}") for k in keys)).alias("node"), F.col("s.level").alias("level"), F.bround(F.col("c.mean"), 2).alias("dg"), F.bround(F.col("c.ci95"), 2).alias("dg_ci"), F.bround(F.col("s.simtime_ns"), 0).alias("simtime_ns"), F.bround(hours, 0).alias("gpu_hours"), F.bround((F.bround(hours, 0) if parity else hours) / F.nullif("_root", F.lit(0.0)), 3).alias("gpu_share"))
    if corrections is not None:
        extra = mean_ci95(corrections, ["calc"], "dg")
        zero = lambda name: F.lit(0.0).alias(name)
        rows = rows.unionByName(extra.select(*((F.col("calc") if k == "calc" else F.lit("bound") if k == "leg" else F.lit(None).cast(rows.schema[k].dataType)).alias(k) for k in keys), F.concat_ws("/", F.col("calc"), F.lit("bound"), F.lit("restraint_corr")).alias("node"), F.lit("restraint_corr").alias("level"), F.bround("mean", 2).alias("dg"), zero("dg_ci"), zero("simtime_ns"), zero("gpu_hours"), zero("gpu_share")))
    return rows


def relative_cost(simtime: DataFrame, gpu: DataFrame, keys: list[str], reference: float = 0.21) -> DataFrame:
    """(keys, relative_cost): hours per ns over a reference cost; null where nothing was run."""
    return simtime.select(*keys, "simtime_ns").join(gpu.select(*keys, "gpu_hours"), keys).select(*keys, (F.col("gpu_hours") / F.nullif("simtime_ns", F.lit(0.0)) / reference).alias("relative_cost"))
