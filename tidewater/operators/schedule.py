"""Where to put windows and how long to run them: spacing, overlap, improvement and allocation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.numeric import half_even, interpolate
from tidewater.operators.series import cumulative_trapezoid
from tidewater.operators.statistics import time_normalised_sems
from tidewater.schema import K_B, STAGE


def integrated_error(stats: DataFrame, times: DataFrame | None = None, er_type: str = "sem", origin: str = "inter", smoothen: bool = True, keys: list[str] = STAGE) -> DataFrame:
    """(keys, lam, er, integrated): error of the gradients and its integral up to each window.

    er_type sem takes time-normalised errors (and needs more than one run); root_var the deviation within runs.
    """
    if er_type not in ("sem", "root_var"):
        raise ValueError("er_type must be sem or root_var")
    if er_type == "sem":
        if origin not in ("inter", "intra"):
            raise ValueError("origin must be inter or intra")
        rows = time_normalised_sems(stats, times, origin, smoothen, keys).withColumn("er", F.when(F.col("n_runs") > 1, F.col("sem")).otherwise(F.raise_error(F.lit("sem needs more than one run")).cast("double")))
    else:
        rows = stats.withColumn("er", F.sqrt("var_intra"))
    return cumulative_trapezoid(rows.select(*keys, "lam", "er"), keys, "lam", "er", "integrated")


def optimal_lambdas(errors: DataFrame, delta_er: float | None = None, n_lam: int | None = None, places: int | None = 3, keys: list[str] = STAGE) -> DataFrame:
    """(keys, k, lam): windows that divide the integrated error evenly; their number is given or follows from delta_er."""
    if (delta_er is None) == (n_lam is None):
        raise ValueError("exactly one of delta_er and n_lam is needed")
    total = errors.groupBy(*keys).agg(F.max_by("integrated", "lam").alias("total"))
    n = F.greatest(half_even(F.col("total") / F.lit(delta_er)) + 1 if n_lam is None else F.lit(n_lam), F.lit(2)).cast("int")
    targets = total.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("target", F.col("total") * F.col("k") / (F.col("n") - 1))
    # a stretch without error maps to one target; np.interp's choice there is the later end, as is the range join's
    out = interpolate(targets, "target", errors, keys, "integrated", "lam", "lam")
    return out.select(*keys, "k", (F.col("lam") if places is None else half_even(F.col("lam"), places)).alias("lam"))


def predicted_overlap(stats: DataFrame, temperature_k: float = 298.0, keys: list[str] = STAGE) -> DataFrame:
    """(keys, i, j, value): tridiagonal overlap matrix expected from the variances within runs; rows sum to 1."""
    w = Window.partitionBy(*keys).orderBy("lam")
    beta = 1 / (K_B * temperature_k)
    rows = stats.select(*keys, (F.row_number().over(w) - 1).alias("i"), (F.lead("lam").over(w) - F.col("lam")).alias("d"), ((F.lead("var_intra").over(w) + F.col("var_intra")) / 2).alias("v"))
    rows = rows.withColumn("up", 1 / (2 + 0.5 * beta**2 * F.col("d") ** 2 * F.col("v"))).withColumn("down", F.lag("up").over(Window.partitionBy(*keys).orderBy("i")))
    cell = lambda step, value: F.struct((F.col("i") + step).alias("j"), value.alias("value"))
    cells = F.explode(F.array(cell(-1, F.col("down")), cell(0, 1 - F.coalesce("up", F.lit(0.0)) - F.coalesce("down", F.lit(0.0))), cell(1, F.col("up"))))
    return rows.select(*keys, "i", cells.alias("c")).select(*keys, "i", "c.j", "c.value").where("value is not null")


def improvement_factor(errors: DataFrame, initial: DataFrame | None = None, keys: list[str] = STAGE) -> DataFrame:
    """(keys, factor): root of the least variance, that of evenly divided error, over the variance at the initial windows.

    Each initial window answers for the error between the midpoints to its neighbours, the outer ones up to 0 and 1.
    """
    initial = errors.select(*keys, "lam") if initial is None else initial
    w = Window.partitionBy(*keys).orderBy("lam")
    mid = lambda other: (F.col("lam") + other.over(w)) / 2
    edges = initial.select(*keys, "lam", F.coalesce(mid(F.lag("lam")), F.lit(0.0)).alias("lo"), F.coalesce(mid(F.lead("lam")), F.lit(1.0)).alias("hi"))
    edges = interpolate(edges, "lo", errors, keys, "lam", "integrated", "e0")
    edges = interpolate(edges, "hi", errors, keys, "lam", "integrated", "e1")
    start = edges.groupBy(*keys).agg(F.sum((F.col("e1") - F.col("e0")) ** 2).alias("v0"), F.count("*").alias("n"))
    best = errors.groupBy(*keys).agg(F.max_by("integrated", "lam").alias("total"))
    return start.join(best, keys).select(*keys, F.sqrt(F.col("total") ** 2 / F.col("n") / F.col("v0")).alias("factor"))


def optimal_runtime(stats: DataFrame, times: DataFrame, windows: DataFrame, max_runtime_ns: float = 30.0, keys: list[str] = STAGE) -> DataFrame:
    """Allocation: (keys, lam, predicted_ns, actual_ns, extra_ns per run) for the most efficient total time of each window.

    predicted is the time-normalised smoothed error over sqrt(runtime constant * cost), at most max_runtime per run;
    extra at most doubles what has been run and is rounded up to 0.1 ns; 0 where the time is reached.
    """
    sems = time_normalised_sems(stats, times, "inter_delta_g", True, keys).select(*keys, "lam", "n_runs", "sem", (F.col("total_ns") * F.col("n_runs")).alias("actual_ns"))
    rows = sems.join(windows.select(*keys, "lam", "runtime_constant", "relative_cost"), [*keys, "lam"])
    predicted = F.least(F.col("sem") / F.sqrt(F.col("runtime_constant") * F.col("relative_cost")), F.lit(max_runtime_ns) * F.col("n_runs"))
    rows = rows.withColumn("predicted_ns", predicted)
    extra = F.least((F.col("predicted_ns") - F.col("actual_ns")) / F.col("n_runs"), F.col("actual_ns") / F.col("n_runs"))
    return rows.select(*keys, "lam", "n_runs", "predicted_ns", "actual_ns", F.when(F.col("actual_ns") < F.col("predicted_ns"), F.ceil(extra * 10) / 10.0).otherwise(F.lit(0.0)).alias("extra_ns"))


def relax_constant(windows: DataFrame, equilibrated: DataFrame, keys: list[str] = STAGE, by: float = 4.0) -> DataFrame:
    """windows with the runtime constant divided where the stage is not equilibrated."""
    flags = equilibrated.select(*keys, F.col("equilibrated").alias("_eq"))
    return windows.join(flags, keys, "left").withColumn("runtime_constant", F.when(F.coalesce("_eq", F.lit(False)), F.col("runtime_constant")).otherwise(F.col("runtime_constant") / by)).select(*windows.columns)


def runtime_to_cycles(allocation: DataFrame, time_per_cycle_ns: float, runtime: str = "extra_ns") -> DataFrame:
    """allocation with cycles; a runtime that is no multiple of the time per cycle (to 4 places) fails the query."""
    exact = F.bround(F.col(runtime).cast("decimal(30,12)") % F.lit(str(time_per_cycle_ns)).cast("decimal(30,12)"), 4)
    ok = (exact == 0) | (exact == F.lit(str(round(time_per_cycle_ns, 4))).cast("decimal(30,12)"))
    cycles = half_even(F.col(runtime) / time_per_cycle_ns).cast("long")
    return allocation.withColumn("cycles", F.when(ok, cycles).otherwise(F.raise_error(F.lit("runtime is no multiple of the time per cycle")).cast("long")))
