"""Statistics of series, windows and stages, and tests on them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.distributions import chi2_p_value, normal_quantile, t975
from tidewater.functions.numeric import half_even
from tidewater.functions.ranges import positions, ranked
from tidewater.operators.series import checked, cumulative_trapezoid, smooth3, subsample
from tidewater.schema import SERIES, STAGE, WINDOW

ORIGINS = {"inter": "sem_inter", "intra": "sem_intra", "inter_delta_g": "sem_inter_dg"}


def series_stats(samples: DataFrame, inefficiency: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """(keys, mean of all rows, var and squared_sem of every floor(g)-th row, g)."""
    means = samples.groupBy(*keys).agg(F.avg("grad").alias("mean"))
    thin = subsample(samples, inefficiency, keys).groupBy(*keys).agg(F.var_pop("grad").alias("var"), (F.var_pop("grad") / F.count("*")).alias("squared_sem"), F.first("g").alias("g"))
    return means.join(thin, keys)


def window_stats(stats: DataFrame, weights: DataFrame, timestep_ns: float, energy_freq: int, keys: list[str] = WINDOW) -> DataFrame:
    """Per window: variances and errors within and between runs, mean, inefficiency (also as a time), weighted error.

    g_ns multiplies by the timestep alone, as the reported inefficiencies always did; g_sample_ns by the time of a row.
    Where weights has the relative cost of each window, it is carried on, and costs that differ within a stage fail the
    query.
    """
    runs = F.count("*")
    out = stats.groupBy(*keys).agg(runs.alias("n_runs"), F.avg("var").alias("var_intra"), (F.avg("squared_sem") / runs).alias("s2_intra"), (F.var_pop("mean") / runs).alias("s2_inter"), F.avg("mean").alias("mean"), F.avg("g").alias("g"))
    out = out.withColumn("sem_intra", F.sqrt("s2_intra")).withColumn("sem_inter", F.sqrt("s2_inter")).withColumn("sem_tot", F.sqrt(F.col("s2_intra") + F.col("s2_inter"))).drop("s2_intra", "s2_inter")
    out = out.withColumn("g_ns", F.col("g") * timestep_ns).withColumn("g_sample_ns", F.col("g") * timestep_ns * energy_freq)
    more = []
    if "relative_cost" in weights.columns:
        stage = Window.partitionBy(*(k for k in keys if k != "lam"))
        same = F.min("relative_cost").over(stage) == F.max("relative_cost").over(stage)
        more = [checked(same, "relative costs differ within a stage", F.col("relative_cost")).alias("relative_cost")]
    return out.join(weights.select(*keys, "weight", *more), keys).withColumn("sem_inter_dg", F.col("sem_inter") * F.col("weight"))


def time_normalised_sems(stats: DataFrame, times: DataFrame, origin: str = "inter", smoothen: bool = True, keys: list[str] = STAGE) -> DataFrame:
    """stats with `sem`, the chosen error times the root of all runs' time; times has total_ns of one run per window."""
    if origin not in ORIGINS:
        raise ValueError(f"origin must be one of {sorted(ORIGINS)}")
    out = stats.join(times.select(*keys, "lam", "total_ns"), [*keys, "lam"]).withColumn("_sem", F.col(ORIGINS[origin]) * F.sqrt(F.col("total_ns") * F.col("n_runs")))
    out = smooth3(out, keys, "lam", "_sem", "sem") if smoothen else out.withColumn("sem", F.col("_sem"))
    return out.drop("_sem")


def mean_ci95(table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, ci95): the half width is t(0.975, n - 1) times the standard error; null for one row."""
    n = F.count(value)
    return table.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd")).select(*keys, "n", "mean", (t975(F.col("n") - 1) * F.col("_sd") / F.sqrt("n")).alias("ci95"))


def thermodynamic_integration(samples: DataFrame, weights: DataFrame | None = None, keys: list[str] = STAGE) -> DataFrame:
    """(keys, run, dg): trapezoid integral of each run's mean gradients.

    Without weights they follow from the means, one row per window with its runs: the samples are read once.
    """
    means = samples.groupBy(*keys, "lam", "run").agg(F.avg("grad").alias("mean"))
    if weights is None:
        windows = means.groupBy(*keys, "lam").agg(F.collect_list(F.struct("run", "mean")).alias("_runs"))
        w = Window.partitionBy(*keys).orderBy("lam")
        weight = 0.5 * (F.coalesce(F.lead("lam").over(w), F.col("lam")) - F.coalesce(F.lag("lam").over(w), F.col("lam")))
        each = windows.select(*keys, weight.alias("weight"), "_runs").select(*keys, "weight", F.explode("_runs").alias("_r"))
        return each.groupBy(*keys, F.col("_r.run").alias("run")).agg(F.sum(F.col("_r.mean") * F.col("weight")).alias("dg"))
    return means.join(weights.select(*keys, "lam", "weight"), [*keys, "lam"]).groupBy(*keys, "run").agg(F.sum(F.col("mean") * F.col("weight")).alias("dg"))


def ti_profile(samples: DataFrame, keys: list[str] = STAGE) -> DataFrame:
    """(keys, run, lam, mean, sd, pmf): mean gradients and their cumulative integral."""
    means = samples.groupBy(*keys, "run", "lam").agg(F.avg("grad").alias("mean"), F.stddev_pop("grad").alias("sd"))
    return cumulative_trapezoid(means, [*keys, "run"], "lam", "mean", "pmf")


def histogram(samples: DataFrame, bins: int = 50, keys: list[str] = SERIES, value: str = "grad") -> DataFrame:
    """(keys, bin, left, density): equal bins from a series' least to greatest value, the last one closed."""
    ends = samples.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    binned = samples.where(F.col(value).isNotNull()).join(ends, keys).withColumn("bin", F.least(F.floor((F.col(value) - F.col("_lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("_c"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return every.join(counts, [*keys, "bin"], "left").select(*keys, "bin", (F.col("_lo") + F.col("bin") * width).alias("left"), (F.coalesce("_c", F.lit(0)) / F.nullif(F.col("_n") * width, F.lit(0.0))).alias("density"))


def window_moments(samples: DataFrame, keys: list[str] = WINDOW) -> DataFrame:
    return samples.groupBy(*keys).agg(F.avg("grad").alias("mean"), F.stddev_pop("grad").alias("sd"))


def kruskal_wallis(samples: DataFrame, keys: list[str] = WINDOW, level: float = 0.05, value: str = "grad") -> DataFrame:
    """(keys, h, df, p, differ): whether the runs of a window differ; windows of one run are left out."""
    placed = ranked(samples, keys, value, "_rank")
    ties = samples.groupBy(*keys, value).agg(F.count("*").cast("double").alias("t")).groupBy(*keys).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"), F.sum("t").alias("n"))
    runs = placed.groupBy(*keys, "run").agg((F.sum("_rank") * F.sum("_rank") / F.count("*")).alias("part")).groupBy(*keys).agg(F.sum("part").alias("parts"), (F.count("*") - 1).alias("df"))
    n = F.col("n")
    h = (12.0 / (n * (n + 1)) * F.col("parts") - 3 * (n + 1)) / F.nullif(1 - F.col("ties") / (n * n * n - n), F.lit(0.0))
    out = runs.join(ties, keys).where("df > 0").select(*keys, h.alias("h"), "df")
    return out.withColumn("p", chi2_p_value(F.col("h"), F.col("df").cast("double"))).withColumn("differ", F.col("p") < level)


def probability_plot(table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, k, theoretical, ordered): sorted values against normal quantiles of their median ranks."""
    last = F.pow(F.lit(0.5), 1.0 / F.col("n"))
    p = F.when(F.col("k") == F.col("n"), last).when(F.col("k") == 1, 1 - last).otherwise((F.col("k") - 0.3175) / (F.col("n") + 0.365))
    rows = positions(table.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("ordered")), keys, "ordered").withColumn("k", F.col("i") + 1)
    return rows.select(*keys, "k", normal_quantile(p).alias("theoretical"), "ordered")


def gaussian_kde(table: DataFrame, keys: list[str], value: str, points: int = 100) -> DataFrame:
    """(keys, x, density): Gaussian kernel density with Scott's bandwidth on an even grid over the values' range.

    Batches add up their rows' kernels on the grid, so what is shuffled is a grid for each batch and key.
    """
    rows = table.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    stats = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"), (F.stddev_samp("_v") * F.pow(F.count("*"), -0.2)).alias("_h")).where("_h > 0")
    held = rows.join(stats, keys)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, part in pdf.groupby(keys, dropna=False, sort=False):
                lo, hi, n, h = (part[c].iloc[0] for c in ("_lo", "_hi", "_n", "_h"))
                x, sums = np.linspace(lo, hi, points), np.zeros(points)
                v = part["_v"].to_numpy()
                for s in range(0, len(v), 4096):
                    sums += np.exp(-0.5 * ((x - v[s : s + 4096, None]) / h) ** 2).sum(axis=0)
                yield pd.DataFrame([[*key, x.tolist(), (sums / (n * h * (2 * np.pi) ** 0.5)).tolist()]], columns=[*keys, "_x", "_d"])

    array = T.ArrayType(T.DoubleType())
    sums = held.mapInPandas(add, T.StructType([*(held.schema[k] for k in keys), T.StructField("_x", array), T.StructField("_d", array)]))
    cells = sums.select(*keys, F.posexplode(F.arrays_zip("_x", "_d")).alias("_k", "_c")).select(*keys, "_k", "_c._x", "_c._d")
    return cells.groupBy(*keys, "_k").agg(F.first("_x").alias("x"), F.sum("_d").alias("density")).drop("_k")


def shapiro_wilk(table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, w, p), a row for every group: Shapiro-Wilk W by Royston's approximation; null below 4 values.

    W is the squared correlation of the ordered values with weights from normal quantiles, all as aggregations. The
    approximation of p was fitted to 5000 values at most; beyond, it is carried on.
    """
    win = Window.partitionBy(*keys)
    n, k, m, mm, m1, m2 = (F.col(c) for c in ("_n", "_k", "_m", "_mm", "_m1", "_m2"))
    # missing values stand behind the n others and take no part
    rows = table.select(*keys, F.col(value).alias("_v"), F.row_number().over(win.orderBy(F.asc_nulls_last(value))).alias("_k"), F.count(value).over(win).alias("_n"))
    rows = rows.withColumn("_m", F.when((n >= 4) & (k <= n), normal_quantile((k - 0.375) / (n + 0.25))))
    rows = rows.withColumn("_mm", F.sum(m * m).over(win)).withColumn("_m1", F.max(m).over(win)).withColumn("_m2", F.max(F.when(k == n - 1, m)).over(win))
    u = 1 / F.sqrt(F.nullif(n, F.lit(0)))
    poly = lambda cs: reduce(lambda a, c: a * u + c, cs, F.lit(0.0))
    # fixed values of the published approximation, highest power first
    a1 = poly([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0.0]) + m1 / F.sqrt(mm)
    a2 = F.when(n > 5, poly([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0]) + m2 / F.sqrt(mm))
    rows = rows.withColumn("_a1", a1).withColumn("_a2", a2)
    a1, a2 = F.col("_a1"), F.col("_a2")
    phi = F.when(n > 5, (mm - 2 * m1**2 - 2 * m2**2) / (1 - 2 * a1**2 - 2 * a2**2)).otherwise((mm - 2 * m1**2) / (1 - 2 * a1**2))
    edge = F.least(k, n + 1 - k)
    size = F.when(edge == 1, a1).when((edge == 2) & (n > 5), a2)
    rows = rows.withColumn("_a", F.coalesce(size * F.signum(k - (n + 1) / 2.0), m / F.sqrt(phi)))
    out = rows.groupBy(*keys, "_n").agg((F.sum(F.col("_a") * F.col("_v")) ** 2 / F.nullif(F.var_pop("_v") * F.count("_v"), F.lit(0.0))).alias("_w"))
    n, ln, w = n.cast("double"), F.log("_n"), F.col("_w")
    small_mu, small_sd = 0.544 - 0.39978 * n + 0.025054 * n * n - 0.0006714 * n * n * n, F.exp(1.3822 - 0.77857 * n + 0.062767 * n * n - 0.0020322 * n * n * n)
    large_mu, large_sd = -1.5861 - 0.31082 * ln - 0.083751 * ln * ln + 0.0038915 * ln * ln * ln, F.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln * ln)
    z = F.when(n <= 11, (-F.log(-2.273 + 0.459 * n - F.log(1 - w)) - small_mu) / small_sd).otherwise((F.log(1 - w) - large_mu) / large_sd)
    upper = chi2_p_value(z * z, F.lit(1.0)) / 2
    out = out.select(*keys, "_n", "_w", z.alias("_z"), upper.alias("_u"))
    return out.select(*keys, F.col("_n").alias("n"), F.col("_w").alias("w"), F.when(F.col("_z") >= 0, F.col("_u")).otherwise(1 - F.col("_u")).alias("p"))


def equil_vs_total(windows: DataFrame, simtime: DataFrame, keys: list[str] = WINDOW) -> DataFrame:
    """(keys, total_ns, equil_time_ns): the first run's simulated time against the equilibration time."""
    return simtime.where("run = 1").select(*keys, "simtime_ns").join(windows.select(*keys, "equil_time_ns"), keys).select(*keys, F.col("simtime_ns").alias("total_ns"), "equil_time_ns")


def average_waters(coords: DataFrame, atom: int, radius: float, percent: float = 100.0, atom2: int | None = None, radius2: float | None = None, resname: str = "WAT", keys: list[str] = SERIES) -> DataFrame:
    """(keys, waters): mean over the last percent of frames of the water atoms within radius of the atom, by three.

    With atom2, atoms also have to be within radius2 of it. Frames without any count as 0. The centre has one row per
    frame, so the join adds no rows.
    """
    frame = [*keys, "frame"]

    def near(rows: DataFrame, centre: int, r: float) -> DataFrame:
        at = coords.where(F.col("atom") == centre).select(*frame, F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"))
        d2 = (F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2 + (F.col("z") - F.col("_z")) ** 2
        return rows.join(at, frame).where(d2 <= r * r).drop("_x", "_y", "_z")

    rows = near(coords.where(F.col("resname") == resname), atom, radius)
    if atom2 is not None and radius2 is not None:
        rows = near(rows, atom2, radius2)
    counts = rows.groupBy(*frame).agg((F.count("*") / 3.0).alias("_w"))
    w = Window.partitionBy(*keys)
    frames = coords.select(*frame).distinct().withColumn("_i", F.row_number().over(w.orderBy("frame")) - 1).withColumn("_n", F.count("*").over(w))
    kept = frames.where(F.col("_i") >= half_even(F.col("_n") - F.lit(percent / 100) * F.col("_n")))
    return kept.join(counts, frame, "left").groupBy(*keys).agg(F.avg(F.coalesce("_w", F.lit(0.0))).alias("waters"))


def quadrature(column: str) -> Column:
    return F.sqrt(F.sum(F.col(column) * F.col(column)))
