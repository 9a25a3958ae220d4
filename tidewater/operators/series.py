"""Rows of a series: their index, truncation, filters, time axes, rolling and block averages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.numeric import half_even
from tidewater.functions.ranges import in_ranges, longest, positions
from tidewater.schema import RUN, SERIES, STAGE, WINDOW


def indexed(samples: DataFrame, keys: list[str] = SERIES, order: str = "step") -> DataFrame:
    """samples with i, the 0-based place of each row in its series, and n, the rows of the series."""
    return positions(samples, keys, order)


def checked(ok: Column, message: str, value: Column) -> Column:
    """value where ok, else the query fails with the message."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def truncate_fraction(samples: DataFrame, start: float = 0.0, end: float = 1.0, keys: list[str] = SERIES) -> DataFrame:
    """Rows of each series from one fraction of its length to another; the start shares a row with the block before."""
    if not 0 <= start < end <= 1:
        raise ValueError("fractions must satisfy 0 <= start < end <= 1")
    low, high = F.greatest(half_even(F.col("n") * F.lit(start)) - 1, F.lit(0.0)), half_even(F.col("n") * F.lit(end)) - 1
    return indexed(samples, keys).where((F.col("i") >= low) & (F.col("i") <= high)).select(*samples.columns)


def cut_to_shortest(samples: DataFrame, keys: list[str] = WINDOW) -> DataFrame:
    """samples whose runs all end with the shortest run of their window, as means across runs by step need it."""
    shortest = samples.groupBy(*keys, "run").count().groupBy(*keys).agg(F.min("count").alias("_least"))
    return indexed(samples, [*keys, "run"]).join(shortest, keys).where("i < _least").select(*samples.columns)


def drop_unequilibrated(samples: DataFrame, windows: DataFrame, timestep_ns: float, energy_freq: int, keys: list[str] = WINDOW) -> DataFrame:
    """Rows from each window's equilibration time on; a window without one fails the query."""
    first = F.greatest(F.floor(F.col("equil_time_ns") / (timestep_ns * energy_freq)) - 1, F.lit(0))
    at = windows.select(*keys, checked(F.col("equil_time_ns").isNotNull(), "equilibration time is not set", F.col("equil_time_ns")).alias("equil_time_ns"))
    return indexed(samples, [*keys, "run"]).join(at, keys).where(F.col("i") >= first).select(*samples.columns)


def discard_burn_in(samples: DataFrame, fraction: float, keys: list[str] = SERIES) -> DataFrame:
    """Rows after the first round(n * fraction)."""
    if not 0 <= fraction < 1:
        raise ValueError("the discarded fraction must be from 0 to below 1")
    return indexed(samples, keys).where(F.col("i") >= half_even(F.col("n") * F.lit(fraction))).select(*samples.columns)


def valid_runs(run_nos: list[int] | None, n_runs: int) -> list[int]:
    """The run numbers, all of them if none are given."""
    if run_nos is None:
        return list(range(1, n_runs + 1))
    if not run_nos or len(set(run_nos)) != len(run_nos) or min(run_nos) < 1 or max(run_nos) > n_runs:
        raise ValueError(f"run numbers must be distinct and from 1 to {n_runs}")
    return list(run_nos)


def select_runs(samples: DataFrame, run_nos: list[int] | None, n_runs: int) -> DataFrame:
    return samples if run_nos is None else samples.where(F.col("run").isin(valid_runs(run_nos, n_runs)))


def subsample(samples: DataFrame, inefficiency: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Every floor(g)-th row of each series; inefficiency has g by key."""
    return indexed(samples, keys).join(inefficiency.select(*keys, "g"), keys).where(F.col("i") % F.floor("g") == 0).select(*samples.columns, "g")


def set_equilibration_time(windows: DataFrame, time_ns: float, **under: str) -> DataFrame:
    """windows with the flag and time set for those whose keys have the given values."""
    here = reduce(lambda a, b: a & b, (F.col(k) == v for k, v in under.items()), F.lit(True))
    return windows.withColumn("equilibrated", F.when(here, F.lit(True)).otherwise(F.col("equilibrated"))).withColumn("equil_time_ns", F.when(here, F.lit(time_ns)).otherwise(F.col("equil_time_ns")))


def lambda_weights(windows: DataFrame, keys: list[str] = STAGE) -> DataFrame:
    """(keys, lam, lam_index, weight): trapezoid weight of each window's lam in its stage."""
    w = Window.partitionBy(*keys).orderBy("lam")
    before, after = F.lag("lam").over(w), F.lead("lam").over(w)
    weight = 0.5 * (F.coalesce(after, F.col("lam")) - F.coalesce(before, F.col("lam")))
    return windows.select(*keys, "lam").distinct().select(*keys, "lam", (F.row_number().over(w) - 1).alias("lam_index"), weight.alias("weight"))


def time_axis(samples: DataFrame, start: Column, end: Column, keys: list[str] = SERIES) -> DataFrame:
    """indexed samples with time_ns: the n points after start of an even grid of n + 1 from start to end."""
    return indexed(samples, keys).withColumn("time_ns", start + (end - start) * (F.col("i") + 1) / F.col("n"))


def rolling_mean(samples: DataFrame, block: int, keys: list[str] = SERIES, value: str = "grad") -> DataFrame:
    """indexed samples with `rolling`, the mean of the `block` rows before each row; null before there are as many."""
    rows, w = in_ranges(indexed(samples, keys), keys, "step", block, longest(samples, keys))
    mean = F.when(F.col("i") >= block, F.avg(value).over(w.rowsBetween(-block, -1)))
    out = rows.withColumn("rolling", checked(F.col("n") >= block, "the block is longer than the series", mean))
    return out.where("_own").select(*samples.columns, "i", "n", "rolling")


def block_gradient(samples: DataFrame, block: int, block_ns: float, keys: list[str] = WINDOW) -> DataFrame:
    """(keys, i, gradient): slope between neighbouring rolling means, averaged over the runs of a window."""
    series = [*keys, "run"]
    rows, w = in_ranges(rolling_mean(samples, block, series), series, "i", block, longest(samples, series))
    rows = rows.withColumn("earlier", F.lag("rolling", block).over(w)).where("_own")
    slope = (F.col("rolling") - F.col("earlier")) / F.lit(block_ns)
    return rows.where(F.col("i") >= 2 * block).groupBy(*keys, "i").agg(F.avg(slope).alias("gradient"))


def block_of(i: Column, n: Column, n_blocks: int) -> Column:
    """Block of row i of n, with boundaries at round(j * n / n_blocks): the largest j whose boundary i has reached."""
    guess = F.floor(i * n_blocks / n)
    edge = lambda j: half_even(j * n / F.lit(n_blocks))
    return F.least(F.when(edge(guess) > i, guess - 1).when(edge(guess + 1) <= i, guess + 1).otherwise(guess), F.lit(n_blocks - 1)).cast("int")


def block_average(samples: DataFrame, weights: DataFrame, n_blocks: int = 100, start: float = 0.0, end: float = 1.0, time: Column | None = None, keys: list[str] = STAGE) -> DataFrame:
    """(keys, run, block, dg, time_ns): weighted block means, summed over the windows of a stage.

    Each series is cut to [round(start n), round(end n)) first; fewer rows than blocks fail the query. The time of a
    block is that of an even grid from the first to the last row's time.
    """
    return block_averages(samples, weights, n_blocks, [start], end, time, keys).drop("fraction")


def block_averages(samples: DataFrame, weights: DataFrame, n_blocks: int, starts: list[float], end: float = 1.0, time: Column | None = None, keys: list[str] = STAGE) -> DataFrame:
    """block_average for several start fractions at once, told apart by `fraction`: the series are sorted and read once."""
    series = [*keys, "lam", "run"]
    rows = indexed(samples, series).withColumn("_time", F.col("step").cast("double") if time is None else time)
    cuts = F.array(*(F.struct(F.lit(float(f)).alias("fraction"), half_even(F.col("n") * F.lit(float(f))).alias("a")) for f in starts))
    rows = rows.where(F.col("i") < half_even(F.col("n") * F.lit(end))).withColumn("_c", F.explode(F.filter(cuts, lambda c: F.col("i") >= c["a"])))
    m, i = half_even(F.col("n") * F.lit(end)) - F.col("_c.a"), F.col("i") - F.col("_c.a")
    rows = rows.select(*series, F.col("_c.fraction").alias("fraction"), m.alias("m"), block_of(i, m, n_blocks).alias("block"), "grad", "_time")
    means = rows.groupBy(*series, "fraction", "m", "block").agg(F.avg("grad").alias("mean"), F.min("_time").alias("first"), F.max("_time").alias("last"))
    w = Window.partitionBy(*series, "fraction")
    means = means.withColumn("t0", F.min("first").over(w)).withColumn("t1", F.max("last").over(w))
    enough = checked(F.col("m") >= n_blocks, "not enough data for the blocks", F.col("mean"))
    at = F.col("t0") + (F.col("t1") - F.col("t0")) * F.col("block") / max(n_blocks - 1, 1)
    return means.join(weights.select(*keys, "lam", "weight"), [*keys, "lam"]).groupBy(*keys, "fraction", "run", "block").agg(F.sum(enough * F.col("weight")).alias("dg"), F.sum(at).alias("time_ns"))


def same_times(blocks: DataFrame, keys: list[str] = STAGE) -> DataFrame:
    """blocks, failing where the runs of a stage end at different times or a value is missing."""
    w = Window.partitionBy(*keys)
    last = F.max("time_ns").over(Window.partitionBy(*keys, "run"))
    out = blocks.withColumn("_last", last).withColumn("_even", F.max("_last").over(w) - F.min("_last").over(w) <= 1e-8 + 1e-5 * F.abs(F.max("_last").over(w)))
    ok = F.col("_even") & F.col("dg").isNotNull() & ~F.isnan("dg")
    return out.withColumn("dg", checked(ok, "run times differ or values are missing", F.col("dg"))).select(*blocks.columns)


def smooth3(table: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """table with the mean of each value and its neighbours in order."""
    return table.withColumn(out, F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-1, 1)))


def cumulative_trapezoid(table: DataFrame, keys: list[str], x: str, y: str, out: str) -> DataFrame:
    """table with the integral of y over x from the first x up to each row."""
    w = Window.partitionBy(*keys).orderBy(x)
    step = 0.5 * (F.col(y) + F.lag(y).over(w)) * (F.col(x) - F.lag(x).over(w))
    return table.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn(out, F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def gradient_timeseries(samples: DataFrame, end: Column, start: Column | None = None) -> DataFrame:
    """Every gradient with its time, and the mean and population deviation of its window."""
    rows = time_axis(samples, F.lit(0.0) if start is None else start, end)
    w = Window.partitionBy(*WINDOW)
    return rows.select(*SERIES, "i", "time_ns", "grad", F.avg("grad").over(w).alias("window_mean"), F.stddev_pop("grad").over(w).alias("window_sd"))


def squared_sem_convergence(convergence: DataFrame, keys: list[str] = STAGE) -> DataFrame:
    """(keys, frac, squared_sem, sem): between-run variance of the means at each fraction."""
    squared = F.var_pop("dg") / F.count("*")
    return convergence.groupBy(*keys, "frac").agg(squared.alias("squared_sem"), F.sqrt(squared).alias("sem"))


def gradient_convergence(gradients: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """gradients (keys, lam, frac, grad) with grad_shift, the difference from that of the last fraction."""
    w = Window.partitionBy(*keys, "lam").orderBy("frac").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return gradients.withColumn("grad_shift", F.col("grad") - F.last("grad").over(w))


def convergence_axis(convergence: DataFrame, times: DataFrame, keys: list[str] = STAGE) -> DataFrame:
    """convergence with the time of each fraction, and a row at time 0 without a value.

    times has total_ns (all runs), equil_ns (one run) and n_runs of each stage.
    """
    burnt = F.col("n_runs") * F.col("equil_ns")
    rows = convergence.join(times, keys).withColumn("time_ns", F.col("frac") * (F.col("total_ns") - burnt) + burnt).select(*convergence.columns, "time_ns")
    zero = convergence.select(*keys, "run").distinct().select(*keys, "run", F.lit(0.0).alias("frac"), F.lit(None).cast("double").alias("dg"), F.lit(0.0).alias("time_ns"))
    return rows.unionByName(zero)
