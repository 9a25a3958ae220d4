"""Equilibration tests: block gradients, half differences, stationarity, comparisons of the start with the end, R-hat."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.distributions import f_p_value, normal_quantile, t975, t_p_value
from tidewater.functions.numeric import half_even
from tidewater.functions.ranges import medians, positions, ranked, with_keys
from tidewater.operators.estimator import block_mbars
from tidewater.operators.series import block_averages, block_gradient, discard_burn_in
from tidewater.schema import STAGE, WINDOW
from tidewater.sources.scratch import settled


def equil_block_gradient(samples: DataFrame, times: Column, block: int, block_ns: float, threshold: float | None = None, keys: list[str] = WINDOW) -> DataFrame:
    """(keys, equilibrated, equil_time_ns, time_shifted_ns): first slope below the threshold, or the first change of its sign.

    The index counts from the first slope, two blocks into the series, so the plain time is two blocks early; the
    shifted one adds them. times gives a row's time from its step.
    """
    slopes = block_gradient(samples, block, block_ns, keys)
    w = Window.partitionBy(*keys).orderBy("i")
    turn = F.signum("gradient") != F.signum(F.lag("gradient").over(w))
    hit = F.coalesce(turn, F.lit(False)) if threshold is None else (F.coalesce(turn, F.lit(False)) | (F.abs("gradient") < threshold))
    first = slopes.withColumn("_hit", hit).groupBy(*keys).agg((F.min(F.when(F.col("_hit"), F.col("i"))) - 2 * block).alias("at"))
    grid = samples.where("run = 1").select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("step")) - 1).alias("at"), times.alias("equil_time_ns"))
    return first.join(grid, [*keys, "at"], "left").select(*keys, F.col("at").isNotNull().alias("equilibrated"), "equil_time_ns", (F.col("equil_time_ns") + 2 * block_ns).alias("time_shifted_ns"))


def _discarded(blocks: DataFrame, fractions: list[float], n_blocks: int, keys: list[str]) -> DataFrame:
    """blocks once for each fraction, without the first blocks that it discards."""
    cut = F.array(*(F.struct(F.lit(f).alias("fraction"), F.lit(int(round(f * n_blocks))).alias("from")) for f in fractions))
    return blocks.withColumn("_c", F.explode(cut)).where("block >= _c.from").select(*blocks.columns, "_c.fraction", F.col("_c.from").alias("from"))


def _first_pass(tests: DataFrame, keys: list[str], passed: Column) -> DataFrame:
    """(keys, equilibrated, fraction): the least fraction whose test passed."""
    return tests.groupBy(*keys).agg(F.min(F.when(passed, F.col("fraction"))).alias("fraction")).select(*keys, F.col("fraction").isNotNull().alias("equilibrated"), "fraction")


def half_difference_tests(blocks: DataFrame, n_blocks: int = 100, fractions: tuple[float, ...] = (0.0, 0.1, 0.3, 0.6), keys: list[str] = STAGE) -> DataFrame:
    """(keys, fraction, gradient, ci95): slope between the halves of what is left, with its interval over runs."""
    rows = _discarded(blocks, list(fractions), n_blocks, keys)
    middle = F.col("from") + half_even((n_blocks - F.col("from")) / F.lit(2.0))
    first_run = F.min("run").over(Window.partitionBy(*keys))
    rows = rows.withColumn("_late", F.col("block") >= middle).withColumn("_r1", F.col("run") == first_run).withColumn("_m", middle)
    gap = rows.where("_r1").groupBy(*keys, "fraction").agg((F.max(F.when(F.col("block") == F.col("_m"), F.col("time_ns"))) - F.max(F.when(F.col("block") == F.col("from"), F.col("time_ns")))).alias("gap"))
    runs = rows.groupBy(*keys, "fraction", "run").agg((F.avg(F.when(F.col("_late"), F.col("dg"))) - F.avg(F.when(~F.col("_late"), F.col("dg")))).alias("d"))
    slopes = runs.join(gap, [*keys, "fraction"]).withColumn("s", F.col("d") / F.col("gap"))
    n = F.count("*")
    return slopes.groupBy(*keys, "fraction").agg(F.avg("s").alias("gradient"), (t975(n - 1) * F.stddev_samp("s") / F.sqrt(n)).alias("ci95"))


def equil_multiwindow(blocks: DataFrame, n_blocks: int = 100, keys: list[str] = STAGE) -> DataFrame:
    """The least discarded fraction at which the slope's 95 % interval contains 0."""
    return _first_pass(half_difference_tests(blocks, n_blocks, keys=keys), keys, (F.col("gradient") - F.col("ci95") < 0) & (F.col("gradient") + F.col("ci95") > 0))


#: Published KPSS level statistics and their p values.
KPSS_STATISTIC, KPSS_P = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)


def kpss_level(x: np.ndarray) -> tuple[float, float]:
    """(statistic, p) of the KPSS test for a level, with the automatic number of lags; p within 0.01 and 0.1."""
    n, e = len(x), x - x.mean()
    auto = lambda lag: float((e[lag:] * e[: n - lag]).sum())
    s0, s1 = auto(0) / n, 0.0
    for lag in range(1, int(n ** (2 / 9)) + 1):
        q = auto(lag) / (n / 2)
        s0, s1 = s0 + q, s1 + lag * q
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1) if s0 else 0
    s2 = (auto(0) + 2 * sum(auto(k) * (1 - k / (lags + 1)) for k in range(1, lags + 1))) / n
    eta = float((e.cumsum() ** 2).sum() / (n * n * s2)) if s2 else float("nan")
    return eta, float(np.interp(eta, KPSS_STATISTIC, KPSS_P))


def kpss_tests(blocks: DataFrame, n_blocks: int = 100, fractions: tuple[float, ...] = (0.0, 0.1, 0.3, 0.5), keys: list[str] = STAGE) -> DataFrame:
    """(keys, fraction, statistic, p) of the mean series of runs; a group is at most n_blocks numbers."""
    means = _discarded(blocks.groupBy(*keys, "block").agg(F.avg("dg").alias("dg")), list(fractions), n_blocks, keys)
    lists = means.groupBy(*keys, "fraction").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "dg"))), lambda s: s["dg"]).alias("x"))

    @F.pandas_udf("statistic double, p double")
    def test(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kpss_level(np.array(v)) for v in x], columns=["statistic", "p"])

    return lists.withColumn("_t", test("x")).select(*keys, "fraction", "_t.statistic", "_t.p")


def equil_kpss(blocks: DataFrame, n_blocks: int = 100, level: float = 0.05, keys: list[str] = STAGE) -> DataFrame:
    return _first_pass(kpss_tests(blocks, n_blocks, keys=keys), keys, F.col("p") > level)


def _check_slices(first: float, last: float, intervals: int) -> None:
    if not (0 < first < 1 and 0 < last < 1 and first + last <= 1 and intervals > 1):
        raise ValueError("first and last must be fractions that sum to 1 at most, intervals above 1")


def _slices(samples: DataFrame, weights: DataFrame, first: float, last: float, intervals: int, n_blocks: int, keys: list[str]) -> DataFrame:
    """(keys, fraction, run, a, b, time_ns): each run's mean at the start and at the end, for rising start fractions."""
    _check_slices(first, last, intervals)
    blocks = block_averages(samples, weights, n_blocks, [float(f) for f in np.linspace(0, 1 - last, intervals)], keys=keys)
    return _ends(blocks, first, last, n_blocks, keys)


def _ends(blocks: DataFrame, first: float, last: float, n_blocks: int, keys: list[str]) -> DataFrame:
    early, late = F.col("block") < round(first * n_blocks), F.col("block") >= round((1 - last) * n_blocks)
    return blocks.groupBy(*keys, "fraction", "run").agg(F.avg(F.when(early, F.col("dg"))).alias("a"), F.avg(F.when(late, F.col("dg"))).alias("b"), F.min("time_ns").alias("time_ns"))


def geweke_tests(samples: DataFrame, weights: DataFrame, first: float = 0.1, last: float = 0.5, intervals: int = 4, n_blocks: int = 100, keys: list[str] = STAGE) -> DataFrame:
    """(keys, fraction, t, df, p, time_ns): Welch's test of the runs' means at the start and at the end."""
    rows = _slices(samples, weights, first, last, intervals, n_blocks, keys).groupBy(*keys, "fraction").agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_samp("a").alias("va"), F.var_samp("b").alias("vb"), F.count("*").alias("n"), F.min("time_ns").alias("time_ns"))
    sa, sb = F.col("va") / F.col("n"), F.col("vb") / F.col("n")
    rows = rows.withColumn("t", (F.col("ma") - F.col("mb")) / F.sqrt(F.nullif(sa + sb, F.lit(0.0)))).withColumn("df", (sa + sb) ** 2 * (F.col("n") - 1) / F.nullif(sa**2 + sb**2, F.lit(0.0)))
    return rows.select(*keys, "fraction", "t", "df", t_p_value("t", "df").alias("p"), "time_ns")


def paired_t_tests(samples: DataFrame, weights: DataFrame, first: float = 0.1, last: float = 0.5, intervals: int = 4, n_blocks: int = 100, keys: list[str] = STAGE) -> DataFrame:
    """As geweke_tests, with the paired test over runs, on block averages."""
    return paired_t(_slices(samples, weights, first, last, intervals, n_blocks, keys), keys)


def paired_t(slices: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fraction, t, df, p, time_ns) from each run's means a and b."""
    rows = slices.withColumn("d", F.col("a") - F.col("b")).groupBy(*keys, "fraction").agg(F.avg("d").alias("m"), F.stddev_samp("d").alias("s"), F.count("d").alias("n"), F.min("time_ns").alias("time_ns"))
    rows = rows.withColumn("t", F.col("m") / F.nullif(F.col("s") / F.sqrt("n"), F.lit(0.0))).withColumn("df", (F.col("n") - 1).cast("double"))
    return rows.select(*keys, "fraction", "t", "df", t_p_value("t", "df").alias("p"), "time_ns")


def equil_geweke(samples: DataFrame, weights: DataFrame, level: float = 0.2, keys: list[str] = STAGE, **options: float) -> DataFrame:
    return _first_pass(geweke_tests(samples, weights, keys=keys, **options), keys, F.col("p") > level)


def equil_paired_t(samples: DataFrame, weights: DataFrame, level: float = 0.05, keys: list[str] = STAGE, **options: float) -> DataFrame:
    return _first_pass(paired_t_tests(samples, weights, keys=keys, **options), keys, F.col("p") > level)


def _normal_scores(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """rows, which have the rows of their key as _c, with the normal quantiles of the value's ranks."""
    return ranked(rows, keys, value, "_rank").withColumn("_p", (F.col("_rank") - 0.375) / (F.col("_c") + 0.25)).withColumn(out, normal_quantile(F.col("_p"))).drop("_rank", "_p")


def gelman_rubin(samples: DataFrame, discard: float = 0.1, cutoff: float = 1.1, keys: list[str] = WINDOW, value: str = "grad") -> DataFrame:
    """(keys, rhat, converged): the larger of the rank-normalised split R-hat and that of the distances from the median.

    Chains are the first and last floor(n / 2) draws of each run after the discarded fraction. Ranks and the median are
    those of all chains of a window together.
    """
    kept = discard_burn_in(samples, discard, [*keys, "run"])
    rows = positions(kept.select(*keys, "run", "step", F.col(value).alias("v")), [*keys, "run"], "step").withColumn("h", F.floor(F.col("n") / 2))
    rows = rows.withColumn("half", F.when(F.col("i") < F.col("h"), 0).when(F.col("i") >= F.col("n") - F.col("h"), 1)).where("half is not null")
    # ranked twice and cut at the median: computed once
    rows = settled(rows.select(*keys, "run", "half", "v"))
    # written, so that this side is known to be the smaller one: the rows' file is small too, and would be broadcast whole
    of = settled(rows.groupBy(*keys).agg(F.count("*").alias("_c")).join(medians(rows, keys, "v", "_mid"), keys))
    rows = with_keys(rows, of, keys).withColumn("f", F.abs(F.col("v") - F.col("_mid")))
    rows = _normal_scores(_normal_scores(rows, keys, "v", "z"), keys, "f", "zf")
    chains = rows.groupBy(*keys, "run", "half").agg(*(f(c).alias(f"{n}_{c}") for c in ("z", "zf") for n, f in (("m", F.avg), ("v", F.var_samp))), F.count("*").alias("c"))
    m = F.max("c")
    rhat = lambda c: F.sqrt((m * F.var_samp(f"m_{c}") / F.nullif(F.avg(f"v_{c}"), F.lit(0.0)) + m - 1) / m)
    return chains.groupBy(*keys).agg(F.greatest(rhat("z"), rhat("zf")).alias("rhat")).withColumn("converged", F.col("rhat") <= cutoff)


def gelman_rubin_equilibrated(samples: DataFrame, windows: DataFrame, total_ns: Column, cutoff: float = 1.1, keys: list[str] = WINDOW) -> DataFrame:
    """gelman_rubin with each window's own equilibrated fraction discarded; a window without a time fails the query."""
    share = windows.select(*keys, F.when(F.col("equil_time_ns").isNotNull(), F.col("equil_time_ns") / total_ns).otherwise(F.raise_error(F.lit("equilibration time is not set")).cast("double")).alias("_f"))
    rows = positions(samples.join(share, keys), [*keys, "run"], "step")
    return gelman_rubin(rows.where(F.col("i") >= half_even(F.col("n") * F.col("_f"))).select(*samples.columns), 0.0, cutoff, keys)


def write_back_equilibration(windows: DataFrame, result: DataFrame, run_ns: DataFrame, keys: list[str] = STAGE) -> DataFrame:
    """windows with the flag and time (fraction of the first run's time) of the stages that a detector passed."""
    found = result.where("equilibrated").select(*keys, F.col("fraction").alias("_f"))
    rows = windows.join(found, keys, "left").join(run_ns.select(*keys, "lam", F.col("total_ns").alias("_t")), [*keys, "lam"], "left")
    return rows.withColumn("equil_time_ns", F.when(F.col("_f").isNotNull(), F.col("_f") * F.col("_t")).otherwise(F.col("equil_time_ns"))).withColumn("equilibrated", F.col("_f").isNotNull() | F.col("equilibrated")).select(*windows.columns)


def read_equil_flags(windows: DataFrame, keys: list[str] = WINDOW) -> DataFrame:
    """The stored flags and times: a detector that decides nothing."""
    return windows.select(*keys, "equilibrated", "equil_time_ns")


def brown_forsythe(table: DataFrame, group: str, value: str) -> DataFrame:
    """(f, df1, df2, p): whether the spreads of the groups differ, by one-way F of the distances from the medians."""
    rows = table.select(group, F.col(value).alias("v"))
    rows = with_keys(rows, settled(medians(rows, [group], "v", "_mid")), [group]).withColumn("d", F.abs(F.col("v") - F.col("_mid")))
    groups = rows.groupBy(group).agg(F.avg("d").alias("m"), F.count("d").alias("n"), (F.var_pop("d") * F.count("d")).alias("within"))
    total = groups.agg(F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"), F.sum(F.col("n") * F.col("m")).alias("s1"), F.sum("n").alias("n"), F.sum("within").alias("w"), F.count("*").alias("k"))
    between = (F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / (F.col("k") - 1)
    out = total.where("k > 1").select((between / F.nullif(F.col("w") / (F.col("n") - F.col("k")), F.lit(0.0))).alias("f"), (F.col("k") - 1).cast("double").alias("df1"), (F.col("n") - F.col("k")).cast("double").alias("df2"))
    return out.withColumn("p", f_p_value("f", "df1", "df2"))


def paired_t_tests_mbar(samples: DataFrame, first: float = 0.1, last: float = 0.5, intervals: int = 4, n_blocks: int = 100, keys: list[str] = STAGE, timestep_ns: float = 1.0) -> DataFrame:
    """paired_t_tests on blocks that are estimated by reweighting: all blocks of all start fractions are one solve."""
    _check_slices(first, last, intervals)
    blocks = block_mbars(samples, n_blocks, [float(f) for f in np.linspace(0, 1 - last, intervals)], keys=keys, timestep_ns=timestep_ns)
    return paired_t(_ends(blocks, first, last, n_blocks, keys), keys)


def equil_paired_t_mbar(samples: DataFrame, level: float = 0.05, keys: list[str] = STAGE, **options: float) -> DataFrame:
    return _first_pass(paired_t_tests_mbar(samples, keys=keys, **options), keys, F.col("p") > level)


#: Detectors by name: DataFrames to (keys, equilibrated, fraction) or (keys, equilibrated, equil_time_ns).
DETECTORS = {"block_gradient": equil_block_gradient, "multiwindow": equil_multiwindow, "kpss": equil_kpss, "geweke": equil_geweke, "paired_t": equil_paired_t, "paired_t_mbar": equil_paired_t_mbar, "stored": read_equil_flags}
