"""Analyses of a stage: from samples to a free energy with its error and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import autocorrelation, equilibration, estimator, schedule, series, statistics
from tidewater.schema import SERIES, STAGE
from tidewater.sources.scratch import settled


def free_energy_ti(samples: DataFrame, keys: list[str] = STAGE) -> DataFrame:
    """(keys, n, mean, ci95): integrated gradients of each run, and their mean with its interval."""
    runs = statistics.thermodynamic_integration(samples, None, keys)
    return statistics.mean_ci95(runs, keys, "dg")


def gradient_data(samples: DataFrame, timestep_ns: float, energy_freq: int, windows: DataFrame | None = None) -> DataFrame:
    """window_stats of samples, with inefficiencies computed from them; windows may give weights and relative costs."""
    g = autocorrelation.statistical_inefficiency(samples)
    weights = series.lambda_weights(samples) if windows is None else windows
    return statistics.window_stats(statistics.series_stats(samples, g), weights, timestep_ns, energy_freq)


def stage_analyse(samples: DataFrame, windows: DataFrame, failed: DataFrame, timestep_ns: float, energy_freq: int, temperature_k: float = 298.0, run_nos: list[int] | None = None, n_runs: int = 5) -> dict[str, DataFrame]:
    """Tables of a stage's analysis: runs, mean, overlap, predicted overlap, window statistics, R-hat.

    Windows without equilibration, or runs that failed, fail the queries.
    """
    ok = F.when(F.col("equilibrated") & F.col("equil_time_ns").isNotNull(), F.col("equil_time_ns")).otherwise(F.raise_error(F.lit("a window is not equilibrated")).cast("double"))
    checked = windows.withColumn("equil_time_ns", ok)
    bad = failed.where("failed").select(*SERIES, F.lit(True).alias("_failed"))
    kept = series.select_runs(series.drop_unequilibrated(samples, checked, timestep_ns, energy_freq), run_nos, n_runs)
    kept = kept.join(bad, SERIES, "left").withColumn("grad", F.when(F.col("_failed").isNull(), F.col("grad")).otherwise(F.raise_error(F.lit("a run failed")).cast("double"))).drop("_failed")
    kept = settled(kept)
    lam_state = series.lambda_weights(kept).select(*STAGE, "lam", F.col("lam_index").alias("state"))
    rows = kept.join(lam_state, [*STAGE, "lam"])
    solved = estimator.solve(rows)
    grams = settled(estimator.gram(rows, solved))
    runs = estimator.end_states(solved, grams, temperature_k)
    stats = gradient_data(kept, timestep_ns, energy_freq)
    return {
        "runs": runs,
        "mean": statistics.mean_ci95(runs, STAGE, "dg"),
        "overlap": estimator.overlap(grams, solved),
        "predicted_overlap": schedule.predicted_overlap(stats, temperature_k),
        "window_stats": stats,
        "rhat": equilibration.gelman_rubin(kept, 0.0),
    }
