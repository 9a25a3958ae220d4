"""Queries over the driver's tables: series, statistics, tests, hierarchies and agreement; and all that are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import agreement, autocorrelation, equilibration, estimator, geometry, rollup, schedule, series, statistics
from tidewater.plans import analyse, estimator_queries, reader_queries
from tidewater.plans.registry import BLOCK, BLOCK_NS, BLOCKS, ORACLE_SQL, QUERIES, T975, R, normal_quantile_sql, query, shown, t_tail_sql, upper_normal_sql, with_even, with_samples
from tidewater.schema import STAGE
from tidewater.sources.tables import STEP, TIMESTEP_NS, frames_from_embeddings, hierarchy_from_orders, samples_from_events, states_from_embeddings, table
from tidewater.streaming import monitor

#: All registered queries; those of the other two modules come with their import.
__all__ = ["ORACLE_SQL", "QUERIES", "estimator_queries", "reader_queries"]


@query("samples_from_events", with_samples(f"SELECT lam, run, step, {R('grad', 'grad')} FROM samples"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(samples_from_events(spark, d), "lam", "run", "step", "grad")


@query("cut_to_shortest", with_even(f"SELECT lam, run, step, {R('grad', 'grad')} FROM samples"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(even(spark, d), "lam", "run", "step", "grad")


@query("lambda_weights", with_samples(f"SELECT lam, lam_index, {R('weight', 'weight')} FROM weights"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(series.lambda_weights(samples_from_events(spark, d)), "lam", "lam_index", "weight")


MEANS = "means AS (SELECT lam, run, avg(grad) AS mean, stddev_pop(grad) AS sd FROM samples GROUP BY lam, run)"
TI_RUNS = "runs AS (SELECT run, sum(mean * weight) AS dg FROM means JOIN weights USING (lam) GROUP BY run)"
#: Fixed value: 0.975 quantile of Student's t with 4 degrees of freedom (five runs).
T4 = "2.7764451051977987"


@query("ti_free_energy", with_samples(f"SELECT CAST(count(*) AS BIGINT) AS n, {R('avg(dg)', 'mean')}, {R(f'{T4} * stddev_samp(dg) / sqrt(count(*))', 'ci95')} FROM runs", MEANS, TI_RUNS))
def ti_free_energy(spark: SparkSession, d: str) -> DataFrame:
    return shown(analyse.free_energy_ti(samples_from_events(spark, d)), "n", "mean", "ci95")


@query("ti_runs", with_samples(f"SELECT run, {R('dg', 'dg')} FROM runs", MEANS, TI_RUNS))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = samples_from_events(spark, d)
    return shown(statistics.thermodynamic_integration(s, series.lambda_weights(s)), "run", "dg")


@query("ti_profile", with_samples(f"SELECT run, lam, {R('mean', 'mean')}, {R('sd', 'sd')}, round(sum(part) OVER (PARTITION BY run ORDER BY lam), 6) + 0 AS pmf FROM (SELECT *, coalesce(0.5 * (mean + lag(mean) OVER w) * (lam - lag(lam) OVER w), 0) AS part FROM means WINDOW w AS (PARTITION BY run ORDER BY lam))", MEANS))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(statistics.ti_profile(samples_from_events(spark, d)), "run", "lam", "mean", "sd", "pmf")


@query("truncate_fraction", with_samples("SELECT lam, run, step FROM samples WHERE i >= greatest(round_even(n * 0.3, 0) - 1, 0) AND i <= round_even(n * 0.8, 0) - 1"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(series.truncate_fraction(samples_from_events(spark, d), 0.3, 0.8), "lam", "run", "step")


@query("discard_burn_in", with_samples("SELECT lam, run, step FROM samples WHERE i >= round_even(n * 0.1, 0)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(series.discard_burn_in(samples_from_events(spark, d), 0.1), "lam", "run", "step")


@query("select_runs", with_samples("SELECT lam, run, step FROM samples WHERE run IN (1, 3)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(series.select_runs(samples_from_events(spark, d), [1, 3], 5), "lam", "run", "step")


def even(spark: SparkSession, d: str) -> DataFrame:
    """Samples whose runs end with the shortest of their window, as means across runs need them."""
    return series.cut_to_shortest(samples_from_events(spark, d))


def weights(spark: SparkSession, d: str) -> DataFrame:
    """The windows' weights, which cutting their runs doesn't change: a scan without a sort."""
    return series.lambda_weights(samples_from_events(spark, d))


def _windows(s: DataFrame) -> DataFrame:
    """A windows table as a setup would have it: each window's time grows with its lam."""
    return series.lambda_weights(s).withColumn("equilibrated", F.col("lam") < 1).withColumn("equil_time_ns", 0.01 + 0.02 * F.col("lam")).withColumn("runtime_constant", F.lit(0.0005)).withColumn("relative_cost", F.lit(1.0))


@query("drop_unequilibrated", with_samples(f"SELECT lam, run, step FROM samples WHERE i >= greatest(floor((0.01 + 0.02 * lam) / ({TIMESTEP_NS!r}::DOUBLE * {STEP})) - 1, 0)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = samples_from_events(spark, d)
    return shown(series.drop_unequilibrated(s, _windows(s), TIMESTEP_NS, STEP), "lam", "run", "step")


@query("set_equilibration_time", with_samples(f"SELECT lam, lam < 1 OR lam = 0.5 AS equilibrated, round(CASE WHEN lam = 0.5 THEN 0.2 ELSE 0.01 + 0.02 * lam END, 6) + 0 AS equil_time_ns FROM weights"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(series.set_equilibration_time(_windows(samples_from_events(spark, d)), 0.2, lam=0.5), "lam", "equilibrated", "equil_time_ns")


@query("time_axis", with_samples("SELECT lam, run, step, round(0.1 + 0.9 * (i + 1) / n, 6) + 0 AS time_ns FROM samples"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(series.time_axis(samples_from_events(spark, d), F.lit(0.1), F.lit(1.0)), "lam", "run", "step", "time_ns")


ROLLING = f"rolled AS (SELECT *, CASE WHEN i >= {BLOCK} THEN avg(grad) OVER (PARTITION BY lam, run ORDER BY step ROWS BETWEEN {BLOCK} PRECEDING AND 1 PRECEDING) END AS rolling FROM samples)"


@query("rolling_mean", with_samples(f"SELECT lam, run, step, {R('rolling', 'rolling')} FROM rolled", ROLLING))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(series.rolling_mean(samples_from_events(spark, d), BLOCK), "lam", "run", "step", "rolling")


SLOPES = f"slopes AS (SELECT lam, i, avg(g) AS gradient FROM (SELECT lam, i, (rolling - lag(rolling, {BLOCK}) OVER (PARTITION BY lam, run ORDER BY i)) / {BLOCK_NS!r}::DOUBLE AS g FROM rolled) WHERE i >= {2 * BLOCK} GROUP BY lam, i)"


@query("equil_block_gradient", with_even(f"SELECT lam, first IS NOT NULL AS equilibrated, round((first + 1) * {STEP * TIMESTEP_NS!r}::DOUBLE, 6) + 0 AS equil_time_ns, round((first + 1) * {STEP * TIMESTEP_NS!r}::DOUBLE + {2 * BLOCK_NS!r}::DOUBLE, 6) + 0 AS time_shifted_ns FROM (SELECT lam, min(CASE WHEN turn THEN i END) - {2 * BLOCK} AS first FROM (SELECT lam, i, sign(gradient) <> sign(lag(gradient) OVER (PARTITION BY lam ORDER BY i)) AS turn FROM slopes) GROUP BY lam)", ROLLING, SLOPES))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(equilibration.equil_block_gradient(even(spark, d), F.col("step") * TIMESTEP_NS, BLOCK, BLOCK_NS), "lam", "equilibrated", "equil_time_ns", "time_shifted_ns")


def blocks_sql(name: str, start: str = "0.0") -> str:
    """A CTE of block averages of the rows from a fraction on."""
    return f"""{name}_rows AS (SELECT lam, run, i - a AS k, n - a AS m, step, grad FROM (SELECT *, round_even(n * {start}, 0) AS a FROM samples) WHERE i >= a),
{name}_cut AS (SELECT *, least(CASE WHEN round_even(g * m / {BLOCKS}.0, 0) > k THEN g - 1 WHEN round_even((g + 1) * m / {BLOCKS}.0, 0) <= k THEN g + 1 ELSE g END, {BLOCKS - 1}) AS block FROM (SELECT *, floor(k * {BLOCKS} / m) AS g FROM {name}_rows)),
{name} AS (SELECT run, block, sum(mean * weight) AS dg, sum(t0 + (t1 - t0) * block / {BLOCKS - 1}.0) AS time_ns
  FROM (SELECT lam, run, block, avg(grad) AS mean FROM {name}_cut GROUP BY lam, run, block)
  JOIN (SELECT lam, run, CAST(min(step) AS DOUBLE) AS t0, CAST(max(step) AS DOUBLE) AS t1 FROM {name}_rows GROUP BY lam, run) USING (lam, run) JOIN weights USING (lam) GROUP BY run, block)"""


@query("smooth3", with_samples("SELECT lam, run, round(avg(mean) OVER (PARTITION BY run ORDER BY lam ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) + 0 AS smooth FROM means", MEANS))
def _(spark: SparkSession, d: str) -> DataFrame:
    means = samples_from_events(spark, d).groupBy("lam", "run").agg(F.avg("grad").alias("mean"))
    return shown(series.smooth3(means, ["run"], "lam", "mean", "smooth"), "lam", "run", "smooth")


@query("gradient_timeseries", with_samples("SELECT lam, run, step // 200 - 1 AS i, round((i + 1) * 1.0 / n, 6) + 0 AS time_ns, round(grad, 6) + 0 AS grad, round(avg(grad) OVER (PARTITION BY lam), 6) + 0 AS window_mean, round(stddev_pop(grad) OVER (PARTITION BY lam), 6) + 0 AS window_sd FROM samples"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(series.gradient_timeseries(samples_from_events(spark, d), F.lit(1.0)), "lam", "run", "i", "time_ns", "grad", "window_mean", "window_sd")


#: Statistical inefficiency by self-joins on the lag; a lag that no series reaches would show as a missing stop.
INEFFICIENCY = f"""dev AS (SELECT lam, run, i, n, grad - avg(grad) OVER (PARTITION BY lam, run) AS dx FROM samples),
s2 AS (SELECT lam, run, n, avg(dx * dx) AS s2 FROM dev GROUP BY lam, run, n),
corr AS (SELECT a.lam, a.run, t.t, sum(2 * a.dx * b.dx) AS p FROM range(1, 64) t(t) JOIN dev a ON true JOIN dev b ON a.lam = b.lam AND a.run = b.run AND b.i = a.i + t.t GROUP BY a.lam, a.run, t.t),
c AS (SELECT lam, run, t, n, p / (2 * (n - t) * s2) AS c FROM corr JOIN s2 USING (lam, run)),
stop AS (SELECT lam, run, coalesce(min(CASE WHEN c <= 0 AND t > 3 OR t >= n - 1 THEN t END), 64) AS stop FROM c GROUP BY lam, run),
g AS (SELECT lam, run, n, greatest(1 + coalesce(sum(CASE WHEN t < stop THEN 2 * c * (1 - t / CAST(n AS DOUBLE)) END), 0), 1) AS g FROM c JOIN stop USING (lam, run) GROUP BY lam, run, n)"""
STATS = """thin AS (SELECT lam, run, var_pop(grad) AS var, var_pop(grad) / count(*) AS s2, any_value(g) AS g FROM samples JOIN g USING (lam, run) WHERE samples.i % CAST(floor(g) AS BIGINT) = 0 GROUP BY lam, run),
stats AS (SELECT lam, run, mean, var, s2, g FROM thin JOIN means USING (lam, run)),
wstats AS (SELECT lam, count(*) AS n_runs, avg(var) AS var_intra, avg(mean) AS mean, avg(g) AS g, sqrt(avg(s2) / count(*)) AS sem_intra, sqrt(var_pop(mean) / count(*)) AS sem_inter, sqrt(avg(s2) / count(*) + var_pop(mean) / count(*)) AS sem_tot, any_value(weight) AS weight FROM stats JOIN weights USING (lam) GROUP BY lam),
total AS (SELECT lam, max(step) * 0.000004::DOUBLE AS total_ns FROM samples GROUP BY lam)"""


@query("statistical_inefficiency", with_samples(f"SELECT lam, run, CAST(n AS BIGINT) AS n, {R('g', 'g')} FROM g", INEFFICIENCY))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(autocorrelation.statistical_inefficiency(samples_from_events(spark, d)), "lam", "run", "n", "g")


@query("series_stats", with_samples(f"SELECT lam, run, {R('mean', 'mean')}, {R('var', 'var')}, {R('s2', 'squared_sem')}, {R('g', 'g')} FROM stats", MEANS, INEFFICIENCY, STATS))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = samples_from_events(spark, d)
    return shown(statistics.series_stats(s, autocorrelation.statistical_inefficiency(s)), "lam", "run", "mean", "var", "squared_sem", "g")


def _stats_and_times(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = samples_from_events(spark, d)
    return s, analyse.gradient_data(s, TIMESTEP_NS, STEP), s.groupBy(*STAGE, "lam").agg((F.max("step") * TIMESTEP_NS).alias("total_ns"))


SEMS = "sems AS (SELECT lam, n_runs, avg(er) OVER (ORDER BY lam ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS sem, avg(erg) OVER (ORDER BY lam ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS sem_dg, total_ns FROM (SELECT lam, n_runs, total_ns, sem_inter * sqrt(total_ns * n_runs) AS er, sem_inter * weight * sqrt(total_ns * n_runs) AS erg FROM wstats JOIN total USING (lam)))"
ERRORS = "errors AS (SELECT lam, sem AS er, sum(part) OVER (ORDER BY lam) AS integrated FROM (SELECT lam, sem, coalesce(0.5 * (sem + lag(sem) OVER (ORDER BY lam)) * (lam - lag(lam) OVER (ORDER BY lam)), 0) AS part FROM sems))"


@query("time_normalised_sems", with_samples(f"SELECT lam, {R('sem', 'sem')} FROM sems", MEANS, INEFFICIENCY, STATS, SEMS))
def _(spark: SparkSession, d: str) -> DataFrame:
    _, stats, times = _stats_and_times(spark, d)
    return shown(statistics.time_normalised_sems(stats, times), "lam", "sem")


@query("integrated_error", with_samples(f"SELECT lam, {R('er', 'er')}, {R('integrated', 'integrated')} FROM errors", MEANS, INEFFICIENCY, STATS, SEMS, ERRORS))
def _(spark: SparkSession, d: str) -> DataFrame:
    _, stats, times = _stats_and_times(spark, d)
    return shown(schedule.integrated_error(stats, times), "lam", "er", "integrated")


@query("optimal_lambdas", with_samples("SELECT CAST(k AS BIGINT) AS k, round_even(x0 + (x1 - x0) * (target - e0) / (e1 - e0), 3) + 0 AS lam FROM (SELECT k, (SELECT max(integrated) FROM errors) * k / 7.0 AS target FROM range(0, 8) t(k)) JOIN (SELECT lam AS x0, lead(lam) OVER (ORDER BY lam) AS x1, integrated AS e0, lead(integrated) OVER (ORDER BY lam) AS e1, row_number() OVER (ORDER BY lam) AS s, count(*) OVER () AS c FROM errors) ON x1 IS NOT NULL AND (s = 1 OR target >= e0) AND (s = c - 1 OR target < e1)", MEANS, INEFFICIENCY, STATS, SEMS, ERRORS))
def _(spark: SparkSession, d: str) -> DataFrame:
    _, stats, times = _stats_and_times(spark, d)
    return shown(schedule.optimal_lambdas(schedule.integrated_error(stats, times), n_lam=8), "k", "lam")


@query("predicted_overlap", with_samples("""SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(value, 6) + 0 AS value FROM (
  SELECT i, i + 1 AS j, up AS value FROM ov WHERE up IS NOT NULL UNION ALL SELECT i + 1, i, up FROM ov WHERE up IS NOT NULL
  UNION ALL SELECT i, i, 1 - coalesce(up, 0) - coalesce(lag(up) OVER (ORDER BY i), 0) FROM ov)""", MEANS, INEFFICIENCY, STATS, "ov AS (SELECT row_number() OVER (ORDER BY lam) - 1 AS i, 1 / (2 + 0.5 * pow(4184.0 / (8.314462618 * 298.0), 2) * pow(lead(lam) OVER (ORDER BY lam) - lam, 2) * (lead(var_intra) OVER (ORDER BY lam) + var_intra) / 2) AS up FROM wstats)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(schedule.predicted_overlap(analyse.gradient_data(samples_from_events(spark, d), TIMESTEP_NS, STEP)), "i", "j", "value")


@query("improvement_factor", with_samples("""SELECT round(sqrt(pow(max(t), 2) / count(*) / sum(pow(hi - lo, 2))), 6) + 0 AS factor FROM (
  SELECT max(integrated) OVER () AS t, coalesce((integrated + lag(integrated) OVER w) / 2, integrated) AS lo, coalesce((integrated + lead(integrated) OVER w) / 2, integrated) AS hi
  FROM errors WINDOW w AS (ORDER BY lam))""", MEANS, INEFFICIENCY, STATS, SEMS, ERRORS))
def _(spark: SparkSession, d: str) -> DataFrame:
    _, stats, times = _stats_and_times(spark, d)
    return shown(schedule.improvement_factor(schedule.integrated_error(stats, times)), "factor")


@query("optimal_runtime", with_samples("SELECT lam, round(p, 6) + 0 AS predicted_ns, round(a, 6) + 0 AS actual_ns, round(CASE WHEN a < p THEN ceil(least((p - a) / n_runs, a / n_runs) * 10) / 10 ELSE 0 END, 6) + 0 AS extra_ns FROM (SELECT lam, n_runs, total_ns * n_runs AS a, least(sem_dg / sqrt(0.0005), 30.0 * n_runs) AS p FROM sems)", MEANS, INEFFICIENCY, STATS, SEMS))
def _(spark: SparkSession, d: str) -> DataFrame:
    s, stats, times = _stats_and_times(spark, d)
    return shown(schedule.optimal_runtime(stats, times, _windows(s)), "lam", "predicted_ns", "actual_ns", "extra_ns")


@query("relax_constant", with_samples("SELECT lam, round(CASE WHEN lam < 1 THEN 0.0005 ELSE 0.000125 END, 9) + 0 AS runtime_constant FROM weights"))
def _(spark: SparkSession, d: str) -> DataFrame:
    w = _windows(samples_from_events(spark, d))
    return schedule.relax_constant(w, w.select(*STAGE, "lam", "equilibrated"), [*STAGE, "lam"]).select("lam", (F.round("runtime_constant", 9) + 0.0).alias("runtime_constant"))


@query("histogram", with_samples("SELECT e.lam, e.run, CAST(b AS BIGINT) AS bin, round(lo + b * (hi - lo) / 50, 6) + 0 AS \"left\", round(coalesce(c, 0) / (n * (hi - lo) / 50), 6) + 0 AS density FROM (SELECT * FROM ends, range(0, 50) t(b)) e LEFT JOIN (SELECT samples.lam, samples.run, least(floor((grad - lo) / ((hi - lo) / 50)), 49) AS k, count(*) AS c FROM samples JOIN ends ON samples.lam = ends.lam AND samples.run = ends.run GROUP BY ALL) h ON e.lam = h.lam AND e.run = h.run AND e.b = h.k", "ends AS (SELECT lam, run, min(grad) AS lo, max(grad) AS hi, count(*) AS n FROM samples GROUP BY lam, run)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(statistics.histogram(samples_from_events(spark, d)), "lam", "run", "bin", "left", "density")


@query("window_moments", with_samples(f"SELECT lam, {R('avg(grad)', 'mean')}, {R('stddev_pop(grad)', 'sd')} FROM samples GROUP BY lam"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(statistics.window_moments(samples_from_events(spark, d)), "lam", "mean", "sd")


@query("kruskal_wallis", with_samples("SELECT lam, round(h, 5) + 0 AS h, CAST(df AS BIGINT) AS df, round(exp(-h / 2) * (1 + h / 2), 6) + 0 AS p FROM (SELECT lam, (12.0 / (n * (n + 1)) * parts - 3 * (n + 1)) / (1 - ties / (pow(n, 3) - n)) AS h, df FROM (SELECT lam, sum(sr * sr / c) AS parts, count(*) - 1 AS df, sum(c) AS n FROM (SELECT lam, run, sum(r) AS sr, count(*) AS c FROM ranked GROUP BY lam, run) GROUP BY lam) JOIN (SELECT lam, sum(pow(t, 3) - t) AS ties FROM (SELECT lam, grad, count(*) AS t FROM samples GROUP BY lam, grad) GROUP BY lam) USING (lam))", "ranked AS (SELECT lam, run, rank() OVER (PARTITION BY lam ORDER BY grad) + (count(*) OVER (PARTITION BY lam, grad) - 1) / 2.0 AS r FROM samples)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(statistics.kruskal_wallis(samples_from_events(spark, d)).withColumn("h", F.round("h", 5)), "lam", "h", "df", "p")


@query("gaussian_kde", with_samples("SELECT e.lam, e.run, round(lo + (hi - lo) / 99 * k, 6) + 0 AS x, round(sum(exp(-0.5 * pow((lo + (hi - lo) / 99 * k - grad) / h, 2))) / (e.n * h * sqrt(2 * pi())), 6) + 0 AS density FROM (SELECT lam, run, min(grad) AS lo, max(grad) AS hi, count(*) AS n, stddev_samp(grad) * pow(count(*), -0.2) AS h FROM samples GROUP BY lam, run) e, range(0, 100) t(k), samples s WHERE s.lam = e.lam AND s.run = e.run GROUP BY e.lam, e.run, k, lo, hi, e.n, h"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(statistics.gaussian_kde(samples_from_events(spark, d), ["lam", "run"], "grad"), "lam", "run", "x", "density")


@query("half_difference_tests", with_even(f"SELECT fraction, round(avg(s) * 1e6, 4) + 0 AS gradient, round({T4} * stddev_samp(s) / sqrt(count(*)) * 1e6, 4) + 0 AS ci95 FROM (SELECT fraction, run, (avg(CASE WHEN block >= mid THEN dg END) - avg(CASE WHEN block < mid THEN dg END)) / any_value(gap) AS s FROM (SELECT b.run, b.block, b.dg, f / 100.0 AS fraction, f + round_even((100 - f) / 2.0, 0) AS mid, (SELECT max(time_ns) FROM blocks g WHERE g.run = 1 AND g.block = f + round_even((100 - f) / 2.0, 0)) - (SELECT max(time_ns) FROM blocks g WHERE g.run = 1 AND g.block = f) AS gap FROM blocks b, (VALUES (0), (10), (30), (60)) c(f) WHERE b.block >= f) GROUP BY fraction, run) GROUP BY fraction", blocks_sql("blocks")))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = even(spark, d)
    t = equilibration.half_difference_tests(series.block_average(s, weights(spark, d), BLOCKS), BLOCKS)
    return t.select("fraction", (F.round(F.col("gradient") * 1e6, 4) + 0.0).alias("gradient"), (F.round(F.col("ci95") * 1e6, 4) + 0.0).alias("ci95"))


STARTS = {"q0": "0.0", "q1": repr(0.5 / 3), "q2": repr(1.0 / 3), "q3": "0.5"}
SLICES = ", ".join(blocks_sql(n, v) for n, v in STARTS.items()) + ", slices AS (" + " UNION ALL ".join(f"SELECT {v}::DOUBLE AS fraction, run, avg(CASE WHEN block < 10 THEN dg END) AS a, avg(CASE WHEN block >= 50 THEN dg END) AS b FROM {n} GROUP BY run" for n, v in STARTS.items()) + ")"


@query("paired_t_tests", with_even("SELECT round(fraction, 6) + 0 AS fraction, round(t, 6) + 0 AS t, round(1 - sin(atan(abs(t) / 2)) * (1 + pow(cos(atan(abs(t) / 2)), 2) / 2), 6) + 0 AS p FROM (SELECT fraction, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t FROM slices GROUP BY fraction)", SLICES))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = even(spark, d)
    return shown(equilibration.paired_t_tests(s, weights(spark, d), n_blocks=BLOCKS), "fraction", "t", "p")


@query("total_simtime", with_samples("SELECT CASE WHEN grouping(lam) = 1 THEN 'all' WHEN grouping(run) = 1 THEN 'lam' ELSE 'run' END AS level, coalesce(lam, -1) AS lam, coalesce(run, 0) AS run, round(sum(last) * 0.000004, 6) + 0 AS simtime_ns FROM (SELECT lam, run, max(step) AS last FROM samples GROUP BY lam, run) GROUP BY ROLLUP (lam, run)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    t = rollup.total_simtime(samples_from_events(spark, d), TIMESTEP_NS, ["lam", "run"])
    return shown(t.select("level", F.coalesce("lam", F.lit(-1.0)).alias("lam"), F.coalesce("run", F.lit(0)).alias("run"), "simtime_ns"))


@query("progress", with_samples("SELECT lam, run, round(max(step) * 0.000004, 6) + 0 AS simtime_ns, CAST(count(*) AS BIGINT) AS rows, round(avg(grad), 6) + 0 AS mean, round(var_pop(grad), 6) + 0 AS variance FROM samples GROUP BY lam, run"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(monitor.progress(samples_from_events(spark, d), TIMESTEP_NS, keys=["lam", "run"]), "lam", "run", "simtime_ns", "rows", "mean", "variance")


HIERARCHY = "h AS (SELECT r_name AS calc, n_name AS leg, c_mktsegment AS stage, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS run, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
LEG_RUNS = "lr AS (SELECT calc, leg, run, avg(value) / 1e5 AS dg, stddev_samp(value) / 1e5 AS er FROM h GROUP BY calc, leg, run)"


def _leg_runs(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy_from_orders(spark, d).groupBy("calc", "leg", "run").agg((F.avg("value") / 1e5).alias("dg"), (F.stddev_samp("value") / 1e5).alias("er"))


@query("combine_legs", f"WITH {HIERARCHY}, {LEG_RUNS} SELECT calc, run, round(sum(CASE WHEN leg = 'NATION_0' THEN -dg ELSE dg END), 6) + 0 AS dg, round(sqrt(sum(er * er)), 6) + 0 AS er FROM lr GROUP BY calc, run")
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(rollup.combine_legs(_leg_runs(spark, d), ["calc"], ("NATION_0",)), "calc", "run", "dg", "er")


@query("restraint_correction", f"WITH {HIERARCHY}, {LEG_RUNS} SELECT calc, leg, run, round(dg + CASE WHEN leg = 'NATION_0' THEN run * 0.5 ELSE 0 END, 6) + 0 AS dg FROM lr")
def _(spark: SparkSession, d: str) -> DataFrame:
    runs = _leg_runs(spark, d)
    extra = runs.select("calc", "run").distinct().withColumn("dg", F.col("run") * 0.5)
    return shown(rollup.apply_restraint_correction(runs, extra, "NATION_0"), "calc", "leg", "run", "dg")


@query("mean_ci95", f"WITH {HIERARCHY}, {LEG_RUNS} SELECT calc, leg, CAST(count(*) AS BIGINT) AS n, round(avg(dg), 6) + 0 AS mean, round({T975}[count(*) - 1] * stddev_samp(dg) / sqrt(count(*)), 6) + 0 AS ci95 FROM lr GROUP BY calc, leg")
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(statistics.mean_ci95(_leg_runs(spark, d), ["calc", "leg"], "dg"), "calc", "leg", "n", "mean", "ci95")


@query("relative_cost", f"WITH {HIERARCHY} SELECT calc, round(sum(value) / count(*) / 0.21, 4) + 0 AS relative_cost FROM h GROUP BY calc")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = hierarchy_from_orders(spark, d).groupBy("calc").agg(F.count("*").cast("double").alias("simtime_ns"), F.sum("value").alias("gpu_hours"))
    return rollup.relative_cost(t, t, ["calc"]).select("calc", (F.round("relative_cost", 4) + 0.0).alias("relative_cost"))


PAIRS = "p AS (SELECT p_brand AS brand, p_partkey AS k, p_retailprice AS x, CAST(p_size AS DOUBLE) AS y FROM part)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))


@query("pair_statistics", f"WITH {PAIRS} SELECT brand, round(corr(x, y), 6) + 0 AS r, round(regr_r2(y, x), 6) + 0 AS r2, round(avg(abs(x - y)), 6) + 0 AS mue, round(sqrt(avg((x - y) * (x - y))), 6) + 0 AS rmse FROM p GROUP BY brand")
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(agreement.pair_statistics(_pairs(spark, d), ["brand"], "x", "y"))


@query("spearman", f"WITH {PAIRS}, r AS (SELECT brand, rank() OVER (PARTITION BY brand ORDER BY x) + (count(*) OVER (PARTITION BY brand, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY brand ORDER BY y) + (count(*) OVER (PARTITION BY brand, y) - 1) / 2.0 AS ry FROM p) SELECT brand, round(corr(rx, ry), 6) + 0 AS rho FROM r GROUP BY brand")
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(agreement.spearman(_pairs(spark, d), ["brand"], "x", "y"))


@query("kendall_tau", f"WITH {PAIRS} SELECT a.brand, round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(CAST(sum(CASE WHEN a.x <> b.x THEN 1 ELSE 0 END) AS DOUBLE) * sum(CASE WHEN a.y <> b.y THEN 1 ELSE 0 END)), 6) + 0 AS tau FROM p a JOIN p b ON a.brand = b.brand AND a.k < b.k GROUP BY a.brand")
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(agreement.kendall_tau(_pairs(spark, d), ["brand"], "x", "y"))


@query("to_analyse", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return agreement.to_analyse(table(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("average_waters", "WITH fr AS (SELECT vec_id, vec_id % 5 + 1 AS run, embedding AS e, row_number() OVER (PARTITION BY vec_id % 5 ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY vec_id % 5) AS n FROM embeddings WHERE embedding IS NOT NULL), w AS (SELECT vec_id, run, i, n, (SELECT count(*) FROM range(3, 21) t(a) WHERE pow(CAST(e[CAST(a AS INTEGER) * 3 + 1] AS DOUBLE) - CAST(e[1] AS DOUBLE), 2) + pow(CAST(e[CAST(a AS INTEGER) * 3 + 2] AS DOUBLE) - CAST(e[2] AS DOUBLE), 2) + pow(CAST(e[CAST(a AS INTEGER) * 3 + 3] AS DOUBLE) - CAST(e[3] AS DOUBLE), 2) <= 0.09) / 3.0 AS w FROM fr) SELECT CAST(run AS BIGINT) AS run, round(avg(w), 6) + 0 AS waters FROM w WHERE i >= round_even(n - 0.5 * n, 0) GROUP BY run")
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(statistics.average_waters(frames_from_embeddings(spark, d), 0, 0.3, 50.0), "run", "waters")


_AT = [(i, j) for i in range(4) for j in range(i, 4)]
_M = {ij: f"m{i}{j}" for i, j in _AT for ij in ((i, j), (j, i))}
_TRACE = "(m00 + m11 + m22 + m33)"
#: Superposition of atoms 0 to 9 on the first frame's: the key matrix, raised and squared 42 times, leaves the quaternion of the best turn.
SUPERPOSED = [
    "xyz AS (SELECT vec_id, vec_id % 5 AS r, a, CAST(embedding[3 * a + 1] AS DOUBLE) AS x, CAST(embedding[3 * a + 2] AS DOUBLE) AS y, CAST(embedding[3 * a + 3] AS DOUBLE) AS z FROM embeddings, range(0, 10) t(a) WHERE embedding IS NOT NULL)",
    "ref AS (SELECT a, x AS rx, y AS ry, z AS rz FROM xyz WHERE vec_id = (SELECT vec_id FROM xyz ORDER BY r, vec_id LIMIT 1))",
    "fitted AS (SELECT vec_id, r, a, " + ", ".join(f"{c}, avg({c}) OVER w AS c{c}, r{c}, avg(r{c}) OVER w AS d{c}" for c in "xyz") + " FROM xyz JOIN ref USING (a) WINDOW w AS (PARTITION BY vec_id))",
    "h AS (SELECT vec_id, " + ", ".join(f"sum(({a} - c{a}) * (r{b} - d{b})) AS s{a}{b}" for a in "xyz" for b in "xyz") + ", (" + " + ".join(f"sum(({c} - c{c}) ** 2) + sum((r{c} - d{c}) ** 2)" for c in "xyz") + ") / 2 AS bound FROM fitted GROUP BY vec_id)",
    "sq AS (SELECT vec_id, 0 AS k, sxx + syy + szz + bound AS m00, syz - szy AS m01, szx - sxz AS m02, sxy - syx AS m03, sxx - syy - szz + bound AS m11, sxy + syx AS m12, szx + sxz AS m13, syy - sxx - szz + bound AS m22, syz + szy AS m23, szz - sxx - syy + bound AS m33 FROM h UNION ALL SELECT vec_id, k + 1, "
    + ", ".join("(" + " + ".join(f"{_M[i, k]} * {_M[k, j]}" for k in range(4)) + f") / {_TRACE} / {_TRACE}" for i, j in _AT) + " FROM sq WHERE k < 42)",
    "quat AS (SELECT vec_id, q[1] AS qw, q[2] AS qx, q[3] AS qy, q[4] AS qz, list_dot_product(q, q) AS n FROM (SELECT vec_id, CASE greatest(m00, m11, m22, m33) WHEN m00 THEN [m00, m01, m02, m03] WHEN m11 THEN [m01, m11, m12, m13] WHEN m22 THEN [m02, m12, m22, m23] ELSE [m03, m13, m23, m33] END AS q FROM sq WHERE k = 42))",
    "off AS (SELECT vec_id, r, a, x - cx AS x, y - cy AS y, z - cz AS z, rx - dx AS rx, ry - dy AS ry, rz - dz AS rz, qw, qx, qy, qz, n FROM fitted JOIN quat USING (vec_id) WHERE a < 3)",
]
_TURNED = ["((qw * qw + qx * qx - qy * qy - qz * qz) * x + 2 * (qx * qy - qw * qz) * y + 2 * (qx * qz + qw * qy) * z) / n", "(2 * (qx * qy + qw * qz) * x + (qw * qw - qx * qx + qy * qy - qz * qz) * y + 2 * (qy * qz - qw * qx) * z) / n", "(2 * (qx * qz - qw * qy) * x + 2 * (qy * qz + qw * qx) * y + (qw * qw - qx * qx - qy * qy + qz * qz) * z) / n"]


@query("rmsd", "WITH RECURSIVE " + ", ".join(SUPERPOSED) + " SELECT CAST(r + 1 AS BIGINT) AS run, vec_id AS frame, round(sqrt(avg(" + " + ".join(f"({t} - r{c}) ** 2" for t, c in zip(_TURNED, "xyz", strict=True)) + ")), 6) + 0 AS rmsd FROM off GROUP BY r, vec_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(geometry.rmsd(frames_from_embeddings(spark, d), F.col("atom") < 10, F.col("resname") == "LIG"), "run", "frame", "rmsd")


@query("subsample", with_samples("SELECT lam, run, step FROM samples JOIN g USING (lam, run) WHERE samples.i % CAST(floor(g) AS BIGINT) = 0", INEFFICIENCY))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(autocorrelation.decorrelated(samples_from_events(spark, d)), "lam", "run", "step")


@query("equil_time", with_samples("SELECT round(sum(0.01 + 0.02 * lam), 6) + 0 AS equil_time_ns FROM weights"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(rollup.equil_time(_windows(samples_from_events(spark, d))), "equil_time_ns")


@query("all_equilibrated", with_samples("SELECT bool_and(lam < 1) AS equilibrated FROM weights"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rollup.all_equilibrated(_windows(samples_from_events(spark, d))).select("equilibrated")


@query("read_equil_flags", with_samples("SELECT lam, lam < 1 AS equilibrated, round(0.01 + 0.02 * lam, 6) + 0 AS equil_time_ns FROM weights"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(equilibration.read_equil_flags(_windows(samples_from_events(spark, d))), "lam", "equilibrated", "equil_time_ns")


@query("equil_vs_total", with_samples("SELECT lam, round(max(step) * 0.000004, 6) + 0 AS total_ns, round(0.01 + 0.02 * lam, 6) + 0 AS equil_time_ns FROM samples WHERE run = 1 GROUP BY lam"))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = samples_from_events(spark, d)
    simtime = s.groupBy(*STAGE, "lam", "run").agg((F.max("step") * TIMESTEP_NS).alias("simtime_ns"))
    return shown(statistics.equil_vs_total(_windows(s), simtime), "lam", "total_ns", "equil_time_ns")


@query("gradient_convergence", with_samples("SELECT lam, run, round(frac, 6) + 0 AS frac, round(grad - last(grad) OVER (PARTITION BY lam, run ORDER BY frac ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) + 0 AS grad_shift FROM (SELECT lam, run, f / 4.0 AS frac, avg(grad) AS grad FROM samples, range(1, 5) t(f) WHERE i < n * f / 4.0 GROUP BY lam, run, f)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = series.indexed(samples_from_events(spark, d)).withColumn("f", F.explode(F.array(*map(F.lit, (1, 2, 3, 4))))).where(F.col("i") < F.col("n") * F.col("f") / 4.0)
    curves = rows.groupBy(*STAGE, "lam", "run", (F.col("f") / 4.0).alias("frac")).agg(F.avg("grad").alias("grad"))
    return shown(series.gradient_convergence(curves), "lam", "run", "frac", "grad_shift")


@query("block_gradient", with_even("SELECT lam, CAST(i AS BIGINT) AS i, round(gradient, 6) + 0 AS gradient FROM slopes", ROLLING, SLOPES))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(series.block_gradient(even(spark, d), BLOCK, BLOCK_NS), "lam", "i", "gradient")


@query("block_average", with_even("SELECT run, CAST(block AS BIGINT) AS block, round(dg, 9) + 0 AS dg, round(time_ns, 2) + 0 AS time_ns FROM blocks", blocks_sql("blocks")))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = even(spark, d)
    return shown(series.same_times(series.block_average(s, weights(spark, d), BLOCKS)), "run", "block", "dg", "time_ns", dg=9, time_ns=2)


@query("window_stats", with_samples(f"SELECT lam, CAST(n_runs AS BIGINT) AS n_runs, {', '.join(R(c, c) for c in ('var_intra', 'mean', 'g', 'sem_intra', 'sem_inter', 'sem_tot'))}, {R('sem_inter * weight', 'sem_inter_dg')}, round(g * {TIMESTEP_NS!r}::DOUBLE, 12) + 0 AS g_ns, round(g * {STEP * TIMESTEP_NS!r}::DOUBLE, 9) + 0 AS g_sample_ns, 1.0::DOUBLE AS relative_cost FROM wstats", MEANS, INEFFICIENCY, STATS))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = samples_from_events(spark, d)
    return shown(analyse.gradient_data(s, TIMESTEP_NS, STEP, _windows(s)), "lam", "n_runs", "var_intra", "mean", "g", "sem_intra", "sem_inter", "sem_tot", "sem_inter_dg", "g_ns", "g_sample_ns", "relative_cost", g_ns=12, g_sample_ns=9)


Q = lambda p: f"({normal_quantile_sql(p)})"


@query("probability_plot", with_samples(f"SELECT lam, run, CAST(k AS BIGINT) AS k, round({Q('p')}, 6) + 0 AS theoretical, round(grad, 6) + 0 AS ordered FROM (SELECT *, CASE WHEN k = n THEN pow(0.5, 1.0 / n) WHEN k = 1 THEN 1 - pow(0.5, 1.0 / n) ELSE (k - 0.3175) / (n + 0.365) END AS p FROM (SELECT lam, run, grad, n, row_number() OVER (PARTITION BY lam, run ORDER BY grad) AS k FROM samples))"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(statistics.probability_plot(samples_from_events(spark, d), ["lam", "run"], "grad"))


#: Royston's weights, written out; every series here has more than 11 values.
SHAPIRO = [
    f"ordered AS (SELECT lam, run, n, grad, row_number() OVER (PARTITION BY lam, run ORDER BY grad) AS k FROM samples), m AS (SELECT *, {Q('(k - 0.375) / (n + 0.25)')} AS m FROM ordered)",
    "ends AS (SELECT lam, run, n, sum(m * m) AS mm, max(m) AS m1, max(CASE WHEN k = n - 1 THEN m END) AS m2, 1 / sqrt(n) AS u FROM m GROUP BY lam, run, n)",
    "a AS (SELECT *, -2.706056 * pow(u, 5) + 4.434685 * pow(u, 4) - 2.07119 * pow(u, 3) - 0.147981 * pow(u, 2) + 0.221157 * u + m1 / sqrt(mm) AS a1, -3.582633 * pow(u, 5) + 5.682633 * pow(u, 4) - 1.752461 * pow(u, 3) - 0.293762 * pow(u, 2) + 0.042981 * u + m2 / sqrt(mm) AS a2 FROM ends)",
    "w AS (SELECT lam, run, m.n, pow(sum(grad * CASE WHEN k = 1 THEN -a1 WHEN k = m.n THEN a1 WHEN k = 2 THEN -a2 WHEN k = m.n - 1 THEN a2 ELSE m / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) END), 2) / (var_pop(grad) * count(*)) AS w FROM m JOIN a USING (lam, run) GROUP BY lam, run, m.n)",
    "z AS (SELECT *, (ln(1 - w) - (-1.5861 - 0.31082 * ln(n) - 0.083751 * pow(ln(n), 2) + 0.0038915 * pow(ln(n), 3))) / exp(-0.4803 - 0.082676 * ln(n) + 0.0030302 * pow(ln(n), 2)) AS z FROM w)",
]


@query("shapiro_wilk", with_samples(f"SELECT lam, run, CAST(n AS BIGINT) AS n, round(w, 6) + 0 AS w, round({upper_normal_sql('z')}, 6) + 0 AS p FROM z", *SHAPIRO))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(statistics.shapiro_wilk(samples_from_events(spark, d), ["lam", "run"], "grad"))


HALVES = "SELECT fraction, avg(s) AS gradient, 2.7764451051977987 * stddev_samp(s) / sqrt(count(*)) AS ci95 FROM (SELECT fraction, run, (avg(CASE WHEN block >= mid THEN dg END) - avg(CASE WHEN block < mid THEN dg END)) / any_value(gap) AS s FROM (SELECT b.run, b.block, b.dg, f / 100.0 AS fraction, f + round_even((100 - f) / 2.0, 0) AS mid, (SELECT max(time_ns) FROM blocks g WHERE g.run = 1 AND g.block = f + round_even((100 - f) / 2.0, 0)) - (SELECT max(time_ns) FROM blocks g WHERE g.run = 1 AND g.block = f) AS gap FROM blocks b, (VALUES (0), (10), (30), (60)) c(f) WHERE b.block >= f) GROUP BY fraction, run) GROUP BY fraction"


@query("equil_multiwindow", with_even(f"SELECT min(fraction) FILTER (abs(gradient) < ci95) IS NOT NULL AS equilibrated, round(min(fraction) FILTER (abs(gradient) < ci95), 6) + 0 AS fraction FROM ({HALVES})", blocks_sql("blocks")))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = even(spark, d)
    return shown(equilibration.equil_multiwindow(series.block_average(s, weights(spark, d), BLOCKS), BLOCKS), "equilibrated", "fraction")


@query("write_back_equilibration", with_even(f"SELECT lam, lam < 1 OR f IS NOT NULL AS equilibrated, round(coalesce(f * {TIMESTEP_NS!r}::DOUBLE * last, 0.01 + 0.02 * lam), 6) + 0 AS equil_time_ns FROM (SELECT lam, max(step) AS last FROM samples WHERE run = 1 GROUP BY lam), (SELECT min(fraction) FILTER (abs(gradient) < ci95) AS f FROM ({HALVES}))", blocks_sql("blocks")))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = even(spark, d)
    found = equilibration.equil_multiwindow(series.block_average(s, weights(spark, d), BLOCKS), BLOCKS)
    times = s.where("run = 1").groupBy(*STAGE, "lam").agg((F.max("step") * TIMESTEP_NS).alias("total_ns"))
    return shown(equilibration.write_back_equilibration(_windows(s), found, times), "lam", "equilibrated", "equil_time_ns")


#: The level test on the mean series of blocks, with its automatic number of lags.
KPSS = [
    "mean AS (SELECT block, avg(dg) AS x FROM blocks GROUP BY block), dev AS (SELECT f / 100.0 AS fraction, block - f AS i, 100 - f AS n, x - avg(x) OVER (PARTITION BY f) AS e FROM mean, (VALUES (0), (10), (30), (50)) c(f) WHERE block >= f)",
    "auto AS (SELECT a.fraction, a.n, k, sum(a.e * b.e) AS v FROM range(0, 60) r(k) JOIN dev a ON true JOIN dev b ON b.fraction = a.fraction AND b.i = a.i + k GROUP BY ALL)",
    "lags AS (SELECT fraction, n, least(trunc(1.1447 * pow(pow(s1 / s0, 2), 1 / 3.0) * pow(n, 1 / 3.0)), n - 1) AS l FROM (SELECT fraction, n, sum(CASE WHEN k = 0 THEN v / n ELSE v / (n / 2.0) END) AS s0, sum(k * v / (n / 2.0)) AS s1 FROM auto WHERE k <= trunc(pow(n, 2 / 9.0)) GROUP BY fraction, n))",
    "s2 AS (SELECT fraction, n, sum(CASE WHEN k = 0 THEN v ELSE 2 * v * (1 - k / (l + 1)) END) / n AS s2 FROM auto JOIN lags USING (fraction, n) WHERE k <= l GROUP BY fraction, n)",
    "eta AS (SELECT fraction, sum(c * c) / any_value(n * n * s2) AS eta FROM (SELECT fraction, sum(e) OVER (PARTITION BY fraction ORDER BY i) AS c FROM dev) JOIN s2 USING (fraction) GROUP BY fraction)",
    "kpss AS (SELECT fraction, eta AS statistic, CASE WHEN eta <= 0.347 THEN 0.1 WHEN eta <= 0.463 THEN 0.1 - 0.05 * (eta - 0.347) / 0.116 WHEN eta <= 0.574 THEN 0.05 - 0.025 * (eta - 0.463) / 0.111 WHEN eta <= 0.739 THEN 0.025 - 0.015 * (eta - 0.574) / 0.165 ELSE 0.01 END AS p FROM eta)",
]


@query("kpss_tests", with_even(f"SELECT {R('fraction', 'fraction')}, {R('statistic', 'statistic')}, {R('p', 'p')} FROM kpss", blocks_sql("blocks"), *KPSS))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = even(spark, d)
    return shown(equilibration.kpss_tests(series.block_average(s, weights(spark, d), BLOCKS), BLOCKS), "fraction", "statistic", "p")


@query("equil_kpss", with_even("SELECT min(fraction) FILTER (p > 0.05) IS NOT NULL AS equilibrated, round(min(fraction) FILTER (p > 0.05), 6) + 0 AS fraction FROM kpss", blocks_sql("blocks"), *KPSS))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = even(spark, d)
    return shown(equilibration.equil_kpss(series.block_average(s, weights(spark, d), BLOCKS), BLOCKS), "equilibrated", "fraction")


GEWEKE = "geweke AS (SELECT fraction, avg(a - b) / sqrt(var_samp(a) / count(*) + var_samp(b) / count(*)) AS t, pow(var_samp(a) + var_samp(b), 2) * (count(*) - 1) / (pow(var_samp(a), 2) + pow(var_samp(b), 2)) AS df FROM slices GROUP BY fraction)"
PAIRED = "paired AS (SELECT fraction, t, 1 - sin(atan(abs(t) / 2)) * (1 + pow(cos(atan(abs(t) / 2)), 2) / 2) AS p FROM (SELECT fraction, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t FROM slices GROUP BY fraction))"


@query("geweke_statistics", with_even(f"SELECT {R('fraction', 'fraction')}, {R('t', 't')}, {R('df', 'df')}, round({t_tail_sql('t', 'df')}, 6) + 0 AS p FROM geweke", SLICES, GEWEKE))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = even(spark, d)
    return shown(equilibration.geweke_tests(s, weights(spark, d), n_blocks=BLOCKS), "fraction", "t", "df", "p")


@query("equil_geweke", with_even(f"SELECT min(fraction) FILTER (p > 0.2) IS NOT NULL AS equilibrated, round(min(fraction) FILTER (p > 0.2), 6) + 0 AS fraction FROM (SELECT fraction, {t_tail_sql('t', 'df')} AS p FROM geweke)", SLICES, GEWEKE))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = even(spark, d)
    return shown(equilibration.equil_geweke(s, weights(spark, d)), "equilibrated", "fraction")


@query("equil_paired_t", with_even("SELECT min(fraction) FILTER (p > 0.05) IS NOT NULL AS equilibrated, round(min(fraction) FILTER (p > 0.05), 6) + 0 AS fraction FROM paired", SLICES, PAIRED))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = even(spark, d)
    return shown(equilibration.equil_paired_t(s, weights(spark, d), n_blocks=BLOCKS), "equilibrated", "fraction")


def rhat_sql(kept: str) -> list[str]:
    """Rank-normalised split R-hat of the rows (lam, run, i, grad) that `kept` selects."""
    scores = lambda v: Q(f"(rank() OVER (PARTITION BY lam ORDER BY {v}) + (count(*) OVER (PARTITION BY lam, {v}) - 1) / 2.0 - 0.375) / (count(*) OVER (PARTITION BY lam) + 0.25)")
    return [
        f"kept AS (SELECT lam, run, grad AS v, row_number() OVER (PARTITION BY lam, run ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY lam, run) AS m FROM ({kept}))",
        "halves AS (SELECT lam, run, i >= m - m // 2 AS late, v, abs(v - median(v) OVER (PARTITION BY lam)) AS f FROM kept WHERE i < m // 2 OR i >= m - m // 2)",
        f"scored AS (SELECT lam, run, late, p.z, p.fz FROM (SELECT lam, run, late, {scores('v')} AS z, {scores('f')} AS fz FROM halves) p)",
        "chains AS (SELECT lam, run, late, avg(z) AS m, var_samp(z) AS v, avg(fz) AS fm, var_samp(fz) AS fv, count(*) AS c FROM scored GROUP BY lam, run, late)",
        "rhat AS (SELECT lam, greatest(sqrt((max(c) * var_samp(m) / avg(v) + max(c) - 1) / max(c)), sqrt((max(c) * var_samp(fm) / avg(fv) + max(c) - 1) / max(c))) AS rhat FROM chains GROUP BY lam)",
    ]


@query("gelman_rubin", with_even(f"SELECT lam, {R('rhat', 'rhat')}, rhat <= 1.1 AS converged FROM rhat", *rhat_sql("SELECT * FROM samples WHERE i >= round_even(n * 0.1, 0)")))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(equilibration.gelman_rubin(even(spark, d)), "lam", "rhat", "converged")


@query("gelman_rubin_equilibrated", with_even(f"SELECT lam, {R('rhat', 'rhat')}, rhat <= 1.1 AS converged FROM rhat", *rhat_sql("SELECT * FROM samples WHERE i >= round_even(n * (0.01 + 0.02 * lam), 0)")))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = even(spark, d)
    return shown(equilibration.gelman_rubin_equilibrated(s, _windows(s), F.lit(1.0)), "lam", "rhat", "converged")


#: Every start, by sums from the end of a window's mean series; the lags grow by one more each time.
CHODERA = [
    "mean AS (SELECT lam, i, n - i AS m, avg(grad) - (SELECT avg(grad) FROM samples s WHERE s.lam = samples.lam) AS x FROM samples GROUP BY lam, i, n)",
    "start AS (SELECT lam, i, m, avg(x) OVER w AS mu, var_pop(x) OVER w AS s2 FROM mean WINDOW w AS (PARTITION BY lam ORDER BY i DESC))",
    "prod AS (SELECT a.lam, a.i, j, 1 + j * (j + 1) // 2 AS t, j + 1 AS inc, sum(a.x * b.x) OVER w AS p, sum(a.x + b.x) OVER w AS q FROM range(0, 120) r(j) JOIN mean a ON true JOIN mean b ON b.lam = a.lam AND b.i = a.i + 1 + j * (j + 1) // 2 WINDOW w AS (PARTITION BY a.lam, j ORDER BY a.i DESC))",
    "c AS (SELECT lam, i, m, j, t, inc, (p - mu * q + (m - t) * mu * mu) / ((m - t) * s2) AS c FROM prod JOIN start USING (lam, i) WHERE m >= 2 AND s2 > 0)",
    "stop AS (SELECT lam, i, min(CASE WHEN t >= m - 1 OR c <= 0 AND t > 3 THEN j END) AS stop FROM c GROUP BY lam, i)",
    "g AS (SELECT lam, i, any_value(m) AS m, greatest(1 + coalesce(sum(CASE WHEN stop IS NULL OR j < stop THEN 2 * c * (1 - t / CAST(m AS DOUBLE)) * inc END), 0), 1) AS g FROM c JOIN stop USING (lam, i) GROUP BY lam, i)",
]


@query("chodera", with_even("SELECT lam, CAST(i AS BIGINT) AS t0, round(g, 6) + 0 AS g, round((m + 1) / g, 6) + 0 AS n_eff, (m + 1) / g >= 50 AS equilibrated FROM (SELECT *, row_number() OVER (PARTITION BY lam ORDER BY (m + 1) / g DESC, i) AS r FROM g) WHERE r = 1", *CHODERA))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(autocorrelation.chodera_windows(even(spark, d), ["lam"]), "lam", "t0", "g", "n_eff", "equilibrated")


@query("brown_forsythe", with_samples(f"SELECT round(f, 6) + 0 AS f, df1, df2, round({t_tail_sql('sqrt(f)', 'df2')}, 6) + 0 AS p FROM (SELECT ((s2 - s1 * s1 / n) / (k - 1)) / (w / (n - k)) AS f, CAST(k - 1 AS DOUBLE) AS df1, CAST(n - k AS DOUBLE) AS df2 FROM (SELECT sum(c * m * m) AS s2, sum(c * m) AS s1, sum(c) AS n, sum(w) AS w, count(*) AS k FROM (SELECT lam, avg(d) AS m, count(*) AS c, var_pop(d) * count(*) AS w FROM (SELECT lam, abs(grad - median(grad) OVER (PARTITION BY lam)) AS d FROM samples WHERE lam IN (0.0, 0.25)) GROUP BY lam)))"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(equilibration.brown_forsythe(samples_from_events(spark, d).where("lam in (0.0, 0.25)"), "lam", "grad"), "f", "df1", "df2", "p")


def curves_sql(cumulative: bool = True, fraction: str = "1.0") -> list[str]:
    """Integration at 20 fractions of the rows, which `fraction` bounds."""
    so_far = "sum(s) OVER w AS s, sum(c) OVER w AS c" if cumulative else "s, c"
    return [
        f"part AS (SELECT lam, run, p, sum(grad) AS s, count(*) AS c FROM (SELECT *, (SELECT min(p) FROM range(1, 21) t(p) WHERE i < round_even(n * round({fraction} * p / 20.0, 5), 0)) AS p FROM samples) WHERE p IS NOT NULL GROUP BY lam, run, p)",
        f"curves AS (SELECT run, p, round(p * {fraction} / 20.0, 5) AS frac, sum(s / c * weight) AS dg FROM (SELECT lam, run, p, {so_far} FROM part WINDOW w AS (PARTITION BY lam, run ORDER BY p)) JOIN weights USING (lam) GROUP BY run, p)",
    ]


@query("ti_convergence", with_even("SELECT run, round(frac, 5) + 0 AS frac, round(dg, 6) + 0 AS dg FROM curves", *curves_sql()))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = even(spark, d)
    return shown(estimator.ti_convergence(s, weights(spark, d)), "run", "frac", "dg")


@query("ti_convergence_blocks", with_even("SELECT run, round(frac, 5) + 0 AS frac, round(dg, 6) + 0 AS dg FROM curves", *curves_sql(False)))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = even(spark, d)
    return shown(estimator.ti_convergence(s, weights(spark, d), False), "run", "frac", "dg")


@query("squared_sem_convergence", with_even("SELECT round(frac, 5) + 0 AS frac, round(var_pop(dg) / count(*), 6) + 0 AS squared_sem, round(sqrt(var_pop(dg) / count(*)), 6) + 0 AS sem FROM curves GROUP BY frac", *curves_sql()))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = even(spark, d)
    return shown(series.squared_sem_convergence(estimator.ti_convergence(s, weights(spark, d))), "frac", "squared_sem", "sem")


@query("convergence_axis", with_even("SELECT run, round(frac, 5) + 0 AS frac, round(dg, 6) + 0 AS dg, round(frac * 3.5 + 0.5, 6) + 0 AS time_ns FROM curves UNION ALL SELECT DISTINCT run, 0.0, NULL, 0.0 FROM samples", *curves_sql()))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = even(spark, d)
    times = s.select(*STAGE).distinct().select(*STAGE, F.lit(4.0).alias("total_ns"), F.lit(0.1).alias("equil_ns"), F.lit(5).alias("n_runs"))
    return shown(series.convergence_axis(estimator.ti_convergence(s, weights(spark, d)), times), "run", "frac", "dg", "time_ns")


def two_calculations(s: DataFrame) -> DataFrame:
    """Runs 1 to 3 as one calculation, the others as another, which is shorter in all."""
    return s.withColumn("calc", F.when(F.col("run") <= 3, F.lit("a")).otherwise(F.lit("b")))


TOTALS = f"totals AS (SELECT calc, total, min(total) OVER () AS least FROM (SELECT CASE WHEN run <= 3 THEN 'a' ELSE 'b' END AS calc, sum(last) * {TIMESTEP_NS!r}::DOUBLE AS total FROM (SELECT lam, run, max(step) AS last FROM samples GROUP BY lam, run) GROUP BY 1))"
SHARE = "(SELECT least / total FROM totals WHERE calc = CASE WHEN run <= 3 THEN 'a' ELSE 'b' END)"


@query("comparative_convergence", with_even("SELECT calc, run, round(frac, 5) + 0 AS frac, round(dg, 6) + 0 AS dg, round(frac * total, 6) + 0 AS time_ns FROM curves JOIN totals ON calc = CASE WHEN run <= 3 THEN 'a' ELSE 'b' END", TOTALS, *curves_sql(fraction=SHARE)))
def _(spark: SparkSession, d: str) -> DataFrame:
    two = two_calculations(even(spark, d))
    return shown(estimator.comparative_convergence(two, series.lambda_weights(two), timestep_ns=TIMESTEP_NS), "calc", "run", "frac", "dg", "time_ns")


@query("comparative_convergence_blocks", with_even("SELECT calc, run, round(frac, 5) + 0 AS frac, round(dg, 6) + 0 AS dg, round(frac * total, 6) + 0 AS time_ns FROM curves JOIN totals ON calc = CASE WHEN run <= 3 THEN 'a' ELSE 'b' END", TOTALS, *curves_sql(False, SHARE)))
def _(spark: SparkSession, d: str) -> DataFrame:
    two = two_calculations(even(spark, d))
    return shown(estimator.comparative_convergence(two, series.lambda_weights(two), timestep_ns=TIMESTEP_NS, cumulative=False), "calc", "run", "frac", "dg", "time_ns")


#: Equilibrated rows of each window, and the times before them, 0.01 + 0.02 lam a run.
BURNT = [
    "every AS (SELECT * FROM samples), burnt AS (SELECT sum(0.01 + 0.02 * lam) AS one FROM weights)",
    f"spans AS (SELECT calc, total, one * runs AS b, (min(total) OVER () - one * runs) / (total - one * runs) AS f FROM (SELECT CASE WHEN run <= 3 THEN 'a' ELSE 'b' END AS calc, count(DISTINCT run) AS runs, sum(last) * {TIMESTEP_NS!r}::DOUBLE AS total FROM (SELECT lam, run, max(step) AS last FROM every GROUP BY lam, run) GROUP BY 1), burnt)",
    f"left_over AS (SELECT lam, run, grad, row_number() OVER (PARTITION BY lam, run ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY lam, run) AS n FROM every WHERE i >= greatest(floor((0.01 + 0.02 * lam) / ({TIMESTEP_NS!r}::DOUBLE * {STEP})) - 1, 0))",
]


@query("comparative_convergence_equilibrated", with_even("SELECT calc, run, round(frac, 5) + 0 AS frac, round(dg, 6) + 0 AS dg, round(b + frac * (total - b), 6) + 0 AS time_ns FROM curves JOIN spans ON calc = CASE WHEN run <= 3 THEN 'a' ELSE 'b' END", *BURNT, *(c.replace("FROM samples)", "FROM left_over)") for c in curves_sql(fraction="(SELECT f FROM spans WHERE calc = CASE WHEN run <= 3 THEN 'a' ELSE 'b' END)"))))
def _(spark: SparkSession, d: str) -> DataFrame:
    two = two_calculations(even(spark, d))
    return shown(estimator.comparative_convergence(two, series.lambda_weights(two), _windows(two), TIMESTEP_NS, STEP), "calc", "run", "frac", "dg", "time_ns")


@query("roll_up_convergence", f"WITH {HIERARCHY}, {LEG_RUNS} SELECT calc, run, f AS frac, round(sum((dg * f + run) * (CASE WHEN leg = 'NATION_0' THEN -1 ELSE 1 END)), 6) + 0 AS dg FROM lr, (VALUES (0.5::DOUBLE), (1.0::DOUBLE)) v(f) GROUP BY calc, run, f")
def _(spark: SparkSession, d: str) -> DataFrame:
    curves = _leg_runs(spark, d).withColumn("frac", F.explode(F.array(F.lit(0.5), F.lit(1.0)))).select("calc", "leg", "run", "frac", (F.col("dg") * F.col("frac")).alias("dg"))
    sign = curves.select("leg").distinct().withColumn("multiplier", F.when(F.col("leg") == "NATION_0", -1.0).otherwise(1.0))
    extra = curves.select("leg", "run").distinct().withColumn("dg", F.col("run").cast("double"))
    return shown(estimator.roll_up_convergence(curves, sign, "leg", ["calc"], extra), "calc", "run", "frac", "dg")


@query("total_gpu_time", f"WITH {HIERARCHY} SELECT CASE WHEN grouping(calc) = 1 THEN 'all' WHEN grouping(leg) = 1 THEN 'calc' ELSE 'leg' END AS level, coalesce(calc, '') AS calc, coalesce(leg, '') AS leg, round(sum(value) / 1e6, 4) + 0 AS gpu_hours FROM h GROUP BY ROLLUP (calc, leg)")
def _(spark: SparkSession, d: str) -> DataFrame:
    gpu = hierarchy_from_orders(spark, d).groupBy("calc", "leg").agg((F.sum("value") / 1e6).alias("gpu_hours"))
    t = rollup.total_gpu_time(gpu, ["calc", "leg"])
    return shown(t.select("level", F.coalesce("calc", F.lit("")).alias("calc"), F.coalesce("leg", F.lit("")).alias("leg"), "gpu_hours"), gpu_hours=4)


NODES = "nodes AS (SELECT calc, leg, run, dg FROM lr UNION ALL SELECT calc, NULL, run, sum(CASE WHEN leg = 'NATION_0' THEN -dg ELSE dg END) FROM lr GROUP BY calc, run), spent AS (SELECT calc, leg, sum(value) / 1e6 AS t FROM h GROUP BY ROLLUP (calc, leg))"


@query("results_table", f"""WITH {HIERARCHY}, {LEG_RUNS}, {NODES}
SELECT concat_ws('/', n.calc, n.leg) AS node, CASE WHEN n.leg IS NULL THEN 'calc' ELSE 'leg' END AS level, round_even(avg(dg), 2) + 0 AS dg, round_even({T975}[count(*) - 1] * stddev_samp(dg) / sqrt(count(*)), 2) + 0 AS dg_ci, round_even(any_value(t), 0) + 0 AS simtime_ns, round_even(any_value(t) * 0.21, 0) + 0 AS gpu_hours, round_even(any_value(t) * 0.21 / (SELECT t * 0.21 FROM spent WHERE calc IS NULL), 3) + 0 AS gpu_share
FROM nodes n JOIN spent s ON s.calc = n.calc AND s.leg IS NOT DISTINCT FROM n.leg GROUP BY n.calc, n.leg
UNION ALL SELECT calc || '/bound/restraint_corr', 'restraint_corr', round_even(avg(run * 0.5), 2) + 0, 0.0, 0.0, 0.0, 0.0 FROM (SELECT DISTINCT calc, run FROM lr) GROUP BY calc""")
def _(spark: SparkSession, d: str) -> DataFrame:
    h, keys, legs = hierarchy_from_orders(spark, d), ["calc", "leg"], _leg_runs(spark, d)
    runs = legs.select("calc", "leg", "run", "dg").unionByName(rollup.combine_legs(legs, ["calc"], ("NATION_0",)).select("calc", F.lit(None).cast("string").alias("leg"), "run", "dg"))
    times = h.groupBy(*keys).agg((F.sum("value") / 1e6).alias("t"))
    sim = rollup.levels(times, keys, "t", "simtime_ns")
    gpu = rollup.levels(times.withColumn("t", F.col("t") * 0.21), keys, "t", "gpu_hours")
    extra = legs.select("calc", "run").distinct().withColumn("dg", F.col("run") * 0.5)
    return shown(rollup.results_table(runs, sim, gpu, keys, extra), "node", "level", "dg", "dg_ci", "simtime_ns", "gpu_hours", "gpu_share")


@query("runtime_to_cycles", with_samples("SELECT lam, round(CASE WHEN a < p THEN ceil(least((p - a) / n_runs, a / n_runs) * 10) / 10 ELSE 0 END, 6) + 0 AS extra_ns, CAST(round_even(CASE WHEN a < p THEN ceil(least((p - a) / n_runs, a / n_runs) * 10) / 10 ELSE 0 END / 0.1, 0) AS BIGINT) AS cycles FROM (SELECT lam, n_runs, total_ns * n_runs AS a, least(sem_dg / sqrt(0.0005), 30.0 * n_runs) AS p FROM sems)", MEANS, INEFFICIENCY, STATS, SEMS))
def _(spark: SparkSession, d: str) -> DataFrame:
    s, stats, times = _stats_and_times(spark, d)
    return shown(schedule.runtime_to_cycles(schedule.optimal_runtime(stats, times, _windows(s)), 0.1), "lam", "extra_ns", "cycles")


BOOTSTRAP = [
    "means AS (SELECT row_number() OVER (ORDER BY brand) AS pos, avg(x) AS x, avg(y) AS y, stddev_samp(x) AS xe, stddev_samp(y) AS ye, count(*) OVER () AS n FROM p GROUP BY brand)",
    "slots AS (SELECT rep, pos, " + ", ".join(f"(CAST('0x' || substr(md5('42:' || rep || ':' || pos || ':{u}'), 1, 13) AS BIGINT) + 0.5) / pow(16, 13) AS u{u}" for u in "iabcd") + ", n FROM means, range(0, 1000) r(rep))",
    "picked AS (SELECT rep, s.pos AS k, m.x + sqrt(-2 * ln(ua)) * cos(2 * pi() * ub) * xe / 1.96 AS x, m.y + sqrt(-2 * ln(uc)) * cos(2 * pi() * ud) * ye / 1.96 AS y FROM slots s JOIN means m ON m.pos = floor(ui * s.n) + 1)",
    "both_sets AS (SELECT rep, k, x, y FROM picked UNION ALL SELECT -1, pos, x, y FROM means)",
    "ranked AS (SELECT rep, rank() OVER (PARTITION BY rep ORDER BY x) + (count(*) OVER (PARTITION BY rep, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY rep ORDER BY y) + (count(*) OVER (PARTITION BY rep, y) - 1) / 2.0 AS ry FROM both_sets)",
    "taus AS (SELECT a.rep, sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(CAST(sum(CASE WHEN a.x <> b.x THEN 1 ELSE 0 END) AS DOUBLE) * sum(CASE WHEN a.y <> b.y THEN 1 ELSE 0 END)) AS tau FROM both_sets a JOIN both_sets b ON a.rep = b.rep AND a.k < b.k GROUP BY a.rep)",
    "every AS (SELECT rep, r, r2, mue, rmse, rho, tau FROM (SELECT rep, corr(x, y) AS r, regr_r2(y, x) AS r2, avg(abs(x - y)) AS mue, sqrt(avg((x - y) * (x - y))) AS rmse FROM both_sets GROUP BY rep) JOIN (SELECT rep, corr(rx, ry) AS rho FROM ranked GROUP BY rep) USING (rep) JOIN taus USING (rep))",
    "long AS (" + " UNION ALL ".join(f"SELECT rep, '{c}' AS stat, {c} AS v FROM every" for c in agreement.STATISTICS) + ")",
]


@query("bootstrap_statistics", f"WITH {PAIRS}, {', '.join(BOOTSTRAP)} SELECT stat, round(max(v) FILTER (rep = -1), 6) + 0 AS value, round(quantile_cont(v, 0.05) FILTER (rep >= 0), 6) + 0 AS p05, round(quantile_cont(v, 0.95) FILTER (rep >= 0), 6) + 0 AS p95 FROM long GROUP BY stat")
def _(spark: SparkSession, d: str) -> DataFrame:
    means = _pairs(spark, d).groupBy("brand").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.stddev_samp("x").alias("xe"), F.stddev_samp("y").alias("ye"))
    return shown(agreement.stats_with_ci(means, "x", "y", "xe", "ye", "brand"))


SUPPLIERS = f"c AS (SELECT s_nationkey AS nk, avg(s_acctbal) AS m, CASE WHEN count(*) > 1 THEN {T975}[count(*) - 1] * stddev_samp(s_acctbal) / sqrt(count(*)) END AS er FROM supplier GROUP BY s_nationkey)"


def _measured(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    runs = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("calc_base_dir"), F.col("s_acctbal").alias("dg"))
    return runs, table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("calc_base_dir"), F.col("n_name").alias("name"), (F.col("n_nationkey") * 1.5).alias("exp_dg"), F.lit(0.1).alias("exp_er"), F.col("n_regionkey").cast("double").alias("calc_cor"))


@query("set_results", f"WITH {SUPPLIERS} SELECT n_name AS name, round(m + n_regionkey, 6) + 0 AS calc_dg, round(er, 6) + 0 AS calc_er FROM c JOIN nation ON n_nationkey = nk WHERE er IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(agreement.set_results(*_measured(spark, d)), "name", "calc_dg", "calc_er")


@query("set_results_offset", f"WITH {SUPPLIERS}, s AS (SELECT n_name AS name, m + n_regionkey AS dg, er, n_nationkey * 1.5 AS exp_dg FROM nation LEFT JOIN c ON n_nationkey = nk) SELECT name, round(dg + (SELECT avg(exp_dg) - avg(dg) FROM s), 6) + 0 AS calc_dg, round(er, 6) + 0 AS calc_er FROM s WHERE er IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(agreement.set_results(*_measured(spark, d), offset=True), "name", "calc_dg", "calc_er")


@query("rmsd_time_axis", "SELECT CAST(vec_id % 5 + 1 AS BIGINT) AS run, vec_id AS frame, round(2.0 * (row_number() OVER w - 1) / (count(*) OVER (PARTITION BY vec_id % 5) - 1), 6) + 0 AS time_ns FROM embeddings WHERE embedding IS NOT NULL WINDOW w AS (PARTITION BY vec_id % 5 ORDER BY vec_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    frames = frames_from_embeddings(spark, d).select(*STAGE, "lam", "run", "frame").distinct()
    return shown(geometry.rmsd_time_axis(frames, F.lit(2.0)), "run", "frame", "time_ns")
