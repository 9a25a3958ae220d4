"""Registered queries of the reweighting estimator, over states from the vectors.

Their SQL iterates the plain equations 60 times, which is far past convergence for these states.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import equilibration, estimator, series
from tidewater.plans import analyse
from tidewater.plans.registry import ORACLE_SQL, T975, query, shown
from tidewater.schema import K_B
from tidewater.sources.tables import STEP, TIMESTEP_NS, states_apart_from_embeddings, states_from_embeddings

K_T = f"{K_B * 298.0!r}::DOUBLE"
#: u as doubles, the sampled state s, and the place i of n of each row in its series.
STATES = "st AS (SELECT vec_id % 5 + 1 AS run, label % 4 AS s, [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE), CAST(embedding[4] AS DOUBLE)] AS u, row_number() OVER (PARTITION BY label % 4, vec_id % 5 ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label % 4, vec_id % 5) AS n FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)"


def problems(ranges: list[tuple[int, float, float]]) -> str:
    """The rows of each range (problem, start, end) of fractions; the start shares a row with the range before."""
    values = ", ".join(f"({p}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for p, a, b in ranges)
    return f"pr AS (SELECT run, problem, s, u FROM st JOIN (VALUES {values}) v(problem, a, b) ON i >= greatest(round_even(n * a, 0) - 1, 0) AND i <= round_even(n * b, 0) - 1)"


ALL_ROWS = "pr AS (SELECT run, 0 AS problem, s, u FROM st)"
_D = "ln(" + " + ".join(f"n[{k}] * exp(f[{k}] - u[{k}])" for k in range(1, 5)) + ")"
SOLVED = [
    "cnt AS (SELECT run, problem, [" + ", ".join(f"CAST(count(*) FILTER (s = {k}) AS DOUBLE)" for k in range(4)) + "] AS n FROM pr GROUP BY run, problem)",
    "it AS (SELECT run, problem, 0 AS k, [0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS f FROM cnt UNION ALL SELECT run, problem, k + 1, [0.0, ln(s1 / s2), ln(s1 / s3), ln(s1 / s4)] FROM (SELECT run, problem, k, "
    + ", ".join(f"sum(exp(-u[{k}] - d)) AS s{k}" for k in range(1, 5))
    + f" FROM (SELECT it.run, it.problem, it.k, pr.u, {_D} AS d FROM it JOIN cnt ON cnt.run = it.run AND cnt.problem = it.problem JOIN pr ON pr.run = it.run AND pr.problem = it.problem WHERE it.k < 60) GROUP BY run, problem, k))",
    "sol AS (SELECT it.run, it.problem, f, n FROM it JOIN cnt USING (run, problem) WHERE k = 60)",
]
#: Products of the samples' weights, and the Hessian of the sampled states but the first.
GRAM = [
    f"w AS (SELECT pr.run, [exp(f[1] - u[1] - d), exp(f[2] - u[2] - d), exp(f[3] - u[3] - d), exp(f[4] - u[4] - d)] AS w FROM (SELECT pr.run, u, f, {_D} AS d FROM pr JOIN sol USING (run, problem)) pr)",
    "gram AS (SELECT run, i, j, sum(w[i] * w[j]) AS g FROM w, range(1, 5) a(i), range(1, 5) b(j) GROUP BY run, i, j)",
    "hess AS (SELECT run, any_value(f) AS f, any_value(n) AS n, " + ", ".join(f"sum(CASE WHEN i = {i} AND j = {j} THEN {f'n[{i}]' if i == j else '0'} - n[{i}] * n[{j}] * g ELSE 0 END) AS h{i}{j}" for i in range(2, 5) for j in range(i, 5)) + " FROM gram JOIN sol USING (run) GROUP BY run)",
]


def solved_sql(body: str, rows: str, *more: str) -> str:
    return "WITH RECURSIVE " + ", ".join([STATES, rows, *SOLVED, *more]) + " " + body


#: The error of the last state against the first: the inverse Hessian's corner, less the sampling of the two states.
ERROR = "sqrt((h22 * h33 - h23 * h23) / (h22 * (h33 * h44 - h34 * h34) - h23 * (h23 * h44 - h34 * h24) + h24 * (h23 * h34 - h33 * h24)) - 1 / n[1] - 1 / n[4])"


@query("mbar", solved_sql(f"SELECT CAST(run AS BIGINT) AS run, round(f[4] * {K_T}, 6) + 0 AS dg, round({ERROR} * {K_T}, 6) + 0 AS err FROM hess", ALL_ROWS, *GRAM))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(estimator.mbar(states_from_embeddings(spark, d)), "run", "dg", "err")


@query("mbar_free_energies", solved_sql("SELECT CAST(run AS BIGINT) AS run, CAST(k AS BIGINT) AS i, round(f[k + 1], 6) + 0 AS f, n[k + 1] AS n FROM sol, range(0, 4) r(k)", ALL_ROWS))
def _(spark: SparkSession, d: str) -> DataFrame:
    solved = estimator.solve(states_from_embeddings(spark, d)).select("run", F.posexplode(F.arrays_zip("f", "n")).alias("i", "x"))
    return shown(solved.select("run", "i", "x.f", "x.n"))


#: Six states that overlap little: the plain equations take some thousand passes.
_APART = [
    "x AS (SELECT vec_id % 6 AS s, (vec_id % 6) * 2.5::DOUBLE + CAST(embedding[1] AS DOUBLE) * 8 AS x FROM embeddings WHERE embedding IS NOT NULL)",
    "st AS (SELECT s, [" + ", ".join(f"(x - {2.5 * j!r}) * (x - {2.5 * j!r}) / 2 + {8.0 * j!r}" for j in range(6)) + "]::DOUBLE[] AS u FROM x)",
    "cnt AS (SELECT [" + ", ".join(f"CAST(count(*) FILTER (s = {j}) AS DOUBLE)" for j in range(6)) + "] AS n FROM st)",
    "it AS (SELECT 0 AS k, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS f UNION ALL SELECT k + 1, [0.0, " + ", ".join(f"ln(s1 / s{j})" for j in range(2, 7)) + "] FROM (SELECT k, "
    + ", ".join(f"sum(exp(-u[{j}] - d)) AS s{j}" for j in range(1, 7)) + " FROM (SELECT k, u, ln(" + " + ".join(f"n[{j}] * exp(f[{j}] - u[{j}])" for j in range(1, 7)) + ") AS d FROM it, cnt, st WHERE k < 3000) GROUP BY k))",
]


@query("mbar_states_apart", "WITH RECURSIVE " + ", ".join(_APART) + " SELECT CAST(j - 1 AS BIGINT) AS i, round(f[j], 6) + 0 AS f, n[j] AS n FROM it, cnt, range(1, 7) r(j) WHERE k = 3000")
def _(spark: SparkSession, d: str) -> DataFrame:
    solved = estimator.solve(states_apart_from_embeddings(spark, d)).select(F.posexplode(F.arrays_zip("f", "n")).alias("i", "x"))
    return shown(solved.select("i", "x.f", "x.n"), "i", "f", "n")


@query("mbar_overlap", solved_sql("SELECT CAST(run AS BIGINT) AS run, i - 1 AS i, j - 1 AS j, round(g * n[j], 6) + 0 AS value FROM gram JOIN sol USING (run)", ALL_ROWS, *GRAM[:2]))
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = states_from_embeddings(spark, d)
    solved = estimator.solve(rows)
    return shown(estimator.overlap(estimator.gram(rows, solved), solved), "run", "i", "j", "value")


@query("mbar_neighbour_slopes", solved_sql(f"SELECT CAST(run AS BIGINT) AS run, round((k - 0.5) / 3.0, 6) + 0 AS lam_mid, round((f[k + 1] - f[k]) * {K_T}, 6) + 0 AS d_pmf, round((f[k + 1] - f[k]) * {K_T} * 3, 6) + 0 AS grad FROM sol, range(1, 4) r(k)", ALL_ROWS))
def _(spark: SparkSession, d: str) -> DataFrame:
    lam = F.array(*(F.lit(k / 3) for k in range(4)))
    return shown(estimator.neighbour_slopes(estimator.pmf(estimator.solve(states_from_embeddings(spark, d)), lam)), "run", "lam_mid", "d_pmf", "grad")


@query("mbar_convergence", solved_sql(f"SELECT CAST(run AS BIGINT) AS run, round(problem / 5.0, 5) + 0 AS frac, round(f[4] * {K_T}, 6) + 0 AS dg FROM sol", problems([(p, 0.0, round(p / 5, 5)) for p in range(1, 6)])))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(estimator.convergence(states_from_embeddings(spark, d), points=5), "run", "frac", "dg")


@query("mbar_convergence_blocks", solved_sql(f"SELECT CAST(run AS BIGINT) AS run, round(problem / 5.0, 5) + 0 AS frac, round(f[4] * {K_T}, 6) + 0 AS dg FROM sol", problems([(p, round((p - 1) / 5, 5), round(p / 5, 5)) for p in range(1, 6)])))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(estimator.convergence(states_from_embeddings(spark, d), False, points=5), "run", "frac", "dg")


@query("mbar_comparative_convergence", solved_sql(f"SELECT calc, CAST(run AS BIGINT) AS run, round(problem * share / 5.0, 5) + 0 AS frac, round(f[4] * {K_T}, 6) + 0 AS dg, round(round(problem * share / 5.0, 5) * total, 6) + 0 AS time_ns FROM sol JOIN spans ON runs = (run <= 3)", "pr AS (SELECT run, problem, s, u FROM st JOIN spans ON runs = (run <= 3), range(1, 6) r(problem) WHERE i <= round_even(n * round(share * problem / 5.0, 5), 0) - 1)").replace(STATES, f"{STATES}, spans AS (SELECT calc, runs, total, min(total) OVER () / total AS share FROM (SELECT CASE WHEN runs THEN 'a' ELSE 'b' END AS calc, runs, sum(last) * {TIMESTEP_NS!r}::DOUBLE AS total FROM (SELECT run <= 3 AS runs, run, s, (max(i) + 1) * {STEP} AS last FROM st GROUP BY run, s) GROUP BY runs))", 1))
def _(spark: SparkSession, d: str) -> DataFrame:
    two = states_from_embeddings(spark, d).withColumn("calc", F.when(F.col("run") <= 3, F.lit("a")).otherwise(F.lit("b")))
    return shown(estimator.comparative_convergence(two, timestep_ns=TIMESTEP_NS, points=5), "calc", "run", "frac", "dg", "time_ns")


RUN_NS = f"(SELECT sum(c) * {STEP * TIMESTEP_NS!r}::DOUBLE FROM (SELECT count(*) AS c FROM st WHERE st.run = sol.run))"


@query("block_mbar", solved_sql(f"SELECT CAST(run AS BIGINT) AS run, CAST(problem AS BIGINT) AS block, round(f[4] * {K_T}, 6) + 0 AS dg, round(({RUN_NS} - 0.002) * problem / 4.0 + 0.002, 6) + 0 AS time_ns FROM sol", problems([(b, b / 4, (b + 1) / 4) for b in range(4)])))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(estimator.block_mbar(states_from_embeddings(spark, d), 4, timestep_ns=TIMESTEP_NS, equil_ns=0.002), "run", "block", "dg", "time_ns")


#: Ten blocks after each of four start fractions.
STARTS = [float(s) for s in np.linspace(0, 0.5, 4)]
TEN = [(10 * k + b, round(s + (1 - s) * b / 10, 5), round(s + (1 - s) * b / 10 + (1 - s) / 10, 5)) for k, s in enumerate(STARTS) for b in range(10)]
PAIRED = [
    f"slices AS (SELECT problem // 10 AS k, run, avg(CASE WHEN problem % 10 < 1 THEN f[4] END) * {K_T} AS a, avg(CASE WHEN problem % 10 >= 5 THEN f[4] END) * {K_T} AS b FROM sol GROUP BY ALL)",
    f"paired AS (SELECT {STARTS!r}[k + 1] AS fraction, t, 1 - sin(atan(abs(t) / 2)) * (1 + pow(cos(atan(abs(t) / 2)), 2) / 2) AS p FROM (SELECT k, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t FROM slices GROUP BY k))",
]


@query("paired_t_tests_mbar", solved_sql(f"SELECT round(fraction, 6) + 0 AS fraction, round(t, 5) + 0 AS t, round(p, 6) + 0 AS p, round(round(fraction, 5) * (SELECT min(c) * {STEP * TIMESTEP_NS!r}::DOUBLE FROM (SELECT count(*) AS c FROM st GROUP BY run)), 6) + 0 AS time_ns FROM paired", problems(TEN), *PAIRED))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(equilibration.paired_t_tests_mbar(states_from_embeddings(spark, d), n_blocks=10, timestep_ns=TIMESTEP_NS), "fraction", "t", "p", "time_ns", t=5)


@query("equil_paired_t_mbar", solved_sql("SELECT min(fraction) FILTER (p > 0.05) IS NOT NULL AS equilibrated, round(min(fraction) FILTER (p > 0.05), 6) + 0 AS fraction FROM paired", problems(TEN), *PAIRED))
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(equilibration.equil_paired_t_mbar(states_from_embeddings(spark, d), n_blocks=10), "equilibrated", "fraction")


def analysed(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """A stage's analysis, with gradients and states of the embeddings' series."""
    s = states_from_embeddings(spark, d).drop("state").withColumn("grad", F.col("u")[3] - F.col("u")[0])
    w = series.lambda_weights(s).withColumn("equilibrated", F.lit(True)).withColumn("equil_time_ns", F.lit(0.0))
    none = s.select("calc", "leg", "stage", "lam", "run").distinct().withColumn("failed", F.lit(False))
    return analyse.stage_analyse(s, w, none, TIMESTEP_NS, STEP)


@query("stage_analyse", solved_sql(f"SELECT CAST(count(*) AS BIGINT) AS n, round(avg(f[4]) * {K_T}, 6) + 0 AS mean, round({T975}[count(*) - 1] * stddev_samp(f[4]) * {K_T} / sqrt(count(*)), 6) + 0 AS ci95 FROM sol", ALL_ROWS))
def _(spark: SparkSession, d: str) -> DataFrame:
    """The mean of a stage's analysis."""
    return shown(analysed(spark, d)["mean"], "n", "mean", "ci95")


@query("stage_analyse_runs", ORACLE_SQL["mbar"])
def _(spark: SparkSession, d: str) -> DataFrame:
    """The runs of a stage's analysis: all rows are equilibrated, so they are the estimates of whole runs."""
    return shown(analysed(spark, d)["runs"], "run", "dg", "err")


@query("stage_analyse_overlap", ORACLE_SQL["mbar_overlap"])
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(analysed(spark, d)["overlap"], "run", "i", "j", "value")


@query("stage_analyse_window_means", "WITH s AS (SELECT label % 4 / 3.0::DOUBLE AS lam, vec_id % 5 AS run, CAST(embedding[4] AS DOUBLE) - CAST(embedding[1] AS DOUBLE) AS grad FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL), m AS (SELECT lam, run, avg(grad) AS mean FROM s GROUP BY lam, run) SELECT round(lam, 6) + 0 AS lam, CAST(count(*) AS BIGINT) AS n_runs, round(avg(mean), 6) + 0 AS mean, round(stddev_pop(mean) / sqrt(count(*)), 6) + 0 AS sem_inter FROM m GROUP BY lam")
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(analysed(spark, d)["window_stats"], "lam", "n_runs", "mean", "sem_inter")
