"""Registered queries of the readers and writers: lines made of the given tables, parsed by the readers' own expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import agreement, series, statistics
from tidewater.plans.registry import T975, query, shown, with_samples
from tidewater.schema import K_B
from tidewater.sources import files, sinks
from tidewater.sources.scratch import shared_folder
from tidewater.sources.tables import STEP, TIMESTEP_NS, samples_from_events, table
from tidewater.streaming import monitor


def _lines(rows: DataFrame, file: Column, lines: list[Column], lam: Column | None = None, run: Column | None = None) -> DataFrame:
    """(keys, file, pos, value) as the readers have it, the lines of each row in order."""
    keys = [F.lit("calc").alias("calc"), F.lit("free").alias("leg"), F.lit("all").alias("stage"), (F.lit(0.0) if lam is None else lam).alias("lam"), (F.lit(1) if run is None else run).cast("int").alias("run")]
    return rows.select(*keys, file.alias("file"), F.posexplode(F.array(*lines)).alias("pos", "value"))


def _sample_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each event as a line of a sample file, with a header line now and then."""
    rows = table(spark, d, "events").where("event_id is not null and value is not null")
    text = lambda c: F.col(c).cast("string")
    words = [F.lit(""), text("event_id"), (F.col("value") * 2).cast("string"), text("value"), F.lit("1.0"), F.lit("2.5e+00"), (F.col("value") - 1).cast("string"), F.lit("-3.0e+02"), (F.col("value") + 1).cast("string")]
    head = F.when(F.col("event_id") % 7 == 0, F.lit("#   [step]  [potential kcal/mol]")).otherwise(F.lit("  "))
    return _lines(rows, F.col("event_type"), [head, F.concat_ws("   ", *words)])


@query("read_samples", "SELECT event_id AS step, round(value * 2, 6) + 0 AS potential, round(value, 6) + 0 AS grad, 1.0::DOUBLE AS fwd, 2.5::DOUBLE AS bwd, round(value - 1, 6) + 0 AS first, -300.0::DOUBLE AS second, round(value + 1, 6) + 0 AS last FROM events WHERE event_id IS NOT NULL AND value IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = files.parse_samples(_sample_lines(spark, d))
    return shown(s.select("step", "potential", "grad", "fwd", "bwd", F.col("u")[0].alias("first"), F.col("u")[1].alias("second"), F.element_at("u", -1).alias("last")))


@query("endstate_gradient", "SELECT event_id AS step, round(value + 1 - (value - 1), 6) + 0 AS grad FROM events WHERE event_id IS NOT NULL AND value IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(files.parse_samples(_sample_lines(spark, d), endstate=True), "step", "grad")


def _headers(spark: SparkSession, d: str) -> DataFrame:
    """One header for each supplier: degrees glued to the unit, or Kelvin as a word of its own."""
    rows = table(spark, d, "supplier")
    glued = F.concat(F.lit("#Generating temperature is \t"), F.pmod("s_suppkey", F.lit(50)).cast("string"), F.lit("°C"))
    apart = F.concat(F.lit("#Generating temperature is "), (F.pmod("s_suppkey", F.lit(50)) + 280).cast("string"), F.lit(" K"))
    line = F.when(F.col("s_suppkey") % 2 == 0, glued).otherwise(apart)
    return _lines(rows, F.lit("f"), [F.lit("#This file was generated"), line], F.col("s_suppkey").cast("double"), F.col("s_nationkey") + 1)


TEMPERATURE = "CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 50 + 273.15 ELSE s_suppkey % 50 + 280 END"


@query("read_header", f"SELECT CAST(s_suppkey AS DOUBLE) AS lam, CAST(s_nationkey + 1 AS BIGINT) AS run, round({TEMPERATURE}, 6) + 0 AS temperature_k FROM supplier")
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(files.parse_header(_headers(spark, d)), "lam", "run", "temperature_k")


@query("scale_to_energy", f"SELECT CAST(s_suppkey AS DOUBLE) AS lam, CAST(s_nationkey + 1 AS BIGINT) AS run, round(s_acctbal * ({TEMPERATURE}) * {K_B!r}::DOUBLE, 6) + 0 AS grad FROM supplier")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier")
    line = F.concat_ws(" ", F.lit("100"), F.lit("0.0"), F.col("s_acctbal").cast("string"), F.lit("0"), F.lit("0"), F.lit("1.0"))
    s = files.parse_samples(_lines(rows, F.lit("f"), [line], F.col("s_suppkey").cast("double"), F.col("s_nationkey") + 1))
    return shown(files.scale_to_energy(s, files.parse_header(_headers(spark, d))), "lam", "run", "grad")


#: Parts of which a task makes configuration files.
PARTS = 1 << 16


def _config(spark: SparkSession, d: str) -> DataFrame:
    """A configuration file for each part: a later line of an option, and what follows a second =, count for nothing."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    lines = [F.lit("### settings"), F.concat(F.lit("nmoves = "), size, F.lit("00")), F.lit("timestep = 4 * femtosecond"), F.lit("nmoves = 1"), F.concat(F.lit(" energy frequency=  "), size), F.lit("lambda array = 0.0, 0.5, 1.0"), F.concat(F.lit("name = "), key, F.lit(" = again")), F.lit("no option")]
    # a few bytes of a part become eight lines that are sorted where they are made, so the number of tasks goes by parts
    parts = table(spark, d, "part").select("p_partkey", "p_size")
    return _lines(parts.repartition(parts.count() // PARTS + 1, "p_partkey"), key, lines)


@query("read_config", "SELECT CAST(p_partkey AS VARCHAR) AS file, unnest(['nmoves', 'timestep', 'energy frequency', 'lambda array', 'name']) AS option, unnest([p_size || '00', '4 * femtosecond', CAST(p_size AS VARCHAR), '0.0, 0.5, 1.0', CAST(p_partkey AS VARCHAR)]) AS value FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return files.parse_config(_config(spark, d)).select("file", "option", "value")


@query("config_option", "SELECT CAST(p_partkey AS VARCHAR) AS file, p_size || '00' AS value FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return files.config_option(files.parse_config(_config(spark, d)), "nmoves")


@query("sim_meta", "SELECT CAST(p_partkey AS VARCHAR) AS file, 0.000004::DOUBLE AS timestep_ns, p_size * 100::BIGINT AS nmoves, CAST(p_size AS BIGINT) AS energy_freq, round(p_size * 100 * 4 / 1e6, 6) + 0 AS time_per_cycle_ns, 3::BIGINT AS n_lam, 0.5::DOUBLE AS middle FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = files.sim_meta(files.parse_config(_config(spark, d)))
    return shown(m.select("file", "timestep_ns", "nmoves", "energy_freq", "time_per_cycle_ns", F.size("lambda_array").alias("n_lam"), F.col("lambda_array")[1].alias("middle")), timestep_ns=9)


def _result_lines(spark: SparkSession, d: str) -> DataFrame:
    """An estimator's output for each customer, the first title glued to a line."""
    a, k = F.col("c_acctbal"), F.col("c_nationkey")
    text = lambda x: x.cast("string")
    lines = [
        F.lit("lead in" + files.OVERLAP_TITLE),
        F.concat_ws(" ", text(a), F.lit("0.25")),
        F.concat_ws("  ", F.lit("0.5"), text(k)),
        F.lit(files.SLOPES_TITLE + " in kcal/mol"),
        F.concat_ws(" ", F.lit("0.0"), F.lit("0.25"), text(a), F.lit("0.5")),
        F.concat_ws(" ", F.lit("0.25"), F.lit("1.0"), text(k), F.lit("0.75")),
        F.lit(files.PMF_TITLE),
        F.lit("0.0 0.0 0.0"),
        F.concat_ws(" ", F.lit("1.0"), text(a), text(k)),
        F.lit(""),
        F.lit("#TI average gradients"),
        F.lit("0.0 1.0 2.0"),
        F.lit(files.RESULT_TITLE + " in kcal/mol:"),
        F.concat(text(a), F.lit(", "), text(k), F.lit("  #WARNING no subsampling")),
        F.lit("#TI free energy difference:"),
        F.lit("9.0"),
    ]
    return _lines(table(spark, d, "customer").where("c_acctbal is not null and c_nationkey is not null"), F.col("c_custkey").cast("string"), lines)


CUSTOMERS = "(SELECT CAST(c_custkey AS VARCHAR) AS file, c_acctbal AS a, CAST(c_nationkey AS DOUBLE) AS k FROM customer WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL)"


@query("read_mbar_result", f"SELECT file, round(a, 6) + 0 AS dg, round(k, 6) + 0 AS err FROM {CUSTOMERS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(files.parse_mbar_result(_result_lines(spark, d)), "file", "dg", "err")


@query("read_overlap", f"SELECT file, unnest([0, 0, 1, 1])::BIGINT AS i, unnest([0, 1, 0, 1])::BIGINT AS j, round(unnest([a, 0.25, 0.5, k]), 6) + 0 AS value FROM {CUSTOMERS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(files.parse_overlap(_result_lines(spark, d)), "file", "i", "j", "value")


@query("read_mbar_pmf", f"SELECT file, unnest([0.0, 1.0])::DOUBLE AS lam_i, round(unnest([0.0, a]), 6) + 0 AS pmf, round(unnest([0.0, k]), 6) + 0 AS err FROM {CUSTOMERS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(files.parse_mbar_pmf(_result_lines(spark, d)), "file", "lam_i", "pmf", "err")


@query("read_mbar_gradients", f"SELECT file, unnest([0.125, 0.625])::DOUBLE AS lam_mid, round(unnest([a / 0.25, k / 0.75]), 6) + 0 AS grad, round(unnest([2.0, 1.0])::DOUBLE, 6) + 0 AS err FROM {CUSTOMERS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(files.parse_mbar_gradients(_result_lines(spark, d)), "file", "lam_mid", "grad", "err")


@query("read_exp_dgs", "SELECT CASE WHEN s_suppkey % 3 = 0 THEN '/abs/' || s_suppkey WHEN s_suppkey % 3 = 1 THEN '/base/s' || s_suppkey ELSE '/base/x/' || s_suppkey END AS calc_base_dir, s_name AS name, round(s_acctbal, 6) + 0 AS exp_dg, 0.5::DOUBLE AS exp_er, CAST(s_nationkey AS DOUBLE) AS calc_cor, true AS open FROM supplier")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier")
    key = F.col("s_suppkey").cast("string")
    place = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("/abs/"), key)).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("./s"), key)).otherwise(F.concat(F.lit("x/"), key))
    line = F.concat_ws(",", place, F.col("s_name"), F.col("s_acctbal").cast("string"), F.lit("0.5"), F.col("s_nationkey").cast("string"))
    parsed = rows.select(F.from_csv(line, "calc_base_dir string, name string, exp_dg string, exp_er string, calc_cor string").alias("r")).select("r.*")
    out = files.parse_exp_dgs(parsed, "/base/")
    return shown(out.select("calc_base_dir", "name", "exp_dg", "exp_er", "calc_cor", (F.col("calc_dg").isNull() & F.col("calc_er").isNull()).alias("open")))


def _logs(spark: SparkSession, d: str) -> DataFrame:
    """A log for each order, of its customer's series; some have no end, some tell of NaN; the newest has the largest key."""
    rows = table(spark, d, "orders")
    took = F.when(F.col("o_orderkey") % 5 == 0, F.lit("killed")).otherwise(F.concat(F.lit("Simulation took "), F.col("o_totalprice").cast("string"), F.lit(" s")))
    bad = F.when(F.col("o_orderkey") % 3 == 0, F.lit(files.FAILURES[1])).when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("error: "), F.lit(files.FAILURES[0]))).otherwise(F.lit("fine"))
    lines = _lines(rows, F.col("o_orderkey").cast("string"), [F.lit("start"), bad, took], F.col("o_custkey").cast("double"))
    return lines.withColumn("modified", F.timestamp_seconds(F.col("file").cast("long"))).withColumnRenamed("value", "line")


@query("gpu_time", "SELECT CAST(o_custkey AS DOUBLE) AS lam, round(sum(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_totalprice END) / 3600, 7) + 0 AS gpu_hours FROM orders GROUP BY o_custkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown(files.gpu_time(_logs(spark, d)), "lam", "gpu_hours", gpu_hours=7)


@query("failed_runs", "SELECT CAST(c_custkey AS DOUBLE) AS lam, coalesce(bool_or(o_orderkey % 5 = 0), false) AS failed FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    every = table(spark, d, "customer").select(F.lit("calc").alias("calc"), F.lit("free").alias("leg"), F.lit("all").alias("stage"), F.col("c_custkey").cast("double").alias("lam"), F.lit(1).alias("run"))
    return files.failed_runs(_logs(spark, d), every=every).select("lam", "failed")


@query("nan_failures", "SELECT CAST(o_custkey AS DOUBLE) AS lam, max(o_orderkey) % 3 = 0 OR max(o_orderkey) % 7 = 0 AS nan_failure FROM orders GROUP BY o_custkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    return files.nan_failures(_logs(spark, d)).select("lam", "nan_failure")


@query("clean_altloc", "SELECT kind || mark || rest AS value FROM (SELECT CASE WHEN l_orderkey % 4 = 0 THEN 'HETATM' WHEN l_orderkey % 4 = 1 THEN 'REMARK' ELSE 'ATOM  ' END || lpad(CAST(l_linenumber AS VARCHAR), 5, ' ') || '  CA ' AS kind, CASE WHEN l_orderkey % 4 = 1 THEN ['A', 'B', ' '][l_partkey % 3 + 1] ELSE ' ' END AS mark, 'LEU' || l_suppkey AS rest FROM lineitem WHERE l_orderkey % 4 = 1 OR (l_orderkey % 4 <> 3 AND l_partkey % 3 <> 1))")
def _(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_orderkey") % 4 == 0, F.lit("HETATM")).when(F.col("l_orderkey") % 4 == 1, F.lit("REMARK")).when(F.col("l_orderkey") % 4 == 2, F.lit("ATOM  ")).otherwise(F.lit("ANISOU"))
    mark = F.array(F.lit("A"), F.lit("B"), F.lit(" "))[F.pmod("l_partkey", F.lit(3)).cast("int")]
    line = F.concat(kind, F.lpad(F.col("l_linenumber").cast("string"), 5, " "), F.lit("  CA "), mark, F.lit("LEU"), F.col("l_suppkey").cast("string"))
    return files.clean_altloc(table(spark, d, "lineitem").select(line.alias("value")))


@query("read_restraint_corrections", "SELECT CAST(c_nationkey AS VARCHAR) AS file, CAST(c_custkey AS BIGINT) AS run, round(c_acctbal, 6) + 0 AS dg FROM customer WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").where("c_acctbal is not null and c_nationkey is not null")
    line = F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" "), F.col("c_acctbal").cast("string"), F.lit(" kcal / mol"))
    return shown(files.parse_restraint_corrections(_lines(rows, F.col("c_nationkey").cast("string"), [F.lit("run value"), line])), "file", "run", "dg")


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("write_samples", with_samples("SELECT run, step, round(grad, 6) + 0 AS grad FROM samples WHERE lam = 0.25"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Written by stage, here one of each window's name, and read back from one stage's folder."""
    path = _new_folder(spark, "samples")
    sinks.write_samples(samples_from_events(spark, d).withColumn("stage", F.col("lam").cast("string")), path)
    return shown(spark.read.parquet(path).where("stage = '0.25'"), "run", "step", "grad")


def bucketed(spark: SparkSession, d: str) -> DataFrame:
    """The events' samples, read back from a table of whole series."""
    name = f"samples_{uuid.uuid4().hex}"
    sinks.write_sample_table(samples_from_events(spark, d), name, 5, _new_folder(spark, "table"))
    return spark.table(name)


@query("bucketed_samples", with_samples("SELECT lam, run, CAST(i AS BIGINT) AS i, step, round(grad, 6) + 0 AS grad FROM samples WHERE i < round_even(n * 0.5, 0)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """The first half of each series of a bucketed table."""
    rows = series.indexed(bucketed(spark, d))
    return shown(rows.where(F.col("i") < F.bround(F.col("n") * 0.5)), "lam", "run", "i", "step", "grad")


#: A stage of many runs: steps and gradients from the events, every seventh step missing; a log for each status and priority of the orders.
_LIVE = [
    "told AS (SELECT lam, run, i, grad FROM samples WHERE i % 7 <> 3)",
    "steps AS (SELECT lam, run, max(i + 1) * 0.0008 AS simtime_ns, count(*) AS rows, sum(gap) AS gaps, avg(grad) AS mean, var_pop(grad) AS variance FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY lam, run ORDER BY i) > 1 THEN 1 ELSE 0 END AS gap FROM told) GROUP BY lam, run)",
    "said AS (SELECT o_custkey % 7 + 1 AS run, o_orderpriority AS file, sum(CASE WHEN o_orderstatus = 'O' THEN 10 + o_custkey % 100 ELSE 0 END) AS s, bool_or(o_orderstatus = 'O') AS took, bool_or(o_orderstatus = 'P') AS bad, max(o_orderdate) AS m FROM orders WHERE o_orderstatus <> 'F' OR o_custkey % 7 = 6 GROUP BY ALL)",
    "logs AS (SELECT 0.5::DOUBLE AS lam, run, sum(s) / 3600.0 AS gpu_hours, count(*) FILTER (NOT took) AS open_logs, arg_max(bad, (m, file)) AS nan_failure FROM said GROUP BY run)",
]


@query("live_runs", with_samples("SELECT lam, run, round(simtime_ns, 6) + 0 AS simtime_ns, CAST(coalesce(rows, 0) AS BIGINT) AS rows, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, round(mean, 6) + 0 AS mean, round(variance, 6) + 0 AS variance, round(coalesce(gpu_hours, 0), 6) + 0 AS gpu_hours, CAST(coalesce(open_logs, 0) AS BIGINT) AS open_logs, coalesce(nan_failure, false) AS nan_failure, coalesce(open_logs = 0, false) AS finished FROM steps FULL JOIN logs USING (lam, run)", *_LIVE))
def _(spark: SparkSession, d: str) -> DataFrame:
    """The state of an ensemble from lines of samples and logs, as the stream keeps it."""
    s = series.indexed(samples_from_events(spark, d)).where("i % 7 <> 3")
    samples = s.select("lam", "run", F.concat_ws(" ", F.col("step").cast("string"), F.lit("0"), F.col("grad").cast("string")).alias("value"))
    o = table(spark, d, "orders").where("o_orderstatus <> 'F' or o_custkey % 7 = 6")
    took = F.concat_ws(" ", F.lit(files.TOOK), (F.col("o_custkey") % 100 + 10).cast("string"), F.lit("s"))
    line = F.when(F.col("o_orderstatus") == "O", took).when(F.col("o_orderstatus") == "P", F.lit(f"error: {files.FAILURES[0]}")).otherwise(F.lit("started"))
    logs = o.select(F.lit(0.5).alias("lam"), (F.col("o_custkey") % 7 + 1).cast("int").alias("run"), F.col("o_orderpriority").alias("file"), F.col("o_orderdate").cast("timestamp").alias("modified"), line.alias("value"))
    live = monitor.runs_now(monitor.run_lines(samples, logs, ["lam", "run"]), TIMESTEP_NS, STEP, ["lam", "run"])
    return shown(live.drop("stalled"))


HIERARCHY = "SELECT n_regionkey AS region, s_nationkey AS nk, avg(s_acctbal) AS mean, count(*) AS n, CASE WHEN count(*) > 1 THEN " + T975 + "[count(*) - 1] * stddev_samp(s_acctbal) / sqrt(count(*)) END AS ci95 FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_regionkey, s_nationkey"


def _means(spark: SparkSession, d: str) -> DataFrame:
    return statistics.mean_ci95(table(spark, d, "supplier"), ["s_nationkey"], "s_acctbal")


@query("write_report", f"SELECT CAST(nk AS BIGINT) AS s_nationkey, n, round(mean, 6) + 0 AS mean, round(ci95, 6) + 0 AS ci95 FROM ({HIERARCHY})")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Free energies as JSON lines, read back."""
    path, means = _new_folder(spark, "report"), _means(spark, d)
    sinks.write_report(means, path)
    return shown(spark.read.schema(means.schema).json(path))


@query("write_table", f"SELECT CAST(nk AS BIGINT) AS s_nationkey, n, round(mean, 6) + 0 AS mean, round(ci95, 6) + 0 AS ci95 FROM ({HIERARCHY})")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Results as CSV with a header, read back."""
    path, means = _new_folder(spark, "table"), _means(spark, d)
    sinks.write_table(means, path)
    return shown(spark.read.schema(means.schema).option("header", "true").csv(path))


@query("set_summary", f"SELECT n_name AS name, round(mean + n_regionkey, 6) + 0 AS calc_dg, round(ci95, 6) + 0 AS calc_er, n_nationkey % 4 <> 0 AS measured FROM nation LEFT JOIN ({HIERARCHY}) ON nk = n_nationkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The summary of a set as CSV, written before rows with nulls go."""
    runs = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("calc_base_dir"), F.col("s_acctbal").alias("dg"))
    measured = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("calc_base_dir"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 4 != 0, F.lit(1.0)).alias("exp_dg"), F.lit(0.1).alias("exp_er"), F.col("n_regionkey").cast("double").alias("calc_cor"))
    path, summary = _new_folder(spark, "summary"), agreement.set_summary(runs, measured)
    sinks.write_table(summary, path)
    back = spark.read.schema(summary.schema).option("header", "true").csv(path)
    return shown(back.select("name", "calc_dg", "calc_er", F.col("exp_dg").isNotNull().alias("measured")))


