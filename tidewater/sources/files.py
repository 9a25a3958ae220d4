"""Readers of text files as DataFrames. Keys come from paths; files are never opened by the driver, so any path that Spark
reads will do. Each read_ function parses the lines of files with its parse_ function, which takes lines from any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.schema import EXP_DGS, K_B, SERIES

#: Where a path has the keys of a series: .../calc/leg/stage/output/lambda_0.000/run_01/file
LAMBDA, RUN_NO = r"lambda_([0-9.]+)", r"run_(\d+)"
NODE = r"([^/]+)/([^/]+)/([^/]+)/(?:output/)?lambda_"
#: The phrases of job logs, and the titles of the sections of result files.
TOOK, FAILURES = "Simulation took", ("NaN or Inf has been generated along the simulation", "Particle coordinate is NaN")
RESULT_TITLE, OVERLAP_TITLE, PMF_TITLE, SLOPES_TITLE = "#MBAR free energy difference", "#Overlap matrix", "#PMF from MBAR in kcal/mol", "#DG from neighbouring lambda"


def path_keys(path: Column) -> list[Column]:
    """calc, leg, stage, lam and run from a file's path; parts that are missing are empty or null."""
    node = [F.regexp_extract(path, NODE, k + 1).alias(n) for k, n in enumerate(("calc", "leg", "stage"))]
    number = lambda pattern, kind: F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).cast(kind)
    return [*node, number(LAMBDA, "double").alias("lam"), number(RUN_NO, "int").alias("run")]


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(keys, file, modified, value), one row per line; large files are split, so rows carry no order of their own."""
    rows = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    return rows.select(*path_keys(F.col("file")), "file", "modified", "value")


def _numbered(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(keys, file, pos, value): lines with their place, for small files that are read whole."""
    rows = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return rows.select(*path_keys(F.col("file")), "file", F.posexplode(F.split("value", "\n")).alias("pos", "value"))


def read_samples(spark: SparkSession, paths: str | list[str], endstate: bool = False) -> DataFrame:
    return parse_samples(_lines(spark, paths), endstate)


def parse_samples(lines: DataFrame, endstate: bool = False) -> DataFrame:
    """samples: step, potential, gradient, forward, backward and the energies in all states of each line.

    Lines that start with # are skipped. With endstate the gradient is the last state's energy less the first's.
    """
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.trim("value").startswith("#") & (F.trim("value") != "")).withColumn("_p", parts)
    u = F.transform(F.slice("_p", F.lit(6), F.greatest(F.size("_p") - 5, F.lit(0))), lambda x: x.cast("double"))
    rows = rows.select(*SERIES, F.col("_p")[0].cast("long").alias("step"), *(F.col("_p")[k].cast("double").alias(n) for k, n in ((1, "potential"), (2, "grad"), (3, "fwd"), (4, "bwd"))), u.alias("u"))
    return endstate_gradient(rows) if endstate else rows


def endstate_gradient(samples: DataFrame) -> DataFrame:
    return samples.withColumn("grad", F.element_at("u", -1) - F.col("u")[0])


def read_header(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_header(_lines(spark, paths))


def parse_header(lines: DataFrame) -> DataFrame:
    """(keys, temperature_k) from the header: the 4th word, its unit the 5th or glued on behind a degree sign."""
    rows = lines.where(F.lower("value").contains("temperature") & F.col("value").startswith("#")).withColumn("_w", F.split(F.trim("value"), r"\s+"))
    word = F.col("_w")[3]
    unit = F.when(word.contains("°"), F.substring_index(word, "°", -1)).otherwise(F.regexp_replace(F.try_element_at("_w", F.lit(5)), "°", ""))
    value = F.substring_index(word, "°", 1).cast("double")
    return rows.select(*SERIES, F.when(F.upper(unit).startswith("C"), value + 273.15).otherwise(value).alias("temperature_k"))


def scale_to_energy(samples: DataFrame, header: DataFrame) -> DataFrame:
    """samples with reduced gradients turned into kcal/mol at each series' temperature."""
    return samples.join(header, SERIES).withColumn("grad", F.col("grad") * F.col("temperature_k") * K_B).select(*samples.columns)


def read_config(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_config(_numbered(spark, paths))


def parse_config(lines: DataFrame) -> DataFrame:
    """(keys, file, option, value): text before the first =, and between it and the second; the first line of an option counts."""
    rows = lines.where(F.col("value").contains("=")).withColumn("_s", F.split("value", "="))
    rows = rows.select(*SERIES, "file", "pos", F.trim(F.col("_s")[0]).alias("option"), F.trim(F.col("_s")[1]).alias("value"))
    return rows.groupBy(*SERIES, "file", "option").agg(F.min_by("value", "pos").alias("value"))


def config_option(config: DataFrame, option: str) -> DataFrame:
    """(file, value) of one option; a file without it fails the query."""
    files = config.select("file").distinct()
    value = F.when(F.col("value").isNotNull(), F.col("value")).otherwise(F.raise_error(F.lit(f"option {option} is missing")))
    return files.join(config.where(F.col("option") == option).select("file", "value"), "file", "left").select("file", value.alias("value"))


def sim_meta(config: DataFrame) -> DataFrame:
    """(file, timestep_ns, nmoves, energy_freq, time_per_cycle_ns, lambda_array) of each configuration file."""
    names = ["timestep", "nmoves", "energy frequency", "lambda array"]
    wide = config.groupBy("file").pivot("option", names).agg(F.first("value"))
    femto = F.regexp_extract("timestep", r"([0-9.]+)", 1).cast("double")
    lambdas = F.transform(F.split(F.regexp_replace("lambda array", r"[\[\]\s]", ""), ","), lambda x: x.cast("double"))
    return wide.select("file", (femto / 1e6).alias("timestep_ns"), F.col("nmoves").cast("long").alias("nmoves"), F.col("energy frequency").cast("long").alias("energy_freq"), (femto * F.col("nmoves").cast("double") / 1e6).alias("time_per_cycle_ns"), lambdas.alias("lambda_array"))


def parse_section(lines: DataFrame, title: str) -> DataFrame:
    """(keys, file, pos, k, value): the lines behind one that contains the title, up to the next that starts with #; k from 0.

    The title may be glued to the end of a data line, and data lines may end in a remark.
    """
    rows = lines.where(F.trim("value") != "")
    w = Window.partitionBy("file").orderBy("pos")
    rows = rows.withColumn("_part", F.sum(F.when(F.trim("value").startswith("#") | F.col("value").contains(title), 1).otherwise(0)).over(w))
    head = rows.where(F.col("value").contains(title)).groupBy("file").agg(F.min("_part").alias("_part"))
    body = rows.where(~F.trim("value").startswith("#") & ~F.col("value").contains(title)).join(head, ["file", "_part"])
    return body.withColumn("k", F.row_number().over(w) - 1).drop("_part")


def _number(word: Column) -> Column:
    return F.regexp_replace(word, ",", "").cast("double")


def read_mbar_result(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_mbar_result(_numbered(spark, paths))


def parse_mbar_result(lines: DataFrame) -> DataFrame:
    """(keys, file, dg, err): the line behind the title, value before the comma and error behind it; without one the query fails."""
    found = parse_section(lines, RESULT_TITLE).where("k = 0").select("file", F.trim("value").alias("_v"))
    files = lines.select(*SERIES, "file").distinct()
    dg, err = F.trim(F.split("_v", ",")[0]).cast("double"), F.split(F.trim(F.try_element_at(F.split("_v", ","), F.lit(2))), r"\s+")[0].cast("double")
    both = F.when(dg.isNotNull() & err.isNotNull(), dg).otherwise(F.raise_error(F.lit("no free energy difference in the file")).cast("double"))
    return files.join(found, "file", "left").select(*SERIES, "file", both.alias("dg"), err.alias("err"))


def read_overlap(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_overlap(_numbered(spark, paths))


def parse_overlap(lines: DataFrame) -> DataFrame:
    """(keys, file, i, j, value) of the overlap matrix."""
    rows = parse_section(lines, OVERLAP_TITLE)
    return rows.select(*SERIES, "file", F.col("k").alias("i"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("j", "_v")).select(*SERIES, "file", "i", "j", _number(F.col("_v")).alias("value"))


def read_mbar_pmf(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_mbar_pmf(_numbered(spark, paths))


def parse_mbar_pmf(lines: DataFrame) -> DataFrame:
    """(keys, file, lam_i, pmf, err)."""
    rows = parse_section(lines, PMF_TITLE).withColumn("_p", F.split(F.trim("value"), r"\s+"))
    return rows.select(*SERIES, "file", _number(F.col("_p")[0]).alias("lam_i"), _number(F.col("_p")[1]).alias("pmf"), _number(F.col("_p")[2]).alias("err"))


def read_mbar_gradients(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_mbar_gradients(_numbered(spark, paths))


def parse_mbar_gradients(lines: DataFrame) -> DataFrame:
    """(keys, file, lam_mid, grad, err): differences of neighbouring windows over their distance."""
    rows = parse_section(lines, SLOPES_TITLE).withColumn("_p", F.split(F.trim("value"), r"\s+"))
    a, b, dg, err = (_number(F.col("_p")[k]) for k in range(4))
    return rows.select(*SERIES, "file", ((a + b) / 2).alias("lam_mid"), (dg / (b - a)).alias("grad"), (err / (b - a)).alias("err"))


def read_exp_dgs(spark: SparkSession, path: str | None, base_dir: str) -> DataFrame:
    """(calc_base_dir, name, exp_dg, exp_er, calc_cor, calc_dg null, calc_er null); paths are put behind base_dir.

    Columns other than name have to be the expected ones in order. No file gives an empty table.
    """
    if path is None:
        return parse_exp_dgs(spark.createDataFrame([], EXP_DGS), base_dir)
    return parse_exp_dgs(spark.read.csv(path, header=True), base_dir)


def parse_exp_dgs(rows: DataFrame, base_dir: str) -> DataFrame:
    """As read_exp_dgs, from the columns of such a file."""
    found, want = ([c for c in columns if c != "name"] for columns in (rows.columns, [f.name for f in EXP_DGS]))
    if found != want:
        raise ValueError(f"the columns have to be {want}, they are {found}")
    rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in EXP_DGS))
    place = F.when(F.col("calc_base_dir").startswith("/"), F.col("calc_base_dir")).otherwise(F.concat_ws("/", F.lit(base_dir.rstrip("/")), F.regexp_replace("calc_base_dir", r"^\./", "")))
    return rows.withColumn("calc_base_dir", place).select("*", *(F.lit(None).cast("double").alias(c) for c in ("calc_dg", "calc_er")))


def read_job_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(keys, file, modified, line)."""
    return _lines(spark, paths).withColumnRenamed("value", "line")


def gpu_time(logs: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """(keys, gpu_hours): the third word of each line about the time taken, summed."""
    seconds = F.split(F.trim("line"), r"\s+")[2].cast("double")
    return logs.groupBy(*keys).agg((F.sum(F.when(F.trim("line").startswith(TOOK), seconds).otherwise(0.0)) / 3600).alias("gpu_hours"))


def failed_runs(logs: DataFrame, keys: list[str] = SERIES, every: DataFrame | None = None) -> DataFrame:
    """(keys, failed): a series fails if one of its files has no line about the time taken; without files it has not failed."""
    files = logs.groupBy(*keys, "file").agg(F.bool_or(F.trim("line").startswith(TOOK)).alias("_ok"))
    out = files.groupBy(*keys).agg((~F.bool_and("_ok")).alias("failed"))
    if every is None:
        return out
    return every.select(*keys).distinct().join(out, keys, "left").withColumn("failed", F.coalesce("failed", F.lit(False)))


def nan_failures(logs: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """(keys, nan_failure): whether the newest log tells of NaN."""
    bad = F.lit(False)
    for text in FAILURES:
        bad = bad | F.col("line").contains(text)
    files = logs.groupBy(*keys, "file").agg(F.max("modified").alias("_m"), F.bool_or(bad).alias("_bad"))
    return files.groupBy(*keys).agg(F.max_by("_bad", F.struct("_m", "file")).alias("nan_failure"))


def clean_altloc(lines: DataFrame, value: str = "value") -> DataFrame:
    """Structure lines without ANISOU records and other than the first alternate location, whose mark is blanked."""
    atom = F.col(value).startswith("ATOM") | F.col(value).startswith("HETATM")
    mark = F.substring(F.col(value), 17, 1)
    kept = lines.where(~F.col(value).startswith("ANISOU") & (~atom | mark.isin(" ", "A", "")))
    return kept.withColumn(value, F.when(atom & (mark == "A"), F.overlay(F.col(value), F.lit(" "), 17, 1)).otherwise(F.col(value)))


def read_restraint_corrections(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_restraint_corrections(spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file")))


def parse_restraint_corrections(lines: DataFrame) -> DataFrame:
    """(file, run, dg) of lines `run value kcal / mol`."""
    rows = lines.withColumn("_p", F.split(F.trim("value"), r"\s+"))
    return rows.where(F.col("value").rlike(r"^\s*\d+\s+[-+0-9.eE]+")).select("file", F.col("_p")[0].cast("int").alias("run"), F.col("_p")[1].cast("double").alias("dg"))
