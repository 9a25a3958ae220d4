"""Readers on literal files."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewater.plans import reader_queries
from tidewater.plans.registry import QUERIES
from tidewater.sources import files
from tidewater.sources.sinks import write_report, write_samples, write_table

#: The layout is the simulation's; all values are made up here, and what is expected is worked out from them.
STEPS = [(100, -250.5, 12.25, 0.5, 1.75, (-31.0, -20.5, -6.25)), (200, -249.0, -3.5, 2.0, 3.0, (4.0, 5.5, 9.0))]
SIMFILE = """#This file was generated on a Tuesday
#Alchemical array is\t\t (0.0, 0.105, 1.0)
#Generating temperature is \t30°C
#Energy was saved every 100 steps
#   [step]      [potential kcal/mol]       [gradient kcal/mol]
""" + "".join(f"     {s}    {p:e}   {g:e}    {f:e}   {b:e}   " + "   ".join(f"{x:e}" for x in u) + "\n" for s, p, g, f, b, u in STEPS)
MATRIX = [[0.6, 0.4], [0.3, 0.7]]
SLOPES = [(0.0, 0.2, -1.5, 0.04), (0.2, 1.0, 2.4, 0.08)]
PROFILE = [(0.0, 0.0, 0.0), (1.0, 0.9, 0.09)]
LINES = lambda rows: "\n".join(" ".join(map(str, r)) for r in rows)
RESULT = f"""lead in#Overlap matrix
{LINES(MATRIX)}
#DG from neighbouring lambda in kcal/mol
{LINES(SLOPES)}
#PMF from MBAR in kcal/mol
{LINES(PROFILE)}
#TI average gradients and standard deviation in kcal/mol
0.0 -7.5 3.25
#MBAR free energy difference in kcal/mol:
0.9, 0.09  #WARNING SUBSAMPLING DISABLED
#TI free energy difference in kcal/mol:
1.1
"""
CONFIG = "### a comment\nnmoves = 5000\ntimestep = 2 * femtosecond\nnmoves = 1\nenergy frequency = 50\nlambda array = 0.0, 0.5, 1.0\nodd = a = b\n"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree") / "calc" / "bound" / "restrain" / "output" / "lambda_0.105" / "run_02"
    top.mkdir(parents=True)
    for name, text in (("simfile.dat", SIMFILE), ("mbar.dat", RESULT), ("run.cfg", CONFIG), ("a.out", "start\nSimulation took 45 s\n"), ("b.out", "Particle coordinate is NaN\n"), ("corr.txt", "1 -1.25 kcal / mol\n2 -2.5 kcal / mol\n")):
        (top / name).write_text(text)
    return str(top)


KEYS = ("calc", "bound", "restrain", 0.105, 2)


def test_samples(spark, tree):
    rows = sorted(files.read_samples(spark, f"{tree}/simfile.dat").collect(), key=lambda r: r.step)
    assert [tuple(r)[:5] for r in rows] == [KEYS] * 2
    assert [(r.step, r.potential, r.grad, r.fwd, r.bwd, tuple(r.u)) for r in rows] == STEPS
    ends = files.read_samples(spark, f"{tree}/simfile.dat", endstate=True)
    assert sorted(r.grad for r in ends.collect()) == sorted(u[-1] - u[0] for *_, u in STEPS)
    header = files.read_header(spark, f"{tree}/simfile.dat")
    assert header.first().temperature_k == pytest.approx(303.15)
    scaled = files.scale_to_energy(files.read_samples(spark, f"{tree}/simfile.dat"), header)
    assert sorted(r.grad for r in scaled.collect()) == pytest.approx(sorted(g * 303.15 * 8.314462618 / 4184 for _, _, g, *_ in STEPS))


def test_results(spark, tree):
    r = files.read_mbar_result(spark, f"{tree}/mbar.dat").first()
    assert (r.dg, r.err) == (0.9, 0.09)
    assert {(r.i, r.j): r.value for r in files.read_overlap(spark, f"{tree}/mbar.dat").collect()} == {(i, j): v for i, row in enumerate(MATRIX) for j, v in enumerate(row)}
    assert sorted((r.lam_i, r.pmf, r.err) for r in files.read_mbar_pmf(spark, f"{tree}/mbar.dat").collect()) == PROFILE
    slopes = sorted((r.lam_mid, r.grad, r.err) for r in files.read_mbar_gradients(spark, f"{tree}/mbar.dat").collect())
    want = [((a + b) / 2, dg / (b - a), err / (b - a)) for a, b, dg, err in SLOPES]
    assert [x for row in slopes for x in row] == pytest.approx([x for row in want for x in row])
    with pytest.raises(PySparkException):
        files.read_mbar_result(spark, f"{tree}/run.cfg").collect()


def test_config(spark, tree):
    config = files.read_config(spark, f"{tree}/run.cfg")
    assert files.config_option(config, "nmoves").first().value == "5000"
    assert files.config_option(config, "odd").first().value == "a"
    with pytest.raises(PySparkException):
        files.config_option(config, "missing").collect()
    m = files.sim_meta(config).first()
    assert (m.timestep_ns, m.nmoves, m.energy_freq, m.time_per_cycle_ns, m.lambda_array) == (2e-6, 5000, 50, 0.01, [0.0, 0.5, 1.0])


def test_logs(spark, tree):
    logs = files.read_job_logs(spark, f"{tree}/*.out")
    assert files.gpu_time(logs).first().gpu_hours == pytest.approx(45 / 3600)
    assert files.failed_runs(logs).first().failed is True
    assert files.failed_runs(logs.where("line like 'Sim%'")).first().failed is False
    every = files.read_samples(spark, f"{tree}/simfile.dat")
    assert files.failed_runs(logs.where("false"), every=every).first().failed is False
    # the newest log decides
    for newest, want in (("b.out", True), ("a.out", False)):
        dated = logs.withColumn("modified", F.when(F.col("file").endswith(newest), F.lit("2024-02-01").cast("timestamp")).otherwise(F.lit("2024-01-01").cast("timestamp")))
        assert files.nan_failures(dated).first().nan_failure is want
    assert sorted(tuple(r)[1:] for r in files.read_restraint_corrections(spark, f"{tree}/corr.txt").collect()) == [(1, -1.25), (2, -2.5)]


def test_clean_altloc(spark):
    lines = ["ATOM      1  N  AALA", "ATOM      2  N  BALA", "ANISOU    1  N  AALA", "HETATM    3  O   HOH", "REMARK"]
    got = [r.value for r in files.clean_altloc(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == ["ATOM      1  N   ALA", "HETATM    3  O   HOH", "REMARK"]


def test_measured_values(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("calc_base_dir,name,exp_dg,exp_er,calc_cor\nmade/up,first,-3.5,0.25,0\n/abs,x,,0.25,0\n")
    rows = {r.name: r for r in files.read_exp_dgs(spark, str(good), "/base").collect()}
    assert rows["first"].calc_base_dir == "/base/made/up" and rows["first"].exp_dg == -3.5 and rows["first"].calc_dg is None
    assert rows["x"].calc_base_dir == "/abs" and rows["x"].exp_dg is None
    bad = tmp_path / "bad.csv"
    bad.write_text("calc_base_dir,name,exp_dg,exp_er\nmade/up,first,-3.5,0.25\n")
    with pytest.raises(ValueError):
        files.read_exp_dgs(spark, str(bad), "/base")
    assert files.read_exp_dgs(spark, None, "/base").count() == 0


def test_sinks(spark, tree, tmp_path):
    samples = files.read_samples(spark, f"{tree}/simfile.dat")
    write_samples(samples, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s")).where("stage = 'restrain'")
    assert sorted(r.step for r in back.collect()) == [100, 200]
    write_table(samples.select("step"), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).columns == ["step"]
    write_report(samples.select("run", "grad"), str(tmp_path / "r"))
    assert sorted(r.grad for r in spark.read.json(str(tmp_path / "r")).collect()) == sorted(g for _, _, g, *_ in STEPS)


def test_no_task_makes_the_files_of_all_parts(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("id as p_partkey", "cast(id % 50 + 1 as int) as p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(reader_queries, "PARTS", 100)
    lines = reader_queries._config(spark, str(tmp_path))
    files = lines.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("file").alias("n")).collect()
    assert len(files) > 5 and sum(r.n for r in files) == 1000 and max(r.n for r in files) < 200
    assert QUERIES["read_config"](spark, str(tmp_path)).count() == 5000
