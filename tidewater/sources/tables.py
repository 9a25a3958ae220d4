"""Series, states, frames and hierarchies from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.ranges import positions
from tidewater.schema import SERIES

#: The lam of each event type, and the time of a step.
LAM = {"click": 0.0, "error": 0.125, "purchase": 0.25, "signup": 0.5, "view": 1.0}
STEP, TIMESTEP_NS, N_RUNS, N_STATES = 200, 4e-6, 5, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples of one stage: windows by event type, runs by user, values in order of time; runs differ in length."""
    lam = F.create_map(*(x for k, v in LAM.items() for x in (F.lit(k), F.lit(v))))[F.col("event_type")]
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin(list(LAM)) & F.col("user_id").isNotNull())
    rows = rows.select(F.lit("events").alias("calc"), F.lit("free").alias("leg"), F.lit("all").alias("stage"), lam.alias("lam"), (F.pmod("user_id", F.lit(N_RUNS)) + 1).cast("int").alias("run"), "ts", "event_id", F.col("value").alias("grad"))
    return positions(rows, SERIES, "ts", "event_id").select(*SERIES, ((F.col("i") + 1) * STEP).cast("long").alias("step"), "grad")


def states_from_embeddings(spark: SparkSession, sf_dir: str, k: int = N_STATES) -> DataFrame:
    """(keys, lam, run, step, state, u): the first k components as energies, the label as the sampled state, steps in order of vec_id."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    at = F.row_number().over(Window.partitionBy(F.pmod("label", F.lit(k)), F.pmod("vec_id", F.lit(N_RUNS))).orderBy("vec_id"))
    u = F.transform(F.slice("embedding", 1, k), lambda x: x.cast("double"))
    return rows.select(F.lit("embeddings").alias("calc"), F.lit("free").alias("leg"), F.lit("all").alias("stage"), (F.pmod("label", F.lit(k)) / float(k - 1)).alias("lam"), (F.pmod("vec_id", F.lit(N_RUNS)) + 1).cast("int").alias("run"), (at * STEP).cast("long").alias("step"), F.pmod("label", F.lit(k)).cast("int").alias("state"), u.alias("u"))


def states_apart_from_embeddings(spark: SparkSession, sf_dir: str, k: int = 6, apart: float = 2.5, rise: float = 8.0) -> DataFrame:
    """(keys, lam, run, state, u): a sample for each vector in one of k harmonic states that overlap little, in turn by vec_id.

    State j has its middle at j * apart, in units of its width, and lies j * rise higher; a sample is as far from its
    state's middle as eight times the vector's first component.
    """
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null and vec_id is not null")
    state = F.pmod("vec_id", F.lit(k)).cast("int")
    x = state * apart + F.col("embedding")[0].cast("double") * 8.0
    u = F.array(*((x - j * apart) * (x - j * apart) / 2.0 + j * rise for j in range(k)))
    return rows.select(F.lit("embeddings").alias("calc"), F.lit("free").alias("leg"), F.lit("apart").alias("stage"), (state / float(k - 1)).alias("lam"), F.lit(1).alias("run"), state.alias("state"), u.alias("u"))


def frames_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """coords: 21 atoms in three axes from 63 components of each vector; atoms 3 to 20 are water."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null")
    cell = lambda a, c: F.col("embedding")[a * 3 + c].cast("double")
    atoms = F.explode(F.array(*(F.struct(F.lit(a).cast("long").alias("atom"), F.lit("LIG" if a < 3 else "WAT").alias("resname"), F.lit(f"A{a}").alias("atom_name"), cell(a, 0).alias("x"), cell(a, 1).alias("y"), cell(a, 2).alias("z")) for a in range(21))))
    return rows.select(F.lit("embeddings").alias("calc"), F.lit("free").alias("leg"), F.lit("all").alias("stage"), F.lit(0.0).alias("lam"), (F.pmod("vec_id", F.lit(N_RUNS)) + 1).cast("int").alias("run"), F.col("vec_id").alias("frame"), atoms.alias("a")).select("calc", "leg", "stage", "lam", "run", "frame", "a.*")


def hierarchy_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(calc, leg, stage, run, dg): region, nation, market segment and order priority, with the mean total price."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("r_name").alias("calc"), F.col("n_name").alias("leg"), F.col("c_mktsegment").alias("stage"), F.substring("o_orderpriority", 1, 1).cast("int").alias("run"), F.col("o_totalprice").alias("value"), "o_orderkey")
