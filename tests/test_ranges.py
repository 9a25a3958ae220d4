"""Long keys by ranges: the same results as sorted windows, and no task with a whole key."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import make

from tidewater.functions import ranges
from tidewater.operators import agreement, autocorrelation, equilibration, series, statistics


@pytest.fixture
def short(monkeypatch):
    """Keys of over ten rows are long, ranges are of some sixteen."""

    def on():
        monkeypatch.setattr(ranges, "LONG", 10)
        monkeypatch.setattr(ranges, "RANGE", 16)

    return on


def rows_of(df):
    return sorted((tuple(str(round(x, 9) + 0.0 if isinstance(x, float) else x) for x in r) for r in df.collect()))


def table(spark):
    """Ties, nulls, not-a-numbers and a value that a third of the rows have; a null key, one of a single row."""
    rng = np.random.default_rng(4)
    rows = [("a", int(i), float(v)) for i, v in enumerate(np.round(rng.normal(size=300), 1))]
    rows += [("b", int(i), 7.0 if i % 3 else float(i)) for i in range(200)]
    rows += [(None, int(i), float(v)) for i, v in enumerate(rng.exponential(size=60) ** 4)] + [("c", 5, 1.0)]
    rows += [("d", int(i), None if i % 4 == 0 else float("nan") if i % 7 == 0 else float(i % 5)) for i in range(90)]
    return spark.createDataFrame(rows, "k string, step long, v double")


def test_positions_ranks_and_medians(spark, short):
    df = table(spark)
    found = lambda: (rows_of(ranges.positions(df, ["k"], "step").select("k", "step", "i", "n")), rows_of(ranges.ranked(df, ["k"], "v", "r").select("k", "step", "v", "r")), rows_of(ranges.medians(df, ["k"], "v", "m")))
    plain = found()
    short()
    assert found() == plain
    b = [7.0 if i % 3 else float(i) for i in range(200)]
    assert dict(plain[2])["b"] == str(np.median(b)) and len(plain[0]) == len(plain[1]) == 651


def test_orders_by_time_and_name(spark, short):
    rows = [("a", f"2024-01-01 00:{m:02d}:{s:02d}", f"n{m * 7 % 60:02d}{s:02d}", 60 * m + s) for m in range(5) for s in range(0, 60, 2)]
    df = spark.createDataFrame(rows, "k string, t string, name string, id long").withColumn("t", F.col("t").cast("timestamp"))
    short()
    out = ranges.positions(df, ["k"], "t", "id")
    assert out.where("i * 2 <> id or n <> 150").isEmpty()
    names = [r.name for r in ranges.positions(df, ["k"], "name").orderBy("i").collect()]
    assert names == sorted(names)


def test_series_of_many_ranges(spark, short):
    """Indices, truncation, blocks, inefficiencies, R-hat and rank tests by ranges."""
    rng = np.random.default_rng(6)
    data = {(k, r): np.round(np.cumsum(rng.normal(size=150)) * 0.2 + rng.normal(size=150), 1) for k in range(2) for r in (1, 2, 3)}
    s = make(spark, data)
    w = series.lambda_weights(s)

    def found():
        return [rows_of(x) for x in (
            series.truncate_fraction(s, 0.2, 0.7), series.cut_to_shortest(s), series.block_average(s, w, 20), series.rolling_mean(s, 7), series.block_gradient(s, 7, 0.5), series.discard_burn_in(s, 0.3),
            autocorrelation.statistical_inefficiency(s), autocorrelation.statistical_inefficiency(s, fast=True), equilibration.gelman_rubin(s), statistics.kruskal_wallis(s),
            equilibration.brown_forsythe(s, "lam", "grad"), statistics.probability_plot(s, ["lam"], "grad"), agreement.spearman(s.withColumn("y", F.col("grad") * F.col("run")), ["lam"], "grad", "y"),
        )]

    plain = found()
    short()
    assert found() == plain and all(plain)


def test_no_task_has_a_whole_series(spark, monkeypatch):
    monkeypatch.setattr(ranges, "LONG", 1 << 16)
    monkeypatch.setattr(ranges, "RANGE", 1 << 14)
    one = spark.range(1_000_000).select(F.lit("s").alias("k"), (F.pmod(F.col("id") * 7919, F.lit(1_000_000)) * 3).alias("step"))
    out = ranges.positions(one, ["k"], "step")
    # or so little data is put into one task afterwards
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert out.where("i * 3 <> step or n <> 1000000").isEmpty()
    most = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert most < 400_000  # of four partitions


def test_rows_of_series_are_not_broadcast(spark, short):
    """Equal keys and few values make small files of many rows; what is broadcast is the table of a row for each key."""
    rng = np.random.default_rng(7)
    s = make(spark, {(k, r): np.round(rng.normal(size=150), 1) for k in range(2) for r in (1, 2, 3)})

    def broadcast(df, column):
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
        found = [i for i, line in enumerate(lines) if "BroadcastExchange" in line]
        below = [next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines)) for i in found]
        return [line for i, j in zip(found, below, strict=True) for line in lines[i:j] if "FileScan" in line and column in line]

    # the rows' files are below this, joins of them above
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    short()
    found = broadcast(equilibration.gelman_rubin(s), "half:int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not found
