"""Agreement of calculated with measured values: joined results, correlations, errors, bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.ranges import positions, ranked
from tidewater.operators.statistics import mean_ci95

STATISTICS = ("r", "r2", "mue", "rmse", "rho", "tau")


def set_results(calculated: DataFrame, measured: DataFrame, offset: bool = False) -> DataFrame:
    """set_summary without the rows that have a null."""
    return set_summary(calculated, measured, offset).dropna()


def set_summary(calculated: DataFrame, measured: DataFrame, offset: bool = False) -> DataFrame:
    """measured with calc_dg and calc_er, the mean and 95 % half width of each calculation's runs, plus calc_cor.

    calculated has (calc_base_dir, run, dg). A directory that is measured twice fails the query, as does an offset
    without every exp_dg. With offset, calc_dg is moved by the difference of the means. This
    is the table to write before rows with nulls go.
    """
    runs = mean_ci95(calculated, ["calc_base_dir"], "dg").select(F.col("calc_base_dir").alias("_dir"), F.col("mean").alias("_dg"), F.col("ci95").alias("_er"))
    once = F.count("*").over(Window.partitionBy("calc_base_dir")) == 1
    rows = measured.withColumn("calc_dg", F.lit(None).cast("double")).withColumn("calc_er", F.lit(None).cast("double")).withColumn("_once", once)
    rows = rows.join(runs, F.col("calc_base_dir") == F.col("_dir"), "left")
    dg = F.when(F.col("_once"), F.col("_dg") + F.col("calc_cor")).otherwise(F.raise_error(F.lit("a directory is measured more than once")).cast("double"))
    out = rows.withColumn("calc_dg", dg).withColumn("calc_er", F.col("_er")).select(*measured.columns, "calc_dg", "calc_er")
    if offset:
        known = F.count_if(F.col("exp_dg").isNull()) == 0
        shift = F.when(known, F.avg("exp_dg") - F.avg("calc_dg")).otherwise(F.raise_error(F.lit("exp_dg is missing")).cast("double"))
        out = out.crossJoin(F.broadcast(out.agg(shift.alias("_shift")))).withColumn("calc_dg", F.col("calc_dg") + F.col("_shift")).drop("_shift")
    return out


def pair_statistics(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, r, r2, mue, rmse): correlation, its square by regression, mean and root mean squared difference."""
    d = F.col(x) - F.col(y)
    return pairs.groupBy(*keys).agg(F.corr(x, y).alias("r"), F.regr_r2(y, x).alias("r2"), F.avg(F.abs(d)).alias("mue"), F.sqrt(F.avg(d * d)).alias("rmse"))


def spearman(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, rho): correlation of average ranks."""
    rows = ranked(ranked(pairs.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")), keys, "_x", "_rx"), keys, "_y", "_ry")
    return rows.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("rho"))


def kendall_tau(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, tau): tau-b.

    Discordant pairs are those of the values that are in order in x and not in y. They are counted digit by digit:
    with y as a rank, two values that first differ in a bit are out of order if the one with the bit comes first in x.
    That takes a running sum per bit, so neither a set nor a key is ever paired with itself.
    """
    w = Window.partitionBy(*keys)
    rows = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.dense_rank().over(w.orderBy(x)).alias("_x"), F.dense_rank().over(w.orderBy(y)).alias("_y"))
    tied = lambda *by: rows.groupBy(*keys, *by).agg(F.count("*").cast("double").alias("_c")).groupBy(*keys).agg(F.sum(F.col("_c") * (F.col("_c") - 1) / 2).alias("t" + "".join(by)))
    sizes = rows.groupBy(*keys).agg((F.count("*") * (F.count("*") - 1) / 2.0).alias("n0"))
    # as many digits as the largest rank has
    digits = rows.withColumn("_top", F.floor(F.log2(F.max("_y").over(w).cast("double"))).cast("int"))
    digits = digits.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_top")))).withColumn("_one", F.expr("shiftright(_y, _b) & 1"))
    digits = digits.withColumn("_head", F.expr("shiftright(_y, _b + 1)"))
    # values whose x ties are not in order either way: ones of smaller x only
    before = Window.partitionBy(*keys, "_b", "_head").orderBy("_x").rangeBetween(Window.unboundedPreceding, -1)
    swaps = digits.withColumn("_before", F.sum("_one").over(before)).where("_one = 0").groupBy(*keys).agg(F.sum(F.coalesce("_before", F.lit(0))).cast("double").alias("d"))
    out = sizes
    for t in (tied("_x"), tied("_y"), tied("_x", "_y"), swaps):
        out = out.join(t, keys, "left") if keys else out.crossJoin(t)
    d, n1, n2, n3 = (F.coalesce(c, F.lit(0.0)) for c in ("d", "t_x", "t_y", "t_x_y"))
    concordant = F.col("n0") - n1 - n2 + n3 - d
    return out.select(*keys, ((concordant - d) / F.nullif(F.sqrt((F.col("n0") - n1) * (F.col("n0") - n2)), F.lit(0.0))).alias("tau"))


def all_statistics(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, r, r2, mue, rmse, rho, tau); keys may not be empty."""
    return pair_statistics(pairs, keys, x, y).join(spearman(pairs, keys, x, y), keys).join(kendall_tau(pairs, keys, x, y), keys)


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts: the same on any partitioning."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def bootstrap(pairs: DataFrame, x: str, y: str, x_er: str, y_er: str, order: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """(replicate, x, y): n resamplings with replacement, the same rows for both columns, each with normal noise.

    The noise has the deviation error / 1.96. Rows and noise come from md5 of seed, replicate and position.
    """
    rows = pairs.select(F.lit(0).alias("_all"), F.col(order).alias("_o"), F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(x_er).alias("_xe"), F.col(y_er).alias("_ye"))
    rows = positions(rows, ["_all"], "_o").select((F.col("i") + 1).alias("_at"), F.col("n").alias("_n"), "_x", "_y", "_xe", "_ye")
    draw = lambda what: uniform(F.lit(str(seed)), F.col("replicate").cast("string"), F.col("_at").cast("string"), F.lit(what))
    normal = lambda a, b: F.sqrt(-2 * F.log(draw(a))) * F.cos(2 * 3.141592653589793 * draw(b))
    slots = rows.select("_at", "_n").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    slots = slots.select("replicate", (F.floor(draw("i") * F.col("_n")) + 1).alias("_pick"), normal("a", "b").alias("_zx"), normal("c", "d").alias("_zy"))
    picked = slots.join(rows.drop("_n"), slots["_pick"] == rows["_at"])
    return picked.select("replicate", (F.col("_x") + F.col("_zx") * F.col("_xe") / 1.96).alias(x), (F.col("_y") + F.col("_zy") * F.col("_ye") / 1.96).alias(y))


def stats_with_ci(pairs: DataFrame, x: str, y: str, x_er: str, y_er: str, order: str, n: int = 1000, seed: int = 42, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(stat, value, p05, p95): each statistic with percentiles of its bootstrap (the names say which, not 95 %)."""
    one = all_statistics(pairs.withColumn("_all", F.lit(0)), ["_all"], x, y).drop("_all")
    many = all_statistics(bootstrap(pairs, x, y, x_er, y_er, order, n, seed), ["replicate"], x, y)
    # undefined statistics of a replicate (all rows alike) are left out
    spread = many.select(F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).alias("v")) for s in STATISTICS))).alias("e")).groupBy("e.stat").agg(F.expr(f"percentile(e.v, {low})").alias("p05"), F.expr(f"percentile(e.v, {high})").alias("p95"))
    value = one.select(F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in STATISTICS))).alias("e")).select("e.stat", "e.value")
    return value.join(spread, "stat")


def to_analyse(calculations: DataFrame, results: DataFrame, keys: list[str], reanalyse: bool = False) -> DataFrame:
    """Calculations without a stored result, or all of them."""
    return calculations if reanalyse else calculations.join(results.select(*keys).distinct(), keys, "left_anti")
