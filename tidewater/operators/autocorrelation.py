"""Statistical inefficiency by batches of lags: many correlation values in one aggregation over one sorted window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import ranges
from tidewater.functions.ranges import in_ranges, longest, positions, with_keys
from tidewater.operators.series import subsample
from tidewater.schema import SERIES
from tidewater.sources.scratch import settled

#: Lags of the first batch; later ones double, up to the second figure.
FIRST_BATCH, MOST_LAGS = 16, 128


def lag_schedule(first: int, step: int, count: int, fast: bool) -> list[tuple[int, int]]:
    """(lag, increment) of the next lags; fast widens the step by one each time."""
    out = []
    for _ in range(count):
        out.append((first, step))
        first, step = first + step, step + int(fast)
    return out


def statistical_inefficiency(samples: DataFrame, keys: list[str] = SERIES, x: str = "grad", y: str | None = None, fast: bool = False, mintime: int = 3, order: str = "step") -> DataFrame:
    """(keys, n, g): g = 1 + 2 * sum of C(t) (1 - t / n), up to the first C(t) <= 0 with t > mintime; at least 1.

    C is the normalised (cross-)correlation of x and y. A series whose covariance is zero fails the query. Each pass
    takes the next lags of the series that have not stopped; what returns to the driver is whether any is left. A long
    series goes by ranges, each with as many rows of the one before as the largest lag of the pass.
    """
    y = y or x
    means = samples.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    rows = with_keys(samples.select(*keys, F.col(order).alias("_o"), F.col(x).alias("_x"), F.col(y).alias("_y")), means.drop("n"), keys)
    rows = rows.select(*keys, "_o", (F.col("_x") - F.col("_mx")).alias("dx"), (F.col("_y") - F.col("_my")).alias("dy"))
    most = longest(samples, keys)
    # the places in a long series say in which range a row is; a shorter one is one range
    rows = settled(positions(rows, keys, "_o").drop("n") if most > ranges.LONG else rows.withColumn("i", F.lit(0)))
    base = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("dx") * F.col("dy")).alias("s2"))
    state = base.select(*keys, "n", F.when(F.col("s2") != 0, F.col("s2")).otherwise(F.raise_error(F.lit("the sample covariance is zero")).cast("double")).alias("s2"), F.lit(1.0).alias("g"), F.lit(False).alias("done"))
    state = settled(state)
    lag, step, count = 1, 1, FIRST_BATCH
    while True:
        lags = lag_schedule(lag, step, count, fast)
        open_rows = rows.join(state.where("not done and n > " + str(lag + 1)).select(*keys), keys, "left_semi")
        open_rows, by_order = in_ranges(open_rows, keys, "_o", lags[-1][0], most)
        # one pass over the sorted ranges gives the products of all lags
        shifted = open_rows.select(*keys, "_own", *(((F.col("dx") * F.lag("dy", t).over(by_order)) + (F.col("dy") * F.lag("dx", t).over(by_order))).alias(f"p{t}") for t, _ in lags))
        sums = shifted.where("_own").groupBy(*keys).agg(*(F.sum(f"p{t}").alias(f"p{t}") for t, _ in lags))
        n = F.col("n")
        terms = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(float(d)).alias("d"), (F.col(f"p{t}") / F.nullif(2.0 * (n - t) * F.col("s2"), F.lit(0.0))).alias("c")) for t, d in lags))
        # lags at or beyond n - 1 end a series, as does the first correlation below zero
        over = lambda s: (s["t"] >= n - 1) | ((s["c"] <= 0) & (s["t"] > mintime))
        added = F.aggregate(terms, F.struct(F.lit(0.0).alias("sum"), F.lit(False).alias("over")), lambda a, s: F.struct(F.when(a["over"] | over(s), a["sum"]).otherwise(a["sum"] + 2 * s["c"] * (1 - s["t"] / n) * s["d"]).alias("sum"), (a["over"] | over(s)).alias("over")))
        merged = state.join(sums, keys, "left").withColumn("_a", F.when(~F.col("done") & (F.col("n") > lag + 1), added).otherwise(F.struct(F.lit(0.0).alias("sum"), F.lit(True).alias("over"))))
        state = merged.select(*keys, "n", "s2", (F.col("g") + F.col("_a.sum")).alias("g"), F.col("_a.over").alias("done"))
        state = settled(state)
        if state.where("not done").isEmpty():
            return state.select(*keys, "n", F.greatest("g", F.lit(1.0)).alias("g"))
        (lag, step), count = (lags[-1][0] + lags[-1][1], lags[-1][1] + int(fast)), min(2 * count, MOST_LAGS)


def equil_chodera(means: DataFrame, keys: list[str], stride: int = 1, least: float = 50.0, value: str = "grad", order: str = "step", mintime: int = 3) -> DataFrame:
    """(keys, t0, g, n_eff, equilibrated): the start t0 that leaves the most effective samples (T - t0 + 1) / g(t0).

    means is one series per key, the mean over its runs. Every stride-th start before T - 1 is tried; g(t0) is that of
    the rows from t0 on (fast steps). Running sums from the end give a lag's correlation for all starts at once, so
    a pass costs rows times lags; starts that have stopped retire, and with them the rows before the first open one. A
    constant series gives t0 = 0, g = 1, n_eff = 1.
    """
    w = Window.partitionBy(*keys)
    from_end = w.orderBy(F.desc("i"))
    tail = from_end.rowsBetween(Window.unboundedPreceding, 0)
    rows = means.select(*keys, F.col(value).alias("x"), (F.row_number().over(w.orderBy(order)) - 1).cast("long").alias("i"), F.count("*").over(w).alias("n"), F.var_pop(value).over(w).alias("v"))
    flat = rows.where("v = 0 or n < 3").groupBy(*keys).agg(F.lit(0).cast("long").alias("t0"), F.lit(1.0).alias("g"), F.lit(1.0).alias("n_eff"))
    # values from the median, which is near the level of the later rows, so that the sums of products stay exact
    middle = rows.where("v > 0 and n >= 3").groupBy(*keys).agg(F.expr("percentile(x, 0.5)").alias("mid"))
    state = rows.join(middle, keys).select(*keys, "i", "n", (F.col("x") - F.col("mid")).alias("dx"))
    state = state.select(*keys, "i", (F.col("n") - F.col("i")).alias("m"), "dx", F.avg("dx").over(tail).alias("mu"), F.var_pop("dx").over(tail).alias("s2"), F.lit(1.0).alias("g"))
    state = state.withColumn("open", (F.col("i") % stride == 0) & (F.col("m") >= 2) & (F.col("s2") > 0))
    state, bests, lag, step, count = settled(state), [], 1, 1, FIRST_BATCH
    m, mu = F.col("m"), F.col("mu")
    over = lambda s: (s["t"] >= m - 1) | ((s["c"] <= 0) & (s["t"] > mintime))
    while True:
        lags = lag_schedule(lag, step, count, True)
        later = state.select("*", *(F.lag("dx", t).over(from_end).alias(f"x{t}") for t, _ in lags))
        sums = later.select(*state.columns, *(F.sum(F.col("dx") * F.col(f"x{t}")).over(tail).alias(f"p{t}") for t, _ in lags), *(F.sum(F.when(F.col(f"x{t}").isNotNull(), F.col("dx") + F.col(f"x{t}"))).over(tail).alias(f"q{t}") for t, _ in lags))
        terms = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(float(d)).alias("d"), ((F.col(f"p{t}") - mu * F.col(f"q{t}") + (m - t) * mu * mu) / F.nullif((m - t) * F.col("s2"), F.lit(0.0))).alias("c")) for t, d in lags))
        added = F.aggregate(terms, F.struct(F.lit(0.0).alias("sum"), F.lit(False).alias("over")), lambda a, s: F.struct(F.when(a["over"] | over(s), a["sum"]).otherwise(a["sum"] + 2 * s["c"] * (1 - s["t"] / m) * s["d"]).alias("sum"), (a["over"] | over(s)).alias("over")))
        tried = settled(sums.select(*state.columns, F.when(F.col("open"), added).alias("_a")).select(*keys, "i", "m", "dx", "mu", "s2", (F.col("g") + F.coalesce("_a.sum", F.lit(0.0))).alias("g"), (F.col("open") & ~F.col("_a.over")).alias("open"), (F.col("open") & F.col("_a.over")).alias("stopped")))
        g = F.greatest("g", F.lit(1.0))
        bests.append(tried.where("stopped").select(*keys, F.col("i").alias("t0"), g.alias("g"), ((m + 1) / g).alias("n_eff")).groupBy(*keys).agg(F.max_by(F.struct("t0", "g", "n_eff"), F.struct("n_eff", -F.col("t0"))).alias("b")))
        if tried.where("open").isEmpty():
            break
        first = tried.where("open").groupBy(*keys).agg(F.min("i").alias("_first"))
        state = tried.join(first, keys).where("i >= _first").select(*state.columns)
        (lag, step), count = (lags[-1][0] + lags[-1][1], lags[-1][1] + 1), min(2 * count, MOST_LAGS)
    best = reduce(DataFrame.unionByName, bests).groupBy(*keys).agg(F.max_by("b", F.struct("b.n_eff", -F.col("b.t0"))).alias("b")).select(*keys, "b.*")
    return best.unionByName(flat).withColumn("equilibrated", F.col("n_eff") >= least)


def chodera_windows(samples: DataFrame, keys: list[str], stride: int = 1) -> DataFrame:
    """equil_chodera on the mean over runs of each window's samples."""
    return equil_chodera(samples.groupBy(*keys, "step").agg(F.avg("grad").alias("grad")), keys, stride)


def decorrelated(samples: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Every floor(g)-th row of each series."""
    return subsample(samples, statistical_inefficiency(samples, keys), keys).drop("g")
