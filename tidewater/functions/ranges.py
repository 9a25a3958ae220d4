"""Places of rows and ranks of values within keys of any size: long keys go by ranges, none of which is a whole key.

A key is long if it has more than LONG rows. Its rows are dealt to ranges of about RANGE rows at values from a quantile
sketch, counts by range are carried on, and what is left to do is within a range. Shorter keys are one sorted window
each. Both give the same results. Which way it is, a count by key says before the plan is made.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tidewater.sources.scratch import settled

LONG, RANGE = 1 << 20, 1 << 17
#: Ranges of a key at most; the sketch is finer by this factor. Ranges are found in two steps of the root of their number.
MOST_RANGES, FINER = 4096, 16
#: Files whose footers are read to bound the rows.
MOST_FILES = 1000

_known: dict[tuple, int] = {}


def _once(spark: SparkSession, what: tuple, count: Callable[[], int]) -> int:
    key = (spark.sparkContext.applicationId, *what)
    if key not in _known:
        if len(_known) > 1024:
            _known.clear()
        _known[key] = count()
    return _known[key]


def longest(rows: DataFrame, keys: list[str]) -> int:
    """Rows of the key that has most, or a bound within LONG.

    Where the files that rows come from hold no more than that, as their footers say, none of its keys does; otherwise the
    rows are counted by key, once for a plan. A plan that multiplies rows may so take the way of short keys for longer
    ones, which changes no result.
    """
    spark = rows.sparkSession
    files = tuple(sorted(rows.inputFiles()))
    if files and all(f.endswith(".parquet") for f in files):
        held = _once(spark, files, lambda: spark.read.parquet(*files).count() if len(files) < MOST_FILES else LONG + 1)
        if held <= LONG:
            return held
    return _once(spark, (rows.semanticHash(), *keys), lambda: rows.groupBy(*keys).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0])


def with_keys(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the other columns of table, a row for each key; null keys match."""
    other = table.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), *(c for c in table.columns if c not in keys))
    same = reduce(lambda a, b: a & b, (rows[k].eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)))
    return rows.join(other, same).drop(*(f"_key{i}" for i in range(len(keys))))


def ranged(rows: DataFrame, keys: list[str], value: Column, most: int) -> DataFrame:
    """rows with _range, rising with the value, equal values in one; nulls come first, NaN last, and what is no number is one range."""
    n = min(MOST_RANGES, max(1, -(-most // RANGE)))
    v = value.try_cast("double")
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(v, [k / n for k in range(1, n)] or [0.5], FINER * n).alias("_cuts"))
    # written, so that all that follows has the same cuts
    out = with_keys(rows, settled(cuts), keys).withColumn("_v", v)
    step = int(n**0.5) + 1
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col("_v")))
    coarse = F.filter("_cuts", lambda c, i: i % step == step - 1)
    fine = F.slice("_cuts", F.col("_at") * step + 1, step)
    out = out.withColumn("_at", F.coalesce(below(coarse), F.lit(0))).withColumn("_range", F.col("_at") * step + F.coalesce(F.greatest(below(fine), F.lit(0)), F.lit(0)))
    return out.drop("_cuts", "_v", "_at")


def _carried(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _range, count) with _before, the rows of the ranges before, and _n, those of the key."""
    w = Window.partitionBy(*keys)
    before = F.sum("count").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select(*keys, "_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("count").over(w).alias("_n"))


def positions(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """rows with i, the 0-based place of each row in its key, and n, the rows of the key."""
    most = longest(rows, keys)
    if most <= LONG:
        w = Window.partitionBy(*keys)
        return rows.withColumn("i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count("*").over(w))
    dealt = ranged(rows, keys, F.col(order[0]), most)
    here = [*keys, "_range"]
    out = with_keys(dealt, _carried(dealt.groupBy(*here).count(), keys), here)
    place = F.row_number().over(Window.partitionBy(*here).orderBy(*order)) - 1
    return out.withColumn("i", (F.col("_before") + place)).withColumn("n", F.col("_n")).drop("_range", "_before", "_n")


def in_ranges(rows: DataFrame, keys: list[str], order: str, halo: int, most: int) -> tuple[DataFrame, WindowSpec]:
    """rows and a window in which each has the `halo` rows before it; only rows with _own are the window's, the rest neighbours.

    Rows of keys that may be long (most) need their place i and go by ranges of places, each with the last rows of the one
    before; other keys are one window in `order`.
    """
    if most <= LONG:
        return rows.withColumn("_own", F.lit(True)), Window.partitionBy(*keys).orderBy(order)
    size = max(RANGE, 2 * halo)
    own = rows.withColumn("_r", F.floor(F.col("i") / size)).withColumn("_own", F.lit(True))
    before = own.where(F.col("i") % size >= size - halo).withColumn("_r", F.col("_r") + 1).withColumn("_own", F.lit(False))
    return own.unionByName(before), Window.partitionBy(*keys, "_r").orderBy("i")


def ranked(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """rows with `out`, the rank of the value within the key, ties sharing the mean of their ranks."""
    if longest(rows, keys) <= LONG:
        w = Window.partitionBy(*keys).orderBy(value)
        # the rows that tie with this one, in the same sorted window
        peers = F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow))
        return rows.withColumn("_least", F.rank().over(w)).withColumn("_peers", peers).withColumn(out, F.col("_least") + (F.col("_peers") - 1) / 2.0).drop("_least", "_peers")
    places = value_places(rows, keys, value)
    rank = places.select(*keys, value, (F.col("_before") + (F.col("_c") + 1) / 2.0).alias(out))
    return with_keys(rows, rank, [*keys, value])


def value_places(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, _c, _before, _n): of each value how many rows have it, how many a smaller one, and how many there are."""
    most = longest(rows, keys)
    counts = ranged(rows.groupBy(*keys, value).agg(F.count("*").alias("_c")), keys, F.col(value), most)
    here = [*keys, "_range"]
    carried = _carried(counts.groupBy(*here).agg(F.sum("_c").alias("count")), keys)
    w = Window.partitionBy(*here).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return with_keys(counts, carried, here).withColumn("_before", F.col("_before") + F.coalesce(F.sum("_c").over(w), F.lit(0))).drop("_range")


def medians(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, out): the median of each key's values that are not null."""
    known = rows.where(F.col(value).isNotNull()).select(*keys, value)
    if longest(known, keys) <= LONG:
        w = Window.partitionBy(*keys)
        placed = known.withColumn("_k", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
        middle = placed.where((F.col("_k") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_k") == F.floor(F.col("_n") / 2) + 1))
        return middle.groupBy(*keys).agg(F.avg(value).alias(out))
    places = value_places(known, keys, value)
    holds = lambda k: F.max(F.when((F.col("_before") < k) & (k <= F.col("_before") + F.col("_c")), F.col(value)))
    return places.groupBy(*keys).agg(((holds(F.floor((F.col("_n") + 1) / 2)) + holds(F.floor(F.col("_n") / 2) + 1)) / 2.0).alias(out))
