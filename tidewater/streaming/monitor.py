"""Live progress of running series: one state of each from its sample and log files, and allocations after each batch."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from tidewater.schema import SERIES
from tidewater.sources.files import FAILURES, TOOK, path_keys


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.dat", files_per_batch: int = 1000) -> DataFrame:
    """(keys, file, modified, value): lines of new files below folder as they appear."""
    rows = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).text(folder)
    rows = rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    return rows.select(*path_keys(F.col("file")), "file", "modified", "value")


def sample_lines(lines: DataFrame) -> DataFrame:
    """(keys, step, grad) of sample lines; comments are skipped."""
    p = F.split(F.trim("value"), r"\s+")
    return lines.where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(*SERIES, p[0].cast("long").alias("step"), p[2].cast("double").alias("grad"))


def progress(samples: DataFrame, timestep_ns: float, distinct_steps: bool = False, keys: list[str] = SERIES) -> DataFrame:
    """(keys, simtime_ns, rows, mean, variance): batch or stream; in update mode a row per series that moved.

    The running maximum needs no memory of steps. distinct_steps counts a step once when a restarted file repeats it,
    at the price of a key of state for each step.
    """
    rows = samples.dropDuplicates([*keys, "step"]) if distinct_steps else samples
    return rows.groupBy(*keys).agg((F.max("step") * timestep_ns).alias("simtime_ns"), F.count("*").alias("rows"), F.avg("grad").alias("mean"), F.var_pop("grad").alias("variance"))


def job_state(lines: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """(keys, gpu_hours, finished, nan_failure) from log lines, batch or stream."""
    took = F.trim("value").startswith(TOOK)
    bad = F.col("value").contains(FAILURES[0]) | F.col("value").contains(FAILURES[1])
    seconds = F.when(took, F.split(F.trim("value"), r"\s+")[2].cast("double")).otherwise(0.0)
    return lines.groupBy(*keys).agg((F.sum(seconds) / 3600).alias("gpu_hours"), F.bool_or(took).alias("finished"), F.bool_or(bad).alias("nan_failure"))


_TEXT, _LONG, _DOUBLE, _FLAG = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
#: Of a series: the steps it has, as intervals of whole spacings, with moments of their gradients; its log files.
STATE = T.StructType([
    *(T.StructField(c, T.ArrayType(_LONG)) for c in ("first", "last")), T.StructField("rows", _LONG), T.StructField("mean", _DOUBLE), T.StructField("m2", _DOUBLE), T.StructField("step", _LONG),
    T.StructField("seconds", _DOUBLE), *(T.StructField(c, T.ArrayType(_TEXT)) for c in ("open", "closed")), T.StructField("newest", _LONG), T.StructField("newest_file", _TEXT), T.StructField("nan", _FLAG),
])
_EMPTY = ([], [], 0, 0.0, 0.0, None, 0.0, [], [], -1, "", False)
_LIVE = [T.StructField("simtime_ns", _DOUBLE), T.StructField("rows", _LONG), T.StructField("gaps", _LONG), T.StructField("mean", _DOUBLE), T.StructField("variance", _DOUBLE), T.StructField("gpu_hours", _DOUBLE), T.StructField("open_logs", _LONG), T.StructField("nan_failure", _FLAG), T.StructField("finished", _FLAG), T.StructField("stalled", _FLAG)]


def run_lines(samples: DataFrame, logs: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Sample lines and log lines (keys, file, modified, value) as one table or stream of what they tell of their series."""
    p = F.split(F.trim("value"), r"\s+")
    told = samples.where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(*keys, p[0].cast("long").alias("step"), p[2].cast("double").alias("grad"))
    took = F.trim("value").startswith(TOOK)
    bad = F.col("value").contains(FAILURES[0]) | F.col("value").contains(FAILURES[1])
    said = logs.select(*keys, "file", F.unix_micros(F.col("modified").cast("timestamp")).alias("modified"), F.when(took, p[2].cast("double")).alias("seconds"), took.alias("took"), bad.alias("bad"))
    return told.unionByName(said, allowMissingColumns=True)


def _between(first: list[int], last: list[int], x: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """Which of the sorted distinct numbers no interval holds, and the intervals with them."""
    a, b = np.array(first, np.int64), np.array(last, np.int64)
    at = np.searchsorted(a, x, "right") - 1
    new = (at < 0) | (x > (b[at] if len(b) else -1))
    edges = np.concatenate([np.stack([a, b], axis=1), np.stack([x[new], x[new]], axis=1)]).reshape(-1, 2)
    edges = edges[np.argsort(edges[:, 0], kind="stable")]
    heads = np.flatnonzero(np.concatenate([[True], edges[1:, 0] > edges[:-1, 1] + 1])) if len(edges) else np.zeros(0, np.int64)
    return new, edges[heads, 0].tolist(), edges[np.append(heads[1:], len(edges)) - 1, 1].tolist() if len(edges) else []


def _told(state: tuple, pdf: pd.DataFrame, spacing: int) -> tuple:
    """The state after some lines: a step counts once, whichever file repeats it; a log is open until it tells the time taken."""
    first, last, rows, mean, m2, step, seconds, open_, closed, newest, newest_file, nan = state
    given = pdf[pdf["step"].notna()]
    if len(given):
        given = given.assign(place=(given["step"] // spacing).astype("int64")).sort_values("step", kind="stable").drop_duplicates("place")
        new, first, last = _between(first, last, given["place"].to_numpy())
        x = given["grad"].to_numpy(float)[new]
        step = max(int(given["step"].max()), step if step is not None else -(1 << 62))
        if len(x):
            off, n = x.mean() - mean, rows + len(x)
            m2 += float(((x - x.mean()) ** 2).sum()) + off * off * rows * len(x) / n
            mean, rows = mean + off * len(x) / n, n
    for file, part in pdf[pdf["file"].notna()].groupby("file"):
        seconds += float(part["seconds"].sum())
        if part["took"].any():
            closed = sorted({*closed, file})
        elif file not in closed:
            open_ = sorted({*open_, file})
        open_ = [f for f in open_ if f not in closed]
        if (int(part["modified"].max()), file) >= (newest, newest_file):
            nan = bool(part["bad"].any()) or (file == newest_file and nan)
            newest, newest_file = int(part["modified"].max()), file
    return list(first), list(last), int(rows), float(mean), float(m2), step, float(seconds), list(open_), list(closed), int(newest), newest_file, bool(nan)


def _shown(state: tuple, timestep_ns: float, stalled: bool) -> list:
    first, _, rows, mean, m2, step, seconds, open_, closed, _, _, nan = state
    some = rows > 0
    return [step * timestep_ns if some else math.nan, rows, max(len(first) - 1, 0), mean if some else math.nan, m2 / rows if some else math.nan, seconds / 3600, len(open_), nan, bool(closed) and not open_, stalled]


def live_runs(lines: DataFrame, timestep_ns: float, spacing: int, silent_s: int, keys: list[str] = SERIES) -> DataFrame:
    """Stream of (keys, simtime_ns, rows, gaps, mean, variance, gpu_hours, open_logs, nan_failure, finished, stalled).

    lines is run_lines over streams. A row for each series that moved. Steps are kept as intervals of `spacing`, so a run
    without gaps takes the same state however long it is; gaps counts the holes. A series is finished if it has logs and
    all of them told the time they took, and stalled if it isn't finished and nothing came for `silent_s` seconds (seen at
    the next batch). nan_failure is that of the newest log. Late logs, files that repeat steps and steps out of order give
    what the whole would give at once.
    """
    kinds = T.StructType([*(lines.schema[k] for k in keys), *_LIVE])

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else _EMPTY
        if not state.hasTimedOut:
            for pdf in pdfs:
                now = _told(now, pdf, spacing)
            state.update(now)
        row = _shown(now, timestep_ns, False)
        row[-1] = state.hasTimedOut and not row[-2]
        if not state.hasTimedOut:
            state.setTimeoutDuration(silent_s * 1000)
        yield pd.DataFrame([[*key, *row]], columns=kinds.names)

    return lines.groupBy(*keys).applyInPandasWithState(run, kinds, STATE, "update", "ProcessingTimeTimeout")


def runs_now(lines: DataFrame, timestep_ns: float, spacing: int, keys: list[str] = SERIES) -> DataFrame:
    """What live_runs gives, of all lines at once (none is stalled): aggregations only."""
    place = F.floor(F.col("step") / spacing)
    steps = lines.where("step is not null").groupBy(*keys, place.alias("_p")).agg(F.max("step").alias("step"), F.min_by("grad", "step").alias("grad"))
    apart = F.col("_p") - F.lag("_p").over(Window.partitionBy(*keys).orderBy("_p")) > 1
    moments = steps.withColumn("_gap", F.coalesce(apart.cast("long"), F.lit(0))).groupBy(*keys).agg((F.max("step") * timestep_ns).alias("simtime_ns"), F.count("*").alias("rows"), F.sum("_gap").alias("gaps"), F.avg("grad").alias("mean"), F.var_pop("grad").alias("variance"))
    files = lines.where("file is not null").groupBy(*keys, "file").agg(F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("s"), F.bool_or("took").alias("took"), F.bool_or("bad").alias("bad"), F.max("modified").alias("m"))
    logs = files.groupBy(*keys).agg((F.sum("s") / 3600).alias("gpu_hours"), F.count_if(~F.col("took")).alias("open_logs"), F.max_by("bad", F.struct("m", "file")).alias("nan_failure"))
    out = moments.join(logs, keys, "full")
    zero = {"rows": 0, "gaps": 0, "gpu_hours": 0.0, "open_logs": 0, "nan_failure": False}
    finished = F.coalesce(F.col("open_logs") == 0, F.lit(False))
    return out.withColumn("finished", finished).fillna(zero).select(*keys, "simtime_ns", "rows", "gaps", "mean", "variance", "gpu_hours", "open_logs", "nan_failure", "finished", F.lit(False).alias("stalled"))


def start_monitor(table: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Runs a progress or state stream in update mode into a batch function; without seconds, over what is there now.

    Over what is there now no batch runs without data, as one that waits for silence would never end; series that have
    fallen silent are told of with the next data.
    """
    out = table.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)
    if seconds is not None:
        return out.trigger(processingTime=f"{seconds} seconds").start()
    conf, name = table.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return out.trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


#: Batches from one snapshot of the state to the next.
SNAPSHOT = 10


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_at").alias("_v")).select(*keys, "_v.*")


def _parts(folder: str, number: int) -> list[str]:
    """What makes up the state after a batch: the last snapshot, and the batches since."""
    base = number // SNAPSHOT * SNAPSHOT
    return [f"{folder}/snapshot={base}"] * (base > 0) + [f"{folder}/batch={n}" for n in range(base + (base > 0), number + 1)]


def merge_state(folder: str, keys: list[str] = SERIES) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the newest row of each series.

    Batch n writes its rows under folder/batch=n; every SNAPSHOT-th merges the last snapshot and the batches since into
    one of its own; last, one of SNAPSHOT slots of the manifest says that n is there. Everything is written by number, so
    a batch that is replayed after a crash writes the same again, and no step reads more than a snapshot and SNAPSHOT batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("_at", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if number and number % SNAPSHOT == 0:
            parts = [*_parts(folder, number - 1), f"{folder}/batch={number}"]
            _newest(spark.read.parquet(*parts), keys).write.mode("overwrite").parquet(f"{folder}/snapshot={number}")
        spark.range(number, number + 1).write.mode("overwrite").parquet(f"{folder}/manifest/slot={number % SNAPSHOT}")

    return write


def current_state(spark: SparkSession, folder: str, keys: list[str] = SERIES, number: int | None = None) -> DataFrame:
    """The newest row of each series that merge_state has written, up to a batch, by default the last one in the manifest."""
    if number is None:
        number = spark.read.option("ignoreMissingFiles", "true").schema("id long").parquet(f"{folder}/manifest").agg(F.max("id")).first()[0]
    return _newest(spark.read.parquet(*_parts(folder, number)), keys).drop("_at")


def streaming_allocation(samples: DataFrame, plan: Callable[[DataFrame], DataFrame], state_folder: str, out_folder: str, checkpoint: str, timestep_ns: float) -> StreamingQuery:
    """After each batch of samples, the state is brought up to date and plan(state) is written as the new allocation."""
    spark, merge = samples.sparkSession, merge_state(state_folder)

    def sink(batch: DataFrame, number: int) -> None:
        merge(batch, number)
        plan(current_state(spark, state_folder, number=number)).write.mode("overwrite").parquet(f"{out_folder}/batch={number}")

    return start_monitor(progress(samples, timestep_ns), sink, checkpoint)
