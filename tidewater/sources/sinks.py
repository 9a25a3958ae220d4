"""Writers: partitioned sample sets, and result tables as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewater.schema import RUN, STAGE


def write_samples(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet by calculation, leg and stage, so that later reads skip the other stages."""
    samples.write.mode(mode).partitionBy(*STAGE).parquet(path)


def write_sample_table(samples: DataFrame, name: str, buckets: int, path: str | None = None, mode: str = "errorifexists") -> None:
    """A table bucketed by runs and sorted by window and step: windows over a series of it start without a shuffle.

    path puts the files outside the warehouse. Buckets are by calc, leg, stage and run (Spark doesn't use those by lam, a
    floating number), and hold all windows of a run, so there have to be many more runs than tasks.
    """
    rows = samples.repartition(buckets, *RUN).write.mode(mode).bucketBy(buckets, *RUN).sortBy("lam", "step")
    (rows if path is None else rows.option("path", path)).saveAsTable(name)


def write_table(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A results or summary table as CSV files with a header; a set's summary is written before rows with nulls go."""
    table.write.mode(mode).option("header", "true").csv(path)


def write_report(means: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Free energies with their intervals as JSON lines, one per node."""
    means.write.mode(mode).json(path)
