"""The folder that a session shares with its executors, and tables that are cut off from their lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a session on one machine gets a temporary one; a cluster fails."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def settled(table: DataFrame) -> DataFrame:
    """table computed once, written to the shared folder and read back: its plan ends here, its size is known to the planner."""
    path = f"{shared_folder(table.sparkSession)}/settled-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)
