"""A set of queries against all rows, in blocks: each block of queries meets each part of the rows in one task.

Rows stream past the queries, so that a part may be of any size; a task holds one block of queries, what it has found for
them so far, and a segment of rows. Blocks and parts are dealt by hashes of row numbers, so no key can gather.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of the rows at least (over all blocks), so that small tables keep many tasks busy, and rows of a part at most.
LEAST_TASKS, PART_ROWS = 24, 1 << 22


def meet(queries: DataFrame, rows: DataFrame, n_rows: int, blocks: int, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run over each block of queries and each part of rows; both have a row number `_uid`, missing columns become null.

    A row goes to one part for each block of queries, a query to its block for each part. run gets the queries first
    (see sides).
    """
    parts = max(-(-LEAST_TASKS // blocks), -(-n_rows // PART_ROWS))
    deal = lambda n: F.pmod(F.xxhash64("_uid"), F.lit(n)).cast("int")
    asked = queries.withColumn("_row", F.lit(False)).withColumn("_at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: p * blocks + deal(blocks))))
    given = rows.withColumn("_row", F.lit(True)).withColumn("_at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: deal(parts) * blocks + b)))
    both = asked.unionByName(given, allowMissingColumns=True)
    return both.repartitionById(parts * blocks, "_at").sortWithinPartitions("_row").drop("_at").mapInArrow(run, schema)


def sides(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """All queries as one table, then the rows in tables of `rows` each; nothing where a task has no queries or no rows."""
    held: list[pa.RecordBatch] = []
    size, queries = 0, None
    for batch in batches:
        first = batch.num_rows - batch.column("_row").true_count
        if first:
            held.append(batch.slice(0, first))
        if first == batch.num_rows:
            continue
        if queries is None:
            if not held:
                return
            queries, held = pa.Table.from_batches(held), []
            yield queries
        batch = batch.slice(first)
        while batch.num_rows:
            take = batch.slice(0, rows - size)
            held.append(take)
            size += take.num_rows
            batch = batch.slice(take.num_rows)
            if size == rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)
