"""Questions from parts of a table to hash buckets, and answers back, as Spark shuffles of packed arrays.

A part (some MB of documents) sends each bucket the sorted distinct keys that it holds there, in one row. A bucket
compares the keys of all parts and returns one byte per key, in the order asked. A key that fills a part is one entry,
so no key makes a hot task; a part derives its keys anew each time instead of keeping them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes of a part; it grows with the corpus up to the second figure, then the number of parts does.
PART_BYTES, MOST_PART_BYTES, LEAST_PARTS = 4 << 20, 64 << 20, 48
#: A key: what it is dealt and sorted by, and two hashes that tell keys apart.
KEY = np.dtype([("by", "<u8"), ("own", "<u8")])
#: A key with where it stands first in the part that asks; and an answer, whether it stands elsewhere and where it stands first of all.
PLACED = np.dtype([("by", "<u8"), ("own", "<u8"), ("doc", "<i8"), ("pos", "<i4")])
FIRST = np.dtype([("flag", "u1"), ("doc", "<i8"), ("pos", "<i4")])
ASKED, ANSWERED = "part int, bucket int, round int, data binary", "part int, round int, bucket int, data binary"
ELSEWHERE = 1


def part_count(docs: DataFrame, text: str = "text") -> int:
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return max(LEAST_PARTS, -(-total // min(max(PART_BYTES, total >> 12), MOST_PART_BYTES)))


def buckets_of(by: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each key, rising with it."""
    return ((by >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def ask(part: int, round_: int, keys: np.ndarray, n_buckets: int) -> pa.Table:
    """Rows for sorted distinct keys."""
    b = buckets_of(keys["by"], n_buckets)
    at = np.flatnonzero(np.diff(b, prepend=-1))
    data = [x.tobytes() for x in np.split(keys, at[1:])] if len(keys) else []
    n = len(data)
    return pa.table({"part": pa.array([part] * n, pa.int32()), "bucket": pa.array(b[at], pa.int32()), "round": pa.array([round_] * n, pa.int32()), "data": pa.array(data, pa.binary())})


def answer(asked: DataFrame) -> DataFrame:
    """A byte per key: ELSEWHERE if another part asked it too."""

    def run(table: pa.Table) -> pa.Table:
        data = [np.frombuffer(x, KEY) for x in table.column("data").to_pylist()]
        keys = np.concatenate(data)
        order = np.lexsort((keys["own"], keys["by"]))
        s = keys[order]
        same = (s["by"][1:] == s["by"][:-1]) & (s["own"][1:] == s["own"][:-1])
        flags = np.zeros(len(s), np.uint8)
        flags[1:][same] = ELSEWHERE
        flags[:-1][same] = ELSEWHERE
        return answered(table, data, order, flags)

    return asked.groupBy("bucket").applyInArrow(run, ANSWERED)


def firsts(asked: DataFrame) -> DataFrame:
    """As answer for PLACED keys, with each key's first place by document and position."""

    def run(table: pa.Table) -> pa.Table:
        data = [np.frombuffer(x, PLACED) for x in table.column("data").to_pylist()]
        keys = np.concatenate(data)
        order = np.lexsort((keys["pos"], keys["doc"], keys["own"], keys["by"]))
        s = keys[order]
        head = np.concatenate([[True], (s["by"][1:] != s["by"][:-1]) | (s["own"][1:] != s["own"][:-1])])
        at, many = np.flatnonzero(head), np.diff(np.append(np.flatnonzero(head), len(s)))
        out = np.empty(len(s), FIRST)
        out["flag"], out["doc"], out["pos"] = np.repeat((many > 1) * ELSEWHERE, many), np.repeat(s["doc"][at], many), np.repeat(s["pos"][at], many)
        return answered(table, data, order, out)

    return asked.groupBy("bucket").applyInArrow(run, ANSWERED)


def answered(table: pa.Table, data: list[np.ndarray], order: np.ndarray, flags: np.ndarray) -> pa.Table:
    """The flags of keys in sorted order, dealt back to the rows that asked."""
    out = np.empty_like(flags)
    out[order] = flags
    at = np.cumsum([len(x) for x in data])[:-1]
    return pa.table({"part": table.column("part"), "round": table.column("round"), "bucket": table.column("bucket"), "data": pa.array([x.tobytes() for x in np.split(out, at)], pa.binary())})


def answers(table: pa.Table, round_: int, kind: np.dtype | type = np.uint8) -> np.ndarray:
    """The bytes, or other answers, for a part's sorted keys of a round."""
    rows = sorted((b, d) for r, b, d in zip(*(table.column(c).to_pylist() for c in ("round", "bucket", "data")), strict=True) if r == round_)
    return np.frombuffer(b"".join(d for _, d in rows), kind)


Question = Callable[[pa.Table, pa.Table], pa.Table]


def in_rounds(base: DataFrame, questions: list[tuple[Question, Callable[[DataFrame], DataFrame]]], last: Question, schema: str) -> DataFrame:
    """Asks each question in turn, with the answers so far, has it answered, then runs `last` with all answers, part by part.

    The rounds share one shuffle of the texts: Spark reuses an exchange that a plan holds more than once.
    """
    spark = base.sparkSession
    known = spark.createDataFrame([], ANSWERED)
    for q, reply in questions:
        asked = base.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(q, ASKED)
        known = known.union(reply(asked))
    return base.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(last, schema)
