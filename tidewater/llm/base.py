"""Shared helpers of the corpus operators: scratch tables, text chunks, words and rolling hashes.

Everything here works on one Arrow batch inside a task, or plans one Spark step; nothing gathers a table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.scratch import shared_folder

#: A word is a run of bytes other than these (UTF-8 continuation bytes are never among them).
SPACES = (9, 10, 11, 12, 13, 32)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: Text bytes that a task turns into arrays at once; a longer single document is one chunk.
CHUNK_BYTES = 1 << 19
#: Rows of an Arrow batch, so that a batch of long documents stays small.
BATCH_ROWS = "512"

#: Bytes from which a word is known by a digest.
LONG = 512

_RNG = np.random.default_rng(20240229)
BYTE_VALUES = _RNG.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch for this session (texts may be long)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > int(BATCH_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: later steps survive lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """The wanted columns with a row number `_uid`: rows that repeat a doc_id stay apart.

    The numbering is by place in the scan, so the input has to be files (or a materialized table).
    """
    return docs.select(F.monotonically_increasing_id().alias("_uid"), *columns)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of text each, or one row."""
    for batch in batches:
        n = batch.num_rows
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < n:
            done = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Words:
    """Words of a chunk of documents as arrays of positions in one buffer, each document ended by a newline."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.doc_at = np.concatenate([[0], np.cumsum(lengths)])
        inside = ~IS_SPACE[self.buf]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        #: words before[d] .. before[d + 1] - 1 are those of document d
        self.before = np.searchsorted(self.start, self.doc_at)
        self.count = np.diff(self.before)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return hashes_of(self.buf, self.start, self.end, seed)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (in place on a fresh array)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the seed's odd base modulo 2**64, and of its inverse."""
    if seed not in _POWERS or len(_POWERS[seed][0]) < n:
        m, b = max(n, CHUNK_BYTES + 4096), BASES[seed]

        def of(base: int) -> np.ndarray:
            p = np.full(m, base, np.uint64)
            p[0] = 1
            return np.multiply.accumulate(p)

        _POWERS[seed] = of(b), of(pow(b, -1, 2**64))
    return _POWERS[seed]


class Rolling:
    """Hash of any range of a sequence from prefix sums: equal ranges have equal hashes, wherever they stand.

    Only for ranges of fewer than 1024 tokens; see hashes_of.
    """

    def __init__(self, values: np.ndarray, seed: int = 0):
        power, self.inverse = _powers(len(values) + 1, seed)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def hashes_of(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each range of bytes. Modulo 2**64 some ranges of 1024 bytes and more agree whatever the base, so LONG ones get a digest."""
    out = Rolling(BYTE_VALUES[seed][buf], seed).of(start, end)
    for i in np.flatnonzero(end - start >= LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([seed])).digest(), "little")
    return out


def sliding(a: np.ndarray, w: int, op) -> np.ndarray:
    """op over each w neighbours of a, by doubling."""
    k, out = 1, a
    while 2 * k <= w:
        out = op(out[:-k], out[k:])
        k *= 2
    return op(out[: len(out) - (w - k)], out[w - k :]) if w > k else out
