"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated isotonically.

The statistics are counts over whole texts (letters, marks, repeats). The Fourier features approximate a Gaussian
kernel on them; Spark sums the normal equations by partition, the driver solves one small system. The scores are
then calibrated by pooled adjacent violators on a fixed grid of score bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.base import Rolling, Words, arrow_batches, as_bytes, chunks, hashes_of, materialize, mix, read

N_FOURIER, LENGTH_SCALE, RIDGE, BINS, THRESHOLD = 256, 4.0, 1e-3, 2000, 0.3
#: Byte classes that are counted, in the order of the counts.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!?", "|", "#$%&*@^~+=<>", "\"'()[]{}:;-_/\\`", " ", "\n")
_CLASS = np.full(256, len(CLASSES), np.int64)
for _i, _c in enumerate(CLASSES):
    _CLASS[list(_c.encode())] = _i
N_STATS = 11 + 9


def _repeats(doc: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Share of a document's keys that an earlier equal key has, for each of n documents."""
    total = np.bincount(doc, minlength=n)
    # a distinct (document, key) is counted for its document through one of its rows
    _, first = np.unique(mix(keys + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return 1 - np.bincount(doc[first], minlength=n) / np.maximum(total, 1)


def statistics_of(texts: list[bytes]) -> np.ndarray:
    """N_STATS numbers for each text, all finite; an empty text has zeros but for its lengths' logarithms."""
    w, n = Words(texts), len(texts)
    k = len(CLASSES) + 1
    size = np.diff(w.doc_at)
    counts = np.bincount(np.repeat(np.arange(n) * k, size) + _CLASS[w.buf], minlength=n * k).reshape(n, k)
    letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, -1], 1)
    share = counts / np.maximum(size[:, None] - 1, 1)
    words = np.maximum(w.count, 1)
    doc = np.repeat(np.arange(n), w.count)
    length = w.end - w.start
    h = w.hashes()
    starts = lambda m: np.flatnonzero(np.arange(len(h)) + m <= w.before[1:][doc]) if len(h) else np.zeros(0, np.int64)
    grams = starts(3)
    gram_keys = Rolling(h).of(grams, grams + 3) if len(h) else np.zeros(0, np.uint64)
    line_end = np.flatnonzero(w.buf == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    line_keys = hashes_of(w.buf, line_start, line_end)
    line_doc = np.searchsorted(w.doc_at, line_start, "right") - 1
    by = lambda x: np.bincount(doc, x, minlength=n) / words
    mean = by(length)
    tail = w.buf[w.end - 1] if len(h) else np.zeros(0, np.uint8)
    odd_tail = (_CLASS[tail] == 5) | (_CLASS[tail] == 7)
    lone = (length == 1) & (_CLASS[w.buf[w.start]] > 2) & (_CLASS[w.buf[w.start]] < len(CLASSES)) if len(h) else np.zeros(0, bool)
    return np.column_stack([
        np.log1p(size - 1), np.log1p(w.count), mean, np.sqrt(np.maximum(by(length.astype(float) ** 2) - mean**2, 0)),
        counts[:, 1] / letters, share[:, 2], share[:, 3], share[:, 4], share[:, 5], share[:, 6], share[:, 7], share[:, 8], share[:, 10], share[:, -1],
        by(odd_tail.astype(float)), by(lone.astype(float)), _repeats(doc, h, n), _repeats(doc[grams], gram_keys, n), _repeats(line_doc, line_keys, n), by((length > 12).astype(float)),
    ])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f array<double>) of every row."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            f = statistics_of(as_bytes(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.FixedSizeListArray.from_arrays(pa.array(f.ravel()), f.shape[1]).cast(pa.list_(pa.float64()))], ["id", "f"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, f array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    beta: np.ndarray | None = None
    #: calibration: raw scores and their probabilities, both rising
    raw: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    prob: np.ndarray = field(default_factory=lambda: np.array([0.5]))

    def features(self, f: np.ndarray) -> np.ndarray:
        x = np.clip((f - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / len(self.shift)) * np.cos(x @ self.weights + self.shift)
        return np.column_stack([z, np.ones(len(z))])

    def raw_scores(self, f: np.ndarray) -> np.ndarray:
        return self.features(f) @ self.beta if self.beta is not None else np.full(len(f), 0.5)

    def scores(self, f: np.ndarray) -> np.ndarray:
        r = self.raw_scores(f)
        # a thousandth of the raw score orders documents on one calibrated step
        return 0.999 * np.interp(r, self.raw, self.prob) + 0.001 / (1 + np.exp(-np.clip(4 * (r - 0.5), -30, 30)))


def _matrix(batch: pa.RecordBatch, name: str = "f") -> np.ndarray:
    col = batch.column(name)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def pool_adjacent(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic means: (centre, mean) of the pooled blocks of bins x with mean y and weight n."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, n, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    t = np.array(blocks)
    return t[:, 0] / t[:, 2], t[:, 1] / t[:, 2]


def fit(stats: DataFrame, labelled: DataFrame, seed: int = 7) -> Model:
    """stats: (id, f) of all documents, for centre and scale; labelled: (f, y double) of every training row."""
    columns = [g(F.col("f")[i]).alias(f"{g.__name__}{i}") for i in range(N_STATS) for g in (F.avg, F.stddev_pop)]
    row = stats.agg(*columns).first()
    mean, scale = np.array([row[2 * i] or 0.0 for i in range(N_STATS)]), np.array([row[2 * i + 1] or 1.0 for i in range(N_STATS)])
    rng = np.random.default_rng(seed)
    model = Model(mean, np.maximum(scale, 1e-9), rng.normal(size=(N_STATS, N_FOURIER)) / LENGTH_SCALE, rng.uniform(0, 2 * np.pi, N_FOURIER))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((N_FOURIER + 1, N_FOURIER + 2))
        for b in batches:
            if b.num_rows:
                z = model.features(_matrix(b))
                total += z.T @ np.column_stack([z, b.column("y").to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total))], ["i", "v"])

    def summed(table: pa.Table) -> pa.Table:
        total = sum(_matrix(b, "v").sum(axis=0) for b in table.to_batches() if b.num_rows)
        return pa.table({"i": table.column("i")[:1], "v": pa.array([total], pa.list_(pa.float64()))})

    rows = labelled.select("f", "y").mapInArrow(equations, "i long, v array<double>").groupBy("i").applyInArrow(summed, "i long, v array<double>").collect()
    if not rows or not any(any(r.v) for r in rows):
        return model
    both = np.array([r.v for r in sorted(rows, key=lambda r: r.i)])
    n = both[-1, -2]  # the constant feature's square: training rows
    model.beta = np.linalg.solve(both[:, :-1] + RIDGE * n * np.eye(len(both)) / N_FOURIER, both[:, -1])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.floor((model.raw_scores(_matrix(b)) + 1) / 3 * BINS), 0, BINS - 1).astype(np.int64)), b.column("y")], ["bin", "y"])

    bins = sorted(labelled.select("f", "y").mapInArrow(raw, "bin long, y double").groupBy("bin").agg(F.avg("y"), F.count("*")).collect())
    x, y, n = (np.array(v, float) for v in zip(*bins, strict=True))
    model.raw, model.prob = pool_adjacent((x + 0.5) * 3 / BINS - 1, y, n)
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(id, score) of every row of stats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(_matrix(b)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s)], ["id", "score"])

    return stats.select("id", "f").mapInArrow(run, "id long, score double")


def fold(id_col: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % k


def trained(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model]:
    """The statistics of docs, and the model fit to those whose label is known and not held out."""
    stats = materialize(statistics(docs, id_col, text_col), "statistics")
    known = labels.where(F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("double").alias("y"))
    train = materialize(stats.join(known, "id").where(fold(F.col("id"), 5) != 0).select("f", "y"), "labelled")
    return stats, fit(stats, train)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Rows of labels with a null label or doc_id are left out; several labels of a document all count. Without any
    training label every score is 0.5. Null texts are empty, long ones are counted whole; repeated rows and null ids are
    scored each by themselves; an empty table gives no rows. Other columns of either table are not looked at.
    """
    out = score(*trained(docs, labels, label))
    return out.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", text_col: str = "text") -> DataFrame:
    """The rows of docs whose own text scores THRESHOLD or more; scored in place, so that no text is shuffled.

    Null and empty texts are scored as empty ones; repeated rows stay or go together; an empty table stays empty, and
    without any training label all rows stay. Columns may have any names.
    """
    _, model = trained(docs, labels, label, text_col=text_col)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(model.scores(statistics_of(as_bytes(b.column("text")))) for b in chunks(iter([pa.RecordBatch.from_arrays([text], ["text"])])))]))

    return docs.where(scored(F.col(text_col)) >= THRESHOLD)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
