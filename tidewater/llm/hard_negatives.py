"""Hard-negative mining: inner products bounded by the means and deviations of vector segments before they are computed.

A vector is cut into equal segments, of which each has a mean and a deviation. The product of two segments of d
components lies within d times (the product of the means plus or minus the product of the deviations); summed over the
segments that bounds the whole inner product. Pairs that the bounds of one segment leave open are bounded again by four,
then by sixteen, and only what is still open gets its exact score. Anchors come in blocks and rows in parts (see
against); a task goes through its rows in slices and takes along what each anchor has found, which tightens what a bound
has to reach. One pass finds the positives, a second the negatives for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.against import meet, sides
from tidewater.llm.base import materialize, read

POSITIVES, NEGATIVES = 5, 10
#: A negative scores from so many to so many hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Segments of the bounds, in turn; a level whose segments would be single components is left out.
LEVELS = (1, 4, 16)
#: Anchors of a block, anchors and rows bounded at once, rows of an Arrow batch.
BLOCK, ANCHORS, ROWS, BATCH = 1 << 15, 512, 2048, 4096
#: Share of pairs still open above which the next step takes all pairs of a slice in one product of matrices.
DENSE = 0.05
#: What sums in double precision may be off by, as a share of the product of the lengths; products up to EXACT are exact.
SLACK, EXACT = 1e-12, 2.0**53
#: Components have to be below this.
LARGEST = 2.0**45
NONE = np.iinfo(np.int64).min


@dataclass
class Vectors:
    """Vectors of one length: whole components as doubles, with the summaries of each level as rows for one product."""

    x: np.ndarray
    norm: np.ndarray
    #: of each level: means and deviations, each scaled by the root of a segment's components
    levels: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, column: pa.ChunkedArray) -> Vectors:
        a = column.combine_chunks()
        x = a.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(a), -1)
        if len(x) and x.size and np.abs(x).max() >= LARGEST:
            raise OverflowError("a component is too large for scores in 64 bits")
        return cls.made(np.floor(256 * x))

    @classmethod
    def made(cls, x: np.ndarray) -> Vectors:
        d, levels = x.shape[1], []
        for g in LEVELS:
            if g > 1 and 2 * g > d:
                break
            # segments of unequal size where the components don't divide evenly
            edge = np.arange(g) * d // g
            size = np.diff(np.append(edge, d))
            if d == 0:
                break
            mean = np.add.reduceat(x, edge, axis=1) / size
            spread = np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, edge, axis=1) / size
            levels.append((mean * np.sqrt(size), np.sqrt(spread * size)))
        return cls(x, np.sqrt((x * x).sum(axis=1)), levels)

    def rows(self, at) -> Vectors:
        return Vectors(self.x[at], self.norm[at], [(m[at], s[at]) for m, s in self.levels])


def bounds(a: Vectors, b: Vectors, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products by a level's summaries."""
    (m, s), (n, t) = a.levels[level], b.levels[level]
    middle, wide = m @ n.T, s @ t.T + SLACK * np.multiply.outer(a.norm, b.norm)
    return middle - wide, middle + wide


def _pair_bounds(a: Vectors, b: Vectors, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    (m, s), (n, t) = a.levels[level], b.levels[level]
    middle, wide = np.einsum("ij,ij->i", m[i], n[j]), np.einsum("ij,ij->i", s[i], t[j]) + SLACK * a.norm[i] * b.norm[j]
    return middle - wide, middle + wide


def exact(a: Vectors, b: Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (i, j) as 64-bit integers; beyond them the query fails."""
    if not len(i):
        return np.zeros(0, np.int64)
    if a.norm.max() * b.norm.max() < EXACT:
        if len(i) > DENSE * len(a.x) * len(b.x):
            return (a.x @ b.x.T)[i, j].astype(np.int64)
        out = np.empty(len(i), np.int64)
        for k in range(0, len(i), 1 << 16):
            out[k : k + (1 << 16)] = np.einsum("ij,ij->i", a.x[i[k : k + (1 << 16)]], b.x[j[k : k + (1 << 16)]])
        return out
    whole = lambda v: [int(c) for c in v]
    scores = [sum(p * q for p, q in zip(whole(a.x[p]), whole(b.x[q]), strict=True)) for p, q in zip(i.tolist(), j.tolist(), strict=True)]
    if any(abs(s) >= 1 << 63 for s in scores):
        raise OverflowError("a score is beyond 64 bits")
    return np.array(scores, np.int64)


def open_pairs(a: Vectors, b: Vectors, allowed: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The allowed pairs whose score may be from least to most of the row of a, level by level."""
    i = j = None
    for level in range(len(a.levels)):
        if i is None:
            low, high = bounds(a, b, level)
            allowed = allowed & (high >= least[:, None]) & (low <= most[:, None])
            if np.count_nonzero(allowed) <= DENSE * allowed.size:
                i, j = np.nonzero(allowed)
        else:
            keep = np.zeros(len(i), bool)
            for k in range(0, len(i), 1 << 16):
                p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                low, high = _pair_bounds(a, b, level, p, q)
                keep[k : k + (1 << 16)] = (high >= least[p]) & (low <= most[p])
            i, j = i[keep], j[keep]
    return np.nonzero(allowed) if i is None else (i, j)


class Best:
    """The k best rows so far of each of n searches: by score, then id with null last, then number."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.of, self.rows = np.zeros(0, np.int64), np.zeros((0, 4), np.int64)
        #: score that a row has to reach
        self.least = np.full(n, NONE)

    def offer(self, of: np.ndarray, score: np.ndarray, null: np.ndarray, ids: np.ndarray, uid: np.ndarray) -> None:
        good = score >= self.least[of]
        if not good.any():
            return
        of = np.concatenate([self.of, of[good]])
        rows = np.concatenate([self.rows, np.stack([score[good], null[good], ids[good], uid[good]], axis=1)])
        order = np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], -rows[:, 0], of))
        of, rows = of[order], rows[order]
        many = np.bincount(of, minlength=self.n)
        place = np.arange(len(of)) - (np.cumsum(many) - many)[of]
        self.of, self.rows = of[place < self.k], rows[place < self.k]
        last = place == self.k - 1
        self.least[of[last]] = rows[last, 0]


def _by_length(table: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    size = pc.list_value_length(table.column("v")).to_numpy()
    for d in np.unique(size):
        yield int(d), table.filter(pa.array(size == d))


def _labels(table: pa.Table) -> np.ndarray:
    return table.column("y").to_numpy()


class Block:
    """A block's anchors of one length, with their searches: `each` of them for every anchor."""

    def __init__(self, table: pa.Table, each: int, k: int):
        self.table, self.vectors, self.label, self.uid = table, Vectors.of(table.column("v")), _labels(table), table.column("_uid").to_numpy()
        self.each, self.best = each, Best(len(table) * each, k)

    def scan(self, table: pa.Table, same: bool, low: np.ndarray, high: np.ndarray) -> None:
        """Offers rows to the searches: those of the same label but the anchor itself, or those of another; low to high
        is the range of each search's scores, low above high where it takes none."""
        rows, label, uid = Vectors.of(table.column("v")), _labels(table), table.column("_uid").to_numpy()
        ids = table.column("id")
        null, ids = ids.is_null().to_numpy().astype(np.int64), pc.fill_null(ids, 0).to_numpy()
        for start in range(0, len(self.uid), ANCHORS):
            part = slice(start, start + ANCHORS)
            vectors, n = self.vectors.rows(part), len(self.uid[part])
            searches = np.arange(start * self.each, (start + n) * self.each).reshape(n, self.each)
            least = np.maximum(low[searches], self.best.least[searches])
            alike = self.label[part, None] == label
            allowed = alike & (self.uid[part, None] != uid) if same else ~alike
            # the anchor's searches together; those that take nothing don't widen the range
            idle = least > high[searches]
            from_, to = np.where(idle, np.iinfo(np.int64).max, least).min(axis=1), np.where(idle, NONE, high[searches]).max(axis=1)
            allowed &= (from_ <= to)[:, None]
            if not allowed.any():
                continue
            i, j = open_pairs(vectors, rows, allowed, from_.astype(float), to.astype(float))
            score = exact(vectors, rows, i, j)
            for s in range(self.each):
                hit = np.flatnonzero((score >= least[i, s]) & (score <= high[searches[i, s]]))
                # what one slice has beyond a search's k best scores can't stay
                hit = hit[_within_best(i[hit], score[hit], n, self.best.k)]
                self.best.offer(searches[i[hit], s], score[hit], null[j[hit]], ids[j[hit]], uid[j[hit]])


def _within_best(of: np.ndarray, score: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which rows reach the k-th best score of theirs, ties included."""
    order = np.lexsort((-score, of))
    many = np.bincount(of, minlength=n)
    first = np.cumsum(many) - many
    bar = np.full(n, NONE)
    full = many >= k
    bar[full] = score[order[first[full] + k - 1]]
    return score >= bar[of]


def _mine(k: int, same: bool, low: int, high: int):
    """Tasks of a pass: for each anchor its k best rows of the same label, or for each of its positives those of other labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sides(batches, ROWS)
        asked = next(tables, None)
        if asked is None:
            return
        each = 1 if same else max(1, int(pc.max(pc.list_value_length(asked.column("scores"))).as_py() or 0))
        blocks: dict[int, tuple[Block, np.ndarray, np.ndarray]] = {}
        for d, table in _by_length(asked):
            n = len(table)
            least, most = np.full((n, each), NONE), np.full((n, each), np.iinfo(np.int64).max)
            if not same:
                least[:], most[:] = 1, 0
                for i, scores in enumerate(table.column("scores").to_pylist()):
                    # whole scores s with low * p <= 100 * s <= high * p
                    least[i, : len(scores)] = [-(-low * p // 100) for p in scores]
                    most[i, : len(scores)] = [high * p // 100 for p in scores]
            blocks[d] = Block(table, each, k), least.ravel(), most.ravel()
        for table in tables:
            for d, rows in _by_length(table):
                if d in blocks:
                    block, least, most = blocks[d]
                    block.scan(rows, same, least, most)
        for block, _, _ in blocks.values():
            rows, of = block.best.rows, block.best.of
            anchor = pa.array(of // block.each)
            yield pa.RecordBatch.from_arrays([block.table.column("_uid").combine_chunks().take(anchor), pa.array(of % block.each, pa.int32()), pa.array(rows[:, 2], mask=rows[:, 1] > 0), pa.array(rows[:, 3]), pa.array(rows[:, 0])], ["anchor", "search", "id", "uid", "score"])

    return run


FOUND = "anchor long, search int, id long, uid long, score long"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "search").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of (vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by `every`. Rows whose label, vector or a component is null or whose
    components aren't finite take no part; a null vec_id is no anchor, keeps its label and comes last among equal scores.
    Rows that repeat an id are rows of their own, so an anchor's twin can be its positive and both anchors give rows. Only
    vectors of equal length have a score, empty ones 0; scores beyond 64 bits fail the query, as do components from LARGEST
    on. A positive with a negative score has no negatives. Other columns count for nothing, empty tables give none. The
    table has to be files or settled.
    """
    spark = vectors.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    v = F.col("embedding").cast("array<double>")
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    rows = vectors.select(F.monotonically_increasing_id().alias("_uid"), F.col("vec_id").cast("long").alias("id"), label.alias("y"), v.alias("v"), fine.alias("fine"))
    rows = materialize(rows.where("fine").drop("fine"), "vectors")
    anchors = rows.where(F.col("id") % every == 0)
    n, blocks = rows.count(), max(1, -(-anchors.count() // BLOCK))

    near = _best(meet(anchors, rows, n, blocks, _mine(positives, True, low, high), FOUND), positives)
    near = materialize(near.select("anchor", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # a positive's place in the array is its search
    scores = near.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    asked = materialize(anchors.join(scores, F.col("_uid") == F.col("anchor")).drop("anchor"), "anchors")
    far = _best(meet(asked, rows.withColumn("scores", F.lit(None).cast("array<long>")), n, blocks, _mine(negatives, False, low, high), FOUND), negatives)
    far = far.select("anchor", (F.col("search") + 1).alias("_positive"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.withColumnRenamed("rank", "_positive").join(asked.select(F.col("_uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return far.join(named, ["anchor", "_positive"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(read(spark, sf_dir, "embeddings"))
