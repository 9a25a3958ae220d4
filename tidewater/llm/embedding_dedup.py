"""Embedding near-dedup: an exact metric range join on the angle between vectors.

Pivots, as many as the root of the vectors, divide them into cells by the nearest pivot; a cell's covering radius is the
largest angle of its vectors to its pivot. By the triangle inequality a vector can only link with a cell's vectors if its
angle to the cell's pivot is at most the radius of links plus the covering radius. Cells that lie together are packed
into units, as many as the root of the cells and more where a unit would hold over UNIT_ROWS vectors; a cell that is
larger is several units. A vector is copied to the later units that hold a cell it can link with, never to earlier ones,
so that each pair meets once. Each unit joins by itself, with its copies in slices of bounded size: cell by cell, and
within a cell only vectors whose angles to its pivot differ by at most the radius of links are compared. It returns
counts of links and a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.base import arrow_batches, materialize, read
from tidewater.llm.components import components

COSINE = 0.9
#: Vectors of a unit, and of a slice of copies, at most; rows compared at once; sampled vectors for each pivot.
UNIT_ROWS, STEP, SAMPLED = 16384, 256, 4
#: Below this difference from the threshold, single precision doesn't decide; and what angles may be off by.
CLOSE, SLACK = 1e-4, 1e-6
FOUND = "kind string, a long, b long, n long"


def usable(v: Column) -> Column:
    """Not null, not empty, every component finite, one of them not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def units_of(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors in double precision) for each length of vector."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False).astype(float)
    out = []
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        at = column.offsets.to_numpy()[rows]
        x = flat[at[:, None] + np.arange(d)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out.append((rows, x / np.linalg.norm(x, axis=1, keepdims=True)))
    return out


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def pivots_of(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Pivots for each length of vector: of a sample by hash, in proportion to the root of n, those farthest from the ones before."""
    k = max(1, int(np.ceil(np.sqrt(n))))
    by_length: dict[int, list] = {}
    for r in vectors.select("v").orderBy(F.xxhash64("v")).limit(SAMPLED * k).toLocalIterator():
        by_length.setdefault(len(r.v), []).append(r.v)
    out = {}
    for d, rows in by_length.items():
        ((_, x),) = units_of(pa.array(rows, pa.list_(pa.float64())))
        chosen, near = [0], x @ x[0]
        while len(chosen) < min(k, len(x)):
            chosen.append(int(near.argmin()))
            near = np.maximum(near, x @ x[chosen[-1]])
        out[d] = x[chosen]
    return out


@dataclass
class Layout:
    """Where the vectors of one length go: their cells and units. Without pivots all are one cell with all angles 0."""

    pivots: np.ndarray | None
    rows: np.ndarray
    cover: np.ndarray
    #: number of the first unit; of each cell the first of its units and how many it has
    base: int = 0
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    many: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: the units' cells one after another, and where each unit's begin
    cells: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    begin: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def pack(self, base: int) -> int:
        """Deals the cells to units, numbered from base; returns the next number."""
        self.base, n = base, int(self.rows.sum())
        units = max(int(np.ceil(np.sqrt((self.rows > 0).sum()))), -(-n // UNIT_ROWS), 1)
        most = -(-n // units)
        order = np.arange(len(self.rows))
        if self.pivots is not None:
            # cells by the nearest of the first pivots, which lie far apart
            away = angles(self.pivots, self.pivots[:units])
            order = np.lexsort((away.min(axis=1), away.argmin(axis=1)))
        self.first, self.many = np.zeros(len(self.rows), np.int64), np.ones(len(self.rows), np.int64)
        cells, begin, held = [], [], most + 1
        for c in order.tolist():
            r = int(self.rows[c])
            if r > most:
                self.first[c], self.many[c] = len(begin), -(-r // most)
                for _ in range(self.many[c]):
                    begin.append(len(cells))
                    cells.append(c)
                held = most + 1
                continue
            if held + r > most:
                begin.append(len(cells))
                held = 0
            self.first[c] = len(begin) - 1
            cells.append(c)
            held += r
        self.cells, self.begin = np.array(cells), np.array(begin)
        return base + len(begin)

    def own(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(angles to all pivots, the nearest, the angle to it)."""
        if self.pivots is None:
            zero = np.zeros(len(x))
            return zero[:, None], zero.astype(np.int64), zero
        a = angles(x, self.pivots)
        cell = a.argmin(axis=1)
        return a, cell, a[np.arange(len(x)), cell]

    def unit(self, cell: np.ndarray, key: np.ndarray) -> np.ndarray:
        spread = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
        return self.base + self.first[cell] + spread % self.many[cell]

    def copies(self, a: np.ndarray, unit: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, unit) of the later units that a vector can have links in."""
        reach = a <= self.cover + radius + SLACK
        there = np.logical_or.reduceat(reach[:, self.cells], self.begin, axis=1)
        there &= self.base + np.arange(len(self.begin)) > unit[:, None]
        rows, units = np.nonzero(there)
        return rows, self.base + units


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of a[i] and b[i], the smaller label staying."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
        label = root[label]


def unit_links(x: np.ndarray, mine: np.ndarray, cell: np.ndarray, pivots: np.ndarray | None, copies: np.ndarray, least: float, among: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(copies linked to each row, a label for each connected set of rows, pairs compared) of one unit and a slice of copies.

    Own rows are compared with the copies and, if `among`, with one another.
    """
    radius = float(np.arccos(np.clip(least, -1, 1))) + SLACK
    count, label, pairs = np.zeros(len(x), np.int64), np.arange(len(x)), 0
    own, others = np.flatnonzero(mine), np.flatnonzero(~mine)
    own = own[np.argsort(cell[own], kind="stable")]
    rank = np.full(len(x), len(x))
    rank[own] = np.arange(len(own))
    small = x.astype(np.float32)
    edges = np.flatnonzero(np.diff(cell[own], prepend=-1))
    for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(own)], strict=True):
        to = np.concatenate([own[s:], others]) if among else others
        if pivots is None:
            a, b = np.zeros(e - s), np.zeros(len(to))
        else:
            p = pivots[cell[own[s]]][None]
            a, b = angles(x[own[s:e]], p)[:, 0], angles(x[to], p)[:, 0]
        members, to = own[s:e][np.argsort(a)], to[np.argsort(b)]
        a, b = np.sort(a), np.sort(b)
        for k in range(0, len(members), STEP):
            some = members[k : k + STEP]
            lo, hi = np.searchsorted(b, a[k] - radius, "left"), np.searchsorted(b, a[min(k + STEP, len(a)) - 1] + radius, "right")
            for m in range(lo, hi, UNIT_ROWS):
                with_ = to[m : min(m + UNIT_ROWS, hi)]
                pairs += len(some) * len(with_)
                cos = small[some] @ small[with_].T
                i, j = np.nonzero(cos >= least - CLOSE)
                close = cos[i, j] < least + CLOSE
                i, j = some[i], with_[j]
                good = ~close
                good[close] = np.einsum("ij,ij->i", x[i[close]], x[j[close]]) >= least
                good &= rank[i] < rank[j]
                i, j = i[good], j[good]
                np.add.at(count, i, copies[j])
                np.add.at(count, j, copies[i])
                label = _unite(label, i, j)
    return count, label, pairs


def link_vectors(vectors: DataFrame, least: float = COSINE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """vectors: (key, v, copies), v distinct arrays of numbers -> links with other vectors' copies (key, n), links that connect (a, b), work (rows, pairs)."""
    spark, n = vectors.sparkSession, vectors.count()
    radius = float(np.arccos(min(max(least, -1.0), 1.0)))
    pivots = spark.sparkContext.broadcast(pivots_of(vectors, n))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x in units_of(b.column("v")) if b.num_rows else ():
                _, cell, angle = Layout(pivots.value.get(x.shape[1]), np.zeros(0), np.zeros(0)).own(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1])), pa.array(cell), pa.array(angle)], ["d", "cell", "angle"])

    # at most a row for each pivot, and for each length of vector that the sample missed
    held = vectors.mapInArrow(cells, "d long, cell long, angle double").groupBy("d", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("cover")).collect()
    layouts: dict[int, Layout] = {}
    for r in held:
        if r.d not in layouts:
            p = pivots.value.get(r.d)
            layouts[r.d] = Layout(p, np.zeros(1 if p is None else len(p)), np.full(1 if p is None else len(p), -np.inf))
        layouts[r.d].rows[r.cell], layouts[r.d].cover[r.cell] = r.n, r.cover
    units = 0
    for d in sorted(layouts):
        units = layouts[d].pack(units)
    share = spark.sparkContext.broadcast(layouts)

    def dealt(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of one length: which, their cells and units, and (row, unit) of their copies."""
        key = b.column("key").to_numpy()
        for rows, x in units_of(b.column("v")) if b.num_rows else ():
            layout = share.value[x.shape[1]]
            a, cell, _ = layout.own(x)
            unit = layout.unit(cell, key[rows])
            yield rows, cell, unit, *layout.copies(a, unit, radius)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *_, to in dealt(b):
                u, c = np.unique(to, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c)], ["unit", "n"])

    copied = {r.unit: r.n for r in vectors.mapInArrow(sizes, "unit long, n long").groupBy("unit").agg(F.sum("n").alias("n")).collect()}
    slices = np.array([max(1, -(-copied.get(u, 0) // UNIT_ROWS)) for u in range(units)])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("key").to_numpy()
            for rows, cell, unit, copy, to in dealt(b):
                # own rows go to every slice of their unit, a copy to one
                rep = np.repeat(np.arange(len(rows)), slices[unit])
                run = np.arange(len(rep)) - np.repeat(np.cumsum(slices[unit]) - slices[unit], slices[unit])
                slot = (key[rows[copy]].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)).astype(np.int64) % slices[to]
                i = pa.array(np.concatenate([rows[rep], rows[copy]]))
                mine = np.concatenate([np.ones(len(rep), bool), np.zeros(len(copy), bool)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([unit[rep], to])), pa.array(np.concatenate([run, slot])), pa.array(mine), pa.array(np.concatenate([cell[rep], cell[copy]])), b.column("key").take(i), b.column("copies").take(i), b.column("v").take(i)], ["unit", "slice", "mine", "cell", "key", "copies", "v"])

    def compare(table: pa.Table) -> pa.Table:
        key, copies, mine, cell = (table.column(c).to_numpy() for c in ("key", "copies", "mine", "cell"))
        ((_, x),) = units_of(table.column("v").combine_chunks())
        count, label, pairs = unit_links(x, mine, cell, pivots.value.get(x.shape[1]), copies, least, table.column("slice")[0].as_py() == 0)
        linked, joined = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(label)))
        kind = ["links"] * len(linked) + ["edge"] * len(joined) + ["work"]
        a = np.concatenate([key[linked], key[joined], [len(key)]])
        b = np.concatenate([key[linked], key[label[joined]], [0]])
        return pa.table({"kind": pa.array(kind), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(np.concatenate([count[linked], np.zeros(len(joined), np.int64), [pairs]]), pa.int64())})

    sent = f"unit long, slice long, mine boolean, cell long, key long, copies long, v {vectors.schema['v'].dataType.simpleString()}"
    found = materialize(vectors.mapInArrow(send, sent).groupBy("unit", "slice").applyInArrow(compare, FOUND), "found")
    work = found.where("kind = 'work'").agg(F.sum("a").alias("rows"), F.sum("n").alias("pairs"))
    return found.where("kind = 'links'").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n")), found.where("kind = 'edge'").select("a", "b"), work


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = COSINE) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, nor do vectors of
    different lengths. Equal vectors are compared once and counted as often as they occur; rows that repeat a vec_id
    are vectors of their own. A null vec_id keeps its row and is never a component's smallest id if there is another.
    An empty table gives no rows; other columns are not looked at, whatever their names.
    """
    arrow_batches(vectors.sparkSession)
    element = vectors.schema[vector_col].dataType.elementType
    # single precision goes through the shuffles as it is, all else as double; 0 is added as -0.0 equals it
    kind = "float" if isinstance(element, T.FloatType) else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable(F.col(vector_col)), F.transform(vector_col, lambda x: x.cast(kind) + F.lit(0).cast(kind))).alias("v"))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("key"), "v", "first", "copies"), "vectors")
    counts, links, _ = link_vectors(classes.select("key", "v", "copies"), least)
    parts = components(links)
    named = classes.join(parts, classes["key"] == parts["node"], "left").select("key", "v", "first", "copies", F.coalesce("component", "key").alias("component"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(lowest, "component").join(counts, "key", "left").select(F.col("v").alias("class"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.col("component_id").alias("component"))
    out = rows.join(named, rows["v"] == named["class"], "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(read(spark, sf_dir, "embeddings"))
