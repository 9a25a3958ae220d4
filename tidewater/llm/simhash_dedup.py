"""Near duplicates by 64-bit SimHash: generalised pigeonhole over groups of correlated bits.

Two fingerprints within `radius` bits agree to T_i bits in some bit group i whenever the T_i + 1 sum to radius + 1.
Groups hold correlated bits, thresholds are dealt by dynamic programming on the candidates expected of each group,
every group is probed within its threshold, and each candidate is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.base import Words, arrow_batches, as_bytes, chunks, materialize, read
from tidewater.llm.components import components

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Buckets above this size are divided by further bits; it sets the work for a candidate, never the result.
BUCKET = 512
LANES = np.uint64(0x0101010101010101)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints_of(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Fingerprints of a chunk: bit set where over half the XXH64 of the shingles have it; no words: zero."""
    w = Words(texts)
    out = np.zeros(len(texts), np.uint64)
    if not len(w.start):
        return out
    # words of a document joined by one space each, so that a shingle is a slice
    keep = np.zeros(len(w.buf), bool)
    edge = np.zeros(len(w.buf) + 1, np.int8)
    edge[w.start], edge[w.end] = 1, -1
    keep[:] = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    keep[w.end] = True
    flat = _LOWER[w.buf]
    flat[w.end] = 32
    flat = flat[keep].tobytes()
    end = np.cumsum(w.end - w.start + 1)
    start = end - (w.end - w.start + 1)
    end = end - 1
    n = np.where(w.count >= size, w.count - size + 1, np.minimum(w.count, 1))
    doc = np.repeat(np.arange(len(texts)), n)
    first = w.before[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    last = np.minimum(first + size - 1, w.before[1:][doc] - 1)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(flat[s:e], SEED) for s, e in zip(start[first].tolist(), end[last].tolist(), strict=True)), np.uint64, len(doc))
    # eight counters in the bytes of one word: blocks of up to 255 shingles can't overflow
    full = np.flatnonzero(n)
    n, at = n[full], (np.cumsum(n) - n)[full]
    blocks = -(-n // 255)
    block_at = np.repeat(at, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    of_doc = np.cumsum(blocks) - blocks
    bits = np.zeros(len(full), np.uint64)
    for j in range(8):
        lanes = np.add.reduceat((h >> np.uint64(j)) & LANES, block_at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        over = np.add.reduceat(lanes, of_doc, axis=0) * 2 > n[:, None]
        for k in range(8):
            bits |= over[:, k].astype(np.uint64) << np.uint64(8 * k + j)
    out[full] = bits
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every document; a null text is empty."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            fp = fingerprints_of(as_bytes(b.column("text"))).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def bit_sums(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Count and 64 x 64 co-occurrence counts of the bits over all fingerprints, summed by partition, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            x = np.unpackbits(b.column("fp").to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total, n = total + x.T @ x, n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(65)), pa.array([*total.tolist(), [float(n)] * 64])], ["i", "v"])

    rows = nodes.select("fp").mapInArrow(run, "i long, v array<double>").groupBy("i").agg(*(F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(64))).collect()
    table = {r[0]: np.array(r[1:]) for r in rows}
    return (int(table[64][0]), np.stack([table[i] for i in range(64)])) if table else (0, np.zeros((64, 64)))


def bit_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of 64 / m bits; each takes the bits most correlated with those it holds."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for g in range(m):
        size = len(left) // (m - g)
        group = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.discard(group[0])
        while len(group) < size:
            group.append(max(sorted(left), key=lambda b: corr[b, group].sum()))
            left.discard(group[-1])
        groups.append(sorted(group))
    return groups


def candidates(p: np.ndarray, group: list[int], n: int, t: int) -> float:
    """Pairs expected to differ in at most t bits of the group (bits taken as independent)."""
    dist = np.zeros(t + 2)
    dist[0] = 1
    for b in group:
        q = 2 * p[b] * (1 - p[b])
        dist[1:-1] = dist[1:-1] * (1 - q) + dist[:-2] * q
        dist[0] *= 1 - q
    return float(n) * n / 2 * dist[: t + 1].sum()


def thresholds(n: int, both: np.ndarray, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each group that is probed: the cheapest deal over 2 .. radius + 1 groups."""
    p, best = np.diag(both) / max(n, 1), (np.inf, [])
    for m in range(2, radius + 2):
        groups = bit_groups(n, both, m)
        # cost[k]: cheapest way to deal k units (threshold + 1 each) to the groups so far
        cost: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            # masks up to two flipped bits are enumerated; more are never worth it
            price = {u: 0.0 if not u else candidates(p, g, n, u - 1) + 4.0 * n * sum(len(list(combinations(range(len(g)), d))) for d in range(u)) for u in range(min(radius + 1, 3) + 1)}
            cost = {k: min((c + price[u], d + [u]) for j, (c, d) in cost.items() for u in price if j + u == k) for k in {j + u for j in cost for u in price if j + u <= radius + 1}}
        if radius + 1 in cost and cost[radius + 1][0] < best[0]:
            best = cost[radius + 1][0], [(g, u - 1) for g, u in zip(groups, cost[radius + 1][1], strict=True) if u]
    return best[1]


def _mask(bits: list[int]) -> int:
    return int(np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0])


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) of distinct fingerprints (column fp) within `radius` bits; a pair can appear more than once."""
    spark = nodes.sparkSession
    n, both = bit_sums(nodes)
    plan = [(bits, _mask(bits), [_mask(list(f)) for d in range(t + 1) for f in combinations(bits, d)]) for bits, t in thresholds(n, both, radius)] or [([0], 1, [0])]
    entry = F.array(*(F.struct(F.lit(m).alias("mask"), F.array(*map(F.lit, flips)).alias("flips")) for _, m, flips in plan))
    rows = nodes.select("fp", F.explode(entry).alias("e")).select("fp", F.col("e.mask").alias("mask"), F.explode("e.flips").alias("flip"))
    rows = rows.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip")).alias("value"), (F.col("flip") != 0).alias("probe"))
    flipped = any(f != [0] for _, _, f in plan)
    found = None
    held = [bits for bits, _, _ in plan]
    while True:
        # a bucket with many fingerprints is divided by the rest of the bits: radius + 1 parts, one of which agrees
        hot = rows.where("not probe").groupBy("mask", "value").count().where(F.col("count") > BUCKET).select("mask", "value")
        divide = max(map(len, held)) < 48 and not hot.isEmpty()
        cold = rows
        if divide:
            hot = materialize(hot, "hot")
            cold = rows.join(hot, ["mask", "value"], "left_anti")
        a, b = cold.where("not probe").select("mask", "value", F.col("fp").alias("a")), cold.select("mask", "value", F.col("fp").alias("b"))
        apart = F.col("a") != F.col("b") if flipped else F.col("a") < F.col("b")
        near = a.join(b, ["mask", "value"]).where(apart & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        near = near.select("a", "b")
        found = near if found is None else found.union(near)
        if not divide:
            return found
        parts = {}
        for bits in held:
            rest = [x for x in range(64) if x not in bits]
            parts[_mask(bits)] = [sorted(rest[i :: radius + 1]) for i in range(radius + 1)]
        more = F.create_map(*(x for m, ps in parts.items() for x in (F.lit(m), F.array(*(F.lit(_mask(q)) for q in ps)))))
        hot_rows = rows.join(hot, ["mask", "value"], "left_semi").withColumn("part", F.explode(more[F.col("mask")]))
        rows = materialize(hot_rows.select("fp", F.col("mask").bitwiseOR(F.col("part")).alias("mask"), F.col("value").bitwiseOR(F.col("fp").bitwiseAND(F.col("part"))).alias("value"), "probe"), "divided")
        held = [sorted(set(bits) | set(q)) for bits in held for q in parts[_mask(bits)]]


def grouped(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component) of every distinct fingerprint in fps; the component is one of its fingerprints."""
    nodes = materialize(fps.select("fp").distinct(), "nodes")
    parts = components(links(nodes, radius))
    return nodes.join(parts, nodes.fp == parts.node, "left").select("fp", F.coalesce("component", "fp").alias("component"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and link like any other; repeated rows share a component; a null
    doc_id keeps its row and is no component's smallest id unless no other id is there. An empty table gives none.
    Whole texts are fingerprinted, however long; other columns are not looked at, whatever their names.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    named = grouped(fps, radius)
    first = fps.groupBy("fp").agg(F.min("id").alias("first"))
    lowest = named.join(first, "fp").groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(lowest, "component").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the smallest doc_id (null last), the first if rows share it.

    Null and empty texts are one group, as are texts without words; an empty table stays empty. Whole texts are
    fingerprinted, however long. Columns may have any names.

    docs is read twice, and its rows are numbered each time by their place in the scan, so it has to be files; a row that
    is another the second time fails the query.
    """
    arrow_batches(docs.sparkSession)

    @F.arrow_udf("bigint")
    def print_of(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0, np.int64), *(fingerprints_of(as_bytes(b.column("text"))).view(np.int64) for b in chunks(iter([pa.RecordBatch.from_arrays([text], ["text"])])))]))

    at, mark = F.monotonically_increasing_id(), F.xxhash64(F.col(id_col).cast("string"), text_col)
    rows = materialize(docs.select(F.col(id_col).alias("id"), at.alias("at"), mark.alias("mark"), print_of(F.col(text_col)).alias("fp")), "numbered")
    named = grouped(rows, radius)
    per_print = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull(), "id", "at", "mark")).alias("first"))
    stays = named.join(per_print, "fp").groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.at").alias("stays"), F.col("first.mark").alias("known"))
    kept = docs.select(F.struct(*docs.columns).alias("row"), at.alias("at"), mark.alias("mark")).join(stays, F.col("at") == F.col("stays"))
    same = F.when(F.col("mark") == F.col("known"), True).otherwise(F.raise_error(F.lit("rows are numbered otherwise when read again; write them to files first")).cast("boolean"))
    return kept.where(same).select("row.*")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))
