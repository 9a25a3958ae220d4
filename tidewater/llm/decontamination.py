"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, weighted-shingle verification.

An item of n words is compared with windows of n words. A window can only be like it if they share so many shingles as
the similarity asks for, wherever in the item these stand. A join on shingles gives the places in a document where one of
an item of n words stands, and every window of n words with enough of these places is looked at. Such windows, and items,
get a SimHash. Fingerprints within RADIUS bits agree, in one of BLOCKS blocks, up to RADIUS // BLOCKS bits. Items are
written under every value within these bits of each of their blocks, windows under the blocks' own values, and both are
joined on size, block and value: no fingerprint within the radius is lost, and a window, of which there are ever more,
costs one row a block. Each candidate is then verified by the exact weighted similarity: the sum of the smaller over the
sum of the larger shingle weights.

Every step on items is a Spark job. What tasks hold of the benchmark is a bitmap of its shingles' hashes, of at most
2 ** MOST_BITS bits, that says which documents need a look; what it lets through in vain, the join drops.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.base import Rolling, Words, arrow_batches, as_bytes, chunks, materialize, mix, read

SHINGLE, SIMILARITY = 5, 0.8
#: Bits in which fingerprints may differ, and blocks of the index: of 10 or 11 bits, each within 2 bits, so that a window
#: meets a fifth of the items of its size.
RADIUS, BLOCKS = 17, 6
#: The bitmap has 64 bits for each shingle between these powers of two, and is built in segments of this power. A shingle
#: sets PROBES of them: of other shingles one in 100 000 passes.
LEAST_BITS, MOST_BITS, SEGMENT_BITS, PROBES = 19, 30, 19, 4
#: Places of a document whose bits are summed at once, and windows that a task holds before it sends them on.
AT_ONCE, HELD = 1 << 13, 1 << 18
FOUND = "doc_id long, item_id long, start_word long, n_words long, distance long, similarity double"


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words of word hashes; fewer words are one shingle of all of them."""
    n = len(h)
    if not n:
        return h
    at = np.arange(max(n - size + 1, 1))
    return Rolling(h, 1).of(at, np.minimum(at + size, n))


def simhash(s: np.ndarray) -> int:
    """64-bit SimHash in which a shingle counts as often as it occurs."""
    bits = np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(s), bitorder="little").view(np.uint64)[0])


def simhashes(s: np.ndarray, starts: np.ndarray, many: int) -> np.ndarray:
    """SimHash of the windows of `many` shingles at rising starts, from running sums over AT_ONCE places at a time."""
    out, done = [np.zeros(0, np.uint64)], 0
    while done < len(starts):
        first = starts[done]
        at = starts[done : np.searchsorted(starts, first + AT_ONCE)] - first
        bits = np.unpackbits(s[first : first + at[-1] + many].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
        out.append(np.packbits(2 * (sums[at + many] - sums[at]) > many, axis=1, bitorder="little").view(np.uint64)[:, 0])
        done += len(at)
    return np.concatenate(out)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two lists of shingles; the weight is the number of occurrences."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(values)), np.bincount(at[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / max(np.maximum(x, y).sum(), 1))


def probe(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th place of hashes in a bitmap."""
    return ((mix(h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if k else h) >> np.uint64(64 - bits)).astype(np.int64)


def items_of(benchmark: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(item, item_id, n, fp, data): number, words, SimHash and packed shingles of each item that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = Words(as_bytes(b.column("text")))
            h, some = w.hashes(), np.flatnonzero(w.count)
            own = [shingles(h[w.before[d] : w.before[d + 1]], size) for d in some.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("item").take(pa.array(some)), b.column("item_id").take(pa.array(some)), pa.array(w.count[some], pa.int32()), pa.array(np.array([simhash(s) for s in own], np.uint64).view(np.int64)), pa.array([s.tobytes() for s in own], pa.binary())], ["item", "item_id", "n", "fp", "data"])

    source = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    return materialize(source.mapInArrow(run, "item long, item_id long, n int, fp long, data binary"), "items")


def postings(items: DataFrame) -> DataFrame:
    """(h, n): which shingle stands in items of n words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.frombuffer(x, np.int64) for x in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *own])), pa.array(np.repeat(b.column("n").to_numpy(), [len(s) for s in own]))], ["h", "n"])

    return materialize(items.select("n", "data").mapInArrow(run, "h long, n int").distinct(), "postings")


class Known:
    """A bitmap of the hashes of all shingles, and how many words shingles have."""

    def __init__(self, items: DataFrame, posts: DataFrame, size: int):
        self.sizes = sorted(r[0] for r in items.select(F.least("n", F.lit(size))).distinct().collect())
        hashes = posts.select("h").distinct()
        self.bits = bits = min(max(LEAST_BITS, int(64 * hashes.count()).bit_length()), MOST_BITS)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = np.concatenate([probe(b.column("h").to_numpy().view(np.uint64), k, bits) for k in range(PROBES)])
                yield pa.RecordBatch.from_arrays([pa.array(at >> SEGMENT_BITS), pa.array((at & (1 << SEGMENT_BITS) - 1).astype(np.int32))], ["segment", "bit"])

        def segment(table: pa.Table) -> pa.Table:
            mask = np.zeros(1 << SEGMENT_BITS, bool)
            mask[table.column("bit").to_numpy()] = True
            return pa.table({"segment": table.column("segment")[:1], "data": pa.array([np.packbits(mask, bitorder="little").tobytes()])})

        made = hashes.mapInArrow(spread, "segment long, bit int").groupBy("segment").applyInArrow(segment, "segment long, data binary")
        self.map = np.zeros(1 << bits - 3, np.uint8)
        for r in made.toLocalIterator():
            self.map[r[0] << SEGMENT_BITS - 3 : r[0] + 1 << SEGMENT_BITS - 3] = np.frombuffer(r[1], np.uint8)

    def among(self, s: np.ndarray) -> np.ndarray:
        """Which of the hashes can be a shingle's."""
        left = np.arange(len(s))
        for k in range(PROBES):
            at = probe(s[left], k, self.bits)
            left = left[self.map[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0]
        return left

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, place in it, hash) of the shingles of a chunk that can be an item's."""
        h, out = w.hashes(), []
        rolling = Rolling(h, 1)
        last = np.repeat(w.before[1:], w.count)
        for size in self.sizes:
            at = np.flatnonzero(np.arange(size, len(h) + size) <= last)
            s = rolling.of(at, at + size)
            hit = self.among(s)
            out.append((at[hit], s[hit]))
        at, s = (np.concatenate([o[i] for o in out] or [np.zeros(0, t)]) for i, t in enumerate((np.int64, np.uint64)))
        order = np.argsort(at, kind="stable")
        at, s = at[order], s[order]
        doc = np.searchsorted(w.before, at, "right") - 1
        return doc, at - w.before[doc], s


def suspects_of(docs: DataFrame, share: object) -> DataFrame:
    """docs: (uid, id, text) -> (uid, id, m, words, h, p) of documents with a hit: word hashes, and hits by hash and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = Words(as_bytes(b.column("text")))
            doc, place, s = share.value.hits(w)
            some, first = np.unique(doc, return_index=True)
            h, ends = w.hashes(), pa.array(np.append(first, len(doc)), pa.int32())
            words = [h[w.before[d] : w.before[d + 1]].tobytes() for d in some.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("uid").take(pa.array(some)), b.column("id").take(pa.array(some)), pa.array(w.count[some]), pa.array(words, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(s.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(place, pa.int32()))], ["uid", "id", "m", "words", "h", "p"])

    return materialize(docs.mapInArrow(run, "uid long, id long, m long, words binary, h array<long>, p array<int>"), "suspects")


def _window(words: bytes, start: int, n: int, size: int) -> np.ndarray:
    return shingles(np.frombuffer(words, np.uint64)[start : start + n], min(size, n))


def placed(suspects: DataFrame, posts: DataFrame, size: int, least: float) -> DataFrame:
    """(uid, n, start, fp) of all windows of n words that can have the similarity `least` to an item of n words.

    Of a and b shingles, so similar ones share least / (1 + least) * (a + b). Every window in which as many stand in
    items of n words is given, whatever their order. A document of fewer words than an item is one window.
    """
    hits = suspects.select("uid", "m", F.explode(F.arrays_zip("h", "p")).alias("x")).select("uid", "m", "x.h", "x.p").join(posts, "h")
    one = F.least("n", F.lit(size)) - 1
    enough = F.greatest(F.ceil(F.lit(least / (1 + least)) * (F.col("n") + F.least("n", "m") - 2 * one) - 1e-9), F.lit(1))
    each = hits.groupBy("uid", "m", "n").agg(F.sort_array(F.collect_list("p")).alias("p")).withColumn("enough", enough.cast("int"))
    each = each.where(F.size("p") >= F.col("enough")).groupBy("uid").agg(F.collect_list(F.struct("n", "enough", "p")).alias("sizes"))

    def windows(words: bytes, n: int, enough: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and SimHashes of one document's windows of n words with enough hits at the places p."""
        s = shingles(np.frombuffer(words, np.uint64), min(size, n))
        m = len(words) // 8
        many = min(n, m) - min(size, n) + 1
        hit = np.zeros(len(s) + 1, np.int32)
        hit[p + 1] = 1
        before = np.cumsum(hit, dtype=np.int32)
        starts = np.flatnonzero(before[many : many + max(m - n, 0) + 1] - before[: max(m - n, 0) + 1] >= enough)
        return starts, simhashes(s, starts, many)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        size_of = [len(r[2]) for r in rows]
        columns = [np.repeat(np.array([r[0] for r in rows], np.int64), size_of), np.repeat(np.array([r[1] for r in rows], np.int32), size_of), np.concatenate([r[2] for r in rows]).astype(np.int32), np.concatenate([r[3] for r in rows]).view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["uid", "n", "start", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for i in range(b.num_rows):
                uid, words, sizes = b.column("uid")[i].as_py(), b.column("words")[i].as_py(), b.column("sizes")[i].values
                for n, need, p in zip(*sizes.flatten(), strict=True):
                    rows.append((uid, n.as_py(), *windows(words, n.as_py(), need.as_py(), p.values.to_numpy())))
                    held += len(rows[-1][2])
                    if held > HELD:
                        yield made(rows)
                        rows, held = [], 0
        if rows:
            yield made(rows)

    return suspects.select("uid", "words").join(each, "uid").mapInArrow(run, "uid long, n int, start int, fp long")


def blocks_of(fp: Column, flips: int) -> Column:
    """Array of (block, value) for every value of each block within `flips` bits of the fingerprint's."""
    edges = [64 * k // BLOCKS for k in range(BLOCKS + 1)]

    def block(k: int) -> Column:
        width = edges[k + 1] - edges[k]
        value = F.shiftrightunsigned(fp, edges[k]).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        masks = F.array(*(F.lit(sum(1 << b for b in f)) for d in range(flips + 1) for f in combinations(range(width), d)))
        return F.transform(masks, lambda m: F.struct(F.lit(k).alias("block"), value.bitwiseXOR(m).alias("value")))

    return F.flatten(F.array(*map(block, range(BLOCKS))))


def within(windows: DataFrame, items: DataFrame) -> DataFrame:
    """(n, fp, item, distance): of each size and fingerprint of windows, the items of that size within RADIUS, each once.

    Windows of one fingerprint are looked up as one, so a passage in many documents is one row of the index.
    """
    under = lambda df, flips, *keep: df.select(*keep, "n", "fp", F.explode(blocks_of(F.col("fp"), flips)).alias("b")).select(*keep, "n", "fp", "b.block", "b.value")
    known = under(items, RADIUS // BLOCKS, "item").withColumnRenamed("fp", "other")
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))).cast("long")
    near = under(windows.select("n", "fp").distinct(), 0).join(known, ["n", "block", "value"]).where(far <= RADIUS)
    return near.select("n", "fp", "item", far.alias("distance")).distinct()


def verified(suspects: DataFrame, near: DataFrame, items: DataFrame, size: int, least: float) -> DataFrame:
    """(uid, doc_id, item_id, ...): the best window, the first of equal ones, of each item that is similar enough."""
    cases = near.join(items.select("item", "item_id", "data"), "item").groupBy("uid").agg(F.collect_list(F.struct("n", "start", "item", "item_id", "distance", "data")).alias("cases"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for u, i, m, t, cases in zip(*(b.column(c).to_pylist() for c in ("uid", "id", "m", "words", "cases")), strict=True):
                best: dict[int, tuple] = {}
                for c in sorted(cases, key=lambda c: c["start"]):
                    sim = similarity(_window(t, c["start"], c["n"], size), np.frombuffer(c["data"], np.uint64))
                    if sim >= least and sim > best.get(c["item"], (0.0,))[0]:
                        best[c["item"]] = sim, c["item_id"], c["start"], min(c["n"], m), c["distance"]
                rows += [(u, i, item_id, start, n, far, sim) for sim, item_id, start, n, far in best.values()]
            names = ["uid", "doc_id", "item_id", "start_word", "n_words", "distance", "similarity"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.float64() if k == 6 else pa.int64()) for k in range(7)], names)

    return suspects.select("uid", "id", "m", "words").join(cases, "uid").mapInArrow(run, f"uid long, {FOUND}")


def _finder(benchmark: DataFrame, size: int, least: float) -> tuple[object, Callable[[DataFrame], DataFrame]]:
    """The shared bitmap, and what finds items in (uid, id, text)."""
    spark = benchmark.sparkSession
    arrow_batches(spark)
    items = items_of(benchmark, size)
    posts = postings(items)
    share = spark.sparkContext.broadcast(Known(items, posts, size))

    def find(docs: DataFrame) -> DataFrame:
        suspects = suspects_of(docs, share)
        windows = materialize(placed(suspects, posts, size, least), "windows")
        near = windows.join(within(windows, items), ["n", "fp"]).select("uid", "n", "start", "item", "distance")
        return verified(suspects, near, items, size, least)

    return share, find


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, distance, similarity): the best window of each item found in a document.

    Case and marks count as they are. Null and empty texts and items match nothing; repeated items are found each by
    its item_id, repeated documents in every row, null ids stay. Documents without a finding give no row, nor do empty
    tables. Whole texts are searched, however long: a document's word hashes are one array. Other columns of either
    table are not looked at, whatever their names.

    An item of fewer words than a shingle is one shingle of all its words and is found wherever it stands verbatim. A
    document of fewer words than an item is one window.
    """
    _, find = _finder(benchmark, size, least)
    return find(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).drop("uid")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """docs without the rows in whose text an item is found; each row is judged by itself, whatever its id.

    Rows with null or empty texts stay, repeated rows stay or go together, an empty table stays empty, and an empty
    benchmark keeps all. Columns may have any names. Items and long texts count as in contaminated.
    """
    share, find = _finder(benchmark, size, least)

    @F.arrow_udf("boolean")
    def hit(text: pa.Array) -> pa.Array:
        out, done = np.zeros(len(text), bool), 0
        for b in chunks(iter([pa.RecordBatch.from_arrays([text], ["text"])])):
            out[done + np.unique(share.value.hits(Words(as_bytes(b.column("text"))))[0])] = True
            done += b.num_rows
        return pa.array(out)

    # written with row numbers and the bitmap's word, so that only rows with a hit are shuffled with their text
    rows = materialize(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("uid"), hit(F.col(text_col)).alias("hit")), "rows")
    bad = find(rows.where("hit").select("uid", F.lit(None).cast("long").alias("id"), F.col("row")[text_col].alias("text"))).select("uid").distinct()
    return rows.where("not hit").select("row.*").unionAll(rows.where("hit").join(bad, "uid", "left_anti").select("row.*"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
