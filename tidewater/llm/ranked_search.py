"""Ranked lexical search by the Best Position Algorithm over impact-ordered lists.

Every text is read once, for its length and the terms that some query has. Parts of the documents meet blocks of queries;
a part goes through its documents segment by segment. In a segment each term has a list of its documents by falling
impact. A query reads its lists from their best positions on, the ends of what has been seen without a gap; each document
it meets is looked up at once in all other lists, which gives its score and marks its places there as seen, so that best
positions run ahead of what has been read. No document still unseen can score more than the impacts at the best
positions together. The query is through with a segment once that sum is strictly below its 20th best score, which it
takes along from segment to segment.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.against import meet, sides
from tidewater.llm.base import arrow_batches, as_bytes, materialize, read

BEST = 20
#: In bytes of UTF-8, a term is a run of these once A to Z are in lower case.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Queries of a block, and terms of its queries, repeats included, about; cells (documents times terms) of a segment's table
#: of positions, and its documents at most.
BLOCK, TERMS, CELLS, SEGMENT = 1024, 1 << 18, 1 << 24, 8192
#: Entries that a query reads from a list at once, at first and at most.
FIRST_READ, MOST_READ = 8, 256
#: The bitmap of the queries' terms has 64 bits for each between these powers of two; what it lets through in vain, the block drops.
LEAST_BITS, MOST_BITS = 19, 27
COUNTED = "_uid long, id long, n long, terms array<string>, tf array<long>"
FOUND = "item long, item_id long, doc long, doc_id long, score long"


def term_counts(text: bytes) -> Counter:
    return Counter(TERM.findall(text.lower()))


def _lists(rows: list[list], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    flat = pa.array([x for r in rows for x in r], pa.binary() if kind == pa.string() else kind)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.cast(kind))


def counted(table: DataFrame, known: object = None) -> DataFrame:
    """(_uid, id, text) -> COUNTED: terms of each text, all of them or those that may be in the bitmap `known`, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, shift = known.value if known else (None, 0)
        for b in batches:
            n, terms, tf = [], [], []
            for text in as_bytes(b.column("text")):
                counts = term_counts(text)
                n.append(sum(counts.values()))
                if bits is not None:
                    counts = {t: c for t, c in counts.items() if bits[(at := zlib.crc32(t) >> shift) >> 3] >> (at & 7) & 1}
                terms.append(list(counts))
                tf.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([b.column("_uid"), b.column("id"), pa.array(n, pa.int64()), _lists(terms, pa.string()), _lists(tf, pa.int64())], ["_uid", "id", "n", "terms", "tf"])

    return table.mapInArrow(run, COUNTED)


def bitmap(vocabulary: DataFrame) -> tuple[bytes, int]:
    """Bits of the terms' checksums, and by how much a checksum is shifted; at most 2 ** MOST_BITS bits whatever there is."""
    bits = min(max(LEAST_BITS, int(64 * vocabulary.count()).bit_length()), MOST_BITS)
    shift = 32 - bits
    out = np.zeros(1 << bits - 3, np.uint8)
    at = F.shiftright(F.crc32(F.col("term").cast("binary")), shift)
    for r in vocabulary.select(at.alias("at")).groupBy(F.expr("at >> 3").alias("byte")).agg(F.expr("bit_or(1 << cast(at & 7 as int))")).toLocalIterator():
        out[r[0]] = r[1]
    return out.tobytes(), shift


class Segment:
    """Impact-ordered lists of some documents over a block's terms, and where each document stands in them."""

    def __init__(self, docs: pa.Table, vocabulary: pa.Array, weight: np.ndarray):
        terms = docs.column("terms").combine_chunks()
        size = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(size)), size)
        term = pc.fill_null(pc.index_in(terms.flatten(), vocabulary), -1).to_numpy(zero_copy_only=False)
        tf = docs.column("tf").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        doc, term, tf = (x[term >= 0] for x in (doc, term, tf))
        m = docs.column("m").to_numpy()[doc]
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact, term = doc[order], impact[order], term[order]
        self.length = np.bincount(term, minlength=len(vocabulary))
        self.offset = np.cumsum(self.length) - self.length
        #: position of a document in a term's list, -1 where it isn't in it
        self.place = np.full((len(size), len(vocabulary)), -1, np.int32)
        self.place[self.doc, term] = np.arange(len(term)) - self.offset[term]
        ids = docs.column("id")
        self.uid, self.null = docs.column("_uid").to_numpy(), ids.is_null().to_numpy()
        self.id = pc.fill_null(ids, 0).to_numpy()


class Top:
    """The best documents so far of a query: rows of (score, null id, id, number), best first."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.zeros((0, 4), np.int64)

    @property
    def least(self) -> int:
        """The score that a document has to reach."""
        return int(self.rows[-1, 0]) if len(self.rows) == self.k else 1

    def offer(self, segment: Segment, docs: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.least
        if not good.any():
            return
        docs = docs[good]
        rows = np.concatenate([self.rows, np.stack([score[good], segment.null[docs], segment.id[docs], segment.uid[docs]], axis=1)])
        self.rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.k]]


def best_positions(segment: Segment, terms: np.ndarray, counts: np.ndarray, top: Top) -> int:
    """Offers the segment's documents to a query's best ones until no unseen one can be among them; entries read."""
    some = segment.length[terms] > 0
    terms, counts = terms[some], counts[some]
    offset, length = segment.offset[terms], segment.length[terms]
    start = np.cumsum(length) - length
    seen, met = np.zeros(int(length.sum()), bool), np.zeros(len(segment.uid), bool)
    best, step, read_entries = np.zeros(len(terms), np.int64), FIRST_READ, 0
    while True:
        # impacts at the best positions (at first those at the top); a list seen to its end has nothing left
        left = best < length
        limit = int((counts * np.where(left, segment.impact[offset + np.maximum(best - 1, 0)], 0)).sum())
        if not left.any() or limit < top.least:
            return read_entries
        at = best[:, None] + np.arange(step)
        entries = (offset[:, None] + at)[at < length[:, None]]
        read_entries += len(entries)
        docs = segment.doc[entries]
        docs = np.unique(docs[~met[docs]])
        met[docs] = True
        place = segment.place[docs[:, None], terms]
        held = place >= 0
        top.offer(segment, docs, np.where(held, segment.impact[offset + np.maximum(place, 0)] * counts, 0).sum(axis=1))
        seen[(start + place)[held]] = True
        gaps = np.append(np.flatnonzero(~seen), len(seen))
        best = np.minimum(gaps[np.searchsorted(gaps, start + best)] - start, length)
        step = min(2 * step, MOST_READ)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the size of segments follows from the block's terms, so rows come in small tables
        tables = sides(batches, 64)
        asked = next(tables, None)
        if asked is None:
            return
        terms = asked.column("terms").combine_chunks()
        vocabulary = pc.unique(terms.flatten())
        weight = np.zeros(len(vocabulary), np.int64)
        at = pc.index_in(terms.flatten(), vocabulary).to_numpy(zero_copy_only=False)
        weight[at] = asked.column("w").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))[:-1]
        own, counts = np.split(at, ends), np.split(asked.column("tf").combine_chunks().flatten().to_numpy(zero_copy_only=False), ends)
        tops = [Top(k) for _ in own]
        docs, most = [], max(1, min(SEGMENT, CELLS // max(len(vocabulary), 1)))

        def through() -> None:
            segment = Segment(pa.concat_tables(docs), vocabulary, weight)
            for t, c, top in zip(own, counts, tops, strict=True):
                best_positions(segment, t, c, top)
            docs.clear()

        for table in tables:
            for at in range(0, len(table), most):
                docs.append(table.slice(at, most))
                if sum(map(len, docs)) >= most:
                    through()
        if docs:
            through()
        many = [len(t.rows) for t in tops]
        rows = np.concatenate([t.rows for t in tops])
        query = np.repeat(np.arange(len(tops)), many)
        yield pa.RecordBatch.from_arrays([asked.column("_uid").combine_chunks().take(pa.array(query)), asked.column("id").combine_chunks().take(pa.array(query)), pa.array(rows[:, 3]), pa.array(rows[:, 2], mask=rows[:, 1] > 0), pa.array(rows[:, 0])], ["item", "item_id", "doc", "doc_id", "score"])

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score, item): the k best documents of each item, rank from 1, equal scores by doc_id.

    Null and empty texts have no terms; documents that share none with an item are not ranked for it, and items without a
    document give no row. Null ids come last among equals, then rows as read. Repeated rows are documents, or items, of
    their own; `item` is the item's row number. Other columns count for nothing, empty tables give none. Both tables have
    to be files or settled tables.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    source = lambda t, i: t.select(F.monotonically_increasing_id().alias("_uid"), F.col(i).cast("long").alias("id"), "text")
    asked = materialize(counted(source(items, "item_id")).select("_uid", "id", F.explode(F.arrays_zip("terms", "tf")).alias("t")).select("_uid", "id", F.col("t.terms").alias("term"), F.col("t.tf").alias("tf")), "asked")
    known = spark.sparkContext.broadcast(bitmap(asked.select("term").distinct()))
    posts = materialize(counted(source(docs, "doc_id"), known).where("n > 0"), "posts")
    n, total = posts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # document frequencies, summed up before they are shuffled; the join drops terms that only the bitmap let through
    df = posts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = asked.select("term").distinct().join(df, "term").select("term", weight.alias("w"))
    queries = asked.join(weights, "term").groupBy("_uid", "id").agg(F.collect_list(F.struct("term", "tf", "w")).alias("t"))
    queries = materialize(queries.select("_uid", "id", F.col("t.term").alias("terms"), F.col("t.tf").alias("tf"), F.col("t.w").alias("w")), "queries")
    rows = posts.where(F.size("terms") > 0).select("_uid", "id", "terms", "tf", F.expr(f"75L + (25L * n * {n}L) div {max(total, 1)}L").alias("m"))
    many, terms = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-many // BLOCK), -(-terms // TERMS))
    found = meet(queries, rows, n, blocks, _search(k), FOUND)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "doc")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score", "item")


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("item")
