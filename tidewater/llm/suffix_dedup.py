"""Byte-level deduplication that keeps the first copy, by longest previous factors.

The corpus in order of doc_id is one text. A byte goes if a previous factor of `length` bytes or more covers it: the
longest factor that starts at some place and also at an earlier one. The longest previous factor of a suffix is the
larger of its common prefixes with the previous and the next suffix, in suffix order, that stand at smaller positions.
Only suffixes that agree on `length` bytes matter, and these share the anchor of their first window (the least hash of
its runs of SEED_BYTES bytes), so the suffix array is built class by class of equal anchors.

Parts of the corpus ask hash buckets which anchors stand at two places, and which blocks (the text of all windows
around one anchor) stand earlier as a whole. Where different blocks share an anchor, the first copy of each is sent to
the anchor's bucket, which builds the class's suffix array, the common prefixes of neighbours and, with a stack of
smaller positions, the array of longest previous factors. An anchor with more than MOST_BLOCKS different blocks would
be a hot task; its windows are dealt by their own hashes instead, where equal ones, and so the earliest, meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.ask import ANSWERED, ELSEWHERE, KEY, answer, answered, answers, ask, buckets_of, in_rounds, part_count
from tidewater.llm.base import BYTE_VALUES, arrow_batches, as_bytes, numbered, read
from tidewater.llm.repeats import Hashes, Windows

LENGTH_BYTES, SEED_BYTES = 100, 32
#: Text bytes whose windows are derived at once (some 100 bytes of arrays each); longer documents are cut into pieces.
CHUNK = 1 << 19
#: Different blocks of an anchor that one task compares; suffixes that are sorted at once.
MOST_BLOCKS, SLAB = 1024, 1 << 18
#: A key with the document (by order of doc_id, null first) and row of its first place in a part.
PLACED = np.dtype([("by", "<u8"), ("own", "<u8"), ("doc", "<u8"), ("row", "<u8")])
#: What precedes the texts of the blocks that are sent to a bucket.
BLOCK = np.dtype([("by", "<u8"), ("doc", "<u8"), ("row", "<u8"), ("size", "<u4")])
EARLIER, VARIED, CROWDED = 1, 2, 4
SEEDS, BLOCKS, SUFFIXES, WINDOWS = 1, 2, 3, 4
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def longest_previous_factors(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """By position: the longest common prefix with a suffix at a smaller position.

    order lists the positions 0 .. n - 1 in suffix order, common the common prefix of each with the one before it. The
    stack holds positions that rise; whatever a smaller one removes has found both its previous and its next smaller.
    """
    out = np.zeros(len(order), np.int64)
    stack: list[tuple[int, int]] = []
    for p, c in zip([*order.tolist(), -1], [*common.tolist(), 0], strict=True):
        while stack and stack[-1][0] > p:
            q, before = stack.pop()
            out[q] = max(before, c)
            c = min(before, c)
        stack.append((p, c))
    return out


def suffix_order(text: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, by group, of the suffixes at `starts` to a depth of `length` bytes, and the neighbours' common prefixes.

    Suffixes that agree so far stand in the order of their positions.
    """
    keys = np.empty((len(starts), 4 + length), np.uint8)
    keys[:, :4] = group.astype(">u4").view(np.uint8).reshape(-1, 4)
    keys[:, 4:] = np.lib.stride_tricks.sliding_window_view(text, length)[starts]
    order = np.argsort(keys.view(f"S{4 + length}").ravel(), kind="stable")
    keys = keys[order]
    differ = keys[1:] != keys[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1) - 4, length)
    return order, np.concatenate([[0], np.maximum(common, 0)])


class Part:
    """One part's documents in order of doc_id (null first, then as they were read), in pieces of bounded size."""

    def __init__(self, table: pa.Table, length: int):
        self.table = table.sort_by([("rank", "ascending"), ("doc_id", "ascending"), ("_uid", "ascending")])
        self.number = table.column("part")[0].as_py() if table.num_rows else 0
        self.length = length
        self.texts = as_bytes(self.table.column("text").combine_chunks()) if table.num_rows else []
        rank, uid = (self.table.column(c).to_numpy().astype(np.uint64) for c in ("rank", "_uid"))
        ids = self.table.column("doc_id").fill_null(0).to_numpy().astype(np.int64)
        self.doc = np.where(rank > 0, ids.view(np.uint64) ^ np.uint64(1 << 63), np.uint64(0))
        self.row = uid | rank << np.uint64(63)
        #: of each chunk: rows and byte offsets of its pieces, where they start in its buffer, and its runs of windows
        self.read = []
        for rows, offsets, parts in self._pieces():
            buf, at = self._joined(parts)
            self.read.append((rows, offsets, at, Windows(BYTE_VALUES[0][buf], at, length, min(SEED_BYTES, length))))

    def _pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """Chunks of pieces of documents. Each window starts in one piece, which holds it whole."""
        rows, offsets, parts, held = [], [], [], 0
        for r, t in enumerate(self.texts):
            for a in range(0, max(len(t) - self.length + 1, 1), CHUNK):
                piece = t[a : a + CHUNK + self.length - 1] if len(t) > CHUNK else t
                if held and held + len(piece) > CHUNK:
                    yield np.array(rows), np.array(offsets), parts
                    rows, offsets, parts, held = [], [], [], 0
                rows.append(r)
                offsets.append(a)
                parts.append(piece)
                held += len(piece)
        if rows:
            yield np.array(rows), np.array(offsets), parts

    def _joined(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in parts])]).astype(np.int64)

    def buffers(self) -> Iterator[np.ndarray]:
        """The chunks' bytes, again."""
        for *_, parts in self._pieces():
            yield self._joined(parts)[0]

    def places(self, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Document and row of each of the chunks' starts."""
        rows = np.concatenate([np.zeros(0, np.int64), *(r[np.searchsorted(at, s, "right") - 1] for (r, _, at, _), s in zip(self.read, found, strict=True))])
        return self.doc[rows], self.row[rows]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct anchors, at how many places each stands, and whether one run of windows holds several."""
        none = np.zeros(0, np.uint64)
        h, n = np.unique(np.concatenate([none, *(w.anchors for *_, w in self.read)]), return_counts=True)
        r, m = np.unique(np.concatenate([none, *(w.run_anchor for *_, w in self.read)]), return_counts=True)
        return h, n, n > m[np.searchsorted(r, h)] if len(h) else np.zeros(0, bool)

    def blocks(self, known: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The runs with a repeated anchor of each chunk; of all runs the keys and whether the anchor stands twice in one run."""
        h, n, inner = self.anchors()
        keep = (n > 1) | (answers(known, SEEDS) & ELSEWHERE > 0)
        h, inner = h[keep], inner[keep]
        runs, keys, twice = [], [np.zeros(0, PLACED)], [np.zeros(0, bool)]
        for (*_, win), buf in zip(self.read, self.buffers(), strict=True):
            at = np.minimum(np.searchsorted(h, win.run_anchor), max(len(h) - 1, 0))
            runs.append(np.flatnonzero(h[at] == win.run_anchor) if len(h) else np.zeros(0, np.int64))
            if len(runs[-1]):
                start = win.run_start[runs[-1]]
                one, two = Hashes(BYTE_VALUES[0][buf], BYTE_VALUES[1][buf]).of(start, start + win.run_size[runs[-1]] - 1 + self.length)
                k = np.zeros(len(start), PLACED)
                k["by"], k["own"] = win.run_anchor[runs[-1]], one * np.uint64(31) + two
                keys.append(k)
                twice.append(inner[at[runs[-1]]])
        keys = np.concatenate(keys)
        keys["doc"], keys["row"] = self.places([w.run_start[r] for (*_, w), r in zip(self.read, runs, strict=True)])
        return runs, keys, np.concatenate(twice)

    def sorted_out(self, known: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Of each chunk: runs that stand earlier as a whole, runs to compare in their anchor's class, and window by window."""
        runs, keys, inner = self.blocks(known)
        _, at, first = distinct(keys)
        flags = answers(known, BLOCKS)[at]
        again = ~first | (flags & EARLIER > 0)
        open_ = ~again & ((flags & VARIED > 0) | inner)
        crowded = open_ & (flags & CROWDED > 0)
        cuts = np.cumsum([len(r) for r in runs])[:-1]
        part = lambda mask: [r[m] for r, m in zip(runs, np.split(mask, cuts), strict=True)] if runs else []
        return part(again), part(open_ & ~crowded), part(crowded)

    def class_runs(self, classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(chunk, start, windows, anchor) of the runs that are compared in their anchor's class."""
        chunk = np.repeat(np.arange(len(classes)), [len(r) for r in classes])
        pick = lambda get, kind: np.concatenate([np.zeros(0, kind), *(get(w)[r] for (*_, w), r in zip(self.read, classes, strict=True))])
        return chunk, pick(lambda w: w.run_start, np.int64), pick(lambda w: w.run_size, np.int64), pick(lambda w: w.run_anchor, np.uint64)

    def windows(self, crowded: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Of each chunk the starts of the windows that are compared singly, and the keys of all."""
        starts = [w.windows(r) for (*_, w), r in zip(self.read, crowded, strict=True)]
        keys = np.zeros(sum(map(len, starts)), PLACED)
        if len(keys):
            hashes = [Hashes(BYTE_VALUES[0][buf], BYTE_VALUES[1][buf]).of(s, s + self.length) for s, buf in zip(starts, self.buffers(), strict=True)]
            keys["by"], keys["own"] = (np.concatenate([h[k] for h in hashes]) for k in (0, 1))
            keys["doc"], keys["row"] = self.places(starts)
        return starts, keys


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, each at its first place, where each key is among them, and whether no smaller place has it."""
    order = np.lexsort((keys["own"], keys["by"]))
    s = keys[order]
    head = np.concatenate([[True], (s["by"][1:] != s["by"][:-1]) | (s["own"][1:] != s["own"][:-1])]) if len(s) else np.zeros(0, bool)
    at, first = np.empty(len(s), np.int64), np.empty(len(s), bool)
    at[order], first[order] = np.cumsum(head) - 1, head
    return s[head], at, first


def earliest(table: pa.Table) -> pa.Table:
    """A byte per key: EARLIER if another part has it at a smaller place, VARIED and CROWDED by how many share its `by`."""
    data = [np.frombuffer(x, PLACED) for x in table.column("data").to_pylist()]
    keys = np.concatenate(data)
    order = np.lexsort((keys["row"], keys["doc"], keys["own"], keys["by"]))
    s = keys[order]
    same = np.concatenate([[False], (s["by"][1:] == s["by"][:-1]) & (s["own"][1:] == s["own"][:-1])])
    start = np.flatnonzero(np.concatenate([[True], s["by"][1:] != s["by"][:-1]]))
    kinds = np.add.reduceat((~same).astype(np.int64), start)
    kind = (kinds > 1).astype(np.uint8) * VARIED | (kinds > MOST_BLOCKS).astype(np.uint8) * CROWDED
    return answered(table, data, order, np.repeat(kind, np.diff(np.append(start, len(s)))) | same.astype(np.uint8) * EARLIER)


def classed(table: pa.Table, length: int) -> pa.Table:
    """A byte per window of the blocks sent: 1 if its longest previous factor has `length` bytes."""
    heads, bodies = [], []
    for x in table.column("data").to_pylist():
        n = int.from_bytes(x[:4], "little")
        heads.append(np.frombuffer(x, BLOCK, n, 4))
        bodies.append(x[4 + n * BLOCK.itemsize :])
    head = np.concatenate(heads)
    text = np.frombuffer(b"".join(bodies), np.uint8)
    size = head["size"].astype(np.int64)
    begin = np.cumsum(size + length - 1) - (size + length - 1)
    window = np.cumsum(size) - size
    # classes of equal anchors one after another, the blocks of each by position
    order = np.lexsort((head["row"], head["doc"], head["by"]))
    total = np.cumsum(size[order])
    new = np.concatenate([[True], head["by"][order][1:] != head["by"][order][:-1]])
    flags, done = np.zeros(int(size.sum()), np.uint8), 0
    ends = np.append(np.flatnonzero(new)[1:], len(order))
    while done < len(order):
        least = total[done] - size[order[done]] + SLAB
        stop = int(max(ends[np.searchsorted(ends, done, "right")], ends[max(np.searchsorted(total[ends - 1], least, "right") - 1, 0)]))
        some = order[done:stop]
        many = size[some]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at, common = suffix_order(text, np.repeat(begin[some], many) + step, np.repeat(np.cumsum(new[done:stop]), many), length)
        flags[np.repeat(window[some], many) + step] = longest_previous_factors(at, common) >= length
        done = stop
    cut = np.cumsum([int(h["size"].sum()) for h in heads])[:-1]
    return pa.table({"part": table.column("part"), "round": table.column("round"), "bucket": table.column("bucket"), "data": pa.array([x.tobytes() for x in np.split(flags, cut)], pa.binary())})


def remove_later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH_BYTES, texts: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes.

    The order of documents is that of doc_id, null first; rows that share a doc_id, as repeated rows do, follow in the
    order in which they are read. Matches never cross documents, overlapping ones count. Null and empty texts have no
    bytes; an empty table gives no rows. Long texts are taken whole, in pieces that overlap by a window; a part holds
    its documents' bytes. Other columns are not looked at, whatever their names. Rows are dealt to parts by hash, so
    neither null nor repeated ids nor long documents that stand together make a hot part.
    """
    arrow_batches(docs.sparkSession)
    parts = part_count(docs, text_col)
    base = numbered(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = base.select(F.pmod(F.xxhash64("_uid"), F.lit(parts)).cast("int").alias("part"), F.col("doc_id").isNotNull().cast("int").alias("rank"), "doc_id", "_uid", "text")

    def seeds(table: pa.Table, known: pa.Table) -> pa.Table:
        p = Part(table, length)
        h, *_ = p.anchors()
        keys = np.zeros(len(h), KEY)
        keys["by"] = h
        return ask(p.number, SEEDS, keys, parts)

    def blocks(table: pa.Table, known: pa.Table) -> pa.Table:
        p = Part(table, length)
        return ask(p.number, BLOCKS, distinct(p.blocks(known)[1])[0], parts)

    def suffixes(table: pa.Table, known: pa.Table) -> pa.Table:
        p = Part(table, length)
        _, classes, crowded = p.sorted_out(known)
        chunk, start, size, anchor = p.class_runs(classes)
        doc, row = p.places([start[chunk == c] for c in range(len(p.read))])
        bufs = list(p.buffers()) if len(start) else []
        bucket, out = buckets_of(anchor, parts), []
        order = np.argsort(bucket, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
            head = np.zeros(len(some), BLOCK)
            head["by"], head["doc"], head["row"], head["size"] = anchor[some], doc[some], row[some], size[some]
            body = [bufs[c][a : a + z + length - 1].tobytes() for c, a, z in zip(chunk[some].tolist(), start[some].tolist(), size[some].tolist(), strict=True)]
            out.append((int(bucket[some[0]]), b"".join([len(some).to_bytes(4, "little"), head.tobytes(), *body])))
        sent = pa.table({"part": pa.array([p.number] * len(out), pa.int32()), "bucket": pa.array([o[0] for o in out], pa.int32()), "round": pa.array([SUFFIXES] * len(out), pa.int32()), "data": pa.array([o[1] for o in out], pa.binary())})
        return pa.concat_tables([sent, ask(p.number, WINDOWS, distinct(p.windows(crowded)[1])[0], parts)])

    def compare(table: pa.Table) -> pa.Table:
        return classed(table, length) if table.column("round")[0].as_py() == SUFFIXES else earliest(table)

    def cut(table: pa.Table, known: pa.Table) -> pa.Table:
        p = Part(table, length)
        again, classes, crowded = p.sorted_out(known)
        chunk, start, size, anchor = p.class_runs(classes)
        # flags of windows come by bucket; each block's are found where it stands in that order
        order = np.argsort(buckets_of(anchor, parts), kind="stable")
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(size[order]) - size[order]
        flags = answers(known, SUFFIXES)
        singles, keys = p.windows(crowded)
        _, key_at, first = distinct(keys)
        later = ~first | (answers(known, WINDOWS)[key_at] & EARLIER > 0)
        single_cut = np.split(later, np.cumsum([len(s) for s in singles])[:-1]) if singles else []
        doc_at = np.concatenate([[0], np.cumsum([len(t) for t in p.texts])]).astype(np.int64)
        drop = np.zeros(int(doc_at[-1]), bool)
        for c, (rows, offsets, piece_at, win) in enumerate(p.read):
            mine = np.flatnonzero(chunk == c)
            step = np.arange(size[mine].sum()) - np.repeat(np.cumsum(size[mine]) - size[mine], size[mine])
            hit = flags[np.repeat(at[mine], size[mine]) + step] > 0
            gone = win.covered(np.concatenate([win.windows(again[c]), (np.repeat(start[mine], size[mine]) + step)[hit], singles[c][single_cut[c]]]))
            for r, o, a, z in zip(rows.tolist(), offsets.tolist(), piece_at[:-1].tolist(), piece_at[1:].tolist(), strict=True):
                drop[doc_at[r] + o : doc_at[r] + o + z - a] |= gone[a:z]
        heads = drop.copy()
        heads[1:] &= ~drop[:-1]
        inner = doc_at[:-1][(doc_at[:-1] < len(drop)) & (np.diff(doc_at) > 0)]
        heads[inner] = drop[inner]
        count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[doc_at])
        kept = [np.frombuffer(t, np.uint8)[~drop[a : a + len(t)]].tobytes() for t, a in zip(p.texts, doc_at[:-1].tolist(), strict=True)]
        columns = [p.table.column("doc_id"), pa.array(np.diff(doc_at)), pa.array(count(drop)), pa.array(count(heads)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k if texts else None for k in kept], pa.binary())]
        return pa.table(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    by_bucket = lambda run: lambda asked: asked.groupBy("round", "bucket").applyInArrow(run, ANSWERED)
    return in_rounds(base, [(seeds, answer), (blocks, by_bucket(earliest)), (suffixes, by_bucket(compare))], cut, RESULT)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_later_copies(read(spark, sf_dir, "documents"), texts=False).drop("kept")
