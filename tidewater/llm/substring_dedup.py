"""Substring deduplication by seed and extend: every word inside a passage that also stands elsewhere is removed.

Seeds are winnowed anchors: in each window of `length` words the run of SEED_WORDS words with the least hash. Parts of
the corpus ask hash buckets which anchors stand at two places (the join on seeds). Around such an anchor all windows that
hold it are compared, and each repeated one learns where its words stand first of all. A match with the words there is
extended both ways, window by window, as long as both run along; what can't be extended further is a maximal match, and
all words in matches are cut out. No pair of documents is formed, so a passage in a million documents costs each of its
copies the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.ask import ELSEWHERE, FIRST, KEY, PLACED, answer, answers, ask, firsts, in_rounds, part_count
from tidewater.llm.base import Words, arrow_batches, as_bytes, chunks, numbered, read
from tidewater.llm.repeats import Hashes, Windows

WINDOW_WORDS, SEED_WORDS = 35, 8
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_repeats long, kept string"


Chunk = tuple[pa.RecordBatch, Words, np.ndarray, Windows]


def _chunks(table: pa.Table, length: int) -> list[Chunk]:
    """A part's chunks, each with its words, their hashes and its windows."""
    out = []
    for b in chunks(iter(table.to_batches())):
        w = Words(as_bytes(b.column("text")))
        h = w.hashes()
        out.append((b, w, h, Windows(h, w.before, length, min(SEED_WORDS, length))))
    return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, each with its first place; where each given key is among them, how often each occurs."""
    order = np.lexsort((keys["pos"], keys["doc"], keys["own"], keys["by"]))
    s = keys[order]
    new = np.concatenate([[True], (s["by"][1:] != s["by"][:-1]) | (s["own"][1:] != s["own"][:-1])]) if len(s) else np.zeros(0, bool)
    at = np.empty(len(s), np.int64)
    at[order] = np.cumsum(new) - 1
    return s[new], at, np.bincount(at, minlength=int(new.sum()))


def _keys(by: np.ndarray, own: np.ndarray) -> np.ndarray:
    out = np.empty(len(by), KEY)
    out["by"], out["own"] = by, own
    return out


def _anchors(found: list[Chunk]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct anchor hashes of a part, and how often each occurs."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(w.anchors for *_, w in found)]), return_counts=True)


def _ids(b: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(b.column("doc_id"), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def _heads(starts: np.ndarray, keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which of the repeated windows begin a match: the one before isn't repeated, or stands first elsewhere than just before."""
    on = np.zeros(len(starts), bool)
    same = (starts[1:] == starts[:-1] + 1) & (keys["pos"][1:] == keys["pos"][:-1] + 1)
    on[1:] = same & (first["doc"][1:] == first["doc"][:-1]) & (first["pos"][1:] == first["pos"][:-1] + 1)
    return ~on


def _candidates(found: list[Chunk], known: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each chunk: the starts of the windows with a repeated anchor, and their keys."""
    h, n = _anchors(found)
    repeated = h[(n > 1) | (answers(known, 1) & ELSEWHERE > 0)]
    for b, w, words, win in found:
        at = np.minimum(np.searchsorted(repeated, win.run_anchor), max(len(repeated) - 1, 0))
        runs = np.flatnonzero(repeated[at] == win.run_anchor) if len(repeated) else np.zeros(0, np.int64)
        starts = win.windows(runs)
        # words by two hashes each, long ones by two digests
        by, own = Hashes(words, w.hashes(1) if len(starts) else words).of(starts, starts + win.length)
        keys, doc = np.empty(len(by), PLACED), np.searchsorted(w.before, starts, "right") - 1
        keys["by"], keys["own"], keys["doc"], keys["pos"] = by, own, _ids(b)[doc], starts - w.before[doc]
        yield starts, keys


def _kept(w: Words, drop: np.ndarray) -> list[bytes]:
    """Each document's words that are not dropped, joined by one space."""
    keep = np.zeros(len(w.buf) + 1, np.int8)
    keep[w.start[~drop]] = 1
    keep[w.end[~drop]] = -1
    mask = np.cumsum(keep[:-1], dtype=np.int8).view(bool)
    ends = w.end[~drop]
    mask[ends] = True
    out = w.buf.copy()
    out[ends] = 32
    at = np.concatenate([[0], np.cumsum(mask)])[w.doc_at]
    flat = out[mask].tobytes()
    return [flat[a : max(b - 1, a)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = WINDOW_WORDS, texts: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, n_repeats and, if asked for, the kept text.

    A window repeats if its words start anywhere else, in the same document or another, rows that repeat a document
    included; overlapping occurrences count. n_repeats counts the maximal matches: the longest passages whose words run
    along with those of the first place, by doc_id (null first) and position, at which their windows stand; at the first
    place itself, the longest passages that are repeated. Null and empty texts and those of fewer words than a window keep what they have; a null doc_id keeps
    its row; an empty table gives no rows. Long texts are taken whole: a document's words are one chunk. Other columns
    are not looked at, whatever their names.
    """
    arrow_batches(docs.sparkSession)
    parts = part_count(docs, text_col)
    base = numbered(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = base.select(F.pmod(F.xxhash64("_uid"), F.lit(parts)).cast("int").alias("part"), "doc_id", "text")

    def seeds(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            return ask(0, 1, np.zeros(0, KEY), parts)
        h, _ = _anchors(_chunks(table, length))
        return ask(table.column("part")[0].as_py(), 1, _keys(h, np.zeros_like(h)), parts)

    def extend(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            return ask(0, 2, np.zeros(0, PLACED), parts)
        keys = [k for _, k in _candidates(_chunks(table, length), known)]
        return ask(table.column("part")[0].as_py(), 2, _distinct(np.concatenate(keys))[0], parts)

    def cut(table: pa.Table, known: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if table.num_rows:
            whole = _chunks(table, length)
            found = list(_candidates(whole, known))
            _, at, n = _distinct(np.concatenate([k for _, k in found]))
            first = answers(known, 2, FIRST)
            twice, first = ((n > 1) | (first["flag"] & ELSEWHERE > 0))[at], first[at]
            done = 0
            for (b, w, _, win), (starts, keys) in zip(whole, found, strict=True):
                mine = np.flatnonzero(twice[done : done + len(keys)])
                drop, begins = win.covered(starts[mine]), np.zeros(len(w.start), bool)
                begins[starts[mine][_heads(starts[mine], keys[mine], first[done + mine])]] = True
                done += len(keys)
                count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[w.before])  # noqa: B023, E731
                kept = _kept(w, drop)
                out += zip(b.column("doc_id").to_pylist(), w.count.tolist(), count(drop).tolist(), (hashlib.sha256(k).hexdigest() for k in kept), count(begins).tolist(), (k.decode() if texts else None for k in kept), strict=True)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "n_repeats", "kept"])

    return in_rounds(base, [(seeds, answer), (extend, firsts)], cut, RESULT)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), texts=False).drop("kept")
