"""Token counts of a unigram vocabulary: Viterbi that carries only the best score and the pieces of its path.

Aho-Corasick lists the vocabulary's pieces that end at each character; the best way there is the best of their starts'
scores plus their own. Ties go as in the public unigram tokenizers: starts are visited from left to right and only a
strictly better score replaces what a character has, so of equal ways the one whose last piece starts first stays. A
character without a piece of its own may be unknown at the least score of the vocabulary less 10, and counts as its
UTF-8 bytes. Scores are added in double precision.

No piece crosses from another character into a space, nor holds a line feed, so a text's best path is that of its
words one after another: each distinct word is counted once per task, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.base import arrow_batches, as_bytes, chunks, hashes_of, read

SPACE_MARK, UNKNOWN_PENALTY = "▁", 10.0
#: A public vocabulary with scores; read by the driver only.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct words whose counts a task keeps; it starts anew when they are more.
KEPT_WORDS = 1 << 18


class Unigram:
    """A unigram vocabulary: pieces with their scores, spaces written as SPACE_MARK."""

    def __init__(self, pieces: dict[str, float], dummy_prefix: bool = True, byte_fallback: bool = True):
        self.pieces, self.dummy_prefix, self.byte_fallback = pieces, dummy_prefix, byte_fallback
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        #: whether texts fall into words at spaces, and at line feeds
        self.by_words = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self.by_lines = not any("\n" in p for p in pieces)
        self._machine, self._counts = None, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None, "_counts": {}}

    @classmethod
    def from_model(cls, path: str) -> Unigram:
        """The ordinary pieces of a SentencePiece model file with their scores."""
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i) or m.is_unused(i))]
        return cls({m.id_to_piece(i): m.get_score(i) for i in ids})

    def count(self, word: str) -> int:
        """Pieces of the best path of one word (or whole text) whose spaces are marked."""
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for p, s in self.pieces.items():
                self._machine.add_word(p, (len(p), s))
            self._machine.make_automaton()
        n = len(word)
        ways: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, way in self._machine.iter(word):
            ways[end].append(way)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for end, char in enumerate(word):
            top, pieces, single = None, 0, False
            for size, score in sorted(ways[end], reverse=True):
                single |= size == 1
                s = best[end + 1 - size] + score
                if top is None or s > top:
                    top, pieces = s, count[end + 1 - size] + 1
            # the unknown character starts last, so it has to be strictly better
            if not single and (top is None or best[end] + self.unknown > top):
                top, pieces = best[end] + self.unknown, count[end] + (len(char.encode()) if self.byte_fallback else 1)
            best[end + 1], count[end + 1] = top, pieces
        return count[n]

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text; an empty text has none."""
        texts = [b" " + t if t and self.dummy_prefix else t for t in texts]
        buf = np.frombuffer(b"".join(texts), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not len(buf):
            return np.zeros(len(texts), np.int64)
        first = np.zeros(len(buf), bool)
        first[at[:-1][at[:-1] < len(buf)]] = True
        if self.by_words:
            first[1:] |= (buf[1:] == 32) & (buf[:-1] != 32)
        if self.by_lines:
            first |= buf == 10
            first[1:] |= buf[:-1] == 10
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(buf))
        keys, where, back = np.unique(hashes_of(buf, start, end), return_index=True, return_inverse=True)
        known = self._counts
        if len(known) > KEPT_WORDS:
            known.clear()
        out = np.empty(len(keys), np.int64)
        for i, (a, b) in enumerate(zip(start[where].tolist(), end[where].tolist(), strict=True)):
            word = buf[a:b].tobytes()
            n = known.get(word)
            if n is None:
                n = known[word] = self.count(word.decode().replace(" ", SPACE_MARK))
            out[i] = n
        total = np.concatenate([[0], np.cumsum(out[back])])
        return np.diff(total[np.searchsorted(start, at)])


def token_counts(docs: DataFrame, vocabulary: Unigram, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens.

    Null and empty texts have 0; a null doc_id keeps its row, repeated rows are counted each by themselves; an empty
    table gives no rows. Long texts are counted whole, word by word; a word's ways are held for all its characters.
    Other columns are not looked at, whatever their names. Within a chunk of texts, words are told apart by 64-bit
    hashes; counts kept from chunk to chunk by the words themselves.
    """
    arrow_batches(docs.sparkSession)
    # one vocabulary: its size is that of its file
    share = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(share.value.counts(as_bytes(b.column("text"))))], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), Unigram.from_model(model))
