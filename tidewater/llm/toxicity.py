"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word enters as vectors that are learned with the network: one for its hashed whole form, and the mean of those of its
hashed prefixes and grams of characters. Beside them stand a few numbers that need no steps to learn: how toxic its form
and its characters are in the labelled sample, a document's own contribution taken out while training. The network
reads windows of WINDOW words in both directions, attention pools its states, and a document's score is that of its most
toxic window. Windows overlap: one starts at every STRIDE-th word and at the last WINDOW words, so that no word is left out
and any run of WINDOW - STRIDE + 1 words is whole in some window. Everything is trained in numpy on a bounded sample of
labelled documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.base import BYTE_VALUES, Rolling, arrow_batches, as_bytes, chunks, read
from tidewater.llm.quality import fold

#: Labelled documents that are trained on at most, and bytes of their texts, each of at most a share of them and counted
#: as some bytes more; they bound the driver's share, whatever repeats.
MOST_LABELLED, MOST_BYTES, TEXT_SHARE, ROW_BYTES = 8192, 64 << 20, 16, 64
#: Words of a window, and between the starts of windows.
WINDOW, STRIDE, THRESHOLD = 24, 12, 0.3
TABLE_BITS, HIDDEN, ATTENTION, EPOCHS, RATE, BATCH = 18, 8, 8, 10, 0.01, 256
PREFIXES, GRAM = tuple(range(3, 12)), 5
#: Numbers of a word from the labels, and length of each of its two learned vectors, which stand in tables of this many bits.
CHANNELS, EMBED, EMBED_BITS = 5, 6, 13
INPUTS = CHANNELS + 2 * EMBED
#: Steps at least, which small samples reach by more passes than EPOCHS.
LEAST_STEPS = 160
#: The vectors' share of the learning rate, what they lose in a step, how often they are left out in training; every
#: HELD-th document is not learned from but fits the scale of the scores.
EMBED_RATE, DECAY, LEFT_OUT, HELD = 0.1, 1e-3, 0.5, 10
#: Weight of the prior in a feature's count.
PRIOR = 3.0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Tokens:
    """Lower-cased runs of letters of a chunk, and the hashed features of each."""

    def __init__(self, texts: list[bytes]):
        buf = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8).copy()
        at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        buf[(buf >= 65) & (buf <= 90)] += 32
        # capitals of the Latin-1 letters
        after = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)) + 1
        buf[after] += 32
        edge = np.diff(_LETTER[buf].view(np.int8), prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.before = np.searchsorted(self.start, at)
        self._hash = Rolling(BYTE_VALUES[0][buf])

    def features(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, kinds) table slots of the chosen words; -1 where a word is too short. Kinds: whole, prefixes, grams."""
        start, end = self.start[rows], self.end[rows]
        bucket = lambda a, b, kind: ((self._hash.of(a, b) ^ np.uint64(kind * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        whole = bucket(start, end, 1)
        # a prefix only counts where the word goes on behind it
        prefix = np.stack([np.where(start + k < end, bucket(start, np.minimum(start + k, end), 2), -1) for k in PREFIXES], axis=1)
        gram = np.stack([np.where(start + k + GRAM <= end, bucket(start + np.minimum(k, end - start), np.minimum(start + k + GRAM, end), 3), -1) for k in range(1, 8)], axis=1)
        return whole, np.concatenate([prefix, gram], axis=1)

    def keys(self) -> np.ndarray:
        return self._hash.of(self.start, self.end)


def channels(value: np.ndarray, slots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The inputs of words from the values of their slots; value has one more entry, 0, for slot -1."""
    whole, chars = slots
    own = value[chars]
    k = len(PREFIXES)
    there = np.maximum((chars[:, :k] >= 0).sum(axis=1), 1)
    low = np.where(chars >= 0, own, -4.0)
    return np.stack([value[whole], low[:, :k].max(axis=1), own[:, :k].sum(axis=1) / there, low[:, k:].max(axis=1), np.ones(len(whole))], axis=1).astype(np.float32) / 2


def embed_slots(slots: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the two tables for each word, and how many character rows count; the last row, zeros, stands for none."""
    shift = TABLE_BITS - EMBED_BITS
    chars = np.where(slots[1] >= 0, slots[1] >> shift, 1 << EMBED_BITS)
    return slots[0] >> shift, chars, np.maximum((slots[1] >= 0).sum(axis=1), 1).astype(np.float32)


def embedded(tables: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The learned inputs of words: (words, 2 * EMBED)."""
    word, chars, n = rows
    return np.concatenate([tables[0][word], tables[1][chars].sum(axis=1) / n[:, None]], axis=1)


def windows_of(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words) of all windows; a document of fewer words than a window has one."""
    n = np.diff(before)
    many = np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1
    doc = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    # the last window ends with the document
    start = np.minimum(k * STRIDE, np.maximum(n[doc] - WINDOW, 0))
    return doc, before[:-1][doc] + start, np.minimum(n[doc], WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Gated recurrent units in both directions, attention over their states, one logit."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        make = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"out": make(2 * HIDDEN), "bias": np.full(1, -2, np.float32), "att": make(2 * HIDDEN, ATTENTION), "pick": make(ATTENTION)}
        for d in "fb":
            self.p |= {f"x{d}": make(INPUTS, 3 * HIDDEN), f"h{d}": make(HIDDEN, 3 * HIDDEN)}

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """x: (windows, words, inputs), mask: words that are there -> logits."""
        n, t, h = len(x), x.shape[1], HIDDEN
        states, tape = np.empty((t, n, 2 * h), np.float32), []
        for k, d in enumerate("fb"):
            into, w, last = x @ self.p[f"x{d}"], self.p[f"h{d}"], np.zeros((n, h), np.float32)
            for s in range(t) if d == "f" else range(t - 1, -1, -1):
                i, u = into[:, s], last @ w
                zr = _sigmoid(i[:, : 2 * h] + u[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(i[:, 2 * h :] + r * u[:, 2 * h :])
                now = last + z * (c - last)
                if keep:
                    tape.append((k, s, last, z, r, c, u[:, 2 * h :]))
                states[s, :, k * h : (k + 1) * h] = last = now
        e = np.tanh(states @ self.p["att"])
        a = e @ self.p["pick"] + np.where(mask.T, 0, -1e4).astype(np.float32)
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        return pooled @ self.p["out"] + self.p["bias"], (x, states, e, a, pooled, tape)

    def backward(self, dlogit: np.ndarray, kept: tuple) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters and of the inputs."""
        x, states, e, a, pooled, tape = kept
        h, g = HIDDEN, {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["bias"] = pooled.T @ dlogit, dlogit.sum(keepdims=True)
        dpool = dlogit[:, None] * self.p["out"]
        da = np.einsum("nh,tnh->tn", dpool, states)
        da = a * (da - (a * da).sum(axis=0))
        de = da[:, :, None] * self.p["pick"] * (1 - e**2)
        g["pick"] = np.einsum("tn,tna->a", da, e)
        g["att"] = np.einsum("tnh,tna->ha", states, de)
        dstates = a[:, :, None] * dpool + de @ self.p["att"].T
        dx = np.zeros_like(x)
        carry = {0: np.zeros_like(tape[0][2]), 1: np.zeros_like(tape[0][2])}
        for k, s, last, z, r, c, u in reversed(tape):
            d = "fb"[k]
            dn = dstates[s, :, k * h : (k + 1) * h] + carry[k]
            dc = dn * z * (1 - c**2)
            dz, dr = dn * (c - last) * z * (1 - z), dc * u * r * (1 - r)
            dinto = np.concatenate([dz, dr, dc], axis=1)
            du = np.concatenate([dz, dr, dc * r], axis=1)
            g[f"x{d}"] += x[:, s].T @ dinto
            g[f"h{d}"] += last.T @ du
            carry[k] = dn * (1 - z) + du @ self.p[f"h{d}"].T
            dx[:, s] += dinto @ self.p[f"x{d}"].T
        return g, dx


@dataclass
class Model:
    value: np.ndarray
    tables: np.ndarray
    net: Network
    #: a document's score is sigmoid(slope * its largest logit + shift)
    slope: float
    shift: float

    def logits(self, texts: list[bytes]) -> np.ndarray:
        t = Tokens(texts)
        # words that repeat in the chunk are looked up once
        _, first, back = np.unique(t.keys(), return_index=True, return_inverse=True)
        x = np.zeros((len(first) + 1, INPUTS), np.float32)
        if len(first):
            slots = t.features(first)
            x[:-1] = np.concatenate([channels(self.value, slots), embedded(self.tables, embed_slots(slots))], axis=1)
        kind = np.append(back.ravel(), len(first))
        return best_windows(self.net, lambda doc, at: x[kind[at]], t.before)[0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return _sigmoid(self.slope * self.logits(texts) + self.shift)


def gather(start: np.ndarray, size: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW): the words of windows, n_words where there is none, and the mask of those that are there."""
    mask = np.arange(WINDOW) < size[:, None]
    return np.where(mask, start[:, None] + np.arange(WINDOW), n_words), mask


def best_windows(net: Network, inputs: Callable[[np.ndarray, np.ndarray], np.ndarray], before: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document the largest logit of its windows, and that window's first word and size.

    inputs gives the inputs of words (windows, WINDOW) of documents (windows).
    """
    doc, start, size = windows_of(before)
    out = [np.zeros(0, np.float32)]
    for i in range(0, len(doc), step):
        at, mask = gather(start[i : i + step], size[i : i + step], int(before[-1]))
        out.append(net.forward(inputs(doc[i : i + step], at), mask)[0])
    logit = np.concatenate(out)
    order = np.lexsort((-logit, doc))
    top = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])] if len(doc) else order
    return logit[top], start[top], size[top]


class Adam:
    """Steps of parameters by running means of gradients and of their squares."""

    def __init__(self) -> None:
        self.state: dict[str, tuple] = {}
        self.step = 0

    def move(self, name: str, grad: np.ndarray, rate: float) -> np.ndarray:
        m, v = self.state.get(name, (0.0, 0.0))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        self.state[name] = m, v
        return rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-7)


def train(texts: list[bytes], y: np.ndarray, seed: int = 5) -> Model:
    """texts with their labels (0 or 1); without both labels every score is the share of toxic ones."""
    rng, prior = np.random.default_rng(seed), float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    odds = np.log(prior / (1 - prior))
    tables = np.zeros((2, (1 << EMBED_BITS) + 1, EMBED), np.float32)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 + (1 << TABLE_BITS)), tables, Network(seed), 0.0, float(odds))
    # in how many documents of each label a slot occurs; every word's kind, and the slots of each kind
    size, seen = 1 << TABLE_BITS, np.zeros((2, 1 << TABLE_BITS))
    words, before, kinds = [], [np.zeros(1, np.int64)], []
    for i in range(0, len(texts), 64):
        t = Tokens(texts[i : i + 64])
        keys, first, back = np.unique(t.keys(), return_index=True, return_inverse=True)
        slots = t.features(first)
        kinds.append((keys, slots[0].astype(np.int32), slots[1].astype(np.int32)))
        words.append(keys[back.ravel()])
        before.append(t.before[1:] + before[-1][-1])
        doc = np.repeat(np.arange(len(t.before) - 1), np.diff(t.before))
        own = np.unique(doc * len(keys) + back.ravel()) if len(keys) else np.zeros(0, np.int64)
        doc, kind = own // max(len(keys), 1), own % max(len(keys), 1)
        chars = slots[1][kind]
        pair = np.unique(np.concatenate([doc * size + slots[0][kind], (doc[:, None] * size + chars)[chars >= 0]]))
        for label in (0, 1):
            seen[label] += np.bincount(pair[y[i + pair // size] == label] % size, minlength=size)
    before = np.concatenate(before)
    keys, first = np.unique(np.concatenate([k[0] for k in kinds]), return_index=True)
    slots = tuple(np.concatenate([k[j] for k in kinds])[first].astype(np.int64) for j in (1, 2))
    kind = np.append(np.searchsorted(keys, np.concatenate(words)), len(keys)).astype(np.int32)
    del kinds, words
    value_of = lambda toxic, clean: np.append(np.log((toxic + PRIOR * prior) / (clean + PRIOR * (1 - prior))) - odds, 0).astype(np.float32)
    value = value_of(seen[1], seen[0])
    # what a document's words are worth without itself, by its label; the last row stands for no word
    less = [value_of(seen[1], np.maximum(seen[0] - 1, 0)), value_of(np.maximum(seen[1] - 1, 0), seen[0])]
    worth = np.zeros((2, len(keys) + 1, CHANNELS), np.float32)
    for label in (0, 1):
        worth[label, :-1] = channels(less[label], slots)
    rows = embed_slots((np.append(slots[0], 0), np.concatenate([slots[1], np.full((1, slots[1].shape[1]), -1)])))
    part = lambda k: tuple(r[k] for r in rows)

    def learned() -> np.ndarray:
        out = np.concatenate([embedded(tables, part(slice(i, i + 16384))) for i in range(0, len(keys) + 1, 16384)])
        out[-1] = 0
        return out

    def inputs(vectors: np.ndarray, label: np.ndarray, at: np.ndarray) -> np.ndarray:
        k = kind[at]
        return np.concatenate([worth[label[:, None], k], vectors[k]], axis=2)

    net, adam = Network(seed), Adam()
    all_doc, all_start, all_size = windows_of(before)
    taught = np.arange(len(y)) % HELD > 0
    taught |= y[taught].min() == y[taught].max()
    epochs = max(EPOCHS, -(-LEAST_STEPS // max(2 * int(taught.sum()) // BATCH, 1)))
    for epoch in range(epochs):
        if epoch % 4 == 0:
            if epoch == 0:
                # at first the window with the most telling word stands for its document
                top = np.maximum(worth[:, :, 0], np.maximum(worth[:, :, 1], worth[:, :, 3]))
                top[:, -1] = -9
                rank = np.concatenate([top[y[all_doc[i : i + 8192], None], kind[gather(all_start[i : i + 8192], all_size[i : i + 8192], len(kind) - 1)[0]]].max(axis=1) for i in range(0, len(all_start), 8192)])
                order = np.lexsort((-rank, all_doc))
                pick = order[np.concatenate([[True], all_doc[order][1:] != all_doc[order][:-1]])]
                start, length = all_start[pick], all_size[pick]
            else:
                vectors = learned()
                _, start, length = best_windows(net, lambda doc, at: inputs(vectors, y[doc], at), before)  # noqa: B023
            # and of documents that aren't toxic, another window at random
            clean = np.flatnonzero((y == 0) & taught)
            some = np.flatnonzero((y[all_doc] == 0) & taught[all_doc])
            some = some[rng.integers(0, len(some), len(clean))]
            start, length, target = np.concatenate([start[taught], all_start[some]]), np.concatenate([length[taught], all_size[some]]), np.concatenate([y[taught], np.zeros(len(some), np.int64)])
        order = rng.permutation(len(start))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            at, mask = gather(start[pick], length[pick], len(kind) - 1)
            # the kinds of the batch, each looked up once
            used, back = np.unique(kind[at], return_inverse=True)
            mine = part(used)
            vectors = embedded(tables, mine)
            vectors[used == len(keys)] = 0
            there = (rng.random(at.shape) >= LEFT_OUT).astype(np.float32)[:, :, None] / (1 - LEFT_OUT)
            x = np.concatenate([worth[target[pick][:, None], kind[at]], vectors[back.reshape(at.shape)] * there], axis=2)
            logit, kept = net.forward(x, mask, keep=True)
            grad, dx = net.backward(((_sigmoid(logit) - target[pick]) / len(pick)).astype(np.float32), kept)
            adam.step += 1
            rate = RATE * (1 - epoch / epochs)
            for k, g in grad.items():
                net.p[k] = (net.p[k] - adam.move(k, g, rate)).astype(np.float32)
            per = np.zeros((len(used), 2 * EMBED), np.float32)
            np.add.at(per, back.ravel(), (dx[:, :, CHANNELS:] * there * mask[:, :, None]).reshape(-1, 2 * EMBED))
            g = np.zeros_like(tables)
            np.add.at(g[0], mine[0], per[:, :EMBED])
            np.add.at(g[1], mine[1], np.repeat((per[:, EMBED:] / mine[2][:, None])[:, None], mine[1].shape[1], axis=1))
            tables = ((1 - DECAY) * tables - adam.move("tables", g, EMBED_RATE * rate)).astype(np.float32)
            tables[:, -1] = 0
    vectors = learned()
    top = best_windows(net, lambda doc, at: inputs(vectors, y[doc], at), before)[0].astype(float)
    held = ~taught if not taught.all() and y[~taught].min() != y[~taught].max() else np.ones(len(y), bool)
    top, y = top[held], y[held]
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic fit, slightly held back
        q = _sigmoid(slope * top + shift)
        w = q * (1 - q) + 1e-6
        g = np.array([((q - y) * top).sum() + 0.1 * (slope - 1), (q - y).sum()])
        hess = np.array([[(w * top * top).sum() + 0.1, (w * top).sum()], [(w * top).sum(), w.sum()]])
        move = np.linalg.solve(hess, g)
        slope, shift = slope - float(np.clip(move[0], -0.5, 0.5)), shift - float(np.clip(move[1], -0.5, 0.5))
    return Model(value.astype(np.float32), tables, net, max(slope, 0.01), shift)


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED, most_bytes: int = MOST_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of at most `most` training rows and `most_bytes` of text, chosen by a hash of the id; all of them if there are fewer.

    Of rows that repeat an id as many are taken as still fit; texts of over a TEXT_SHARE-th of most_bytes are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_y"))
    known = known.where(fold(F.col("_id"), 4) != 2)
    n = known.count()
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 40))
    size = F.octet_length("text") + ROW_BYTES

    def drawn(share: float) -> DataFrame:
        rows = known if share >= 1 else known.where(place < int(share * (1 << 40)))
        texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= most_bytes // TEXT_SHARE)
        return texts.join(rows, F.col("_doc") == F.col("_id")).select("_id", "text", "_y")

    share = min(1.0, most / max(n, 1))
    held = drawn(share).agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    order = [place, F.xxhash64("text"), F.col("_y")]
    # the running sum is over `most` rows at most
    first = drawn(share * min(1.0, most_bytes / max(held, 1))).orderBy(*order).limit(most)
    first = first.withColumn("_sum", F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    rows = first.where(F.col("_sum") <= most_bytes).toArrow()
    texts, y, ids = as_bytes(rows.column("text").combine_chunks()), rows.column("_y").to_numpy(), rows.column("_id").to_numpy()
    del rows
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
    return [texts[i] for i in order], y[order].astype(np.int64)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Rows of labels with a null label or doc_id are left out; other columns of either table are not looked at. Null and
    empty texts are one window without words; repeated rows and null ids are scored each by themselves; long texts are
    scored whole, in windows at every STRIDE-th word; an empty table gives no rows. With no label, or only one of the two, every score is the
    share of toxic labels (0.5 without any).
    """
    arrow_batches(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast(train(*sample(docs, labels, label)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, limit=1 << 19):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(share.value.scores(as_bytes(b.column("text"))).astype(float))], ["id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, score double")
    return scored.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
