"""Exact dedup, ranked search and hard negatives against brute force, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import exact_dedup, hard_negatives, ranked_search
from tidewater.llm.hard_negatives import Best, Vectors

UPPER = re.compile("[A-Z]")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def folded(t):
    return UPPER.sub(lambda m: m[0].lower(), t or "")


def want_groups(rows):
    """(doc_id, keep_id, group_size, kept, hash) of (doc_id, text) rows, in order."""
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault(folded(t), []).append((-math.inf if i is None else i, -n))
    out = []
    for n, (i, t) in enumerate(rows):
        g = groups[folded(t)]
        keep = max(g)
        out.append((str(i), str(None if keep[0] == -math.inf else keep[0]), len(g), keep[1] == -n, hashlib.sha256(folded(t).encode()).hexdigest()))
    return sorted(out)


def got_groups(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(df).collect())


@pytest.mark.parametrize("least,shares", [(256, 1000), (4, 3)])
def test_exact_groups(least, shares, spark, tmp_path, monkeypatch):
    """Hot contents in shares or not: case of A to Z counts for nothing, that of other letters does; common beginnings."""
    monkeypatch.setattr(exact_dedup, "LEAST", least)
    monkeypatch.setattr(exact_dedup, "SHARES", shares)
    r = random.Random(3)
    start = "The same long beginning of every licence, " * 4
    some = ["", None, "Hot text", "hOT TEXT", "Éa", "éa", "éA", start + "a", start + "B", start + "b", "x" * 300_000, "X" * 300_000, "x" * 299_999 + "y", "İ", "i̇", "ΑΣ", "ας", "ασ"]
    texts = [r.choice(some) for _ in range(300)] + ["Hot text"] * 200 + ["éa", "Éa", "éA"] * 40
    ids = [r.choice([None, 7, *range(500)]) for _ in texts]
    path = str(tmp_path / "d")
    spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    assert got_groups(docs) == want_groups(list(zip(ids, texts, strict=True)))
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(Counter(folded(x.text) for x in kept.collect()).values()) == [1] * len({folded(t) for t in texts})


def test_exact_groups_without_python(spark, write_docs):
    plan = exact_dedup.exact_groups(write_docs(["a", "b", "A"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def test_exact_groups_of_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.orderBy("_uid").collect()]
    assert [x[:4] for x in got_groups(odd_docs)] == [x[:4] for x in want_groups(rows)]
    assert exact_dedup.deduplicated(odd_docs).columns == odd_docs.columns and exact_dedup.deduplicated(odd_docs).count() == 6
    assert exact_dedup.exact_groups(no_docs).collect() == [] and exact_dedup.deduplicated(no_docs).collect() == []


def want_ranked(docs, items, k=20):
    """Rows of (item, rank, doc, score) over texts, numbered in order; ids are the numbers."""
    split = [TERM.findall(folded(t)) for t in docs]
    counts = [Counter(w) for w in split]
    n, total = sum(map(bool, split)), sum(map(len, split))
    df, out = Counter(t for c in counts for t in c), []
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
    for i, item in enumerate(items):
        asked, scores = Counter(TERM.findall(folded(item))), []
        for d, c in enumerate(counts):
            m = 75 + 25 * len(split[d]) * n // total if total else 0
            s = sum(q * weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, d))
        out += [(i, rank, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.fixture
def write_items(spark, tmp_path):
    def write(texts, name="items"):
        spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    return write


@pytest.mark.parametrize("seed,block,cells", [(1, 1024, 1 << 24), (2, 3, 1 << 24), (3, 1024, 1)])
def test_ranked(seed, block, cells, write_docs, write_items, monkeypatch):
    """Many ties, copies in a third of the documents, a term in all of them; blocks of few items, segments of few documents."""
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    monkeypatch.setattr(ranked_search, "CELLS", cells)
    monkeypatch.setattr(ranked_search, "TERMS", 40 if cells == 1 else 1 << 18)
    r = random.Random(seed)
    words = [*(f"w{k}" for k in range(60)), "Éa", "東京", "e-mail", "A.B", "x\x00y"]
    some = lambda k: " ".join(r.choices(words, [1 / (1 + j) for j in range(len(words))], k=k))
    docs = [some(r.randint(0, 40)) + " all" for _ in range(400)] + ["W1 w2 all"] * 200 + ["", None, "...", " all" * 3000]
    items = [some(r.randint(1, 12)) for _ in range(9)] + ["all", "", None, "nowhere", "w1 W1 w1 w59", some(300)]
    got = sorted((x.item_id, x.rank, x.doc_id, x.score) for x in ranked_search.ranked(write_docs(docs), write_items(items)).collect())
    assert got == want_ranked(docs, items)


def test_best_positions_stop_early():
    """Lists are read to the end only where they have to be."""
    n = 5000
    tf = np.concatenate([[50] * 20, np.ones(n - 20, int)])
    docs = pa.table({"_uid": np.arange(n), "id": np.arange(n), "terms": pa.array([["a", "b"]] * n), "tf": pa.array([[int(t), 1] for t in tf]), "m": np.full(n, 100)})
    segment = ranked_search.Segment(docs, pa.array(["a", "b"]), np.array([1000, 10]))
    top = ranked_search.Top(20)
    read = ranked_search.best_positions(segment, np.array([0, 1]), np.array([1, 1]), top)
    assert top.rows[:, 2].tolist() == list(range(20)) and read < 200


def test_ranked_on_odd_rows(spark, odd_docs, no_docs, write_items):
    items = write_items(["one two word", "tokyo Zß東京🙂", None, "double double"]).withColumn("w", F.lit("x")).withColumn("_uid", F.lit(1))
    got = sorted((x.item_id, x.rank, str(x.doc_id)) for x in ranked_search.ranked(odd_docs, items).collect())
    # the word of the long text counts most; both rows of document 1 are ranked, the null id behind them for its length
    assert got == [(0, 1, "5"), (0, 2, "1"), (0, 3, "1"), (0, 4, "None"), (1, 1, "6"), (3, 1, "6")]
    assert ranked_search.ranked(no_docs, items).collect() == [] and ranked_search.ranked(odd_docs, items.where("false")).collect() == []


def want_negatives(rows):
    """(anchor, positive, rank, negative, scores) of (vec_id, embedding, label) rows; ids may be null or repeat."""
    fine = [(n, i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i is not None and i % 7 == 0 else y) for n, (i, v, y) in enumerate(rows) if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v, y in fine:
        if i is None or i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0, m, z) for m, j, w, z in fine if m != n and len(w) == len(v)]
        for s, pnull, p, *_ in sorted(x for x in scored if x[4] == y)[:5]:
            found = sorted(x for x in scored if x[4] != y and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out += [(i, str(None if pnull else p), rank, str(None if null else q), -s, -t) for rank, (t, null, q, *_) in enumerate(found, 1)]
    return sorted(out)


def got_negatives(df):
    return sorted((x.anchor_id, str(x.positive_id), x.rank, str(x.negative_id), x.positive_score, x.negative_score) for x in hard_negatives.mined(df).collect())


@pytest.mark.parametrize("seed,block,rows", [(1, 1 << 15, 2048), (2, 2, 64), (3, 1 << 15, 100)])
def test_hard_negatives(seed, block, rows, spark, tmp_path, monkeypatch):
    """Clusters, copies in a third of the rows, whole small components so that scores tie; odd rows among them."""
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ROWS", rows)
    r, g = random.Random(seed), np.random.default_rng(seed)
    centres = g.normal(size=(6, 20))
    vectors = [list(map(float, np.round(centres[r.randrange(6)] + 0.5 * g.normal(size=20), r.choice([0, 1, 3])))) for _ in range(500)]
    for k in range(0, 500, 3):
        vectors[k] = vectors[0]
    data = [(k, v, r.randrange(10) if seed < 3 else r.randrange(2)) for k, v in enumerate(vectors)]
    nan, inf = float("nan"), float("inf")
    data += [(600, None, 1), (700, [nan] * 20, 1), (701, [inf] * 20, 1), (800, vectors[4], None), (801, [None] * 20, 3), (900, [1.0, 2.0], 3), (901, [1.0, 3.0], 3), (902, [1.0, 1.0], 4), (1000, [], 3), (1001, [], 3), (1002, [], 4), (None, vectors[5], 3), (100, vectors[6], 2), (100, vectors[6], 2)]
    path = str(tmp_path / "v")
    spark.createDataFrame(data, "vec_id long, embedding array<double>, label long").withColumn("v", F.lit(1)).withColumn("_uid", F.lit(1)).withColumn("id", F.lit("x")).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert got_negatives(df) == want_negatives(data)
    assert hard_negatives.mined(df.where("false")).collect() == [] and hard_negatives.mined(df.where("vec_id % 100 > 0")).collect() == []


def test_bounds_hold_and_leave_little():
    """Bounds hold at each level, and tighten; clustered vectors are mostly settled by them."""
    g = np.random.default_rng(5)
    walk = lambda n: np.floor(256 * np.cumsum(g.normal(size=(n, 64)), axis=1))
    a, b = Vectors.made(walk(50)), Vectors.made(walk(400))
    score = a.x @ b.x.T
    widths = []
    for level in range(3):
        low, high = hard_negatives.bounds(a, b, level)
        assert (low <= score).all() and (score <= high).all()
        widths.append((high - low).mean())
    assert widths[0] > widths[1] > widths[2]
    bar = np.partition(score, -5, axis=1)[:, -5]
    i, j = hard_negatives.open_pairs(a, b, np.ones(score.shape, bool), bar, np.full(50, np.inf))
    assert set(zip(*np.nonzero(score >= bar[:, None]), strict=True)) <= set(zip(i, j, strict=True)) and len(i) < 0.1 * score.size


def test_exact_scores_of_large_components():
    a = Vectors.made(np.array([[2.0**31, 3.0, -(2.0**30)]]))
    assert hard_negatives.exact(a, a, np.array([0]), np.array([0])).tolist() == [2**62 + 9 + 2**60]
    with pytest.raises(OverflowError):
        hard_negatives.exact(Vectors.made(np.array([[2.0**32, 0.0]])), Vectors.made(np.array([[2.0**32, 0.0]])), np.array([0]), np.array([0]))


def test_best_takes_ties_by_id():
    best = Best(1, 2)
    zero = np.zeros(3, np.int64)
    best.offer(zero, np.array([5, 5, 4]), zero, np.array([9, 8, 1]), zero)
    best.offer(zero[:1], np.array([5]), zero[:1], np.array([3]), zero[:1])
    assert best.rows[:, 2].tolist() == [3, 8] and best.least.tolist() == [5]
