"""Operators against brute force on small tables."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

import corpus_pipeline
from tidewater.llm import components, decontamination, embedding_dedup, mixing, quality, secrets, simhash_dedup, substring_dedup, suffix_dedup, token_counts, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")


def texts(seed, n=60, words=120, vocab=300):
    """Random texts, some with shared passages, near copies, exact copies and repeats inside."""
    r = random.Random(seed)
    lexicon = ["".join(r.choice("abcdeèß東") for _ in range(r.randint(1, 8))) for _ in range(vocab)]
    some = lambda k: [r.choice(lexicon) for _ in range(k)]
    passage, out = some(60), []
    for i in range(n):
        w = some(r.randint(0, words))
        if i % 5 == 0:
            w = w + passage[r.randint(0, 20) :] + some(5)
        if i % 7 == 0 and out:
            w = out[-1].split(" ")[: r.randint(1, 200)]
        if i % 11 == 0:
            w = some(3) * 40
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed,length", [(1, 35), (2, 10), (3, 4)])
def test_substring_dedup(seed, length, write_docs):
    docs = texts(seed)
    rows = substring_dedup.remove_repeats(write_docs(docs), length=length).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows}
    split = [WORD.findall(t) for t in docs]
    # matches with the first place of their words, extended word by word until they differ
    first, matches = {}, Counter()
    for i, w in enumerate(split):
        for s in range(len(w) - length + 1):
            first.setdefault(tuple(w[s : s + length]), []).append((i, s))
    for i, w in enumerate(split):
        s = 0
        while s <= len(w) - length:
            places = first[tuple(w[s : s + length])]
            if len(places) == 1:
                s += 1
                continue
            (j, p), k = places[0], 1
            at = lambda k: first.get(tuple(w[s + k : s + k + length]), [None])  # noqa: B023, E731
            while s + k <= len(w) - length and len(at(k)) > 1 and at(k)[0] == (j, p + k):
                k += 1
            matches[i] += 1
            s += k
    assert {r.doc_id: r.n_repeats for r in rows} == {i: matches[i] for i in range(len(docs))}
    seen = Counter(tuple(w[s : s + length]) for w in split for s in range(len(w) - length + 1))
    for i, w in enumerate(split):
        drop = {s + k for s in range(len(w) - length + 1) if seen[tuple(w[s : s + length])] > 1 for k in range(length)}
        assert got[i] == (len(w), len(drop), " ".join(x for k, x in enumerate(w) if k not in drop))


def without_later_copies(docs, length):
    """(bytes, removed, spans, hash of the rest) of each text, in order."""
    seen, out = set(), []
    for t in docs:
        b = (t or "").encode()
        drop = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                drop[s : s + length] = True
            seen.add(b[s : s + length])
        drop = drop[:-1]
        kept = np.frombuffer(b, np.uint8)[~drop].tobytes()
        spans = int((np.diff(np.concatenate([[0], drop.astype(int)])) == 1).sum())
        out.append((len(b), int(drop.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed,length,most", [(4, 100, 1024), (5, 40, 1024), (6, 33, 1)])
def test_suffix_dedup(seed, length, most, write_docs, monkeypatch):
    """With one block a class, every class of several is compared window by window."""
    monkeypatch.setattr(suffix_dedup, "MOST_BLOCKS", most)
    docs = [*texts(seed), "a" * 500, "ab" * 300, "a" * 120, "abc" * 900, "cab" * 700]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_later_copies(write_docs(docs), length=length).collect()}
    assert got == dict(enumerate(without_later_copies(docs, length)))


@pytest.mark.parametrize("chunk", [1 << 19, 700])
def test_suffix_dedup_ids_and_long_texts(chunk, spark, tmp_path, monkeypatch):
    """Null ids come first, rows of one id follow each other as read, long documents are cut into pieces."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    docs = texts(21, n=80)
    docs[7] = " ".join(docs)
    docs[40] = docs[7][300:9000] + "x" * 3000 + docs[7][:5000]
    for ids in ([None] * 80, [5 if i % 10 else i for i in range(80)], [None if i % 3 else 80 - i for i in range(80)]):
        path = str(tmp_path / f"{ids.count(None)}")
        spark.createDataFrame(list(zip(ids, docs, strict=True)), "doc_id long, text string").coalesce(1).write.parquet(path)
        order = sorted(range(80), key=lambda i: (ids[i] is not None, ids[i] or 0, i))
        want = sorted((str(ids[i]), *w) for i, w in zip(order, without_later_copies([docs[i] for i in order], 60), strict=True))
        got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_later_copies(spark.read.parquet(path), length=60).collect())
        assert got == want


def test_longest_previous_factors():
    r = random.Random(9)
    for _ in range(50):
        text = bytes(r.choice(b"ab") for _ in range(r.randint(12, 120)))
        length, starts = 10, np.arange(len(text) - 9)
        order, common = suffix_dedup.suffix_order(np.frombuffer(text, np.uint8), starts, np.zeros(len(starts), np.int64), length)
        assert [text[s : s + length] for s in order] == sorted(text[s : s + length] for s in starts)
        lcp = lambda i, j: next((k for k in range(length) if text[i + k] != text[j + k]), length)  # noqa: B023, E731
        want = [max((lcp(i, j) for j in range(i)), default=0) for i in starts.tolist()]
        assert suffix_dedup.longest_previous_factors(order, common).tolist() == want


def test_simhash(write_docs):
    docs = [*texts(7), *("Some Words that Repeat with one change number " * 20 + str(i) for i in range(40)), "two words", "", " x "]
    want = []
    for t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(len(w) - 2, 1))] if w else []
        want.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (want[i] ^ want[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash_dedup.simhash_components(write_docs(docs)).collect()}
    assert got == {i: (want[i], root[i]) for i in range(len(docs))}


def test_dense_fingerprints_are_divided(spark, monkeypatch):
    """Buckets over the size are split by further bits and lose no link."""
    monkeypatch.setattr(simhash_dedup, "BUCKET", 8)
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(3)]
    fps = {b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(120)}
    signed = [int(np.array([x], np.uint64).view(np.int64)[0]) for x in fps]
    got = {frozenset((a, b)) for a, b in simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want


@pytest.mark.parametrize("hub", [1 << 20, 3])
def test_components(hub, spark, monkeypatch):
    """With a hub of three links, most nodes are joined by broadcast."""
    monkeypatch.setattr(components, "HUB", hub)
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(500, i) for i in range(501, 560)]
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in root.items() if any(x in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("unit_rows,step,kind", [(16384, 256, "float"), (40, 7, "double")])
def test_embeddings(unit_rows, step, kind, spark, monkeypatch):
    """Clustered and scattered vectors, one cluster of a third of all, copies: units of many and of few vectors."""
    monkeypatch.setattr(embedding_dedup, "UNIT_ROWS", unit_rows)
    monkeypatch.setattr(embedding_dedup, "STEP", step)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 8))
    x = np.concatenate([centres[rng.integers(0, 20, 300)] + 0.25 * rng.normal(size=(300, 8)), centres[0] + 0.02 * rng.normal(size=(200, 8)), rng.normal(size=(100, 8))]).astype(np.float32)
    x[550:570] = x[:20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_components(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    label = np.arange(len(x))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    assert got == {i: (int(near[i].sum()) - 1, int(label[i])) for i in range(len(x))}
    assert len(set(label)) < 300


def test_embedding_units_prune(spark):
    """Tight clusters far apart are compared among themselves: few copies, few pairs."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 64))
    x = centres[rng.integers(0, 30, 900)] + 0.05 * rng.normal(size=(900, 64))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "key long, v array<double>, copies long")
    _, _, work = embedding_dedup.link_vectors(df)
    done = work.first()
    assert done.rows < 2 * 900 and done.pairs < 900 * 900 / 5


def test_secrets(write_docs):
    docs = ["no", "password = hunter2secret and token: abc", "secret=token:abcdefgh", "AKIA" + "Z" * 16, "x" * 10 + "a1" * 20, "login: alice " + "Zz9" * 9, "Zz9" * 9 + " alone", "Zz9" * 9 + " " * 300 + "login: alice", "see https://host.example/x with Zz9Zz9Zz9Zz9Zz9Zz9Zz9 ok", "🙂 api_key: '0123456789abcdef0123456789abcdef'"]
    got = {r.doc_id: r.spans for r in secrets.secret_report(write_docs(docs)).collect()}
    assert got[0] == "" and got[1] == "assign:0:24" and got[2] == ""
    assert got[3] == "access:0:20" and got[4] == "hex:10:50"
    assert got[5] == "login:0:12,mixed:13:40" and got[6] == "" and got[7] == ""
    assert got[8].startswith("endpoint:4:") and "mixed" in got[8]
    assert got[9] == "assign:2:44,hex:12:44"
    hidden = {r.doc_id: r.text for r in secrets.redact(write_docs(docs)).collect()}
    assert hidden[0] == "no" and hidden[1] == "[REDACTED] and token: abc" and hidden[5] == "login: alice [REDACTED]"
    assert hidden[9] == "🙂 [REDACTED]'" and hidden[6] == docs[6]


def plain_spans(text):
    """Base and weak spans of one text by comparing every two parts."""
    found = []
    for i, k in enumerate(secrets.KINDS):
        for m in re.finditer(k.pattern, text):
            if len(m[k.group]) >= k.least and all(re.search(h, m[0]) for h in k.holds):
                found.append((m.start(), i, m.end()))
    wide = [f for f in found if secrets.KINDS[f[1]].name in ("login", "endpoint")]
    found = [f for f in found if secrets.KINDS[f[1]].name != "mixed" or not any(w[0] <= f[0] and f[2] <= w[2] for w in wide)]
    secret = lambda f: secrets.KINDS[f[1]].role == "secret"
    apart = lambda f, g: f[2] <= g[0] or g[2] <= f[0]
    kept = [f for f in found if not secrets.KINDS[f[1]].weak or any(secret(f) != secret(g) and apart(f, g) and abs(f[0] - g[0]) <= secrets.SCOPE for g in found)]
    return ",".join(f"{secrets.KINDS[i].name}:{a}:{b}" for a, i, b in sorted(kept))


URLS = ["see https://example.com/Assets/Images2024/headerLogo for it", "https://en.example.org/wiki/List_of_Painters_1850s and https://b.example/Xx1Yy2Zz3Xx1Yy2Zz3Xx1Yy2", "user: Zz9Zz9Zz9Zz9Zz9Zz9Zz9", "login: alice at https://host.example/Path/To/Release2024Final"]


def test_weak_parts_against_brute_force(write_docs):
    r = random.Random(12)
    pieces = [*URLS, "login: alice", "user=Bob_77", "https://h.example/x", "postgres://db.example:5432", "Zz9" * 9, "aB3" * 8 + "==", "password = hunter2secret", "token: abc", "AKIA" + "Q7" * 9, "0f" * 14, "access_key_id: AKIA" + "Z" * 16, "client_secret=Aa1Aa1Aa1Aa1Aa1Aa1Aa1", "🙂", "plain words", '"', "'", " " * 90, "\n", "x" * 150, "secret=abc0123456789abcdef0123456789abcdef"]
    docs = [*URLS, *("".join(r.choice(pieces) + r.choice(["", " ", ",", "  "]) for _ in range(r.randint(1, 14))) for _ in range(300))]
    got = {x.doc_id: x.spans for x in secrets.secret_report(write_docs(docs)).collect()}
    want = {i: plain_spans(t) for i, t in enumerate(docs)}
    assert got == want
    assert all(want[i] == "" for i in range(len(URLS)))
    assert any("mixed" in w for w in want.values()) and any("login" in w for w in want.values()) and any("endpoint" in w for w in want.values())
    hidden = {x.doc_id: x.text for x in secrets.redact(write_docs(URLS)).collect()}
    assert hidden == dict(enumerate(URLS))


def test_token_counts():
    u = token_counts.Unigram({"▁": -2.0, "a": -1.0, "b": -1.0, "ab": -2.0, "▁a": -3.0, "▁ab": -4.0, "ba": -2.0, "abab": -4.0})
    peer = Tokenizer(models.Unigram([("<unk>", 0.0), *u.pieces.items()], 0, False))
    r = random.Random(2)
    for _ in range(400):
        t = "".join(r.choice("ab  cé\n") for _ in range(r.randint(0, 40)))
        want = sum(1 if x in u.pieces else len(x.encode()) for x in peer.encode((" " + t).replace(" ", "▁")).tokens) if t else 0
        assert u.counts([t.encode()])[0] == want, t


def test_mixing(write_docs):
    r = random.Random(4)
    docs = ["w " * r.randint(0, 400) for _ in range(300)]
    sources = [r.choice(["a", "a", "a", "b", "c", None, "d"]) for _ in docs]
    sources[0], docs[0] = "tiny", "w " * 7
    rows = mixing.mix(write_docs(docs, sources)).collect()
    again = mixing.mix(write_docs(docs, sources)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    size = Counter()
    for t, s in zip(docs, sources, strict=True):
        size[s] += len(t.split())
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(size.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        capped = {s for s in open_ if left * weight[s] / total > 3 * size[s] + 1e-9}
        if not capped:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in capped:
            target[s] = 3.0 * size[s]
        left, open_ = left - sum(target[s] for s in capped), open_ - capped
    taken = Counter()
    for r in rows:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    # a source's slots reach its target, also where it has but seven words
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert taken["tiny"] == 21
    for r in rows:
        assert (r.first_slot is None) == (r.taken == 0) == (r.n_slots == 0)


def test_mixing_order(spark):
    """Slots follow the golden ratio exactly, also far out, and every source has its share at any length."""
    slots = [0, 1, 2, 12345, 2**31 - 1, 2**31, 2**32 + 5, 2**47 + 99]
    got = [r.x for r in spark.createDataFrame([(i,) for i in slots], "i long").select(mixing.point(F.col("i")).alias("x")).collect()]
    assert got == [(i * mixing.PHI) % 2**48 / 2**48 for i in slots]
    targets = spark.createDataFrame([("a", 500.0, 0.0, 0.5), ("b", 300.0, 0.5, 0.8), (None, 199.0, 0.8, 0.999), ("t", 1.0, 0.999, 1.0)], "source string, target double, low double, high double")
    rows = sorted(mixing.schedule(targets, 1000, 1).collect(), key=lambda r: r.slot)
    share = {"a": 0.5, "b": 0.3, None: 0.199, "t": 0.001}
    for n in (10, 100, 500, 1000):
        first = Counter(r.source for r in rows[:n])
        assert all(abs(first[s] - n * p) <= 4 for s, p in share.items())
    for s in share:
        assert [r.rank for r in rows if r.source == s] == list(range(sum(r.source == s for r in rows))) and sum(r.source == s for r in rows) >= round(1000 * share[s])
    assert len({r.slot for r in rows}) == len(rows)


def test_running_sums_over_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 3)
    r = random.Random(2)
    rows = [(r.choice(["a", None, "b"]), i, r.randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = {x.i: x.before for x in mixing.running(df, ["k"], F.floor(F.col("i") / 3), ["i"], "v", "before").collect()}
    assert got == {i: sum(v for k2, j, v in rows if k2 == k and j < i) for k, i, _ in rows}


def test_mixed_texts(write_docs):
    docs = write_docs(["one two three", None, "", "four " * 200, "five six"], ["a", "a", "b", "b", None])
    rows = {r.doc_id: r for r in mixing.mixed(docs).collect()}
    assert rows.keys() == {0, 1, 2, 3, 4} and rows[3].text == "four " * 200 and rows[1].text is None
    plain = {r.doc_id: (r.taken, r.first_slot, r.n_slots) for r in mixing.mix(docs).collect()}
    assert plain == {i: (r.taken, r.first_slot, r.n_slots) for i, r in rows.items()}


def test_decontamination(write_docs, spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    items = [[r.choice(words) for _ in range(r.randint(15, 60))] for _ in range(30)]
    docs, want = [], set()
    for i in range(60):
        w = [r.choice(words) for _ in range(200)]
        if i % 3 == 0:
            item = list(items[i % 30])
            if i % 2:
                item[-1] = "changed"
            w[50:50] = item
            want.add((i, i % 30))
        docs.append(" ".join(w))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontamination.contaminated(write_docs(docs), bench).collect()}
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    for d, t in enumerate(docs):
        w = t.split()
        for i, item in enumerate(items):
            best = max(sum((grams(w[s : s + len(item)]) & grams(item)).values()) / sum((grams(w[s : s + len(item)]) | grams(item)).values()) for s in range(len(w) - len(item) + 1))
            assert ((d, i) in got) == (best >= 0.8), (d, i, best)
    assert all(v.similarity >= 0.8 for v in got.values()) and len(got) >= len(want) / 2


def edited(r, item, words, edits):
    out = list(item)
    for _ in range(edits):
        at = r.randrange(len(out)) if out else 0
        out[at : at + r.choice([0, 1, 1])] = r.choice([[], [r.choice(words)], [r.choice(words)]])
    return out


def test_decontamination_recall_under_edits(write_docs, spark):
    """Items of 1 to 60 words with words inserted, deleted and changed, against the best of all windows."""
    r = random.Random(16)
    words = [f"w{i}" for i in range(500)]
    items = [[r.choice(words) for _ in range(r.choice([1, 2, 3, 4, 5, 6, 9, 15, 30, 45, 60]))] for _ in range(60)]
    docs = []
    for i in range(150):
        w = [r.choice(words) for _ in range(r.randint(0, 120))]
        item = items[i % 60]
        at = r.randint(0, len(w))
        w[at:at] = edited(r, item, words, r.randint(0, 4 if len(item) > 20 else 1))
        docs.append(" ".join(w))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontamination.contaminated(write_docs(docs), bench).collect()}
    want = {}
    for d, t in enumerate(docs):
        w = t.split()
        for i, item in enumerate(items):
            size, n = min(5, len(item)), len(item)
            grams = lambda x, size=size: Counter(tuple(x[k : k + size]) for k in range(max(len(x) - size + 1, 1)))
            mine = grams(item)
            best = max((sum((grams(w[s : s + n]) & mine).values()) / sum((grams(w[s : s + n]) | mine).values()) for s in range(max(len(w) - n + 1, 1))), default=0) if w else 0
            if best >= 0.8:
                want[d, i] = best
    assert set(got) <= set(want) and len(want) > 120
    missed = set(want) - set(got)
    assert len(missed) <= 0.02 * len(want), (len(missed), len(want))
    # windows stand where a shingle puts them, so an inserted word can cost a better place
    assert all(got[k] <= want[k] + 1e-9 for k in got)


def test_windows_with_parts_in_another_order(write_docs, spark):
    """No shingle of a window whose halves have changed places says where it starts."""
    item = [f"a{i}" for i in range(100)] + [f"b{i}" for i in range(100)]
    around = [[f"x{i}" for i in range(300)], [f"y{i}" for i in range(250)]]
    docs = [" ".join(around[0] + item[100:] + item[:100] + around[1]), " ".join(around[0]), " ".join(item[100:] + item[:100])]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.start_word, r.n_words, r.similarity) for r in decontamination.contaminated(write_docs(docs), bench).collect()}
    assert got == {0: (7, 300, 200, pytest.approx(192 / 200)), 2: (7, 0, 200, pytest.approx(192 / 200))}
    assert [r.doc_id for r in decontamination.clean(write_docs(docs), bench).collect()] == [1]


def test_all_windows_with_enough_shingles_are_placed(write_docs, spark):
    """Against all windows, one by one; and their fingerprints against those of single windows."""
    r = random.Random(21)
    words = [f"w{i}" for i in range(60)]
    items = [[r.choice(words) for _ in range(n)] for n in (1, 3, 5, 8, 20, 20, 35)]
    docs = []
    for i in range(40):
        item = list(items[i % 7])
        at = r.randrange(len(item))
        docs.append([r.choice(words) for _ in range(r.randint(0, 40))] + item[at:] + item[:at] + [r.choice(words) for _ in range(r.randint(0, 20))])
    table = spark.createDataFrame([(i, i, " ".join(w)) for i, w in enumerate(docs)], "uid long, id long, text string")
    known = decontamination.items_of(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"))
    posts = decontamination.postings(known)
    suspects = decontamination.suspects_of(table, spark.sparkContext.broadcast(decontamination.Known(known, posts, 5)))
    rows = decontamination.placed(suspects, posts, 5, 0.8).collect()
    got = {(x.uid, x.n, x.start): x.fp for x in rows}
    assert len(got) == len(rows)
    text = {x.uid: x.words for x in suspects.collect()}
    assert all(np.array([fp]).view(np.uint64)[0] == decontamination.simhash(decontamination._window(bytes(text[u]), s, n, 5)) for (u, n, s), fp in got.items())
    some = 0
    for d, w in enumerate(docs):
        for item in items:
            n, size = len(item), min(5, len(item))
            grams = lambda x, size=size: Counter(tuple(x[k : k + size]) for k in range(max(len(x) - size + 1, 1)))
            for s in range(max(len(w) - n, 0) + 1):
                a, b = grams(w[s : s + n]), grams(item)
                if sum((a & b).values()) / sum((a | b).values()) >= 0.8:
                    some += 1
                    assert (d, n, s) in got
    assert some > 40


def test_multi_index_finds_all_within_radius(spark):
    r = random.Random(8)
    signed = lambda x: int(np.array([x], np.uint64).view(np.int64)[0])
    prints = [r.getrandbits(64) for _ in range(150)]
    probes = [r.choice(prints) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 40))) for _ in range(80)]
    items = spark.createDataFrame([(i, i % 3, signed(p)) for i, p in enumerate(prints)], "item long, n int, fp long")
    windows = spark.createDataFrame([(i, i % 3, 0, signed(p)) for i, p in enumerate(probes)], "uid long, n int, start int, fp long")
    got = sorted((x.uid, x.item, x.distance) for x in windows.join(decontamination.within(windows, items), ["n", "fp"]).collect())
    assert got == sorted((i, j, (p ^ q).bit_count()) for i, p in enumerate(probes) for j, q in enumerate(prints) if i % 3 == j % 3 and (p ^ q).bit_count() <= decontamination.RADIUS)


def auc(y, s):
    rank = np.argsort(np.argsort(s)) + 1
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


SF = "/root/testdata/sf0.01"


def test_held_out_quality_and_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    known = {r.doc_id: r for r in labels.collect()}
    for rows, label, least in ((quality.quality_scores(docs, labels).collect(), "quality", 0.95), (toxicity.toxicity_scores(docs, labels).collect(), "toxic", 0.8)):
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
        held = [r for r in rows if r.held_out and r.doc_id in known]
        assert auc(np.array([known[r.doc_id][label] for r in held]), np.array([r.score for r in held])) > least


def test_gradient_of_the_network():
    """Backpropagation against differences, for parameters and inputs."""
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, mask = rng.normal(size=(3, 6, toxicity.INPUTS)), np.array([[1] * 6, [1] * 4 + [0] * 2, [0] * 6], bool)
    _, kept = net.forward(x, mask, keep=True)
    grads, dx = net.backward(np.ones(3), kept)

    def difference(values, at):
        old = values[at]
        values[at] = old + 1e-3
        up = net.forward(x, mask)[0].astype(float).sum()
        values[at] = old - 1e-3
        down = net.forward(x, mask)[0].astype(float).sum()
        values[at] = old
        return (up - down) / 2e-3

    for name, g in grads.items():
        at = tuple(rng.integers(0, d) for d in net.p[name].shape)
        assert abs(difference(net.p[name], at) - g[at]) < 5e-3 * max(1, abs(g[at])), name
    for at in ((0, 0, 0), (1, 3, 7), (0, 5, toxicity.INPUTS - 1)):
        assert abs(difference(x, at) - dx[at]) < 5e-3 * max(1, abs(dx[at])), at


def plain_logit(net, x):
    """One window's logit, unit by unit."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    h, both = toxicity.HIDDEN, []
    for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        state, out = np.zeros(h), {}
        for t in order:
            into, own = x[t] @ net.p[f"x{d}"], state @ net.p[f"h{d}"]
            z, r = sigmoid(into[:h] + own[:h]), sigmoid(into[h : 2 * h] + own[h : 2 * h])
            state = (1 - z) * state + z * np.tanh(into[2 * h :] + r * own[2 * h :])
            out[t] = state
        both.append([out[t] for t in range(len(x))])
    states = [np.concatenate([f, b]) for f, b in zip(*both, strict=True)]
    weight = np.exp([np.tanh(s @ net.p["att"]) @ net.p["pick"] for s in states])
    return sum(w * s for w, s in zip(weight / weight.sum(), states, strict=True)) @ net.p["out"] + net.p["bias"][0]


def test_window_scores_against_plain_loops():
    """A document's logit is the largest of its windows', which overlap and leave no word out."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 12))) for _ in range(90)]
    texts_, y = [], []
    for i in range(80):
        y.append(int(i % 4 == 0))
        texts_.append(" ".join(r.choice(words[:60] if not y[-1] else words) for _ in range(r.choice([1, 5, 24, 30, 61]))).encode())
    model = toxicity.train(texts_, np.array(y))
    assert model.tables.any()
    for text in [*texts_[:12], texts_[0] + b" " + texts_[5] * 3]:
        t = toxicity.Tokens([text])
        n = len(t.start)
        slots = t.features(np.arange(n))
        x = np.concatenate([toxicity.channels(model.value, slots), toxicity.embedded(model.tables, toxicity.embed_slots(slots))], axis=1).astype(float)
        starts = sorted({*range(0, max(n - toxicity.WINDOW, 0) + 1, toxicity.STRIDE), max(n - toxicity.WINDOW, 0)})
        # beyond a short document's words, windows are padded with zeros
        windows = [np.concatenate([x[s : s + toxicity.WINDOW], np.zeros((max(toxicity.WINDOW - n, 0), x.shape[1]))]) for s in starts]
        padded = lambda w: model.net.forward(w[None].astype(np.float32), (np.arange(toxicity.WINDOW) < n)[None])[0][0]  # noqa: B023, E731
        want = max(plain_logit(model.net, w) if n >= toxicity.WINDOW else padded(w) for w in windows)
        assert abs(model.logits([text])[0] - want) < 1e-3


def test_ridge_against_dense_equations(spark, write_docs):
    """The partitions' sums give the dense solution, and the scores are its calibrated products."""
    docs = texts(31, n=120)
    y = np.array([float(i % 3 > 0) for i in range(120)])
    stats = quality.statistics(write_docs(docs))
    labelled = stats.join(spark.createDataFrame(list(enumerate(y.tolist())), "id long, y double"), "id").select("f", "y")
    model = quality.fit(stats, labelled)
    f = quality.statistics_of([t.encode() for t in docs])
    assert np.allclose(model.mean, f.mean(axis=0)) and np.allclose(model.scale, np.where(f.std(axis=0) > 0, f.std(axis=0), 1.0))
    z = np.column_stack([np.sqrt(2 / quality.N_FOURIER) * np.cos(np.clip((f - model.mean) / model.scale, -8, 8) @ model.weights + model.shift), np.ones(120)])
    beta = np.linalg.solve(z.T @ z + quality.RIDGE * 120 * np.eye(z.shape[1]) / quality.N_FOURIER, z.T @ y)
    assert np.allclose(z @ beta, model.raw_scores(f), atol=1e-6)
    got = {r.id: r.score for r in quality.score(stats, model).collect()}
    assert np.allclose([got[i] for i in range(120)], model.scores(f))
    order = np.argsort(z @ beta)
    assert (np.diff(model.scores(f)[order]) >= -1e-12).all()


def test_isotonic():
    x, y, n = np.arange(6.0), np.array([0.1, 0.5, 0.3, 0.2, 0.9, 0.8]), np.ones(6)
    centre, mean = quality.pool_adjacent(x, y, n)
    assert (np.diff(mean) > 0).all() and np.allclose(mean, [0.1, 1 / 3, 0.85]) and np.allclose(centre, [0, 2, 4.5])


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "secrets":
            before_secrets = kept
        out = corpus_pipeline.materialize(stage(spark, kept, SF), name)
        assert out.columns == docs.columns and 0 < out.count() <= kept.count()
        kept = out
    # masking can make texts alike again, so groups are looked for before it
    single = simhash_dedup.simhash_components(before_secrets).groupBy("component_id").count().where("count > 1").count()
    assert single == 0
    assert decontamination.contaminated(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    # masking leaves no certain secret of the first kinds
    assert secrets.secret_report(kept).where("n_access + n_hex > 0").count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert mixed.count() == kept.count() and mixed.where("taken > 3 * size").count() == 0
    assert mixed.columns[:3] == docs.columns[:3] and mixed.where("text is null and size > 0 or taken > 0 and first_slot is null").count() == 0


def thue_morse(n):
    """A word of n bytes of two letters; of it and its mirror, polynomial hashes modulo 2**64 agree for every odd base."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_long_words_are_told_apart(n, write_docs, spark):
    one, two = thue_morse(n)
    same = [f"w{i}" for i in range(34)]
    texts = [" ".join([*same, one]), " ".join([*same, two])]
    rows = substring_dedup.remove_repeats(write_docs(texts)).collect()
    assert [r.n_removed for r in rows] == [0, 0]
    found = decontamination.contaminated(write_docs(["x y " + one]), spark.createDataFrame([(1, two), (2, one)], "item_id long, text string"))
    assert [r.item_id for r in found.collect()] == [2]
    vocabulary = token_counts.Unigram.from_model(token_counts.MODEL)
    together = sum(r.n_tokens for r in token_counts.token_counts(write_docs([one + "b " + two]), vocabulary).collect())
    apart = [r.n_tokens for t in (one + "b", two) for r in token_counts.token_counts(write_docs([t]), vocabulary).collect()]
    assert together == sum(apart)
    # bytes: the windows of one are not those of the other, and a text of one letter in a thousand isn't either
    want = without_later_copies([one, two], 100)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_later_copies(write_docs([one, two])).collect()}
    assert got == dict(enumerate(want))


def test_toxicity_sample_is_bounded(spark):
    """Rows that repeat one labelled id, and null texts, count like others; very long texts are left out."""
    docs = spark.range(30000).selectExpr("1L as doc_id", "cast(null as string) as text").union(spark.range(2, 500).selectExpr("id as doc_id", "repeat('word ', 200) as text"))
    docs = docs.union(spark.createDataFrame([(7, "x" * 200_000)], "doc_id long, text string"))
    labels = spark.range(500).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    texts, y = toxicity.sample(docs, labels, most=300)
    assert 0 < len(texts) == len(y) <= 300
    texts, _ = toxicity.sample(docs, labels, most=50_000, most_bytes=1 << 20)
    assert sum(len(t) + toxicity.ROW_BYTES for t in texts) <= 1 << 20 and max(map(len, texts)) <= 1 << 16


def test_thresholds_are_the_best_deal():
    """Of all ways to deal the radius to groups, none expects fewer candidates; all pairs within the radius meet in a group."""
    g = np.random.default_rng(2)
    x = (g.random((400, 64)) < g.random(64)).astype(float)
    x[:, 10:14] = x[:, [9]]
    both, p = x.T @ x, x.mean(axis=0)
    radius = simhash_dedup.RADIUS
    price = lambda b, t: simhash_dedup.candidates(p, b, 400, t) + 4.0 * 400 * sum(math.comb(len(b), d) for d in range(t + 1)) if t >= 0 else 0.0
    cost = lambda deal: sum(price(b, t) for b, t in deal)
    chosen = simhash_dedup.thresholds(400, both)
    assert sum(t + 1 for _, t in chosen) == radius + 1 and len({b for bits, _ in chosen for b in bits}) == sum(len(bits) for bits, _ in chosen)
    deals = [list(zip(groups, d, strict=True)) for m in range(2, radius + 2) for groups in [simhash_dedup.bit_groups(400, both, m)] for d in itertools.product(range(-1, 3), repeat=m) if sum(t + 1 for t in d) == radius + 1]
    assert cost(chosen) == pytest.approx(min(map(cost, deals)))
