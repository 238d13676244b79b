"""Lexical search, clustering and removal of repeated spans against brute force, and odd tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from rowtide.llm import automaton_search, centroids, quality, repeated_spans
from rowtide.llm.column_suffixes import classes

DOCS = "doc_id long, text string, item int, Term string, file string, PLACE int"
ITEMS = "item_id long, text string, k int"
ODD = [
    (1, "The cat sat on the mat, and the dog: it sat, too. " * 3, 1, "a", "b", 1),
    (1, "The cat sat on the mat, and the dog: it sat, too. " * 3, 1, "a", "b", 1),
    (2, None, None, None, None, None),
    (3, "", 1, "", "", 1),
    (None, " ,;\n", 1, "a", "b", 1),
    (None, "THE CAT sat; on the mat, and the dog: it sat, too. 漢字 naïve", 1, "a", "b", 1),
    (5, "cat " * 30_000, 1, "a", "b", 1),
    (6, "x" * 100_000, 1, "a", "b", 1),
    (0, "x" * 60, 1, "a", "b", 1),
    (7, "漢字 😀 naïve\r\nThe CAT" * 9, 1, "a", "b", 1),
    (8, "0" + "漢字 😀 naïve\r\nThe CAT" * 9, 1, "a", "b", 1),
]


# --- spans -----------------------------------------------------------------------------


def spans_by_hand(docs, span=50):
    first = {}
    last = math.inf
    for i, x in docs:
        for a in range(len(x) - span + 1):
            w = x[a : a + span]
            first[w] = min(first.get(w, last), last if i is None else i)
    out = []
    for i, x in docs:
        gone = bytearray(len(x) + 1)
        for a in range(len(x) - span + 1):
            if first[x[a : a + span]] < (last if i is None else i):
                gone[a : a + span] = b"\1" * span
        rest = bytes(c for c, g in zip(x, gone) if not g)
        starts = sum(1 for k in range(len(x)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(x), sum(gone), starts, hashlib.sha256(rest).hexdigest(), rest))
    return sorted(out, key=str)


def check_spans(spark, rows, **options):
    df = spark.createDataFrame(rows, DOCS)
    got = repeated_spans.remove_repeated_spans(df, with_text=True, **options)
    got = sorted(((*r[:5], bytes(r["kept"])) for r in got.collect()), key=str)
    assert got == spans_by_hand([(r[0], (r[1] or "").encode()) for r in rows])


def test_classes_are_equal_spans():
    rnd = random.Random(1)
    for _ in range(100):
        span, letters = rnd.choice([1, 2, 3]), rnd.choice([1, 2, 3])
        texts = [bytes(rnd.randint(1, letters) for _ in range(rnd.randint(span, 9))) for _ in range(rnd.randint(1, 12))]
        symbols = np.zeros((len(texts), 9), dtype=np.uint8)
        for i, x in enumerate(texts):
            symbols[i, 9 - len(x) :] = np.frombuffer(x, dtype=np.uint8)
        found = classes(symbols, np.array([len(x) for x in texts]), span, 9)
        of = {}
        for i, x in enumerate(texts):
            for a in range(9):
                if a + span <= len(x):
                    of.setdefault(x[a : a + span], set()).add(int(found[i, a]))
                else:
                    assert found[i, a] == -1
        assert all(len(v) == 1 for v in of.values()) and len({min(v) for v in of.values()}) == len(of)


@pytest.mark.parametrize("crowd", [repeated_spans.STRINGS, 2])
def test_spans(spark, crowd):
    check_spans(spark, ODD, crowd=crowd)
    rnd = random.Random(crowd)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(30) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [text(rnd.randint(1, 40)) for _ in range(3)]
        for _ in range(rnd.randint(0, 3)):
            passage = rnd.choice(passages)
            a = rnd.randint(0, 60)
            parts.insert(rnd.randint(0, len(parts)), passage[a : a + rnd.randint(40, 120)])
        rows.append((rnd.randint(0, 90), rnd.choice(["", " "]).join(parts), 1, "", "", 1))
    rows += [(r[0] + 1, *r[1:]) for r in rows[:20]] + [(200 + i, passages[0], 1, "", "", 1) for i in range(40)]
    check_spans(spark, rows, crowd=crowd)


def test_spans_in_pieces(spark, monkeypatch):
    """Long texts in many pieces; each file holds one text."""
    rnd = random.Random(4)
    base = "".join(rnd.choice("ab c") for _ in range(300_000))
    with monkeypatch.context() as m:
        m.setattr(repeated_spans, "SLICE", 1 << 10)
        strings = repeated_spans.Strings([base.encode()], 50)
        assert strings.n.sum() == len(base) - 49
    df = spark.createDataFrame([(1, base), (2, "q" * 70 + base[1000:-500] + "z" * 90)], "doc_id long, text string")
    first, second = sorted(map(tuple, repeated_spans.remove_repeated_spans(df).collect()))
    assert first[1:4] == (300_000, 0, 0)
    assert second[1:4] == (298_660, 298_500, 1)
    assert second[4] == hashlib.sha256(b"q" * 70 + b"z" * 90).hexdigest()


# --- search ----------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return Counter(TERM.findall((text or "").translate(LOW)))


def search_by_hand(docs, items, k):
    docs = [(i, c, sum(c.values())) for i, c in ((i, terms_of(x)) for i, x in docs) if c]
    n, length = len(docs), sum(d[2] for d in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = []
    queries = {}
    for i, x in items:
        queries.setdefault(i, Counter()).update(terms_of(x))
    for item, q in queries.items():
        found = []
        for i, c, size in docs:
            m = 75 + (25 * size * n) // length
            score = sum(
                t * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m))
                for w, t in q.items()
                if w in c
            )
            if score > 0:
                found.append((-score, math.inf if i is None else i, i))
        found.sort(key=lambda f: f[:2])
        out += [(item, r + 1, f[2], -f[0]) for r, f in enumerate(found[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("term_bytes", [automaton_search.TERM_BYTES, 16])
def test_search(spark, term_bytes):
    items = [(1, "The cat, the dog", 1), (2, "", 1), (3, None, 1), (None, "naïve 漢字", 1), (4, "nowhere", 1), (1, "CAT 漢字", 2), (9, "x" * 100_000, 1)]
    docs = spark.createDataFrame(ODD, DOCS)
    got = automaton_search.search(docs, spark.createDataFrame(items, ITEMS), 4, term_bytes=term_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == search_by_hand([r[:2] for r in ODD], [r[:2] for r in items], 4)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_of_whole_tables(spark, table):
    docs, items = table("documents"), table("benchmark")
    got = automaton_search.search(docs.union(docs.where("doc_id < 5")), items)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [r for r in rows if r[0] < 5]
    want = search_by_hand(rows, [(r["item_id"], r["text"]) for r in items.collect()], 20)
    assert sorted(map(tuple, got.collect()), key=str) == want


# --- clusters --------------------------------------------------------------------------


def clusters_by_hand(rows, k, rounds, size=64):
    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    if not rows:
        return []
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    vectors = np.array([r[1] for r in rows])
    means = np.array([r[1] for r in sorted(rows, key=key)[:k]])
    for step in range(rounds + 1):
        squares = ((vectors[:, None] - means[None]) ** 2).sum(axis=2)
        own = squares.argmin(axis=1)
        if step < rounds:
            for j in range(len(means)):
                if (own == j).any():
                    means[j] = vectors[own == j].sum(axis=0) // (own == j).sum()
    distance = squares[np.arange(len(own)), own]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in means.tolist()]
    return sorted(
        (
            (i, int(c), int(d), int(distance[own == c].sum()), int(distance.sum()), digest[c])
            for (i, _), c, d in zip(rows, own, distance)
        ),
        key=str,
    )


def check_clusters(spark, rows, k=8, rounds=10, size=64):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, Cluster int, ids string")
    got = centroids.cluster_vectors(df, k=k, rounds=rounds, size=size)
    assert sorted(map(tuple, got.collect()), key=str) == clusters_by_hand(rows, k, rounds, size)


def test_clusters(spark, table):
    rows = [(r["vec_id"], r["embedding"]) for r in table("embeddings").collect()]
    check_clusters(spark, rows)
    check_clusters(spark, rows, k=3, rounds=1)


def test_clusters_of_odd_tables(spark):
    rnd = np.random.default_rng(2)
    grid = [(int(i), [float(x) for x in rnd.integers(-3, 3, 4) / 4]) for i in rnd.integers(0, 1 << 60, 300)]  # many ties
    odd = [(None, [0.5] * 4), (None, [0.5] * 4), (1, None), (2, [1.0]), (3, [1.0, None, 0.0, 0.0]), (4, [math.nan] * 4), (5, [math.inf] * 4)]
    check_clusters(spark, grid + grid[:50] + odd, size=4)
    check_clusters(spark, odd, size=4)
    check_clusters(spark, grid[:3], size=4)
    check_clusters(spark, [(1, None), (2, [])], size=4)
    check_clusters(spark, [(7, [0.25] * 4)] * 3000 + [(8, [0.5] * 4)], size=4)
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<float>"), size=1).collect()


def test_bounds_save_distances(table):
    """Later rounds measure few distances, and what they assign is what a whole scan assigns."""
    vectors = np.array([[math.floor(1024 * x) for x in r["embedding"]] for r in table("embeddings").collect() if len(r["embedding"] or []) == 64])
    history = vectors[None, :8].astype(np.int64)
    state, measured = {"vectors": vectors.astype(np.int32).tobytes(), "own": b""}, []
    for _ in range(8):
        block = centroids.Block(state, 64, 8)
        measured.append(block.assign(history))
        squares = ((vectors[:, None] - history[-1][None]) ** 2).sum(axis=2)
        assert (block.own == squares.argmin(axis=1)).all()
        state |= {n: getattr(block, n).tobytes() for n in ("own", "upper", "lower", "since")}
        means = [vectors[block.own == j].sum(axis=0) // max((block.own == j).sum(), 1) for j in range(8)]
        history = np.concatenate([history, np.array(means)[None]])
    assert measured[0] == 8 * len(vectors) and measured[-1] < measured[0] / 2


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame(ODD, DOCS)
    assert automaton_search.search(docs, items).count() == 0
    assert automaton_search.search(some, items).count() == 0
    assert automaton_search.search(docs, some.selectExpr("doc_id AS item_id", "text")).count() == 0
    assert repeated_spans.remove_repeated_spans(docs).count() == 0
    assert centroids.cluster_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_a_sample_of_labelled_texts_is_bounded(spark):
    """One id in 20,000 documents, equal ones and different ones."""
    labels = spark.createDataFrame([(1, 1), (6, 0), (8, 1)], "doc_id long, quality int")
    docs = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.lit("the same text").alias("text"))
    docs = docs.union(spark.range(500).select(F.lit(8), F.concat(F.lit("text "), "id")))
    docs = docs.union(spark.createDataFrame([(6, "another"), (6, None)], "doc_id int, text string"))
    sample = quality.labelled_sample(docs, labels, rows=10_000).collect()
    assert len(sample) == len({(r["text"], r["label"]) for r in sample}) == 503
    assert quality.labelled_sample(docs, labels, rows=100).count() == 100
