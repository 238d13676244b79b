"""The operators against brute force, the libraries they reproduce, and odd tables."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from rowtide.llm import (
    byte_bpe,
    elias_fano,
    embedding_dedup,
    fuzzy_lines,
    lsh_forest,
    mixing,
    quality,
    threshold_topk,
    token_blocks,
    trie_lm,
    warc,
)
from rowtide.llm.chunk_cache import TextEncoder
from rowtide.llm.components import connected_components

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "The cat sat on the mat and looked at the dog.\nSecond line here.", "en", "a", 10),
    (1, "The cat sat on the mat and looked at the dog.\nSecond line here.", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (None, "  \n\t ", "en", "b", 5),
    (5, "word " * 30_000, "en", None, 9),
    (6, "x" * 200_000, "en", "b", 9),
    (7, "漢字 😀 naïve\r\nThe CAT", "zh", "c", 9),
]


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def groups(n, links):
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(root[i], root[j])
            changed |= root[i] != low or root[j] != low
            root[i] = root[j] = low
    return root


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("size", F.lit("clash")).withColumn("Score", F.lit(1))


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


def test_components(spark):
    rnd = random.Random(3)
    links = [(k, k + 1) for k in range(40, 90)] + [(rnd.randrange(30), rnd.randrange(30)) for _ in range(20)]
    links += [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = connected_components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()
    want = groups(140, [p for p in links if None not in p])
    assert {r["node"]: r["component"] for r in got} == {i: want[i] for p in links if None not in p and p[0] != p[1] for i in p}
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(160):
        v = base[i % 12] + rng.normal(size=16) * rng.choice([0, 0.05, 0.12, 0.2])
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [None] * 16, 1), (204, rows[0][1], None)]
    rows += [(205, [], 0), (206, [1.0], 0), (207, [2.0], 0), (208, [float("inf")] * 16, 0), rows[1], rows[1]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit(0))
    links = []
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            ok = a[2] is not None and a[2] == b[2] and a[1] and b[1] and len(a[1]) == len(b[1])
            if ok and all(x is not None and math.isfinite(x) for x in a[1] + b[1]) and any(a[1]) and any(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links.append((i, j))
    n = Counter(i for pair in links for i in pair)
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    place = {i: k for k, i in enumerate(order)}
    root = groups(len(rows), [(place[i], place[j]) for i, j in links])
    want = Counter()
    for i, r in enumerate(rows):
        component = rows[order[root[place[i]]]][0]
        want[r[0], n[i], component, r[0] == component] += 1
    for tile in (2048, 7):
        assert Counter(tuple(r) for r in embedding_dedup.link_vectors(df, tile=tile).collect()) == want
    assert len(links) > 50 and embedding_dedup.link_vectors(df.where("false")).count() == 0


def test_quantisation_bound():
    rng = np.random.default_rng(1)
    u = rng.normal(size=(200, 24))
    u /= np.linalg.norm(u, axis=1)[:, None]
    q, scale, rounded, left = embedding_dedup.quantised(u)
    near = (q.astype(float) @ q.T.astype(float)) * scale[:, None] * scale
    assert (abs(u @ u.T - near) <= left[:, None] * rounded + left + 1e-12).all()


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 7]) for i in range(300)]
    rows += [(400, None), (500, [float("nan")] * 6), (600, [None] * 6), (None, [1.0] * 6), (700, [0.0] * 6), (800, [1.0, 2.0])]
    rows += [rows[3], rows[100]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    want = set()
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and x == x for x in v)]
    for i, v in good:
        if i % 100 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(v) == len(w))[:10]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(found)}
    for blocks in ({}, {"candidates": 40, "queries": 2}):
        assert {tuple(r) for r in threshold_topk.top_k(df, "vec_id % 100 = 0", **blocks).collect()} == want
    assert threshold_topk.top_k(df.where("false"), "vec_id % 100 = 0").count() == 0


def test_quality(spark, table, odd, nothing):
    got = quality.score_documents(table("documents"), table("labels")).join(table("labels"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.9 * len(held)
    labels = table("labels")
    rows = quality.score_documents(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    none = quality.score_documents(odd, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.score_documents(nothing, labels).count() == 0
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns


def test_warc(spark):
    long_ = "é" * 600
    rows = [(1, "u1", long_), (2, "u\r\n2", long_), (3, None, long_), (3, "again", long_), (None, "n", long_), (4, "u", None)]
    rows += [(5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "z" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit(0))
    got = Counter(tuple(r) for r in warc.archive_digests(df.repartition(3)).collect())
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and h == long_ and i is not None and i < 3
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None] += 1
    assert got == want
    assert warc.archive_digests(df.where("false")).count() == 0


def test_warc_files_and_ranges(spark):
    assert list(warc.ranges([(0, 5), (5, 5), (100, 5)], gap=10)) == [[(0, 5), (5, 5)], [(100, 5)]]
    assert list(warc.ranges([(0, 5), (5, 5)], most=9)) == [[(0, 5)], [(5, 5)]]
    df = spark.createDataFrame([(1, "u", "a" * 2000), (2, "v", "a" * 2000)], "page_id long, url string, html string")
    index = warc.write_warc(df, warc.shared_folder(spark, "t")).collect()
    for r in index:
        with open(r["file"].removeprefix("file://"), "rb") as f:
            f.seek(r["offset"])
            headers, block = warc.parse_record(gzip.decompress(f.read(r["length"])))
        assert headers["WARC-Target-URI"] == r["url"] and headers["WARC-Type"] == r["record_type"]
        assert block == (b"" if r["record_type"] == "revisit" else b"a" * 2000)


def test_blocks():
    rng = np.random.default_rng(1)
    n = 3 * token_blocks.BLOCK
    for x in (rng.integers(0, 50_000, n), np.zeros(n), rng.integers(0, 2**32, n), np.where(rng.random(n) < 0.05, 2**32 - 1, 7)):
        x = x.astype(np.uint32)
        blocks = token_blocks.encode_blocks(x)
        starts = np.cumsum([0] + [len(b) for b in blocks])[:-1]
        assert (token_blocks.decode_blocks(np.frombuffer(b"".join(blocks), np.uint8), starts) == x).all()


def test_token_files(spark, odd, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = token_blocks.token_index(odd.repartition(3), TOKENIZER).orderBy("start").collect()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [r[0] for r in order]
    at = 0
    for r, row in zip(got, order):
        ids = np.array(tokenizer.encode(row[1] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_blocks.token_index(nothing, TOKENIZER).count() == 0


def test_chunks_equal_whole_texts():
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    one = lambda s: np.array(tokenizer.encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes()
    chunked = TextEncoder(one, ["<|endoftext|>"])
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab cde \n\t  THE'sé漢字😀.,! 12　\x1c\r") for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    texts += ["a\n <|endoftext|> b", "a" * 3000, "ab" * 900, " " * 50, "".join(map(chr, range(32, 3000)))]
    for t in texts:
        assert chunked(t) == one(t)
        ids = bpe.text_ids(t)
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(t)
        assert bpe.decode(ids) == t.encode()


def test_byte_bpe_tables(odd, nothing):
    got = byte_bpe.token_digests(odd, RANKS, public_tokenizers.PATTERN).collect()
    digests = Counter((r["doc_id"], r["decoded_sha256"]) for r in got)
    assert digests == Counter((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in ODD)
    assert byte_bpe.token_digests(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    there = byte_bpe.encode_documents(odd, RANKS, public_tokenizers.PATTERN)
    back = byte_bpe.detokenize(there, RANKS, public_tokenizers.PATTERN).select("text", "bytes").collect()
    assert all((r["text"] or "").encode() == bytes(r["bytes"]) for r in back)


def test_mixing(table, odd, nothing):
    for df in (table("documents"), odd.drop("size")):
        rows = mixing.mix(df, block_words=64, shard_documents=3).collect()
        assert Counter(r["size"] for r in rows) == Counter(len(words_of(r["text"])) for r in df.collect())
        by = {}
        for r in rows:
            assert 0 <= r["taken"] <= 2 * r["size"]
            by.setdefault(r["source"], []).append(r)
        names = sorted(by, key=lambda s: (s is None, s))
        sizes = {s: sum(r["size"] for r in by[s]) for s in names}
        target, weight = {}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        free, wanted = set(names), 1.5 * sum(sizes.values())
        while free:
            level = (wanted - sum(target.values())) / sum(weight[s] for s in free)
            full = [s for s in free if level * weight[s] > 2 * sizes[s]]
            target |= {s: 2 * sizes[s] for s in full} or {s: level * weight[s] for s in free}
            free = free - set(full) if full else set()
        for s in names:
            assert by[s][0]["target"] == pytest.approx(target[s])
            assert abs(sum(r["taken"] for r in by[s]) - target[s]) <= 1
    again = mixing.mix(odd).columns
    assert again[-4:] == ["_size", "source_size", "target", "taken"] and mixing.mix(nothing).count() == 0
    copies = mixing.mixed_rows(table("documents"))
    assert sum(len(words_of(r["text"])) for r in copies.collect()) == sum(r["taken"] for r in mixing.mix(table("documents")).collect())


def test_apportionment(spark):
    rnd = random.Random(4)
    for _ in range(4):
        votes = [float(rnd.choice([0, 1, 2, 5, 10, 100, 1000])) for _ in range(25)]
        seats = rnd.randint(0, 150)
        df = spark.createDataFrame([(i, v, seats) for i, v in enumerate(votes)], "i int, v double, n long")
        want = [0] * 25
        for _ in range(seats):
            want[max(range(25), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        got = {r["i"]: r["s"] for r in mixing.apportioned(df, [], ["i"], "v", "n", "s").collect()}
        assert [got[i] for i in range(25)] == want


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in ((1000, 10**6), (5000, 5000), (1, 10), (300, 2**60), (2000, 3)):
        x = np.sort(rng.integers(0, u, n)).astype(np.uint64)
        e = elias_fano.EliasFano(elias_fano.EliasFano.arrays("x", x, u), "x")
        assert (e.access(np.arange(n)) == x).all()
        asked, zero = rng.integers(0, u, 300), np.zeros(300, dtype=np.int64)
        assert (e.successor(asked, zero, zero + n) == np.searchsorted(x, asked.astype(np.uint64))).all()


def test_trie(spark, table, odd, nothing):
    docs = table("documents")
    toks = {r["doc_id"]: [*words_of(r["text"]), None] for r in docs.collect()}
    train = [i for i in toks if zlib.crc32(str(i).encode()) % 7 != 2]
    counts, grams = Counter(), {2: Counter(), 3: Counter()}
    for i in train:
        counts.update(toks[i])
        for n in grams:  # a text begins after one end
            grams[n].update(zip(*[[None, *toks[i]][k:] for k in range(n)]))
    n, v = sum(counts.values()), len(counts)
    contexts = {2: counts, 3: grams[2]}
    left = {n: Counter() for n in grams}  # the mass that a context's continuations have
    for size, found in grams.items():
        for gram, c in found.items():
            context = gram[0] if size == 2 else gram[:2]
            left[size][context] += (c - 0.75) / contexts[size][context]

    def chance(before, w):
        p = max(counts[w] - 0.75, 0) / n + 0.75 * v / n / (v + 1)
        for size in (2, 3):
            context = before[-1] if size == 2 else tuple(before[-2:])
            if len(before) >= size - 1 and contexts[size][context]:
                share = max(grams[size][(*before[1 - size :], w)] - 0.75, 0) / contexts[size][context]
                p = share + (1 - left[size][context]) * p
        return p

    small = trie_lm.train(docs.where("crc32(cast(string(doc_id) as binary)) % 7 <> 2"), shard_bytes=1 << 16)
    assert small.bits >= 2 and (small.tokens, small.words) == (n, v)
    better = [0.0, 0.0]
    for r in trie_lm.score_documents(docs).collect():
        words = toks[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        exact = sum(math.log10(chance(([None, *words])[: k + 1], w)) for k, w in enumerate(words))
        assert r["score"] == pytest.approx(exact, abs=0.02 * len(words))  # probabilities are rounded to 8 bits
        if r["held_out"]:
            better = [better[0] + r["score"], better[1] + r["base_score"]]
    assert better[0] > better[1]
    rows = trie_lm.score_documents(odd, order=3).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(words_of(r[1])) + 1 for r in ODD)
    assert trie_lm.score_documents(nothing).count() == 0


def test_near_duplicates(spark, odd, nothing):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(80)]
        for _ in range(rnd.choice([1, 3, 90])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 2, 6])):
                copy[rnd.randrange(80)] = word()
            texts.append(" ".join(copy))
    texts += ["a b", "A  b", "one", None, "", "one"]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1))
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    root = groups(len(sets), links)
    got = lsh_forest.near_duplicates(df).collect()
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in enumerate(sets)}
    # at the threshold itself a link may be missed: most copies here differ in 6 or 12 words of 80
    missed = {r["doc_id"] for r in got if r["component_id"] != root[r["doc_id"]]}
    assert len(missed) <= 0.03 * len(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = lsh_forest.one_of_each(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["kept"]) and kept.columns == df.columns
    assert lsh_forest.near_duplicates(odd).count() == len(ODD) and lsh_forest.near_duplicates(nothing).count() == 0
    assert lsh_forest.one_of_each(odd).count() == len(ODD) - 1


def test_lines(spark, odd, nothing):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    base = [" ".join(word() for _ in range(rnd.choice([1, 4, 30, 60]))) for _ in range(40)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(4):
            line = rnd.choice(base).split(" ")
            if rnd.random() < 0.5:
                line[rnd.randrange(len(line))] = word()
            lines.append(" ".join(line))
        texts.append("\n".join([*lines, "", "common"]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_lines", F.lit(1))
    lines = [(i, k, line) for i, t in enumerate(texts) for k, line in enumerate(t.split("\n")) if line.strip()]
    sets = [{x[k : k + 8] for k in range(len(x) - 7)} or {x} for *_, x in lines]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = groups(len(sets), links)
    stay = {lines[r][:2] for r in root}
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip() or (i, k) in stay) for i, t in enumerate(texts)}
    got = fuzzy_lines.drop_repeated_lines(df).collect()
    assert sum(r["text"] != want[r["doc_id"]] for r in got) <= 1  # MinHash may miss a link
    assert got[0]["_n_lines"] == 5 and sum(r["n_kept"] for r in got) >= len(stay)
    rows = fuzzy_lines.drop_repeated_lines(odd).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(r[:2] for r in ODD)
    assert fuzzy_lines.drop_repeated_lines(nothing).count() == 0


def test_no_python_in_native_plans(table):
    for df in (mixing.mix(table("documents")), fuzzy_lines.drop_repeated_lines(table("documents"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
