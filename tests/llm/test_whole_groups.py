"""Crowded groups: what shares most of a template is linked exactly where it is alike."""

import random
import re
import time

import numpy as np

from pyspark.sql import functions as F

from rowtide.llm import fuzzy_lines, lsh_forest, mixing, trie_lm
from rowtide.plans import staging


def jaccard(a, b):
    return len(a & b) / len(a | b)


def shingles(line):
    return {line[i : i + 8] for i in range(len(line) - 7)}


def words(rnd, n):
    return [("%06x" % rnd.getrandbits(24))[: rnd.randint(3, 6)] for _ in range(n)]


def templated(rnd, n, pairs, head, tail, changed):
    """n texts with one beginning; of the first ones, ``pairs`` have a twin with some last words changed."""
    begin = words(rnd, head)
    out = []
    for i in range(n):
        own = words(rnd, tail)
        out.append(" ".join(begin + own))
        if i < pairs:
            out.append(" ".join(begin + own[: tail - changed] + words(rnd, changed)))
    return out


def kept_lines(df):
    return {r["doc_id"] for r in fuzzy_lines.drop_repeated_lines(df).collect() if r["n_kept"]}


def test_lines_of_a_template(spark):
    lines = templated(random.Random(5), 500, 120, 32, 9, 4)
    sets = [shingles(x) for x in lines]
    twins = [i for i in range(0, 240, 2) if jaccard(sets[i], sets[i + 1]) >= 0.8]
    assert len(twins) > 100 and max(jaccard(sets[i], sets[i + 2]) for i in range(0, 240, 2)) < 0.8
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(8)
    kept = kept_lines(df)
    assert set(range(len(lines))) - kept == {i + 1 for i in twins}


def test_lines_of_few_words(spark):
    rnd = random.Random(6)
    lines = []
    for _ in range(60):
        # 240 characters: ten words are just enough for the shingles of words, nine are too few
        parts = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(23)) for _ in range(10)]
        lines += [" ".join(parts) + "x", " ".join(parts[:9]) + parts[9] + "x"]
    sets = [shingles(x) for x in lines]
    assert min(jaccard(sets[i], sets[i + 1]) for i in range(0, 120, 2)) > 0.9
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(8)
    assert kept_lines(df) == set(range(0, 120, 2))


def test_bands_of_all_regions(spark):
    # hashes of the last two regions alone
    df = spark.sql("SELECT array(array(1500000000, 1600000000, 2000000000), cast(array() AS array<int>)) AS sketch")
    assert len(df.select(fuzzy_lines._bands(df["sketch"]).alias("b")).first()["b"]) == 2


def test_documents_of_a_template(spark):
    texts = templated(random.Random(7), 500, 120, 160, 40, 10)
    sets = [{tuple(x.split()[i : i + 3]) for i in range(198)} for x in texts]
    assert min(jaccard(sets[i], sets[i + 1]) for i in range(0, 240, 2)) >= 0.85
    assert max(jaccard(sets[i], sets[i + 2]) for i in range(0, 240, 2)) < 0.85
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    rows = lsh_forest.near_duplicates(df).collect()
    twins = set(range(1, 240, 2))
    assert {r["doc_id"] for r in rows if not r["kept"]} == twins
    assert all(r["component_id"] == r["doc_id"] - (r["doc_id"] in twins) for r in rows)


def test_trie_keeps_long_contexts_and_single_ngrams(spark):
    rnd = random.Random(8)
    texts = [" ".join(words(rnd, 30)) for _ in range(20)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model = trie_lm.Model(trie_lm.train(df))
    trigrams = {tuple(w[i : i + 3]) for w in map(str.split, texts) for i in range(28)}
    assert len(model.levels) == 2 and model.size(3) >= len(trigrams)


def test_stretches_of_the_drawn_blocks(spark):
    text = " " + " ".join(f"w{i}" for i in range(1000)) + " "
    df = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")
    rows = [r["text"].split() for r in mixing.mixed_rows(df, share=0.4, block_words=10).collect()]
    places = [[int(w[1:]) for w in row] for row in rows]
    assert all(p == list(range(p[0], p[0] + len(p))) for p in places)
    taken = sorted(i for p in places for i in p)
    assert len(taken) == len(set(taken)) == 400 and taken[-1] > 800
    assert all(p[0] % 10 == 0 and len(p) % 10 == 0 for p in places)


def test_counts_leave_at_a_fixed_size(monkeypatch):
    monkeypatch.setattr(trie_lm, "HELD", 100)
    rnd = np.random.default_rng(9)
    seen = [rnd.integers(0, 400, 60).astype(np.uint64) for _ in range(50)]
    tally, runs = trie_lm.Tally(), []
    for keys in seen:
        runs += tally.add(keys)
        assert tally.held < 200
    runs += tally.rest()
    assert len(runs) > 5 and not list(tally.rest())
    assert all((np.diff(k.astype(np.int64)) > 0).all() for k, _ in runs)
    got = trie_lm.summed(*(np.concatenate(x) for x in zip(*runs)))
    want = np.unique(np.concatenate(seen), return_counts=True)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_shards_of_the_trie_hold_their_own_contexts_only(spark):
    rnd = random.Random(10)
    texts = [" ".join(f"w{rnd.randrange(3000)}" for _ in range(200)) for _ in range(250)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")

    model = trie_lm.Model(trie_lm.train(df, shard_bytes=1 << 14))
    shards = [s for level in model.levels for s in level if s]
    assert len(shards) == 64
    assert all(s.pointers.n <= s.words.n + 1 for s in shards)


def test_written_tables_leave_no_shuffle_files(spark):
    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {m.group() for m in re.finditer(r"shuffle_\d+_\d+_\d+[.]data", blocks.mkString(" "))}

    before, asked = shuffles(), spark.conf.get(staging.CLEANUP)
    rows = spark.range(100_000).groupBy((F.col("id") % 1000).alias("g")).agg(F.count("id").alias("n"))
    written = staging.stage(rows.repartition(8, "n"), "test-shuffles")
    left = shuffles() - before
    for _ in range(50):  # they are removed in the background
        if not left:
            break
        time.sleep(0.2)
        left = shuffles() - before
    assert not left
    assert written.count() == 1000
    assert spark.conf.get(staging.CLEANUP) == asked
    staging.release(written)


def test_bands_begin_at_borders(spark):
    """Also where a hash is the border itself, and where regions stay empty."""
    rnd = random.Random(14)
    borders = fuzzy_lines._borders()
    sets = [[], [5], [-(2**31)], [2**31 - 1], borders, [b - 1 for b in borders], sorted([*borders, *(b - 1 for b in borders)])]
    sets += [sorted({rnd.randrange(-(2**31), 2**31) for _ in range(n)}) for n in (2, 15, 16, 17, 40, 300)]
    sets += [sorted({rnd.randrange(0, 2**29) for _ in range(60)})]
    df = spark.createDataFrame([(i, [x, []]) for i, x in enumerate(sets)], "hash long, sketch array<array<int>>")
    few = {r["hash"]: r["bands"] for r in fuzzy_lines._all_bands(df).collect()}
    first = {r["hash"]: r["b"] for r in df.select("hash", fuzzy_lines._bands(F.col("sketch")).alias("b")).collect()}
    for i, x in enumerate(sets):
        regions = len({(v + 2**31) * fuzzy_lines.REGIONS >> 32 for v in x})
        assert len(first[i]) == regions and set(first[i]) <= set(few[i])
        assert len(few[i]) == (len(x) if len(x) <= fuzzy_lines.FEW else regions)
