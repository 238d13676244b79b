"""Samplers: exact sizes, repeatability, independence of partitioning."""

import hashlib

import pytest
from pyspark.sql import functions as F

from rowtide.operators import sampling
from rowtide.operators.lookup import add_row_index
from rowtide.operators.sampling import bernoulli, bernoulli_fast, cluster, reservoir, sample, systematic


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def md5(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def test_bernoulli(spark):
    df = spark.range(5000)
    want = [i for i in range(5000) if md5(3, i)[:8] < f"{int(0.2 * 2**32):08x}"]
    assert ids(bernoulli(df, 0.2, "id", 3)) == want and 800 < len(want) < 1200
    assert ids(bernoulli(df.repartition(13), 0.2, "id", 3)) == want
    assert bernoulli(df, 0.0, "id").count() == 0 and bernoulli(df, 1.0, "id").count() == 5000
    assert bernoulli_fast(df, 1.0).count() == 5000
    for p in (-0.1, 1.1):
        with pytest.raises(ValueError):
            bernoulli(df, p, "id")


@pytest.mark.parametrize("size", [1, 7, 500, 4999, 5000, 9000])
def test_reservoir_takes_the_smallest_hashes(spark, size):
    df = spark.range(5000).repartition(9)
    want = sorted(sorted(range(5000), key=lambda i: md5(5, i))[:size])
    assert ids(reservoir(df, size, "id", 5)) == want


def test_reservoir_is_even_over_rows(spark):
    df = spark.range(1000)
    halves = [sum(i < 500 for i in ids(reservoir(df, 100, "id", seed))) for seed in range(6)]
    assert 230 < sum(halves) < 370
    with pytest.raises(ValueError):
        reservoir(df, 0, "id")
    assert reservoir(df.limit(0), 5, "id").count() == 0


def test_nothing_is_sorted_or_gathered(spark):
    """The sample is a filter on about twice as many rows, written out."""
    df = spark.range(100_000)
    picked = sampling._smallest(df, sampling.row_hash(1, "id"), 50, ["id"])
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and "TakeOrdered" not in plan
    read = picked._jdf.queryExecution().optimizedPlan().collectLeaves().head()
    assert spark.read.parquet(read.relation().location().rootPaths().head().toString()).count() < 200
    hashed = sorted((hashlib.md5(f"1:{i}".encode()).hexdigest(), i) for i in range(100_000))
    assert ids(picked) == sorted(i for _, i in hashed[:50])


@pytest.mark.parametrize("size", [1, 700, 701, 1500, 2500])
def test_borders_among_equal_keys(spark, size):
    """A hot key fills most of the table: its rows are taken as far as they are needed."""
    rows = [(7, i) for i in range(1500)] + [(i, 0) for i in range(1000, 2000)]
    df = spark.createDataFrame(rows, "id bigint, n bigint")
    got = reservoir(df, size, "id", 1).collect()
    hashed = sorted(hashlib.md5(f"1:{r[0]}".encode()).hexdigest() for r in rows)
    assert sorted(hashlib.md5(f"1:{r['id']}".encode()).hexdigest() for r in got) == hashed[:size]
    assert len(set(got)) == size


@pytest.mark.parametrize("blocks", [1, 6])
def test_systematic(spark, blocks):
    df = spark.createDataFrame([(i * 7 % 1009,) for i in range(1009)], "id bigint")
    assert ids(systematic(df, 100, "id", start=17, blocks=blocks)) == list(range(17, 1009, 100))
    assert len(ids(systematic(df, 2000, "id", start=1500, blocks=blocks))) == 0
    with_index = add_row_index(df, "id")
    assert ids(systematic(with_index, 100, start=17, row_index="row_index")) == list(range(17, 1009, 100))
    starts = {sampling.systematic_start(100, s) for s in range(50)}
    assert len(starts) > 20 and all(0 <= s < 100 for s in starts)
    for bad in (dict(block_size=0), dict(block_size=5, start=5)):
        with pytest.raises(ValueError):
            systematic(df, order_by="id", **bad)


def test_cluster(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 != 3, F.col("id") % 10).alias("k"))
    for seed in range(4):
        picked = cluster(df, "k", n_clusters=3, seed=seed)
        keys = {r["k"] for r in picked.select("k").distinct().collect()}
        assert len(keys) == 3 and picked.count() == 900
    everything = cluster(df, "k", n_clusters=99)
    assert everything.count() == 3000
    assert cluster(df, "k", sample_size=2).count() == 600
    assert cluster(df, "k", n_clusters=1, sample_size=5).count() == 300
    with_null = [s for s in range(12) if cluster(df, "k", n_clusters=5, seed=s).where("k is null").count()]
    assert with_null and len(with_null) < 12
    with pytest.raises(ValueError):
        cluster(df, "k")


def test_cluster_without_broadcast(spark):
    df = spark.range(2000).select("id", (F.col("id") % 400).alias("k"))
    want = ids(cluster(df, "k", n_clusters=50, seed=2))
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert ids(cluster(df, "k", n_clusters=50, seed=2)) == want and len(want) == 250
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_dispatch(spark):
    df = spark.range(100)
    assert sample(df, "bernoulli", probability=1.0, key="id").count() == 100
    assert sample(df, "reservoir", size=10, key="id").count() == 10
    assert sample(df, "system", block_size=10, order_by="id").count() == 10
    assert sample(df, "cluster", field="id", n_clusters=4).count() == 4
    points = df.withColumn("v", F.col("id") * 1.0)
    assert sample(points, "lttb", sample_size=5, time_field="id", value_field="v", key="id").count() == 5
    with pytest.raises(ValueError):
        sample(df, "snowball")
