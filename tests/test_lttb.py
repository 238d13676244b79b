"""LTTB against the direct algorithm, step by step over all points."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowtide.operators.lttb import hull_candidates, lttb


def direct(points, size):
    """Indices kept; points sorted by time."""
    n = len(points)
    if n <= size:
        return list(range(n))
    if size < 3:
        return list(range(size))
    inner = size - 2
    border = [0, *(1 + i * (n - 2) // inner for i in range(inner + 1)), n]
    kept = [0]
    for b in range(1, inner + 1):
        nxt = points[border[b + 1] : border[b + 2]]
        cx, cy = (sum(p[i] for p in nxt) / len(nxt) for i in (0, 1))
        ax, ay = points[kept[-1]]
        best, best_area = None, -1.0
        for i in range(border[b], border[b + 1]):
            x, y = points[i]
            area = abs((ax - cx) * (y - ay) - (ax - x) * (cy - ay))
            if area > best_area:
                best, best_area = i, area
        kept.append(best)
    return kept + [n - 1]


def series(kind, n, seed=0):
    rng = random.Random(seed)
    value = {
        "noise": lambda i: rng.gauss(0, 1),
        "walk": lambda i, s=[0.0]: s.__setitem__(0, s[0] + rng.gauss(0, 1)) or s[0],
        "sine": lambda i: math.sin(i / 40.0),
        "curve": lambda i: (i / 100.0) ** 2,
        "steps": lambda i: float(i // 50),
        "spikes": lambda i: 100.0 if i % 97 == 5 else 0.0,
    }[kind]
    return [(float(i * 3 + rng.random()), value(i)) for i in range(n)]


def run(spark, points, size, **options):
    rows = [(i, x, y) for i, (x, y) in enumerate(points)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double").repartition(5)
    return sorted(r["id"] for r in lttb(df, size, "x", "y", "id", **options).collect())


@pytest.mark.parametrize("kind", ["noise", "walk", "sine", "curve", "steps", "spikes"])
def test_equals_direct(spark, kind):
    points = series(kind, 3000)
    assert run(spark, points, 40, blocks=5) == direct(points, 40)


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)

    def to(n):
        spark.conf.set(name, str(n))

    yield to
    spark.conf.set(name, old)


@pytest.mark.parametrize("rows", [1, 40, 300])
def test_long_chains_walk_as_a_stream(spark, small_batches, rows):
    """Every point of a convex curve is on the hull; buckets of 75 go over many batches."""
    points = series("curve", 1500)
    small_batches(rows)
    assert run(spark, points, 22) == direct(points, 22)


def test_the_plan_does_not_grow_with_the_series(spark, capsys):
    rows = [(s, i, float(i), math.sin(i * (s + 1))) for s in range(30) for i in range(40)]
    df = spark.createDataFrame(rows, "s long, id long, x double, y double")
    plans = []
    for few in (df.where("s < 2"), df):
        lttb(few, 5, "x", "y", "id", "s").explain()
        plans.append(len(capsys.readouterr().out.splitlines()))
    assert plans[0] == plans[1]


def test_small_requests(spark):
    points = series("noise", 20)
    for size in (1, 2, 3, 19, 20, 50):
        assert run(spark, points, size) == direct(points, size)
    with pytest.raises(ValueError):
        run(spark, points, 0)


def test_golden_series_keeps_ends(spark):
    points = [(1000.0 + 100 * i, float(v)) for i, v in enumerate([10.5, 20, 20, 40, 50, 60, 70, 80, 90, 100])]
    kept = run(spark, points, 5)
    assert len(kept) == 5 and kept[0] == 0 and kept[-1] == 9


def test_series_by_key_and_rows_that_are_no_points(spark):
    rows, want = [], []
    for s, (kind, n) in enumerate([("noise", 500), ("walk", 8), ("sine", 300), ("curve", 120)]):
        points = series(kind, n, s)
        name = None if s == 2 else f"s{s}"
        for i, (x, y) in enumerate(points):
            rows.append((name, 1000 * s + i, str(x), y))
        rows += [(name, 1000 * s + 990, "x", 1.0), (name, 1000 * s + 991, "5", None), (name, 1000 * s + 992, "6", math.nan)]
        want += [1000 * s + i for i in direct(points, 12)]
    df = spark.createDataFrame(rows, "s string, id bigint, x string, y double").repartition(6)
    for options in ({}, {"blocks": 7}):
        got = lttb(df, 12, "x", "y", "id", "s", **options)
        assert sorted(r["id"] for r in got.collect()) == sorted(want)


def test_times(spark):
    df = spark.range(500).select("id", F.timestamp_seconds("id").alias("t"), F.sin(F.col("id") / 9).alias("v"))
    points = [(i * 1e6, math.sin(i / 9)) for i in range(500)]
    assert sorted(r["id"] for r in lttb(df, 30, "t", "v", "id").collect()) == direct(points, 30)
    with pytest.raises(TypeError):
        lttb(df.withColumn("a", F.array("id")), 30, "t", "a", "id")


def test_hull_candidates_keep_all_extremes():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 500):
        x, y = np.sort(rng.random(n)), rng.normal(size=n)
        keep = hull_candidates(np.zeros(n, int), x, y)
        for angle in np.linspace(0, 2 * np.pi, 200):
            d = np.cos(angle) * x + np.sin(angle) * y
            assert keep[d >= d.max() - 1e-15].all()
    assert keep.sum() < 60
    flat = hull_candidates(np.zeros(5, int), np.arange(5.0), np.ones(5))
    assert flat.all()  # points on an edge stay, so that ties go to the earliest
    vertical = hull_candidates(np.zeros(4, int), np.ones(4), np.array([0.0, 3.0, -2.0, 1.0]))
    assert vertical[1] and vertical[2]
