"""Block-wise operators against plain Python row loops."""

import random

import pytest
from pyspark.sql import functions as F

from rowtide.operators import lookup
from rowtide.operators.lookup import add_row_index, row_query
from rowtide.operators.sampling import systematic
from rowtide.operators.sparse import compare_orders, expand_sparse, sparsify, sparsity_stats
from rowtide.plans.order import BLOCK, order_rows
from rowtide.sources.stored_order import read_stored_order

BLOCKS = [1, 7]


@pytest.fixture(params=["one step", "two steps"])
def steps(request, monkeypatch):
    """Either way to find the last values of blocks, whatever the key."""
    if request.param == "one step":
        monkeypatch.setattr("rowtide.plans.order._in_two_steps", lambda rows: False)


def fill_loop(rows, group, cols):
    above, result = {}, []
    for row in rows:
        last = above.setdefault(row[group] if group else None, {})
        row = dict(row)
        for c in cols:
            if row[c] is None:
                row[c] = last.get(c)
            last[c] = row[c]
        result.append(row)
    return result


def random_rows(n, seed, users=5):
    rng = random.Random(seed)
    return [
        dict(
            id=i * 3,
            user=None if rng.random() < 0.1 else rng.randrange(users),
            a=rng.choice([None, None, None, 1.5, 2.5]),
            b=rng.choice([None] * 60 + ["x", "y"]),
        )
        for i in range(n)
    ]


SCHEMA = "id bigint, user bigint, a double, b string"


@pytest.mark.parametrize("blocks", BLOCKS)
def test_expand_equals_row_loop(spark, blocks, steps):
    rows = random_rows(1000, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = expand_sparse(df, "id", ["a", "b"], blocks=blocks).orderBy("id").collect()
    assert [r.asDict() for r in got] == fill_loop(rows, None, "ab")


@pytest.mark.parametrize("blocks", BLOCKS)
def test_partitioned_expand_with_a_hot_and_a_null_key(spark, blocks):
    rows = random_rows(1500, 2)
    for i, r in enumerate(rows):
        if i % 3 == 0:
            r["user"] = 1
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = expand_sparse(df, "id", ["a", "b"], "user", blocks=blocks).orderBy("id").collect()
    assert [r.asDict() for r in got] == fill_loop(rows, "user", "ab")


def test_hot_group_is_spread_over_blocks(spark):
    rows = [dict(id=i, user=1 if i % 3 else i, a=None, b=None) for i in range(3000)]
    ordered = order_rows(spark.createDataFrame(rows, SCHEMA), "id", "user", blocks=10)
    sizes = ordered.df.where("user = 1").groupBy(BLOCK).count().collect()
    assert len(sizes) >= 5
    assert max(r["count"] for r in sizes) <= 3 * 300


def test_hot_copies_are_collapsed_and_spread(spark):
    same = spark.range(30_000).select(F.lit(5).alias("v"))
    rest = spark.range(60_000).select((F.col("id") % 50_000).cast("int").alias("v"))
    df = same.unionAll(rest)
    ordered = order_rows(df, None, blocks=8)
    assert ordered.df.where("v = 5").count() == 31
    got = add_row_index(df, None, blocks=8)
    assert got.agg(F.count("*"), F.countDistinct("row_index"), F.max("row_index")).first()[:] == (90_000, 90_000, 89_999)
    first = got.where("v = 5").agg(F.min("row_index"), F.max("row_index")).first()
    assert first[0] == 10 and first[1] - first[0] + 1 == got.where("v = 5").count()
    stats = sparsity_stats(df, None, blocks=8).first()
    assert stats["cells_elided"] == 90_000 - 50_000


def test_copies_of_one_row_split_over_blocks(spark):
    df = spark.range(40_000).select(F.lit("x").alias("v"))
    ordered = order_rows(df, None, blocks=4)
    assert ordered.df.select(BLOCK).distinct().count() >= 3
    assert sparsify(df, None, blocks=4).where("v = ''").count() == 39_999


@pytest.mark.parametrize("blocks", BLOCKS)
def test_row_index_and_queries(spark, blocks):
    ids = random.Random(3).sample(range(10**9), 2000)
    df = spark.createDataFrame([(i, str(i)) for i in ids], "id bigint, t string").repartition(6)
    ordered = sorted(ids)
    got = add_row_index(df, "id", blocks=blocks).collect()
    assert {r["row_index"]: r["id"] for r in got} == dict(enumerate(ordered))

    def found(**q):
        return sorted(tuple(r) for r in row_query(df, "id", blocks=blocks, **q).collect())

    def rows(at):
        return [(i, ordered[i], str(ordered[i])) for i in at]

    assert found(row_numbers=[5, 0, 1999, 5000]) == rows([0, 5, 1999])
    assert found(rowid_range=(10, 20)) == rows(range(9, 20))
    assert found(rowid_set={1, 300}) == rows([0, 299])
    assert found(row_numbers=range(0, 2400, 2)) == rows(range(0, 2000, 2))
    assert found(row_numbers=[]) == []
    assert found(row_numbers=[3], rowid_range=(1, 2)) == rows([3])
    with pytest.raises(ValueError):
        found()


def test_row_query_reads_only_the_keys_it_needs(spark, table):
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)  # else plans are shown cut off
    orders = table("orders", "sf0.01")
    plan = row_query(orders, "o_orderkey", rowid_range=(7000, 7010), blocks=20)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThanOrEqual(o_orderkey" in text
    assert [r["row_index"] for r in plan.orderBy("row_index").collect()] == list(range(6999, 7010))


@pytest.mark.parametrize("position", [0, 1, 700, 1500])
def test_row_query_on_text_keys(spark, position):
    keys = [None] + sorted({f"{i * 7919 % 100003:05d}'\\" for i in range(1600)})
    df = spark.createDataFrame([(k,) for k in reversed(keys)], "k string").repartition(4)
    got = row_query(df, "k", row_numbers=[position], blocks=8).collect()
    assert [tuple(r) for r in got] == [(position, keys[position])]


def test_text_keys_with_nulls_are_cut_in_order(spark):
    rng = random.Random(5)
    keys = [None] + ["".join(rng.choice("ab'\"\\é,") for _ in range(12)) for _ in range(1500)]
    keys = list(dict.fromkeys(keys))
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(4)
    ordered = [r["k"] for r in df.orderBy("k").collect()]
    got = add_row_index(df, "k", blocks=6).collect()
    assert {r["row_index"]: r["k"] for r in got} == dict(enumerate(ordered))


def test_hot_first_column_uses_a_longer_key(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.lit(7.5)).alias("h"),
        F.timestamp_seconds("id").alias("ts"),
        "id",
    )
    ordered = order_rows(df, ["h", "ts"], blocks=8)
    sizes = [r["count"] for r in ordered.df.groupBy(BLOCK).count().collect()]
    assert len(sizes) >= 6 and max(sizes) <= 3 * 625
    want = {r["id"]: i for i, r in enumerate(df.orderBy("h", "ts").collect())}
    got = {r["id"]: r["row_index"] for r in add_row_index(df, ["h", "ts"], blocks=8).collect()}
    assert got == want


@pytest.mark.parametrize("blocks", BLOCKS)
def test_sparsify_then_expand_is_identity(spark, blocks, steps):
    rows = random_rows(800, 4, users=2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sparse = sparsify(df, "id", blocks=blocks)
    loop, last = [], None
    for r in rows:
        cells = {c: "NULL" if r[c] is None else str(r[c]) for c in ("user", "a", "b")}
        loop.append({"id": r["id"], **{c: "" if last and last[c] == r[c] else cells[c] for c in cells}})
        last = r
    assert [r.asDict() for r in sparse.orderBy("id").collect()] == loop
    back = expand_sparse(sparse, "id", null_values=["NULL"], blocks=blocks)
    back = back.select("id", F.col("user").cast("bigint"), F.col("a").cast("double"), "b")
    assert [r.asDict() for r in back.orderBy("id").collect()] == rows


def test_nan_repeats_nan_and_ambiguous_text_raises(spark):
    df = spark.createDataFrame([(1, float("nan"), "x"), (2, float("nan"), "x")], "id int, v double, t string")
    assert sparsify(df, "id").orderBy("id").collect()[1][:] == (2, "", "")
    bad = spark.createDataFrame([(1, "a"), (2, " ")], "id int, t string")
    with pytest.raises(Exception, match="would be read as a marker"):
        sparsify(bad, "id").collect()
    assert sparsify(bad, "id", on_ambiguous="keep").count() == 2


def test_stats_and_order_comparison(spark):
    df = spark.createDataFrame(
        [(1, "u", 10), (2, "u", 20), (3, "v", 20), (4, "u", 10)], "id int, a string, b int"
    )
    stats = {r["column"]: r[1:] for r in sparsity_stats(df, "id").collect()}
    assert stats == {"id": (4, 0, 0), "a": (4, 1, 1), "b": (4, 1, 2)}
    best = {r["sort_order"]: r["cells_elided"] for r in compare_orders(df, [["id"], ["a", "b"]], ["a", "b"]).collect()}
    assert best == {"id": 2, "a,b": 4}  # u10 u10 u20 v20: two cells of each column


def test_stored_order(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 4).select((F.col("id") * 7 % 1000).alias("v")).write.parquet(path)
    df = read_stored_order(spark, path)
    want = {}
    for file in sorted(spark.read.parquet(path).inputFiles()):
        for r in spark.read.parquet(file).collect():
            want[len(want)] = r["v"]
    assert {r["row_index"]: r["v"] for r in df.collect()} == want
    picked = row_query(df, row_numbers=[3, 500], row_index="row_index").collect()
    assert sorted(tuple(r) for r in picked) == [(3, want[3]), (500, want[500])]
    plan = systematic(df, 10, start=4, row_index="row_index")
    assert sorted(r["v"] for r in plan.collect()) == sorted(v for i, v in want.items() if i % 10 == 4)
    assert "hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        read_stored_order(spark, path, "v")


@pytest.mark.parametrize("blocks", [None, 1, 9])
def test_long_position_lists(spark, blocks):
    """Lists and tables of positions, with gaps, repeats and positions beyond the table."""
    df = spark.range(20_000).selectExpr("id * 3 as k", "id % 7 as v").repartition(5)
    wanted = sorted({i * i % 26_000 for i in range(6000)} - {-1})
    want = [(i, i * 3, i % 7) for i in wanted if i < 20_000]
    table = spark.createDataFrame([(i + 1,) for i in wanted + wanted[:50]], "p int")
    for q in ({"row_numbers": wanted}, {"rowid_set": {i + 1 for i in wanted}}, {"rowid_set": table}):
        assert sorted(tuple(r) for r in row_query(df, "k", blocks=blocks, **q).collect()) == want
    assert row_query(df, "k", row_numbers=[], blocks=blocks).count() == 0
    assert row_query(df, "k", row_numbers=[-1, 20_000], blocks=blocks).count() == 0


def test_few_positions_read_few_blocks(spark):
    df = spark.range(20_000).selectExpr("id as k")
    picked = row_query(df, "k", row_numbers=[3, 19_999], blocks=40)
    assert sorted(r["k"] for r in picked.collect()) == [3, 19_999]
    held = lookup._holding(
        spark.createDataFrame([(b, 500 * b, 500) for b in range(40)], "b int, __rt_start bigint, __rt_count bigint"),
        spark.createDataFrame([(3,), (499,), (500,), (19_999,)], "__rt_wanted bigint"),
        20_000,
    )
    assert sorted(r["b"] for r in held.collect()) == [0, 1, 39]


@pytest.mark.parametrize("order", ["id", ["user", "id"]])
def test_plans_do_not_grow_with_the_number_of_borders(spark, order):
    """The optimizer repeats the block's expression in the filters it moves; borders are constants."""
    df = spark.range(20_000).selectExpr("id", "id % 3 as user")
    rows = order_rows(df, order, blocks=2_000)
    assert len(rows.borders.texts[0]) > 1_000 and len(rows.borders.keys) == (1 if order == "id" else 2)
    plan = rows.df.where(F.col(BLOCK) > 5)._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("CASE WHEN") <= 2
    assert "from_json" not in plan.toString() and "arrays_zip" not in plan.toString()
    by = order if isinstance(order, list) else [order]
    cuts = sorted(tuple(int(v) for v in values) for values in zip(*rows.borders.texts))
    for r in rows.df.where("id % 500 = 7").collect():
        assert r[BLOCK] == sum(cut <= tuple(r[c] for c in by) for cut in cuts)


def test_values_are_carried_through_blocks_without_any(spark, steps):
    df = spark.range(200).selectExpr("id", "case when id in (3, 120) then id end as v")
    full = expand_sparse(df, "id", ["v"], blocks=20)
    assert [r["v"] for r in full.orderBy("id").collect()] == [None] * 3 + [3] * 117 + [120] * 80
