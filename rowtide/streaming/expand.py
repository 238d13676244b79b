"""Expand over a stream: the last values of a key carry over from batch to batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowtide.functions.markers import Inherit
from rowtide.operators.sparse import expand_sparse
from rowtide.plans.staging import remove
from rowtide.sources.manifests import folders


def expand_stream(
    stream: DataFrame,
    order_by: str,
    cols: Sequence[str],
    out: str,
    state: str,
    checkpoint: str,
    partition_by: Sequence[str] | str = (),
    inherit: Inherit = "whitespace",
    **trigger,
) -> StreamingQuery:
    """Append the expanded rows of a stream to the table ``out`` (partitioned by batch).

    Each batch is expanded with the batch operator, so a hot key is spread over tasks.
    What the next batches need, the last values per key, lies at ``state`` as runs of
    batches: after batch n there is a run for each one bit of n + 1, as long as its value,
    with a row for each key. A batch writes one run, merged from its own keys and the
    shorter runs before; what it covers is removed when the next batch begins. So there are at
    most log2(batches) + 1 runs, none larger than the number of keys. Runs are named by batch
    numbers, so a batch run again replaces its own. Rows at or before the last order key
    already emitted for their key come too late and are dropped.
    """
    keys = [partition_by] if isinstance(partition_by, str) else list(partition_by)

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            _expand_batch(batch, batch_id, order_by, list(cols), keys, out, state, inherit)
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _expand_batch(
    batch: DataFrame,
    batch_id: int,
    order_by: str,
    cols: list[str],
    keys: list[str],
    out: str,
    state: str,
    inherit: Inherit,
) -> None:
    columns = batch.columns
    group = keys or ["__one"]
    if not keys:
        batch = batch.withColumn("__one", F.lit(0))
    runs = _runs(batch.sparkSession, state, batch_id)
    carry = _merged(batch, group, order_by, cols, state, runs)
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"s.{k}")) for k in group]
    on = same[0]
    for part in same[1:]:
        on = on & part

    fresh = (
        batch.alias("b")
        .join(carry.select(*group, F.col(order_by).alias("__last")).alias("s"), on, "left")
        .where(F.col("__last").isNull() | (F.col(f"b.{order_by}") > F.col("__last")))
        .select("b.*")
    )
    # the carried row of a key stands above its first row of this batch
    seeds = carry.alias("s").join(batch.select(*group).distinct().alias("b"), on, "left_semi")
    both = fresh.withColumn("__seed", F.lit(False)).unionByName(
        seeds.withColumn("__seed", F.lit(True)), allowMissingColumns=True
    )
    filled = expand_sparse(both, order_by, cols, group, inherit)
    result = filled.where(~F.col("__seed")).select(*columns)
    result.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    latest = (
        filled.groupBy(*group)
        .agg(F.max_by(F.struct(order_by, *cols), order_by).alias("__row"))
        .select(*group, "__row.*")
    )
    after = batch_id + 1
    begin = after - (after & -after)
    shorter = [r for r in runs if r[0] >= begin]
    if shorter:
        earlier = _merged(batch, group, order_by, cols, state, shorter)
        untouched = earlier.alias("s").join(latest.select(*group).alias("b"), on, "left_anti")
        latest = latest.unionByName(untouched)
    latest.write.mode("overwrite").parquet(_run_path(state, (begin, after)))


def _run_path(state: str, run: tuple[int, int]) -> str:
    return f"{state}/batches-{run[0]:012d}-{run[1]:012d}"


def _runs(spark: SparkSession, state: str, batch_id: int) -> list[tuple[int, int]]:
    """The runs (first batch, batch behind the last) that together hold all batches before
    this one; others of these batches are removed, as the batches they were for are done."""
    names = [n.removeprefix("batches-").split("-") for n in folders(spark, state) if n.startswith("batches-")]
    found = sorted(((int(a), int(b)) for a, b in names if int(b) <= batch_id), key=lambda r: (r[0], -r[1]))
    kept: list[tuple[int, int]] = []
    for run in found:
        if not kept or run[0] >= kept[-1][1]:
            kept.append(run)
        else:
            remove(spark, _run_path(state, run))
    return kept


def _merged(
    batch: DataFrame, group: list[str], order_by: str, cols: list[str], state: str, runs: list[tuple[int, int]]
) -> DataFrame:
    """Last row per key in some runs."""
    rows = batch.select(*group, order_by, *cols).where("false")
    schema = rows.schema
    rows = rows.withColumn("__until", F.lit(0))
    for run in runs:
        part = batch.sparkSession.read.schema(schema).parquet(_run_path(state, run))
        rows = rows.unionByName(part.withColumn("__until", F.lit(run[1])))
    latest = rows.groupBy(*group).agg(F.max_by(F.struct(order_by, *cols), "__until").alias("__row"))
    return latest.select(*group, "__row.*")
