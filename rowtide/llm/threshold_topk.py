"""Exact top-k inner products by Fagin's threshold algorithm.

Queries and candidates are dealt into blocks; each pair of blocks is one task. There the
candidates are sorted once in each dimension. A query walks all lists at once from their
better ends; what it meets is scored in full. The best any unseen vector can reach is the
sum of the values last met in each list, weighted by the query: once that is below the
k-th best score, the walk ends. The k best of each block meet in a ranked window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowtide.llm.shared import column
from rowtide.plans.staging import stage

#: Candidates and queries in a block.
CANDIDATES = 8192
QUERIES = 1024
SCHEMA = "query_id long, query_row string, vec_id long, score long"


def top_k(
    vectors: DataFrame,
    queries_where: str,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = 1024,
    candidates: int = CANDIDATES,
    queries: int = QUERIES,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query's ``k`` best rows.

    Components count as floor(``scale`` * x). The score is the inner product; ties go
    to the smaller id. Queries are the rows for which ``queries_where`` holds (an
    expression on ``vec_id``); candidates are all rows with another id and as many
    components. Rows without an id, and vectors that are NULL, empty, or hold NULL or a
    number that is not finite, take no part. Of a query's rows that are equal
    throughout, one counts; repeated candidates each count. Scores need to fit 63 bits.
    An empty table gives no rows; further columns are not looked at.
    """
    v = column(vectors, vector_column, "array<double>")
    rows = vectors.select(column(vectors, id_column, "bigint").alias("vec_id"), v.alias("v"))
    rows = rows.where(
        F.col("vec_id").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ).withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))
    rows = rows.withColumn("dims", F.size("v"))
    asked = rows.where(queries_where).withColumn("query_row", F.sha2(F.to_json(F.struct("v")), 256))
    asked = stage(asked.dropDuplicates(["vec_id", "query_row"]), "queries")
    sizes = rows.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / candidates).cast("int").alias("c_blocks"))
    sizes = sizes.join(
        asked.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / queries).cast("int").alias("q_blocks")), "dims"
    )
    sizes = stage(sizes, "blocks")
    left = rows.join(sizes, "dims").select(
        "dims",
        F.pmod(F.xxhash64("vec_id", "v"), F.col("c_blocks")).cast("int").alias("c"),
        F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q"),
        "vec_id",
        "v",
        F.lit(None).cast("string").alias("query_row"),
    )
    right = asked.join(sizes, "dims").select(
        "dims",
        F.explode(F.sequence(F.lit(0), F.col("c_blocks") - 1)).alias("c"),
        F.pmod(F.xxhash64("vec_id", "query_row"), F.col("q_blocks")).cast("int").alias("q"),
        "vec_id",
        "v",
        "query_row",
    )
    best = left.union(right).groupBy("dims", "c", "q").applyInPandas(lambda rows: _block_best(rows, k), SCHEMA)
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _block_best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    is_query = rows["query_row"].notna().to_numpy()
    v = np.array(rows["v"].tolist(), dtype=np.int64)
    ids = rows["vec_id"].to_numpy()
    lists = SortedLists(v[~is_query], ids[~is_query])
    out = []
    names = rows["query_row"].to_numpy()
    for i in np.flatnonzero(is_query):
        at, scores = lists.best(v[i], k, ids[i])
        out.append(pd.DataFrame({"query_id": ids[i], "query_row": names[i], "vec_id": lists.ids[at], "score": scores}))
    empty = pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []})
    return pd.concat(out, ignore_index=True) if out else empty


class SortedLists:
    """A block's vectors and, for each dimension, their order by that component."""

    def __init__(self, v: np.ndarray, ids: np.ndarray):
        self.v, self.ids = v, ids
        self.order = np.argsort(v, axis=0, kind="stable")
        self.sorted = np.take_along_axis(v, self.order, axis=0)

    def best(self, query: np.ndarray, k: int, own_id: int, first_step: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows whose id is not ``own_id``."""
        n, dims = len(self.v), np.flatnonzero(query)
        at, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        seen = np.zeros(n, dtype=bool)
        up, down = dims[query[dims] > 0], dims[query[dims] < 0]
        depth, step = 0, first_step
        while depth < n:
            end = min(n, depth + step)
            met = np.concatenate([self.order[n - end : n - depth, up].ravel(), self.order[depth:end, down].ravel()])
            if not len(dims):  # every score is 0
                met, end = np.arange(n), n
            fresh = np.zeros(n, dtype=bool)
            fresh[met] = True
            new = np.flatnonzero(fresh & ~seen & (self.ids != own_id))
            seen |= fresh
            at, scores = np.concatenate([at, new]), np.concatenate([scores, self.v[new] @ query])
            keep = np.lexsort((self.ids[at], -scores))[:k]
            at, scores = at[keep], scores[keep]
            bound = self.sorted[n - end, up] @ query[up] + self.sorted[end - 1, down] @ query[down]
            if len(at) == k and scores[-1] > bound:
                break
            depth, step = end, step * 2
        return at, scores
