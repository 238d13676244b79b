"""Exact k-means on integer vectors with ns-bounds (Newling and Fleuret, 2016).

A vector keeps an upper bound of the distance to its centroid, a lower bound for each
other centroid, and with each bound the round in which it was evaluated. The history of
all centroids is kept, so in a later round a bound is loosened by the norm of the whole
displacement since then, never by a sum of drifts over the rounds. Only vectors whose
bounds don't decide are measured again, exactly, and only to the centroids that may win.

Bounds are floating numbers rounded outwards; distances, sums and centroids are integers.
Vectors stay in the blocks in which they were read. A round reads the blocks written by
the one before and writes new ones with their sums, which Spark adds up: k rows of
numbers reach the driver in a round, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.shared import column
from rowtide.plans.staging import release, stage

BLOCK = 4096
#: Components up to this size leave room for exact sums of squares in 64 bits.
LARGEST = 1 << 26
#: Stands for a NULL id within blocks, whose ids would turn into floating numbers else.
_NO_ID = -(1 << 63)
_STATE = "ids array<long>, vectors binary, own binary, upper binary, lower binary, since binary, sums array<long>, distance array<long>, cluster array<int>"


def _integers(vectors: DataFrame, vector_column: str, scale: int, size: int) -> DataFrame:
    rows = vectors.select(column(vectors, "vec_id", "bigint").alias("vec_id"), column(vectors, vector_column, "array<double>").alias("v"))
    rows = rows.where((F.size("v") == size) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def _first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [r["v"] for r in rows.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()]


def _blocks(size: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), BLOCK):
                part = rows.iloc[at : at + BLOCK]
                whole = np.stack(part["v"].to_numpy()).astype(np.int64).reshape(len(part), size)
                if np.abs(whole).max() > LARGEST:
                    raise ValueError(f"components beyond {LARGEST} need more than 64 bits for squared distances")
                yield _row(part["id"].to_numpy(), whole.astype(np.int32).tobytes())

    return cut


def _row(ids, vectors, own=b"", upper=b"", lower=b"", since=b"", sums=(), distance=(), cluster=()) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "ids": [ids], "vectors": [vectors], "own": [own], "upper": [upper], "lower": [lower], "since": [since],
            "sums": [list(sums)], "distance": [list(distance)], "cluster": [list(cluster)],
        }
    )


def _squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    apart = vectors.astype(np.int64) - centroids
    return np.einsum("ij,ij->i", apart, apart)


def _above(squares: np.ndarray) -> np.ndarray:
    """Distances, rounded up to a short float."""
    return np.nextafter(np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(np.inf)), np.float32(np.inf))


def _below(squares: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(-1)), np.float32(-1)), 0)


class Block:
    """A block of vectors with their bounds.

    ``since[i, j]`` is the round in which the bound of vector i for centroid j was
    evaluated: the upper one for its own centroid, the lower one for any other.
    """

    def __init__(self, row, size: int, k: int):
        self.vectors = np.frombuffer(row["vectors"], dtype=np.int32).reshape(-1, size)
        n = len(self.vectors)
        self.fresh = not row["own"]
        if not self.fresh:
            self.own = np.frombuffer(row["own"], dtype=np.int32).copy()
            self.upper = np.frombuffer(row["upper"], dtype=np.float32).copy()
            self.lower = np.frombuffer(row["lower"], dtype=np.float32).reshape(n, k).copy()
            self.since = np.frombuffer(row["since"], dtype=np.int16).reshape(n, k).copy()

    def assign(self, history: np.ndarray) -> int:
        """Every vector to its nearest centroid of the last round; the number of distances measured."""
        now, (k, _), n = len(history) - 1, history.shape[1:], len(self.vectors)
        centroids = history[now]
        if self.fresh:
            squares = np.stack([_squared(self.vectors, c) for c in centroids], axis=1)
            self.own = squares.argmin(axis=1).astype(np.int32)  # the first of equals
            self.upper = _above(squares[np.arange(n), self.own])
            self.lower = _below(squares)
            self.since = np.full((n, k), now, dtype=np.int16)
            return n * k
        gone = (history[:now] - centroids).astype(np.float64)
        moved = np.sqrt(np.einsum("tij,tij->ti", gone, gone)) * (1 + 1e-9)  # of each centroid since each round
        moved = np.concatenate([moved, np.zeros((1, k))])
        every = np.arange(n)
        lower = self.lower * (1 - 1e-9) - moved[self.since, np.arange(k)]
        lower[every, self.own] = np.inf
        upper = self.upper * (1 + 1e-9) + moved[self.since[every, self.own], self.own]
        left = np.flatnonzero(lower.min(axis=1) <= upper)
        measured = len(left)
        nearest = _squared(self.vectors[left], centroids[self.own[left]])
        self.upper[left] = _above(nearest)
        self.since[left, self.own[left]] = now
        # who stays in doubt is measured to each centroid that its bound lets win
        row, j = np.nonzero(lower[left] <= self.upper[left][:, None])
        who = left[row]
        measured += len(who)
        squares = _squared(self.vectors[who], centroids[j])
        self.lower[who, j] = _below(squares)
        self.since[who, j] = now
        # the least (square, number) of each vector, its own among them
        row = np.concatenate([np.arange(len(left)), row])
        j = np.concatenate([self.own[left], j])
        squares = np.concatenate([nearest, squares])
        order = np.lexsort((j, squares, row))
        first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        new, old = j[first].astype(np.int32), self.own[left]
        changed = new != old
        self.lower[left[changed], old[changed]] = _below(nearest[changed])
        self.upper[left[changed]] = _above(squares[first][changed])
        self.own[left] = new
        return measured

    def sums(self, k: int) -> np.ndarray:
        """For each centroid the number of vectors, then the sums of their components."""
        out = np.zeros((k, self.vectors.shape[1] + 1), dtype=np.int64)
        for j in range(k):
            mine = self.own == j
            out[j, 0] = mine.sum()
            out[j, 1:] = self.vectors[mine].sum(axis=0, dtype=np.int64)
        return out


def _assigned(history: np.ndarray, last: bool):
    k, size = history.shape[1:]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for _, row in rows.iterrows():
                block = Block(row, size, k)
                block.assign(history)
                if last:
                    squares = _squared(block.vectors, history[-1][block.own])
                    inertia = np.zeros(k, dtype=np.int64)
                    np.add.at(inertia, block.own, squares)
                    yield _row(row["ids"], b"", sums=inertia, distance=squares, cluster=block.own)
                else:
                    state = [x.tobytes() for x in (block.own, block.upper, block.lower, block.since)]
                    yield _row(row["ids"], row["vectors"], *state, sums=block.sums(k).ravel())

    return work


def _added(blocks: DataFrame) -> list[int]:
    places = blocks.select(F.posexplode("sums").alias("place", "n")).groupBy("place").agg(F.sum("n").alias("n"))
    return [r["n"] for r in sorted(places.collect())]


def cluster_vectors(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    seed: int = 3,
    scale: int = 1024,
    size: int = 64,
    vector_column: str = "embedding",
) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    A row for each vector of exactly ``size`` components, none NULL or not finite; others
    take no part. Components become floor(scale * x). The first centroids are the k
    vectors with the least sha256 of "seed:vec_id" (a NULL id counts as the empty text;
    equal ids by their components), fewer if there are fewer vectors. Rounds assign all
    vectors to the nearest centroid (ties: the smaller number) and replace it by the floor
    of the mean; an empty one stays. Repeated rows are vectors of their own. An empty
    table gives no rows; other columns do not matter. Raises where a scaled component is
    beyond 2^26.
    """
    rows = _integers(vectors, vector_column, scale, size)
    first = _first_centroids(rows, k, seed)
    if not first:
        return rows.selectExpr(
            "vec_id", "cast(0 as int) AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256"
        ).where("false")
    k = len(first)
    history = np.array([first], dtype=np.int64)
    blocks = rows.select(F.coalesce("vec_id", F.lit(_NO_ID)).alias("id"), "v")
    blocks = stage(blocks.mapInPandas(_blocks(size), _STATE), "vector-blocks")
    for _ in range(rounds):
        new = stage(blocks.mapInPandas(_assigned(history, False), _STATE), "vector-blocks")
        release(blocks)
        blocks = new
        centroids = history[-1].copy()
        sums = np.array(_added(blocks), dtype=object).reshape(k, size + 1)
        for j in range(k):
            if sums[j, 0]:
                centroids[j] = [x // sums[j, 0] for x in sums[j, 1:]]
        if (centroids == history[-1]).all():
            break  # all later rounds would be the same
        history = np.concatenate([history, centroids[None]])
    done = stage(blocks.mapInPandas(_assigned(history, True), _STATE).select("ids", "cluster", "distance", "sums"), "clusters")
    release(blocks)
    inertia = _added(done)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history[-1].tolist()]
    row = F.explode(F.arrays_zip("ids", "cluster", "distance")).alias("row")

    def of_cluster(values: list) -> F.Column:
        return F.element_at(F.array(*[F.lit(x) for x in values]), F.col("row.cluster") + 1)

    return done.select(row).select(
        F.nullif(F.col("row.ids"), F.lit(_NO_ID)).alias("vec_id"),
        F.col("row.cluster").alias("cluster"),
        F.col("row.distance").alias("distance"),
        of_cluster([int(x) for x in inertia]).cast("bigint").alias("cluster_inertia"),
        F.lit(int(sum(inertia))).cast("bigint").alias("inertia"),
        of_cluster(digests).alias("centroid_sha256"),
    )
