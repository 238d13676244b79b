"""Near-duplicate vectors of a label, by quantised tile products.

Exact copies are folded first, so a vector that fills a third of the table is one row
afterwards. The vectors left of a label are dealt into tiles of bounded size; each pair
of tiles is one task. There, unit vectors are rounded to int8 and multiplied tile by
tile. With u = s q + e, the product of two unit vectors differs from that of their
roundings by at most |e1| |s2 q2| + |e2|; only pairs that can reach the threshold within
this bound are computed again in double precision, which alone decides.

A task gives back, for each vector, the number of its links and one vector it hangs
together with, never pairs: what leaves a tile pair is at most a row for each vector.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.components import connected_components
from rowtide.llm.shared import column, identity
from rowtide.plans.staging import stage

#: Vectors in a tile that meets other tiles in a task, and in the products inside a task.
TILE = 2048
STEP = 512


def link_vectors(
    vectors: DataFrame,
    threshold: float = 0.98,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    tile: int = TILE,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for each row.

    Rows are linked if their labels are equal and not NULL, their vectors equally long,
    and their cosine in double precision is at least ``threshold``. Vectors that are
    NULL, empty, zero, or hold NULL or a number that is not finite, link with nothing:
    0 links, their own id as component, kept. Repeated rows are copies like any others;
    an empty table gives no rows; further columns are not looked at.
    """
    rows = vectors.select(
        column(vectors, id_column, "bigint").alias("vec_id"),
        column(vectors, vector_column, "array<double>").alias("v"),
        column(vectors, label_column, "string").alias("label"),
    )
    usable = (
        F.col("label").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0.0)
    )
    rows = rows.withColumn("vid", F.when(usable, identity("label", "v")))
    good = rows.where(F.col("vid").isNotNull())
    folded = good.groupBy("vid").agg(
        F.first("label").alias("label"),
        F.first("v").alias("v"),
        F.count(F.lit(1)).alias("copies"),
        F.min("vec_id").alias("least_id"),
    )
    folded = stage(folded, "vectors")
    tiles = stage(
        folded.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")), "tiles"
    )
    dealt = folded.join(tiles, "label").withColumn("own", F.pmod(F.xxhash64("vid"), F.col("tiles")).cast("int"))
    dealt = dealt.select(
        "label", "vid", "v", "copies", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    )
    dealt = dealt.select(
        "label", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "vid", "v", "copies"
    )
    found = stage(
        dealt.groupBy("label", "one", "two").applyInPandas(
            lambda key, rows: _tile_links(rows, key[1], key[2], threshold), "vid string, links long, hangs_on string"
        ),
        "links",
    )
    parts = connected_components(found, "vid", "hangs_on")
    links = found.groupBy("vid").agg(F.sum("links").alias("links"))
    of = folded.select("vid", "copies", "least_id").join(links, "vid", "left")
    of = stage(
        of.join(parts.select(F.col("node").alias("vid"), "component"), "vid", "left").select(
            "vid",
            "least_id",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.coalesce("component", "vid").alias("component"),
        ),
        "classes",
    )
    least = stage(of.groupBy("component").agg(F.min("least_id").alias("component_id")), "least")
    of = stage(of.join(least, "component").select("vid", "links", "component_id"), "classes")
    out = rows.select("vec_id", "vid").join(of, "vid", "left")
    own = F.when(F.col("vid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"),
        F.col("vec_id").eqNullSafe(own).alias("kept"),
    )


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the lengths of the rounded rows and of what rounding left."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def _tile_links(rows: pd.DataFrame, one: int, two: int, threshold: float) -> pd.DataFrame:
    found = []
    for _, same in rows.groupby(rows["v"].str.len()):
        found.append(_links_of(same.reset_index(drop=True), one, two, threshold))
    return pd.concat(found, ignore_index=True)


def _links_of(rows: pd.DataFrame, one: int, two: int, threshold: float) -> pd.DataFrame:
    v = np.array(rows["v"].tolist(), dtype=np.float64)
    v /= np.abs(v).max(axis=1)[:, None]  # no square overflows
    length = np.linalg.norm(v, axis=1)
    q, scale, rounded, left = quantised(v / length[:, None])
    copies = rows["copies"].to_numpy()
    first, second = (np.flatnonzero(rows["own"].to_numpy() == k) for k in (one, two))
    # sums of up to 127 * 127 * dimensions are exact in this type
    wide = np.float32 if 127 * 127 * v.shape[1] < 2**24 else np.float64
    links, root = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
    for a0 in range(0, len(first), STEP):
        a = first[a0 : a0 + STEP]
        qa = q[a].astype(wide)
        for b0 in range(a0 if one == two else 0, len(second), STEP):
            b = second[b0 : b0 + STEP]
            near = (qa @ q[b].astype(wide).T) * scale[a][:, None] * scale[b]
            bound = left[a][:, None] * rounded[b] + left[b]
            i, j = np.nonzero(near + bound >= threshold - 1e-6)
            if one == two and a0 == b0:
                i, j = i[i < j], j[i < j]
            i, j = a[i], b[j]
            exact = np.empty(len(i))
            for k in range(0, len(i), 1 << 16):
                s = slice(k, k + (1 << 16))
                exact[s] = np.einsum("nd,nd->n", v[i[s]], v[j[s]]) / (length[i[s]] * length[j[s]])
            i, j = i[exact >= threshold], j[exact >= threshold]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            root = joined(root, i, j)
    hit = np.flatnonzero(links)
    vid = rows["vid"].to_numpy()
    return pd.DataFrame({"vid": vid[hit], "links": links[hit], "hangs_on": vid[root[hit]]})


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each index's group once the links are added to the groups."""
    while True:
        low = np.minimum(root[i], root[j])
        if np.array_equal(low, root[i]) and np.array_equal(low, root[j]):
            return root
        root = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
