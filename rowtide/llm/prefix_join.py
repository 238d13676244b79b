"""Exact candidates for a Jaccard threshold among sets that crowd together. DataFrame functions only.

Tokens get one order for all sets, rare ones first. Two sets alike enough have a token in
common near the beginning of both (prefix filter), and at its place enough tokens are left
in both (position filter). What many sets have in common stands at their ends, so sets
with most of a template in common hardly meet. No pair is left out by a count.

A token's place in a set bounds the size that an alike set can have. So sets do not meet
at a token alone but at a token with the classes of both sizes, each row going to those
classes that its own place allows: nearly all that meet there pass both filters, however
many sets know the token.

Only pairs of different components are wanted: a token known in one component alone is
as good as rare, and of a token's sets whole components meet first, so a large group that
is linked already does not meet itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.plans.staging import release, stage


#: Classes of sizes from one size to its double; small sizes have one each.
CLASSES = 32


def _size_class(n: Column) -> Column:
    """A number that never falls as the size grows."""
    return F.floor(F.log2(n) * CLASSES).cast("int")


def crossing_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """``a`` < ``b``, written: all pairs of ``node`` with different ``component`` that can be alike.

    Alike means 100 * intersection >= ``percent`` * union of the arrays ``tokens``, which hold
    distinct values. A node has one row. Pairs that are not alike can come out as well.
    """
    rows = sets.select("node", "component", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    counts = rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("known"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    counts = stage(counts.where("low <> high").select("token", "known"), "token-counts")
    n = F.col("n")
    # tokens of one component alone come first and need no row; the others of a set are sorted
    # in one array, and only its beginning is written
    known = rows.join(counts, "token").groupBy("node", "component", "n")
    known = known.agg(F.sort_array(F.collect_list(F.struct("known", "token"))).alias("all"))
    alone = n - F.size("all")
    prefix = F.slice("all", F.lit(1), F.greatest(n - F.ceil(n * percent / 100) + 1 - alone, F.lit(0)).cast("int"))
    known = known.select("node", "component", "n", alone.alias("alone"), F.posexplode(prefix).alias("at", "one"))
    placed = known.select("node", "component", "n", "one.token", (F.col("alone") + F.col("at") + 1).alias("place"))
    placed = stage(placed, "prefixes")
    release(counts)

    # what is left from a place on has to be enough for both sets, so the other set has this size at most
    most = F.floor((n - F.col("place") + 1) * (100 + percent) / percent).cast("int") - n
    least = F.ceil(n * percent / 100).cast("int")
    own = _size_class(n)
    small = placed.where(most >= n).select(
        "token", F.col("component").alias("c"), F.col("node").alias("x"), F.col("n").alias("nx"), F.col("place").alias("px"),
        own.alias("kx"), F.explode(F.sequence(own, _size_class(most))).alias("ky"),
    )
    large = placed.where(most >= least).select(
        "token", F.col("component").alias("d"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("place").alias("py"),
        F.explode(F.sequence(_size_class(least), _size_class(F.least(n, most)))).alias("kx"), own.alias("ky"),
    )
    key = ["token", "kx", "ky"]
    met = small.select(*key, "c").distinct().join(large.select(*key, "d").distinct(), key)
    met = stage(met.where("c <> d"), "met")
    pairs = met.join(small, [*key, "c"]).join(large, [*key, "d"])
    nx, ny = F.col("nx"), F.col("ny")
    pairs = pairs.where((nx < ny) | ((nx == ny) & (F.col("x") < F.col("y"))))
    pairs = pairs.where(nx * 100 >= ny * percent)
    left = F.least(nx - F.col("px"), ny - F.col("py")) + 1
    pairs = pairs.where(left >= F.ceil((nx + ny) * percent / (100 + percent)))
    pairs = stage(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "crossing")
    release(placed, met)
    return pairs
