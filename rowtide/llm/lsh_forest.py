"""Near-duplicate texts by an LSH forest over MinHash signatures.

Rows with equal shingle sets are folded into one node first. A node has ``TREES`` labels,
each of ``DEPTH`` min-hashes; a tree is the nodes sorted by one label. Nodes that share a
prefix form a region, and the depth of the prefix adapts to the region: it starts at
``FIRST_DEPTH`` and grows only where more than ``REGION`` nodes share it. All nodes of a
region that is not crowded are candidates of each other. In the deeper regions of a
crowded one a node's candidates are its nearest neighbours in label order, which are those
with the longest common prefix. Nodes whose whole labels agree, more than ``REGION`` of
them, are also each compared with one of them. Where this leaves more than one component
in a crowded region, its nodes join an exact prefix-filter join, which leaves no pair out.

Candidates whose signatures agree too little for the threshold are left out (by more
than four standard deviations). The others are confirmed on the full sets, made again
from the texts: first each node's most alike candidate, then whatever would join two
components that are still apart. Links within a component change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowtide.llm.components import connected_components
from rowtide.llm.prefix_join import crossing_pairs
from rowtide.llm.shared import column, free_names
from rowtide.llm.text_arrays import mixed, text_words
from rowtide.plans.staging import stage

TREES = 12
DEPTH = 6
FIRST_DEPTH = 2
REGION = 64
NEIGHBOURS = 12
_U = np.uint64
_STEPS = (mixed(np.arange(1, TREES * DEPTH + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1))[None, :]
NODES = "doc_id string, n_shingles long, node string, text_key long, signature array<int>"


# --- sets of whole texts ---------------------------------------------------------------


def word_lists(texts: list[str | None]) -> list[np.ndarray]:
    """The hashes of each text's words, in order."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for hashes, owner in text_words(texts, 1 << 20):
        borders = np.flatnonzero(np.diff(owner)) + 1
        firsts = np.concatenate([[0], borders])
        for first, own in zip(firsts, np.split(hashes, borders)):
            if len(own):
                parts[owner[first]].append(own)
    empty = np.empty(0, dtype=_U)
    return [p[0] if len(p) == 1 else np.concatenate(p) if p else empty for p in parts]


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of ``size`` neighbouring words; of all words, if there are fewer."""
    if not len(words):
        return words
    own = min(size, len(words))
    x = np.full(len(words) - own + 1, own, dtype=_U)
    for k in range(own):
        x = mixed(x * _U(0xD6E8FEB86659FD93) + words[k : len(words) - own + 1 + k])
    return np.unique(x)


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(TREES * DEPTH, np.iinfo(_U).max, dtype=_U)
    for at in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[at : at + 1024, None] * _STEPS).min(axis=0), out=low)
    return (low >> _U(32)).astype(np.uint32).view(np.int32)


def is_alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the sets' intersection has at least ``percent`` hundredths of their union."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _nodes(shingle_words: int):
    def nodes(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            out = []
            for at in range(0, len(rows), 256):
                some = rows.iloc[at : at + 256]
                lists = word_lists(some["text"].tolist())
                for doc_id, key, words in zip(some["doc_id"], some["text_key"], lists):
                    found = shingle_set(words, shingle_words)
                    if len(found):
                        node = hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest()
                        out.append((doc_id, len(found), node, key, signature(found)))
                    else:
                        out.append((doc_id, 0, None, key, None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")])

    return nodes


# --- candidates ------------------------------------------------------------------------


def _candidates(nodes: DataFrame, estimate: float, neighbours: int) -> tuple[DataFrame, DataFrame]:
    """``a`` < ``b``, ``alike`` (share of equal min-hashes): distinct pairs of near neighbours.

    And ``id``, ``region`` of the nodes in crowded regions, where not all pairs are among them.
    """
    paths = [
        F.xxhash64("tree", F.slice("signature", F.col("tree") * DEPTH + 1, d)).alias(f"p{d}")
        for d in range(FIRST_DEPTH, DEPTH + 1)
    ]
    trees = nodes.select(F.xxhash64("node").alias("id"), "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    open_ = trees.select("id", "tree", *paths)
    deeper = [f"p{d}" for d in range(FIRST_DEPTH, DEPTH + 1)]
    regions = []
    for d in range(FIRST_DEPTH, DEPTH + 1):
        path = f"p{d}"
        sizes = stage(open_.groupBy(path).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "regions")
        joined = open_.join(sizes, path)
        if d == FIRST_DEPTH:
            small = joined.where(F.col("n") <= REGION).groupBy(path).agg(F.sort_array(F.collect_set("id")).alias("all"))
            small = small.select("all", F.posexplode("all").alias("at", "a"))
            whole = small.select("a", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("b"))
            open_ = stage(joined.where(F.col("n") > REGION).drop("n"), "open")
            crowded = open_.select("id", F.col(path).alias("region"))
        elif d < DEPTH:
            regions.append(joined.where(F.col("n") <= REGION).select("id", F.col(path).alias("region"), *deeper))
            open_ = stage(joined.where(F.col("n") > REGION).drop("n"), "open")
        else:
            # whole labels agree: cut by a hash of the node, and compare with one of them
            cut = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / REGION))
            last = stage(joined.select("id", path, F.xxhash64(path, cut).alias("region"), *deeper[:-1]), "labels")
            regions.append(last.select("id", "region", *deeper))
            hubs = stage(last.groupBy(path).agg(F.min("id").alias("hub")), "hubs")
            stars = last.join(hubs, path).select(F.col("hub").alias("a"), F.col("id").alias("b")).where("a <> b")
    in_region = regions[0]
    for more in regions[1:]:
        in_region = in_region.unionByName(more)
    order = Window.partitionBy("region").orderBy(*deeper, "id")
    near = F.array(*[F.lead("id", k).over(order) for k in range(1, neighbours + 1)])
    pairs = in_region.select("id", near.alias("near")).select("id", F.explode("near").alias("other"))
    pairs = pairs.where("other IS NOT NULL").select(
        F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")
    )
    pairs = stage(pairs.union(stars).union(whole).distinct(), "candidates")
    # 64 bits find the nodes; should two nodes share them, both become candidates
    known = nodes.select(F.xxhash64("node").alias("id"), "node", "signature", "text_key")
    for end in ("a", "b"):
        own = [F.col("node").alias("n" + end), F.col("signature").alias("s" + end), F.col("text_key").alias("t" + end)]
        pairs = pairs.join(known.select(F.col("id").alias(end), *own), end)
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    first = F.col("na") < F.col("nb")
    pairs = pairs.select(
        F.least("na", "nb").alias("a"),
        F.greatest("na", "nb").alias("b"),
        F.when(first, F.col("ta")).otherwise(F.col("tb")).alias("ta"),
        F.when(first, F.col("tb")).otherwise(F.col("ta")).alias("tb"),
        (same / (TREES * DEPTH)).alias("alike"),
    )
    return stage(pairs.where(F.col("alike") >= estimate), "candidates"), crowded


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The pairs whose full sets are alike enough, written."""

    def confirm(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            good = []
            for at in range(0, len(rows), 64):
                some = rows.iloc[at : at + 64]
                left = [shingle_set(w, shingle_words) for w in word_lists(some["text_a"].tolist())]
                right = [shingle_set(w, shingle_words) for w in word_lists(some["text_b"].tolist())]
                good += [is_alike(x, y, percent) for x, y in zip(left, right)]
            yield rows.loc[np.array(good, dtype=bool), ["a", "b"]]

    for end in ("a", "b"):
        own = texts.select(F.col("text_key").alias("t" + end), F.col("text").alias("text_" + end))
        pairs = pairs.join(own, "t" + end)
    return stage(pairs.select("a", "b", "text_a", "text_b").mapInPandas(confirm, "a string, b string"), "links")


def _crowds_joined(of: DataFrame, crowded: DataFrame, rows: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """``part``, ``whole``: components that a pair of nodes in crowded regions links."""

    def tokens(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in frames:
            sets = [shingle_set(w, shingle_words).view(np.int64) for w in word_lists(some["text"].tolist())]
            yield some[["node", "component"]].assign(tokens=sets)

    known = of.select(F.xxhash64("node").alias("id"), "node", "text_key", "component")
    crowded = stage(crowded.join(known, "id").drop("id"), "crowded")
    mixed = crowded.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = stage(mixed.where("low <> high").select("region"), "mixed-regions")
    apart = stage(crowded.join(mixed, "region").select("node", "text_key", "component").distinct(), "apart")
    texts = rows.join(apart.select("text_key").distinct(), "text_key", "left_semi")
    texts = stage(texts.groupBy("text_key").agg(F.min("text").alias("text")), "texts")
    sets = apart.join(texts, "text_key").select("node", "component", "text")
    pairs = crossing_pairs(sets.mapInPandas(tokens, "node string, component string, tokens array<long>"), percent)
    for end in ("a", "b"):
        own = [F.col("component").alias("c" + end), F.col("text_key").alias("t" + end)]
        pairs = pairs.join(apart.select(F.col("node").alias(end), *own), end)
    links = _confirmed(pairs.select(F.col("ca").alias("a"), F.col("cb").alias("b"), "ta", "tb"), texts, shingle_words, percent)
    wholes = connected_components(links, "a", "b")
    return stage(wholes.select(F.col("node").alias("part"), F.col("component").alias("whole")), "wholes")


def _classes(documents: DataFrame, percent: int, shingle_words: int, neighbours: int) -> tuple[DataFrame, DataFrame]:
    """Rows of documents with their nodes; the nodes' components. Both written."""
    rows = documents.select(column(documents, "doc_id", "bigint"), column(documents, "text", "string"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    # ids travel as text, for a column of integers with NULLs would become one of floats
    found = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(_nodes(shingle_words), NODES)
    found = stage(found.withColumn("doc_id", F.col("doc_id").cast("bigint")), "shingled")
    nodes = found.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("text_key", "signature")).alias("one")
    )
    nodes = stage(nodes.select("node", "least_id", "one.text_key", "one.signature"), "nodes")
    share = percent / 100
    spread = (share * (1 - share) / (TREES * DEPTH)) ** 0.5
    pairs, crowded = _candidates(nodes, share - 4 * spread, neighbours)
    needed = pairs.select(F.col("ta").alias("text_key")).union(pairs.select("tb")).distinct()
    texts = rows.join(stage(needed, "keys"), "text_key", "left_semi")
    texts = stage(texts.groupBy("text_key").agg(F.min("text").alias("text")), "texts")

    both = pairs.select(F.col("a").alias("node"), "a", "b", "ta", "tb", "alike").union(
        pairs.select(F.col("b").alias("node"), "a", "b", "ta", "tb", "alike")
    )
    best = both.groupBy("node").agg(F.max(F.struct("alike", "a", "b", "ta", "tb")).alias("p"))
    best = stage(best.select("p.*").distinct().drop("alike"), "best")
    links = _confirmed(best, texts, shingle_words, percent)
    parts = stage(connected_components(links, "a", "b"), "parts")

    for end in ("a", "b"):
        own = parts.select(F.col("node").alias(end), F.col("component").alias("c" + end))
        pairs = pairs.join(own, end, "left").withColumn("c" + end, F.coalesce("c" + end, end))
    rest = pairs.where("ca <> cb").join(best.select("a", "b"), ["a", "b"], "left_anti")
    # from here on components are the nodes, so the second graph is small and shallow
    more = _confirmed(rest.select(F.col("ca").alias("a"), F.col("cb").alias("b"), "ta", "tb"), texts, shingle_words, percent)
    wholes = connected_components(more, "a", "b").select(F.col("node").alias("part"), F.col("component").alias("whole"))

    of = nodes.select("node", "least_id", "text_key").join(parts, "node", "left")
    of = of.withColumn("part", F.coalesce("component", "node")).join(stage(wholes, "wholes"), "part", "left")
    of = stage(of.select("node", "least_id", "text_key", F.coalesce("whole", "part").alias("component")), "classes")
    wholes = _crowds_joined(of, crowded, rows, shingle_words, percent)
    of = of.withColumnRenamed("component", "part").join(wholes, "part", "left")
    of = stage(of.select("node", "least_id", F.coalesce("whole", "part").alias("component")), "classes")
    least = stage(of.groupBy("component").agg(F.min("least_id").alias("component_id")), "least")
    of = stage(of.join(least, "component").select("node", "component", "component_id"), "classes")
    return found, of


def near_duplicates(
    documents: DataFrame, percent: int = 85, shingle_words: int = 3, neighbours: int = NEIGHBOURS
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept``, ``component`` for each row.

    Texts are linked if 100 * intersection >= ``percent`` * union of their sets of word
    shingles, lower-cased (A to Z). A text with fewer words has all of them as its one
    shingle; NULL, empty and blank texts have none, link with nothing and have no
    ``component`` (the smallest node of the component, by the hash of its set). ``component_id`` is the smallest doc_id reachable (NULL only if all
    reachable ids are NULL), ``kept`` whether it is the row's own. Rows with one id and
    text both have it. An empty table gives no rows; further columns are not looked at.
    """
    found, of = _classes(documents, percent, shingle_words, neighbours)
    out = found.select("doc_id", "n_shingles", "node").join(of, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id",
        F.col("n_shingles").cast("long").alias("n_shingles"),
        own.alias("component_id"),
        F.col("doc_id").eqNullSafe(own).alias("kept"),
        "component",
    )


def one_of_each(
    documents: DataFrame, percent: int = 85, shingle_words: int = 3, neighbours: int = NEIGHBOURS
) -> DataFrame:
    """The rows that stay, all columns as they are: of each component one with its smallest doc_id.

    Of several such rows, the one whose text has the smallest hash, and of those any one.
    Texts without words all stay.
    """
    found, of = _classes(documents, percent, shingle_words, neighbours)
    known = found.where("node IS NOT NULL").join(of, "node")
    first = known.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("f"))
    first = stage(first.select("component", "f.doc_id", "f.text_key"), "keepers")
    key, id_, text_key, component = free_names(documents, "own_key", "keeper_id", "keeper_key", "component")
    first = first.select(F.col("doc_id").alias(id_), F.col("text_key").alias(text_key), F.col("component").alias(component))
    rows = documents.withColumn(key, F.xxhash64(column(documents, "text", "string")))
    same = (F.col(key) == F.col(text_key)) & column(documents, "doc_id", "bigint").eqNullSafe(F.col(id_))
    kept = rows.join(first, same).dropDuplicates([component])
    blank = ~F.coalesce(column(documents, "text", "string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    names = [f"`{c}`" for c in documents.columns]
    return kept.select(*names).union(documents.where(blank).select(*names))
