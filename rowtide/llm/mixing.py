"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame functions only.

Weights share a number of words among the sources; what a source cannot give (more than
``most_repeats`` times its size) is shared again. The words of a source are a stream of
its documents, dealt by a seeded hash into shards of bounded size and ordered by another
within a shard, and the streams are cut into blocks of equally many words. Seats, one
for each block the mix is to have, go to the sources by the highest quotients
target / (2 k - 1), and a source's seats go to its shards in the same way by their sizes:
integer quotas for each shard. A shard fills its quota with its blocks in seeded order,
whole laps first. Quotas are whole blocks, targets are not: what is missing or too much
is put right within the source's last blocks, so its words meet the target.

One window runs over the sources and one over each source's shards, a row for each;
documents and blocks only ever meet within a shard, so no source is in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtide.llm.shared import column, free_names
from rowtide.plans.staging import stage

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 1024
SHARD_DOCUMENTS = 4096
#: Words are runs of other characters than these; a fixed pattern.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, most_repeats: int) -> DataFrame:
    """``target`` for each row of ``source``, ``source_size``; NULL sources come last in the order of weights.

    The level at which weighted shares, none above its limit, add up to the wanted sum:
    sources are taken in by the level at which they reach their limits.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sources.withColumn("place", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("weight", F.get(cycle, (F.col("place") % len(weights)).cast("int")))
    rows = rows.withColumn("most", (F.col("source_size") * most_repeats).cast("double"))
    rows = rows.withColumn("full_at", F.col("most") / F.col("weight"))
    everything = Window.partitionBy()
    rows = rows.withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(share)))
    so_far = Window.orderBy("full_at", "place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("given", F.coalesce(F.sum("most").over(so_far), F.lit(0.0)))
    rows = rows.withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(so_far), F.lit(0.0)))
    level = (F.col("wanted") - F.col("given")) / F.col("left")
    # the level is that of the first source that does not reach its limit, infinite if all do
    below = F.when(level <= F.col("full_at"), F.struct("full_at", "place", level.alias("level")))
    rows = rows.withColumn("first", F.min(below).over(everything))
    target = F.least(F.coalesce(F.col("first.level") * F.col("weight"), F.col("most")), F.col("most"))
    return rows.withColumn("target", target).select("source", "source_size", "place", "target")


def apportioned(parties: DataFrame, group: Sequence[str], order: Sequence[str], votes: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague seats of each party of a group in the new column ``out``.

    Of equal quotients the party that comes first in ``order`` wins. Rounding votes by
    the plain divisor gives a first number; only seats above or below it that the right
    divisor can move are ranked, which are at most about four for each party.
    """
    of_group = Window.partitionBy(*group) if group else Window.partitionBy()
    rows = parties.withColumn("_all", F.sum(votes).over(of_group))
    rows = rows.withColumn("_parties", F.count(F.lit(1)).over(of_group))
    plain = F.when(F.col("_all") > 0, F.floor(F.col(votes) * F.col(seats) / F.col("_all") + 0.5)).otherwise(0)
    rows = rows.withColumn("_first", plain.cast("long"))
    rows = rows.withColumn("_open", F.when(F.col("_all") > 0, F.col(seats) - F.sum("_first").over(of_group)).otherwise(0))
    moved = F.ceil((F.abs("_open") + F.col("_parties")) * F.col(votes) / F.col("_all")) + 1
    up = F.sequence(F.col("_first") + 1, F.col("_first") + moved)
    down = F.sequence(F.greatest(F.lit(1), F.col("_first") - moved + 1), F.col("_first"))
    none = F.array().cast("array<bigint>")
    seat = F.when(F.col(votes) <= 0, none).when(F.col("_open") > 0, up)
    seat = seat.when((F.col("_open") < 0) & (F.col("_first") > 0), down).otherwise(none)
    rows = rows.withColumn("_seat", F.explode_outer(seat))
    rows = rows.withColumn("_quotient", F.col(votes) / (2 * F.col("_seat") - 1))
    best = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy(
        F.when(F.col("_open") < 0, -F.col("_quotient")).otherwise(F.col("_quotient")).desc_nulls_last(),
        *[F.when(F.col("_open") < 0, F.col(c)).desc_nulls_last() for c in order],
        *[F.col(c).asc_nulls_last() for c in order],
        "_seat",
    )
    rows = rows.withColumn("_rank", F.row_number().over(best))
    change = F.when(F.col("_seat").isNotNull() & (F.col("_rank") <= F.abs("_open")), F.signum("_open")).otherwise(0)
    kept = [F.first(c).alias(c) for c in parties.columns if c not in {*group, *order}]
    total = (F.first("_first") + F.sum(change)).cast("long")
    return rows.groupBy(*dict.fromkeys([*group, *order])).agg(*kept, total.alias(out))


def mix(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most_repeats: int = 2,
    seed: int = 42,
    block_words: int = BLOCK_WORDS,
    shard_documents: int = SHARD_DOCUMENTS,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The rows, with the columns ``keep`` (all by default), with ``size``, ``source_size``, ``target`` and ``taken`` (new names if taken).

    Sizes are words; a NULL text has none. Sources are the values of ``source`` by code
    point, NULL as the last one, and weigh ``weights`` in turn; they share ``share``
    times all words, none more than ``most_repeats`` times its own. ``taken`` counts the
    words of a row the mix takes, at most ``most_repeats`` times its size; over a source
    they add up to its rounded target. The choice depends on id, text and seed alone.
    Rows that are equal in both may change places. Rows without words take none; an
    empty table gives no rows; other columns stay as they are.
    """
    return _mix(documents, weights, share, most_repeats, seed, block_words, shard_documents, keep)


def _mix(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most_repeats: int = 2,
    seed: int = 42,
    block_words: int = BLOCK_WORDS,
    shard_documents: int = SHARD_DOCUMENTS,
    keep: Sequence[str] | None = None,
    stretches: str | None = None,
) -> DataFrame:
    """As ``mix``; with a name for ``stretches``, also what a last, partial copy has.

    These are structs of the first word (from 0) and the word after the last, in order,
    one for each drawn block the row meets; NULL if there are none.
    """
    size, source_size, target, taken = free_names(documents, "size", "source_size", "target", "taken")
    key, text = column(documents, "doc_id", "string"), column(documents, "text", "string")
    rows = documents.select(
        F.struct(*[documents[f"`{c}`"] for c in (documents.columns if keep is None else keep)]).alias("row"),
        column(documents, "source", "string").alias("source"),
        word_count(text).alias("size"),
        F.xxhash64(F.lit(seed), key, text).alias("deal"),
    )
    narrow = stage(rows.select("source", "size", "deal"), "sizes")
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    sources = stage(sources, "sources")
    goals = targets(sources.select("source", "source_size"), weights, share, most_repeats)
    wanted = F.greatest(F.lit(1), F.round(F.sum("target").over(Window.partitionBy()) / block_words))
    goals = apportioned(goals.withColumn("seats", wanted.cast("long")), [], ["place"], "target", "seats", "source_seats")
    goals = goals.join(sources.drop("source_size").withColumnRenamed("source", "s"), F.col("s").eqNullSafe(F.col("source")))
    goals = goals.withColumn("shards", F.ceil(F.col("documents") / shard_documents).cast("int"))
    goals = stage(goals.select("place", "source", "source_size", "target", "source_seats", "shards"), "targets")

    def placed(df: DataFrame) -> DataFrame:
        joined = df.join(goals.withColumnRenamed("source", "s"), F.col("s").eqNullSafe(F.col("source"))).drop("s", "source")
        return joined.withColumn("shard", F.pmod(F.col("deal"), F.col("shards")).cast("int"))

    # quotas of the shards
    cells = placed(narrow).groupBy("place", "shard").agg(
        F.sum("size").alias("words"),
        F.first("source_seats").alias("seats"),
        F.first("target").alias("target"),
    )
    cells = apportioned(cells.where("words > 0").withColumn("votes", F.col("words").cast("double")), ["place"], ["shard"], "votes", "seats", "quota")
    whole = F.least(F.col("quota") * block_words, F.col("words") * most_repeats)
    cells = cells.withColumn("whole", whole)
    in_source = Window.partitionBy("place")
    missing = F.round("target").cast("long") - F.sum("whole").over(in_source)
    cells = cells.withColumn("missing", missing)
    room = F.when(F.col("missing") > 0, F.col("words") * most_repeats - F.col("whole")).otherwise(F.col("whole"))
    cells = cells.withColumn("room", room)
    earlier = in_source.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("room").over(earlier), F.lit(0))
    moved = F.greatest(F.lit(0), F.least(F.col("room"), F.abs("missing") - before)) * F.signum("missing").cast("long")
    cells = cells.select("place", "shard", "words", (F.col("whole") + moved).alias("takes"))

    # blocks of the shards in seeded order
    blocks = cells.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / block_words))))
    blocks = blocks.withColumn("length", F.least(F.lit(block_words).cast("long"), F.col("words") - F.col("block") * block_words))
    cell = Window.partitionBy("place", "shard")
    seeded = cell.orderBy(F.xxhash64(F.lit(seed), "place", "shard", "block"), "block")
    ahead = F.sum("length").over(seeded.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    over = F.pmod("takes", "words")
    blocks = blocks.withColumn("laps", F.floor(F.col("takes") / F.col("words")))
    blocks = blocks.withColumn("part", F.greatest(F.lit(0), F.least(F.col("length"), over - ahead)))
    got = F.col("laps") * F.col("length") + F.col("part")
    in_order = cell.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("sum_before", F.sum(got).over(in_order) - got)
    blocks = stage(blocks.select("place", "shard", "block", "laps", "part", "sum_before"), "blocks")

    # what the mix takes of a stretch of a stream is the difference of two running sums
    stream = cell.orderBy("deal").rowsBetween(Window.unboundedPreceding, 0)
    docs = placed(rows.select("row", "size", "deal", "source")).withColumn("end", F.sum("size").over(stream))
    docs = docs.withColumn("begin", F.col("end") - F.col("size"))
    more = []
    if stretches:
        # rows with one place in the stream are equal in id and text, so a second pass over the stream may swap them
        spans = placed(narrow).where("size > 0").withColumn("end", F.sum("size").over(stream))
        spans = spans.select("place", "shard", (F.col("end") - F.col("size")).alias("begin"), "end")
        met = F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words))
        spans = spans.withColumn("block", F.explode(met))
        spans = spans.join(blocks.where("part > 0").select("place", "shard", "block", "part"), ["place", "shard", "block"])
        start = F.col("block") * block_words
        one = F.struct(
            (F.greatest("begin", start) - F.col("begin")).alias("first"),
            (F.least("end", start + F.col("part")) - F.col("begin")).alias("after"),
        )
        spans = spans.select(F.col("place").alias("p"), F.col("shard").alias("h"), F.col("begin").alias("b"), one.alias("one"))
        spans = spans.where("one.first < one.after").groupBy("p", "h", "b").agg(F.sort_array(F.collect_list("one")).alias("stretches"))
        spans = stage(spans, "stretches")
        same = (F.col("place") == F.col("p")) & (F.col("shard") == F.col("h")) & (F.col("begin") == F.col("b"))
        docs = docs.join(spans, same & (F.col("size") > 0), "left").drop("p", "h", "b")
        more = [F.col("stretches").alias(stretches)]
    for name, place in (("begin", F.col("begin")), ("end", F.col("end"))):
        # a stream's end is the end of its last block
        block = F.when(place > 0, F.floor((place - 1) / block_words)).otherwise(0)
        own = blocks.select(
            F.col("place").alias("p"), F.col("shard").alias("h"), F.col("block").alias("b"), "laps", "part", "sum_before"
        )
        docs = docs.withColumn("at", block).join(
            own, (F.col("place") == F.col("p")) & (F.col("shard") == F.col("h")) & (F.col("at") == F.col("b")), "left"
        )
        within = place - F.col("at") * block_words
        upto = F.col("sum_before") + F.col("laps") * within + F.least(F.col("part"), within)
        docs = docs.withColumn("upto_" + name, F.coalesce(upto, F.lit(0))).drop("p", "h", "b", "laps", "part", "sum_before", "at")
    return docs.select(
        "row.*",
        F.col("size").alias(size),
        F.col("source_size").alias(source_size),
        F.col("target").alias(target),
        (F.col("upto_end") - F.col("upto_begin")).cast("long").alias(taken),
        *more,
    )


def mixed_rows(documents: DataFrame, **how) -> DataFrame:
    """The mix itself: rows with the columns of the documents, a row for each copy taken.

    A copy that is taken in part is a row for each stretch of neighbouring words that the
    drawn blocks cover, with the white space between them; ``n_chars``, if there, is
    counted anew for it. Rows of which nothing is taken go.
    """
    size, _, _, taken = free_names(documents, "size", "source_size", "target", "taken")
    stretches, stretch = free_names(documents, "stretches", "stretch")
    mixed = _mix(documents, stretches=stretches, **how).where(F.col(taken) > 0)
    one = "struct<first:bigint,after:bigint>"

    def joined(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["first"], x["after"]).cast(one)))
        touches = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["after"] == x["first"])
        return F.when(touches, longer).otherwise(F.concat(done, F.array(x.cast(one))))

    whole = F.struct(F.lit(0).cast("long").alias("first"), F.col(size).alias("after")).cast(one)
    wholes = F.array_repeat(whole, F.floor(F.col(taken) / F.col(size)).cast("int"))
    # a remainder of all words is a whole copy and counted as one
    partly = F.pmod(F.col(taken), F.col(size)) > 0
    parts = F.aggregate(F.col(stretches), F.array().cast(f"array<{one}>"), joined)
    copies = F.when(partly, F.concat(wholes, parts)).otherwise(wholes)
    mixed = mixed.withColumn(stretch, F.explode(copies))
    first, after = F.col(stretch)["first"], F.col(stretch)["after"]
    cut = after - first < F.col(size)
    # a piece is a word with the white space behind it; white space in front is one of its own
    pieces = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    start = F.when(first > 0, first + lead).otherwise(0)
    some = F.array_join(F.slice(pieces, (start + 1).cast("int"), (after + lead - start).cast("int")), "")
    mixed = mixed.withColumn("text", F.when(cut, some).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        mixed = mixed.withColumn("n_chars", F.when(cut, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return mixed.select(*[f"`{c}`" for c in documents.columns])
