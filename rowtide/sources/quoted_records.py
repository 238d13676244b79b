"""Records that go on over line breaks inside quotes, from lines read in splits.

Whether a line begins inside a quoted cell depends on all lines above it. But each line
maps either state at its begin (outside, inside) to one at its end, and these
maps compose: a line either keeps the state, swaps it, or ends in one state whatever was
before. So the state at any line follows from the last line that fixes it, and the number of swaps
since then; over the splits of a file the same holds for whole splits. Each split is
then cut into records from its true state.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.plans.staging import stage

# what a line does to the state; 2 and 3 fix it
_KEEP, _SWAP, _OUTSIDE, _INSIDE = range(4)


def ends_inside(line: str, delimiter: str, quote: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted cell. A quote opens a cell only at its begin; two stand for one."""
    at = 0
    while True:
        if inside:
            at = line.find(quote, at)
            if at < 0:
                return True
            if line.startswith(quote, at + 1):
                at += 2
                continue
            inside = False
        elif line.startswith(quote, at):
            inside = True
            at += 1
            continue
        at = line.find(delimiter, at)
        if at < 0 or line.find(quote, at) < 0:
            return False
        at += 1


def _effect(line: str, delimiter: str, quote: str) -> int:
    ends = ends_inside(line, delimiter, quote, False), ends_inside(line, delimiter, quote, True)
    return {(False, True): _KEEP, (True, False): _SWAP, (False, False): _OUTSIDE, (True, True): _INSIDE}[ends]


def joined_records(lines: DataFrame, delimiter: str, quote: str, line_break: str) -> tuple[DataFrame, list[DataFrame]]:
    """``file``, ``block``, ``pos``, ``value`` of the records made of lines with the same columns.

    A record stands where its first line does; ``pos`` counts up by one in a split. A
    carriage return before the break at the end of a record goes, those within stay.
    A record is held in memory whole. The second result are written tables, to be
    released after the last use of the records. The texts are written once and travel
    once, to the windows of their split.
    """

    @F.pandas_udf("int")
    def effect(values: pd.Series) -> pd.Series:
        return values.map(lambda x: _KEEP if x is None else _effect(x, delimiter, quote)).astype("int32")

    quoted = F.when(F.contains("value", F.lit(quote)), F.col("value"))  # other lines don't travel to Python
    kept = stage(lines.withColumn("effect", effect(quoted)), "csv-lines")
    order = "over (partition by file, block order by pos)"
    before, up_to = (f"{order[:-1]} rows between unbounded preceding and {end})" for end in ("1 preceding", "current row"))
    fixed = "last(case when effect >= 2 then struct(effect - 2 as state, swaps) end, true)"

    place = "struct(pos, swaps)"
    splits = kept.selectExpr("file", "block", "pos", "effect", f"sum(int(effect = 1)) {up_to} as swaps").groupBy("file", "block").agg(
        F.expr("max_by(struct(effect - 2 as state, swaps), case when effect >= 2 then pos end)").alias("own_fixed"),
        F.expr(f"max({place}).swaps").alias("all_swaps"),
    )
    across = "over (partition by file order by block rows between unbounded preceding and 1 preceding)"
    end = "case when own_fixed is not null then (own_fixed.state + all_swaps - own_fixed.swaps) % 2 end"
    splits = splits.selectExpr("*", f"{end} as end_state", "case when own_fixed is null then all_swaps % 2 else 0 end as turns")
    splits = splits.selectExpr("*", f"sum(turns) {across} as turned", f"sum(turns) {across.replace('1 preceding', 'current row')} as turned_here")
    splits = splits.selectExpr("*", f"last(case when end_state is not null then struct(end_state, turned_here) end, true) {across} as last_end")
    begin = "coalesce((last_end.end_state + turned - last_end.turned_here) % 2, coalesce(turned, 0) % 2)"
    splits = stage(splits.selectExpr("file", "block", f"{begin} as begin_state"), "csv-splits")

    def stated(rows: DataFrame) -> DataFrame:
        """The lines with ``inside``, their state at the begin, and ``record``, the number of the record in the split."""
        marked = rows.selectExpr("*", f"sum(int(effect = 1)) {up_to} as swaps")
        # the state is fixed & 1 xor the swaps since; NULL where only the split's begin fixes it
        state = "({fixed}.state + {swaps} - {fixed}.swaps) % 2"
        marked = marked.selectExpr("*", f"{fixed} {before} as last_fixed", f"coalesce(lag(swaps) {order}, 0) as swaps_before")
        marked = marked.withColumn("known", F.expr(state.format(fixed="last_fixed", swaps="swaps_before")))
        marked = marked.join(splits, ["file", "block"])
        marked = marked.withColumn("inside", F.expr("coalesce(known, (begin_state + swaps_before) % 2) = 1"))
        return marked.withColumn("record", F.expr(f"sum(int(not inside)) {up_to} - 1"))

    # lines that go on from an earlier split belong to the last record that begins before
    begun = stated(kept.select("file", "block", "pos", "effect")).groupBy("file", "block").agg(F.max("record").alias("last"))
    earlier = f"last(case when last >= 0 then struct(block, last) end, true) {across}"
    begun = stage(begun.selectExpr("file", "block", "last", f"{earlier} as owner"), "csv-owners")
    parts = stated(kept).join(begun, ["file", "block"])
    parts = parts.selectExpr("file", "block", "record", "last", "owner", "struct(block, pos, value) as part")
    # only a split's last record and what stands before its first one can have lines of other splits
    inner = parts.where("record >= 0 and record < last").groupBy("file", "block", "record")
    inner = inner.agg(F.sort_array(F.collect_list("part")).alias("parts"))
    outer = parts.where("record < 0 or record = last").selectExpr(
        "file", "case when record < 0 then owner.block else block end as block",
        "case when record < 0 then owner.last else record end as record", "part",
    )
    outer = outer.groupBy("file", "block", "record").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    records = inner.unionByName(outer).select(
        "file", "block", F.col("record").alias("pos"), F.array_join("parts.value", line_break).alias("value")
    )
    return records.withColumn("value", F.regexp_replace("value", "\r$", "")), [kept, splits, begun]
