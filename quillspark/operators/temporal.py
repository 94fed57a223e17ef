"""As-of join: for each row the newest row of the other side that is not newer, in one pass over both sides together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, tie: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows of ``left`` with a struct ``found``: the row of ``right`` with equal keys and the greatest (right_at, tie) up to ``at``, or null.

    Both sides meet in a union and ``found`` is the last of the other side before a row, so nothing is paired. The time
    that ``right`` covers is cut into ``buckets`` parts, which are part of the key: a key with a third of all rows is
    spread over that many tasks. Each part knows its newest row, and a window over the parts of a key, ``buckets`` rows at
    most, carries it into later parts. Null keys match null keys, a null time finds nothing and is found by none; rows
    that repeat are kept; of equal (right_at, tie) the one with the greatest other columns, in their order, is found.
    """
    lo, hi = right.agg(F.min(F.unix_micros(F.col(right_at).cast("timestamp"))), F.max(F.unix_micros(F.col(right_at).cast("timestamp")))).first()
    width = 1 if lo is None else (hi - lo) // buckets + 1

    def placed(rows: DataFrame, time: str) -> DataFrame:
        part = F.expr(f"cast((unix_micros(cast(`{time}` as timestamp)) - {lo or 0}) div {width} as long)")
        return rows.withColumn("_part", F.greatest(F.lit(-1), F.least(F.lit(buckets), part)))

    theirs = right.filter(F.col(right_at).isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], right_at, F.struct(*[c for c in right.columns if c not in keys]).alias("_found"), F.col(tie).alias("_tie"))
    theirs = placed(theirs, right_at).withColumn("_at", F.col(right_at)).drop(right_at)
    mine = placed(left.withColumn("_row", F.struct(*left.columns)), at).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(at).alias("_at"), "_row", "_part")
    names = [f"_k{i}" for i in range(len(keys))]
    # the newest row of each part, and before each part
    newest = theirs.groupBy(*names, "_part").agg(F.max(F.struct("_at", "_tie", "_found"))["_found"].alias("_newest"))
    parts = newest.unionByName(mine.select(*names, "_part").distinct(), allowMissingColumns=True).groupBy(*names, "_part").agg(F.first("_newest", ignorenulls=True).alias("_newest"))
    earlier = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("_carried", F.last("_newest", ignorenulls=True).over(earlier)).select(*names, "_part", "_carried")
    both = theirs.unionByName(mine, allowMissingColumns=True)
    order = Window.partitionBy(*names, "_part").orderBy("_at", F.col("_row").isNotNull(), "_tie", "_found").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_last", F.last("_found", ignorenulls=True).over(order)).filter("_row is not null")
    c = carried.select(*[F.col(n).alias(f"c{n}") for n in [*names, "_part"]], "_carried")
    out = inside.join(c, [inside[n].eqNullSafe(c[f"c{n}"]) for n in [*names, "_part"]], "left")
    return out.select("_row.*", F.when(F.col("_at").isNotNull(), F.coalesce("_last", "_carried")).alias("found"))
