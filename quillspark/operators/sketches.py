"""Stored daily sketches that merge: distinct counts and quantiles of any span of days without reading its rows again.

Distinct counts are HyperLogLog sketches of 2**LG_K registers, off by 1.04 / sqrt(2**LG_K) (1.6 %) as a standard deviation;
quantiles are KLL sketches, whose ranks are off by at most RANK_ERROR with 99 % confidence. Both merge in any order to
sketches with the same bounds, so days can be added one at a time. A sketch has a fixed size; sketching is an aggregate with map-side
combine, so a key with a third of all rows is one small row a task.

Defined results: null values take no part (the distinct count of a day of nulls is 0, its quantiles are null); a null
key or day is one of its own; an empty table has no sketches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K, KLL_K = 12, 200
#: Standard error of a distinct count, and the bound of a quantile's rank.
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (LG_K / 2), 0.0165


def by_day(rows: DataFrame, keys: list[str], at: str, distinct: str, amount: str) -> DataFrame:
    """keys, day, n, ids (distinct values of ``distinct``), amounts (quantiles of ``amount``): one row for each key and day."""
    day = F.to_date(at).alias("day")
    return rows.groupBy(*keys, day).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, F.lit(LG_K)).alias("ids"), F.kll_sketch_agg_double(F.col(amount).cast("double"), F.lit(KLL_K)).alias("amounts"))


def merged(days: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of all given days together: keys, n, ids, amounts."""
    return days.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("ids").alias("ids"), F.kll_merge_agg_double("amounts").alias("amounts"))


def read_off(sketches: DataFrame, ranks: tuple[float, ...] = (0.5,)) -> DataFrame:
    """The given columns with ``distinct`` and ``quantiles`` in place of the sketches."""
    some = F.kll_sketch_get_n_double("amounts") > 0
    q = F.when(some, F.array(*[F.kll_sketch_get_quantile_double("amounts", F.lit(r)) for r in ranks]))
    return sketches.withColumn("distinct", F.hll_sketch_estimate("ids")).withColumn("quantiles", q).drop("ids", "amounts")
