"""The k-th largest value of each key by refining histograms: no sort, and no task holds more of a key than its counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import forget, stored

BUCKETS = 4096


def kth_largest(rows: DataFrame, keys: list[str], value: str, k: int | str) -> DataFrame:
    """keys, ``cutoff`` (the k-th largest ``value``, a whole number) and ``beyond``: how many of the key's rows are larger.

    Keys with fewer than k rows, and null values, have none. ``k`` is a number or a column that is constant in each key.
    Each round counts a key's rows in BUCKETS equal parts of the range in which its k-th value lies, with map-side
    combine, and goes on in the part that holds it; log(range) / log(BUCKETS) rounds, at most six, end at one value, however many rows
    tie there. Equal values are never told apart, so a hot key or value costs counters only.
    """
    rows = rows.filter(F.col(value).isNotNull()).withColumn("_k", F.lit(k) if isinstance(k, int) else F.col(k)).select(*keys, F.col(value).cast("long").alias("_v"), F.col("_k").cast("long"))
    span = rows.groupBy(*keys).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.max("_k").alias("left"), F.count("*").alias("n"))
    span = stored(span.filter("n >= left AND left > 0").select(*keys, "lo", "hi", "left", F.lit(0).cast("long").alias("beyond")))
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in keys]
    while span.filter("hi > lo").limit(1).count():
        width = F.expr(f"cast((hi - lo) div {BUCKETS} + 1 as long)")
        s = span.filter("hi > lo").withColumn("width", width)
        inside = rows.join(s, same(rows, s)).filter("_v BETWEEN lo AND hi")
        counts = inside.groupBy(*[s[c] for c in keys], "lo", "hi", "left", "beyond", "width", F.expr("(_v - lo) div width").alias("b")).agg(F.count("*").alias("n"))
        order = Window.partitionBy(*keys, "lo").orderBy(F.desc("b"))  # BUCKETS rows a key at most
        counts = counts.withColumn("upto", F.sum("n").over(order)).filter("upto >= left AND upto - n < left")
        found = counts.select(*keys, F.expr("lo + b * width").alias("lo"), F.expr("least(hi, lo + (b + 1) * width - 1)").alias("hi"), F.expr("left - (upto - n)").alias("left"), F.expr("beyond + (upto - n)").alias("beyond"))
        before, span = span, stored(span.filter("hi = lo").unionByName(found))
        forget(before)
    return span.select(*keys, F.col("lo").alias("cutoff"), "beyond")


def beyond_newest(rows: DataFrame, keys: list[str], at: str, tie: str, k: int) -> DataFrame:
    """Rows of each key after its k newest by (``at``, ``tie``), both whole numbers: first the k-th time, then the place among its ties."""
    first = kth_largest(rows, keys, at, k)
    tied = rows.join(first, [rows[c].eqNullSafe(first[c]) for c in keys]).filter(F.col(at) == F.col("cutoff")).select(*[rows[c] for c in keys], tie, (F.lit(k) - F.col("beyond")).alias("left"))
    second = kth_largest(tied, keys, tie, "left").select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("cutoff").alias("_tie"))
    cut = first.join(second, [first[c].eqNullSafe(second[f"_{c}"]) for c in keys]).select(*[first[c].alias(f"_k_{c}") for c in keys], "cutoff", "_tie")
    old = (F.col(at) < F.col("cutoff")) | (F.col(at) == F.col("cutoff")) & (F.col(tie) < F.col("_tie"))
    return rows.join(cut, [rows[c].eqNullSafe(cut[f"_k_{c}"]) for c in keys]).filter(old).select(*[rows[c] for c in rows.columns])
