"""Where a reader of a paged listing stops, decided over recorded pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def until(pages: DataFrame, key: str, page: str, last: Column) -> DataFrame:
    """Pages in order up to the first for which ``last`` holds, itself included. ``last`` may use ``before``: items on earlier pages."""
    order = Window.partitionBy(key).orderBy(page)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    p = pages.withColumn("before", F.coalesce(F.sum("n_items").over(earlier), F.lit(0)))
    ended = F.coalesce(F.max(last.cast("int")).over(earlier), F.lit(0))
    return p.withColumn("ended", ended).filter("ended = 0").drop("ended")


def by_total(pages: DataFrame, key: str, page: str, most: int = 2000) -> DataFrame:
    """Until the listing's ``total`` is reached, a page is empty, or ``most`` pages are read; empty pages give nothing."""
    read = pages.filter(F.col(page) <= most)
    return until(read, key, page, (F.col("n_items") == 0) | (F.col("before") + F.col("n_items") >= F.col("total"))).filter("n_items > 0")


def by_size(pages: DataFrame, key: str, page: str, size: int = 50) -> DataFrame:
    """Until a page is empty or shorter than asked for; empty pages give nothing."""
    return until(pages, key, page, F.col("n_items") < size).filter("n_items > 0")
