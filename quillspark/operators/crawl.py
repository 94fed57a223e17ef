"""A bounded crawl in the order of its queue, level by level, with budgets of pages and bytes and a path for every page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .prefix import running


def budgeted_crawl(kids: DataFrame, facts: DataFrame, start: DataFrame, most_depth: int = 10, most_pages: int = 200, most_bytes: int = 500 << 20, chunk: int = 25) -> DataFrame:
    """page, place, depth, parent, path, chunk, imported: what a first-in first-out crawl discovers, in its order.

    kids: parent, position, page; facts: page, title, size; start: page, path (titles above it). A page is imported in
    its place unless its size would take the sum over ``most_bytes``; the crawl ends there. An imported page above
    ``most_depth`` discovers its children by position, each page once, until ``most_pages`` are known. ``path`` holds
    the titles from the top down to the parent; ``chunk`` is the batch of places in which a page comes up.

    A level is ranked by (place of the parent, position), so its order is the queue's; places and byte sums come from
    prefix sums over ranges of that order, and a level is cut to what the budgets leave before it is stored. The queue
    never holds more than ``most_pages``, so a limit on its length above that has no effect and none is kept.

    Defined results: a page without facts has the title '' and no bytes; children that repeat count once, at their first place; a page
    never discovers one that is known; an empty start gives no rows.
    """
    level = running(start.select("page", "path"), ["page"]).filter(F.col("place") < most_pages)
    level = level.select("page", "place", F.lit(0).alias("depth"), F.lit(None).cast(kids.schema["parent"].dataType).alias("parent"), "path")
    seen, count, size, out = None, 0, 0, None
    for depth in range(most_depth + 1):
        described = level.join(facts.select("page", "title", "size"), "page", "left").withColumn("title", F.coalesce("title", F.lit(""))).withColumn("size", F.coalesce("size", F.lit(0)))
        level = stored(running(described, ["place"], F.col("size"), place="_n", total="upto").drop("_n").withColumn("imported", F.col("upto") + size <= most_bytes))
        new, size, whole = level.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)) + size, F.coalesce(F.every("imported"), F.lit(True))).first()
        out = level if out is None else out.unionByName(level)
        seen = level.select("page") if seen is None else seen.union(level.select("page"))
        count += new
        if not new or depth == most_depth or count >= most_pages:
            break
        above = level.filter("imported").select(F.col("page").alias("parent"), F.col("place").alias("after"), F.concat("path", F.array("title")).alias("path"))
        found = above.join(kids, "parent").groupBy("page").agg(F.min(F.struct("after", "position", "parent", "path")).alias("x")).join(seen, "page", "left_anti")
        found = running(found.select("page", "x.*"), ["after", "position", "page"], place="nth").filter(F.col("nth") < most_pages - count)
        found = stored(found.select("page", (F.col("nth") + count).alias("place"), F.lit(depth + 1).alias("depth"), "parent", "path"))
        if not whole:  # the budget of bytes ended inside this level: what was discovered is never imported
            rest = found.withColumn("imported", F.lit(False))
            out = out.select(*rest.columns).unionByName(rest)
            break
        level = found
    return out.select("page", "place", "depth", "parent", "path", F.floor(F.col("place") / chunk).alias("chunk"), "imported")
