"""Versions, chains and state diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import forget, stored


def replay_uploads(uploads: DataFrame, name: str, arrived: list[str], digest: str) -> DataFrame:
    """Uploads in order of arrival per name: equal to the one before is a duplicate, otherwise the next version.

    A rejected upload equals the last accepted one, so comparing with the previous row is exact.
    """
    w = Window.partitionBy(name).orderBy(*arrived)
    dup = F.col(digest).eqNullSafe(F.lag(digest).over(w)) & (F.row_number().over(w) > 1)
    out = uploads.withColumn("duplicate", dup)
    return out.withColumn("version", F.sum((~F.col("duplicate")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def chain_roots(jobs: DataFrame, node: str = "job_id", previous: str = "previous_id") -> DataFrame:
    """node, root, depth: pointer doubling up the previous links, so a chain of length n takes log2(n) joins.

    A missing parent ends the walk. Each round is written to the shared folder, so plans don't grow, and drops the one
    before. After log2(nodes) rounds every chain has ended; what still moves then hangs on a cycle and has no root: root
    and depth are null.
    """
    jobs = stored(jobs.select(F.col(node).alias("n"), F.col(previous).alias("p")))
    known = jobs.select(F.col("n").alias("p")).distinct()
    at = jobs.join(known, "p", "left_semi")
    at = stored(jobs.select("n").join(at, "n", "left").select("n", F.coalesce("p", "n").alias("up"), F.col("p").isNotNull().cast("long").alias("d")))
    left = at.count()
    while True:
        hop = at.select(F.col("n").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        before, at = at, stored(at.join(hop, "up").select("n", F.col("up2").alias("up"), (F.col("d") + F.col("d2")).alias("d"), (F.col("d2") > 0).alias("moved")))
        forget(before)
        left //= 2
        if not left or not at.filter("moved").limit(1).count():
            break
    forget(jobs)
    ends = at.filter("d = 0").select(F.col("n").alias("up"), F.lit(True).alias("ends")).distinct()
    at = at.join(ends, "up", "left")
    return at.select(F.col("n").alias(node), F.when(F.col("ends"), F.col("up")).alias("root"), F.when(F.col("ends"), F.col("d")).alias("depth"))


def _siblings(links: DataFrame, parts: int) -> DataFrame:
    """n, p and the sibling before, by n: from neighbours in one global order, so a parent with very many children is split."""
    rows = stored(links.repartitionByRange(parts, "p", "n").sortWithinPartitions("p", "n").withColumn("at", F.monotonically_increasing_id()))
    within = rows.select((F.col("at") + 1).alias("at"), F.col("p").alias("p2"), F.col("n").alias("prev"))
    # the first row of a partition follows the last of the one before: one row a partition
    ends = rows.groupBy(F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("at"), F.max(F.struct("at", "p", "n")).alias("last"))
    ends = ends.withColumn("last", F.lag("last").over(Window.orderBy("part"))).filter("last is not null")
    before = within.unionByName(ends.select("at", F.col("last.p").alias("p2"), F.col("last.n").alias("prev")))
    return rows.join(before, "at", "left").select("n", "p", F.when(F.col("p2") == F.col("p"), F.col("prev")).alias("prev"))


def chain_tree(jobs: DataFrame, node: str = "job_id", previous: str = "previous_id") -> DataFrame:
    """node, root, depth, place, size: where each version stands in its forked chain.

    ``place`` counts from 0 at the root, a version before its successors and these by id, each with all that follow it
    (preorder); ``size`` counts a version and all that descend from it. Rows that repeat a node count once, with their
    smallest previous link; a missing parent makes a root; versions on a cycle, or that hang on one, have nulls.

    An Euler tour enters and leaves every version once. Each of its 2n steps knows the step before it: entering comes
    after leaving the sibling before or entering the parent, leaving after leaving the last child or entering itself.
    Pointer doubling sums entries and depth up to each step in log2(2n) rounds, whatever the shape: chains of any
    length, or one parent with a third of all versions. Steps have one predecessor each, so no join key is hot; each
    round is written to the shared folder and drops the one before.
    """
    base = stored(jobs.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("n")).agg(F.min(previous).alias("p")))
    links = base.filter("p is not null").join(base.select(F.col("n").alias("p")), "p", "left_semi")
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kin = stored(_siblings(links.select("n", "p"), parts))
    last = kin.groupBy(F.col("p").alias("n")).agg(F.max("n").alias("child"))
    one = F.lit(1).cast("long")
    enter = base.select("n").join(kin, "n", "left").select("n", F.lit(False).alias("out"), F.coalesce("prev", "p").alias("pn"), F.col("prev").isNotNull().alias("pout"), one.alias("entered"), one.alias("level"))
    leave = base.select("n").join(last, "n", "left").select("n", F.lit(True).alias("out"), F.coalesce("child", "n").alias("pn"), F.col("child").isNotNull().alias("pout"), (one - 1).alias("entered"), (-one).alias("level"))
    at = stored(enter.unionByName(leave).withColumn("top", F.when(F.col("pn").isNull(), F.col("n"))))
    left = at.count()
    while left and at.filter("pn is not null").limit(1).count():
        hop = at.select(F.col("n").alias("pn"), F.col("out").alias("pout"), F.struct(F.col("pn").alias("n"), F.col("pout").alias("out"), "entered", "level", "top").alias("b"))
        moved = at.filter("pn is not null").join(hop, ["pn", "pout"]).select(
            "n", "out", F.col("b.n").alias("pn"), F.col("b.out").alias("pout"), (F.col("entered") + F.col("b.entered")).alias("entered"), (F.col("level") + F.col("b.level")).alias("level"), F.col("b.top").alias("top")
        )
        before, at = at, stored(at.filter("pn is null").unionByName(moved))
        forget(before)
        left //= 2
    forget(base, kin)
    ends = F.col("top").isNotNull()
    first, final = F.max(F.when(~F.col("out") & ends, F.col("entered"))), F.max(F.when(F.col("out") & ends, F.col("entered")))
    out = at.groupBy("n").agg(F.max("top").alias("root"), (F.max(F.when(~F.col("out") & ends, F.col("level"))) - 1).alias("depth"), (first - 1).alias("place"), (final - first + 1).alias("size"))
    return out.withColumnRenamed("n", node)


def bounded_crawl(kids: DataFrame, start: DataFrame, most_depth: int = 10, most_pages: int = 200) -> DataFrame:
    """Breadth first from ``start`` (page) over ``kids`` (parent, page): page, depth of the first ``most_pages`` by (depth, page).

    Each level is one join and one anti-join against the pages seen, written to the shared folder before the next, so
    the plan of a level doesn't hold those before. It stops early once the cap is reached.
    """
    level = stored(start.select("page", F.lit(0).alias("depth")))
    seen, count = level, level.count()
    for depth in range(1, most_depth + 1):
        found = level.select(F.col("page").alias("parent")).join(kids, "parent").select("page").distinct()
        # a level is cut to what the cap leaves before it is stored
        level = stored(found.join(seen, "page", "left_anti").orderBy("page").limit(most_pages - count).withColumn("depth", F.lit(depth)))
        new = level.count()
        if not new:
            break
        seen, count = seen.unionByName(level), count + new
        if count >= most_pages:
            break
    return seen.orderBy("depth", "page").limit(most_pages)


def page_diff(pages: DataFrame, states: DataFrame, live_jobs: DataFrame) -> DataFrame:
    """Fetched pages (page_id, version) against known states (page_id, version, job_id): new, unchanged, changed, restarted."""
    s = states.select("page_id", F.col("version").alias("old"), "job_id")
    j = live_jobs.select("job_id", F.lit(True).alias("alive"))
    x = pages.join(s, "page_id", "left").join(j, "job_id", "left")
    alive = F.col("alive").isNotNull()
    verdict = F.when(F.col("old").isNull(), "new").when(~alive, "restarted").when(F.col("old") == F.col("version"), "unchanged").otherwise("changed")
    return x.withColumn("verdict", verdict).withColumn("chain_to", F.when(alive & F.col("verdict").isin("unchanged", "changed"), F.col("job_id")))


def retry_decision(http_status: Column, attempts: Column, most: int = 5) -> Column:
    """Deliveries: 2xx is done, 4xx is final, 0 and 5xx are retried until ``most`` attempts."""
    again = (http_status == 0) | (http_status >= 500)
    return F.when(http_status.between(200, 299), "delivered").when(again & (attempts < most), "retry").otherwise("failed")


def backoff_seconds(attempts: Column) -> Column:
    return F.lit(30) * F.pow(F.lit(2), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(3))).cast("long")


def claim(status: Column, idle_s: Column, lease_s: int = 120) -> Column:
    """A worker's claim of a job: fresh when pending, reclaimed when its lease ran out, otherwise none."""
    return F.when(status == "PENDING", "claimed").when((status == "RUNNING") & (idle_s > lease_s), "reclaimed").otherwise("skipped")


def failure_streaks(events: DataFrame, key: str, at: str, failed: Column, gap_s: int = 900) -> DataFrame:
    """Failures not more than ``gap_s`` apart form a streak that a success ends: key, streak, n, first, last."""
    w = Window.partitionBy(key).orderBy(at, "event_id")
    e = events.withColumn("bad", failed).withColumn("breaks", F.sum((~F.col("bad")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("bad")
    w2 = Window.partitionBy(key, "breaks").orderBy(at, "event_id")
    gap = F.unix_timestamp(F.col(at).cast("timestamp")) - F.unix_timestamp(F.lag(at).over(w2).cast("timestamp"))
    e = e.withColumn("new", (gap.isNull() | (gap > gap_s)).cast("long")).withColumn("streak", F.sum("new").over(w2.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy(key, "breaks", "streak").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
