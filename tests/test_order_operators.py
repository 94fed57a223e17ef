"""Prefix sums, selection by histograms and the budgeted crawl against plain loops."""

import random
from collections import Counter, deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.operators.crawl import budgeted_crawl
from quillspark.operators.joins import left_known
from quillspark.operators.prefix import running
from quillspark.operators.selection import beyond_newest, kth_largest
from quillspark.operators.temporal import as_of


def test_running_sums_over_one_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, rng.randrange(100)]), rng.randrange(50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, v long, k long").repartition(7)
    got = sorted((r.place, r.id, r.total) for r in running(df, [F.desc("k"), "id"], F.col("v")).collect())
    total, want = 0, []
    for place, (i, v, _) in enumerate(sorted(rows, key=lambda r: (-r[2], r[0]))):
        total += v or 0
        want.append((place, i, total))
    assert got == want
    assert sorted(running(df, ["id"]).columns) == ["id", "k", "place", "v"]
    assert running(df.limit(0), ["id"], F.col("v")).count() == 0


def test_kth_largest_with_ties_hot_keys_and_few_rows(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.randrange(-(2**62), 2**62), 7, 7, 8]), i) for i in range(3000)]
    rows += [("hot", 5, 10_000 + i) for i in range(4000)] + [("few", 1, 20_000), ("few", 2, 20_001), ("one", None, 20_002)]
    df = spark.createDataFrame(rows, "k string, v long, id long").repartition(5)
    for k in (1, 3, 900):
        got = {r.k: (r.cutoff, r.beyond) for r in kth_largest(df, ["k"], "v", k).collect()}
        want = {}
        for key in {r[0] for r in rows}:
            vs = sorted((r[1] for r in rows if r[0] == key and r[1] is not None), reverse=True)
            if len(vs) >= k:
                want[key] = (vs[k - 1], sum(v > vs[k - 1] for v in vs))
        assert got == want
        gone = Counter(r.id for r in beyond_newest(df.filter("v is not null"), ["k"], "v", "id", k).collect())
        left = Counter()
        for key in {r[0] for r in rows}:
            mine = sorted(((r[1], r[2]) for r in rows if r[0] == key and r[1] is not None), reverse=True)
            left.update(i for _, i in mine[k:])
        assert gone == left
    assert kth_largest(df.limit(0), ["k"], "v", 1).count() == 0


def queue(kids, facts, start, most_depth, most_pages, most_bytes, chunk):
    known, waiting, size, out = set(), deque(), 0, []
    for page, path in sorted(start)[:most_pages]:
        known.add(page)
        waiting.append((page, 0, None, path))
    order, imported = list(waiting), set()
    while waiting:
        page, depth, _, path = waiting.popleft()
        title, n = facts.get(page, ("", 0))
        if size + n > most_bytes:
            break
        size += n
        imported.add(page)
        if depth < most_depth:
            for _, child in sorted(kids.get(page, [])):
                if len(known) < most_pages and child not in known:
                    known.add(child)
                    waiting.append((child, depth + 1, page, [*path, title]))
                    order.append(waiting[-1])
    for place, (page, depth, parent, path) in enumerate(order):
        out.append((page, place, depth, parent, path, place // chunk, page in imported))
    return out


@pytest.mark.parametrize("depth, pages, size", [(10, 200, 10**9), (2, 200, 10**9), (10, 37, 10**9), (10, 200, 300), (10, 60, 700), (0, 5, 10), (10, 3, 10**9)])
def test_crawl_follows_the_queue(spark, depth, pages, size):
    rng = random.Random(depth + pages)
    edges = [(rng.randrange(90), i % 7, rng.randrange(120)) for i in range(260)] + [(0, 9, 1), (1, 9, 0), (0, 3, 0)]
    facts = {p: (f"t{p}", rng.randrange(20)) for p in range(110)}
    kids = {}
    for parent, position, page in edges:
        kids.setdefault(parent, []).append((position, page))
    start = [(0, ["Top"]), (5, [])]
    want = queue(kids, facts, start, depth, pages, size, 4)
    got = budgeted_crawl(
        spark.createDataFrame(edges, "parent long, position int, page long").repartition(3), spark.createDataFrame([(p, *x) for p, x in facts.items()], "page long, title string, size long"),
        spark.createDataFrame(start, "page long, path array<string>"), depth, pages, size, 4,
    )
    assert [tuple(r) for r in got.orderBy("place").collect()] == want


def test_crawl_of_nothing(spark):
    none = spark.createDataFrame([], "page long, path array<string>")
    kids, facts = spark.createDataFrame([(1, 0, 2)], "parent long, position int, page long"), spark.createDataFrame([], "page long, title string, size long")
    assert budgeted_crawl(kids, facts, none).count() == 0


def test_as_of_over_hot_keys_and_edges(spark):
    rng = random.Random(6)
    day = lambda n: None if n is None else datetime(2024, 1, 1) + timedelta(minutes=n)
    right = [(rng.choice(["hot", "hot", "b", None]), rng.choice([None, rng.randrange(3000)]), i) for i in range(500)]
    left = [(rng.choice(["hot", "hot", "b", "c", None]), rng.choice([None, rng.randrange(-50, 3300)]), i) for i in range(500)]
    r = spark.createDataFrame([(k, day(t), i) for k, t, i in right], "k string, edited timestamp, version long").repartition(3)
    lf = spark.createDataFrame([(k, day(t), i) for k, t, i in left], "k string, at timestamp, id long").repartition(4)
    for buckets in (1, 7, 1024):
        got = {x.id: x.found and x.found.version for x in as_of(lf, r, ["k"], "at", "edited", "version", buckets).collect()}
        for k, t, i in left:
            known = [(rt, v) for rk, rt, v in right if rk == k and rt is not None and t is not None and rt <= t]
            assert got[i] == (max(known)[1] if known else None)
    plan = as_of(lf, r, ["k"], "at", "edited", "version")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert as_of(lf, r.limit(0), ["k"], "at", "edited", "version").filter("found is not null").count() == 0


def test_as_of_finds_the_same_of_equal_rows_in_any_order(spark):
    at = datetime(2024, 1, 1)
    right = [(k, at, 1, body) for k in range(40) for body in (3, 1, 2)] + [(-1, at + timedelta(days=1), 1, 0)]  # one part of time holds all the equal rows
    left = spark.createDataFrame([(k, at + timedelta(minutes=1), k) for k in range(40)], "k long, at timestamp, id long")
    for turned in (right, right[::-1]):
        r = spark.createDataFrame(turned, "k long, edited timestamp, version long, body long").coalesce(1)
        for buckets in (1, 1024):
            assert {x.found.body for x in as_of(left, r, ["k"], "at", "edited", "version", buckets).collect()} == {3}


def test_rows_without_a_key_do_not_meet_in_a_left_join(spark):
    left = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 100).alias("k"))
    right = spark.createDataFrame([(i, f"s{i}") for i in range(0, 100, 2)] + [(None, "none")], "k long, s string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = left_known(left, right, "k")
        want = left.join(right, "k", "left")
        assert sorted(out.collect(), key=str) == sorted(want.collect(), key=str) and out.schema == want.schema
        most = out.withColumn("part", F.spark_partition_id()).groupBy("part").count().agg(F.max("count")).first()[0]
        assert most <= 1500  # 4,000 of the 6,000 rows have no key
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
