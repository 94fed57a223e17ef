"""Forked version chains against a recursive walk: random forests, long chains, one parent of many, cycles."""

import random
import time

from pyspark.sql import functions as F

from quillspark.operators import versioning

NONE = (None, None, None, None)


def walk(rows):
    link = {}
    for n, p in rows:
        if n is not None:
            link[n] = p if n not in link or link[n] is None else link[n] if p is None else min(p, link[n])
    kids = {}
    for n, p in link.items():
        if p is not None and p in link:
            kids.setdefault(p, []).append(n)
    out = dict.fromkeys(link, NONE)
    for root in [n for n, p in link.items() if p is None or p not in link]:
        order, stack = [], [(root, 0)]
        while stack:
            n, d = stack.pop()
            order.append((n, d))
            stack += [(k, d + 1) for k in sorted(kids.get(n, []), reverse=True)]
        size = {}
        for n, _ in reversed(order):
            size[n] = 1 + sum(size[k] for k in kids.get(n, []))
        out |= {n: (root, d, i, size[n]) for i, (n, d) in enumerate(order)}
    return out


def tree(spark, rows, kind="long"):
    df = spark.createDataFrame(rows, f"job_id {kind}, previous_id {kind}").repartition(3)
    return {r.job_id: (r.root, r.depth, r.place, r["size"]) for r in versioning.chain_tree(df).collect()}


def test_random_forests_with_cycles_and_missing_parents(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, rng.randrange(max(1, i)), rng.randrange(max(1, i)), 10_000 + i])) for i in range(300)]
    rows += [(1001, 1002), (1002, 1003), (1003, 1001), (1004, 1002), (1005, 1004), (1006, 1006), (None, 3), (7, 3), (7, None)]
    got = tree(spark, rows)
    assert got == walk(rows)
    assert all(got[n] == NONE for n in range(1001, 1007))


def test_text_ids_and_empty(spark):
    rows = [("b", "a"), ("c", "a"), ("d", "b"), ("a", None), ("x", "gone")]
    assert tree(spark, rows, "string") == walk(rows)
    assert tree(spark, []) == {}


def test_long_chain_and_a_parent_of_many(spark):
    started = time.time()
    chain = spark.range(10_000).select(F.col("id").alias("job_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("previous_id"))
    fan = spark.range(20_000, 25_000).select(F.col("id").alias("job_id"), F.lit(5000).cast("long").alias("previous_id"))
    got = {r.job_id: (r.root, r.depth, r.place, r["size"]) for r in versioning.chain_tree(chain.unionByName(fan)).collect()}
    assert time.time() - started < 60
    assert got[9_999] == (0, 9_999, 9_999, 1) and got[5000] == (0, 5000, 5000, 10_000) and got[0] == (0, 0, 0, 15_000)
    assert all(got[i] == (0, 5001, 10_000 + i - 20_000, 1) for i in range(20_000, 25_000))
