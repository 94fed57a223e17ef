"""Chains and crawls against plain loops."""

from pyspark.sql import functions as F

from quillspark.operators import versioning


def test_chains_end_on_cycles_and_length_does_not_matter(spark):
    chain = spark.range(10_000).select(F.col("id").alias("job_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("previous_id"))
    extra = spark.createDataFrame([(20_001, 20_002), (20_002, 20_001), (20_003, 20_001), (20_004, 99_999), (20_005, 20_005)], "job_id long, previous_id long")
    got = {r.job_id: (r.root, r.depth) for r in versioning.chain_roots(chain.unionByName(extra)).collect()}
    assert len(got) == 10_005 and all(got[i] == (0, i) for i in range(10_000))
    assert got[20_001] == got[20_002] == got[20_003] == got[20_005] == (None, None) and got[20_004] == (20_004, 0)


def test_crawl_stops_at_depth_pages_and_cycles(spark):
    kids = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (1, 6)], "parent long, page long")
    start = spark.createDataFrame([(1,)], "page long")
    assert [(r.page, r.depth) for r in versioning.bounded_crawl(kids, start, most_depth=3).collect()] == [(1, 0), (2, 1), (6, 1), (3, 2), (4, 3)]
    assert versioning.bounded_crawl(kids, start, most_pages=2).count() == 2
