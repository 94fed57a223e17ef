"""Daily sketches merge to what one sketch of all days says, within the stated bounds of the exact answer."""

from pyspark.sql import functions as F

from quillspark.operators import sketches


def test_merged_days_equal_the_whole_within_the_bound(spark):
    rows = spark.range(60_000).select(
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 30 as int))").alias("at"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 2).cast("string"))).alias("k"),
        F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("who"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10**6)) / 7).alias("v"),
    )
    days = sketches.by_day(rows, ["k"], "at", "who", "v").cache()
    whole = {r.k: r for r in rows.groupBy("k").agg(F.countDistinct("who").alias("who"), F.count("*").alias("n"), F.sort_array(F.collect_list("v")).alias("vs")).collect()}
    ranks = (0.01, 0.25, 0.5, 0.9, 0.999)
    for parts in (days, days.orderBy(F.desc("day")).coalesce(1)):
        for r in sketches.read_off(sketches.merged(parts, ["k"]), ranks).collect():
            w = whole[r.k]
            assert r.n == w.n and abs(r.distinct - w.who) <= 3 * sketches.DISTINCT_ERROR * w.who
            for rank, q in zip(ranks, r.quantiles, strict=True):
                below, upto = sum(v < q for v in w.vs) / w.n, sum(v <= q for v in w.vs) / w.n
                assert below - sketches.RANK_ERROR <= rank <= upto + sketches.RANK_ERROR
    # half of the days are read off the same table
    half = sketches.read_off(sketches.merged(days.filter("day < '2024-01-16'"), ["k"])).filter("k = 'hot'").first()
    want = rows.filter("k = 'hot' AND at < '2024-01-16'").agg(F.countDistinct("who"), F.count("*")).first()
    assert half.n == want[1] and abs(half.distinct - want[0]) <= 3 * sketches.DISTINCT_ERROR * want[0]


def test_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(None, None, None, None), ("a", None, 1, 2.0)], "k string, at timestamp, who long, v double")
    got = {r.k: (r.n, r.distinct, r.quantiles) for r in sketches.read_off(sketches.merged(sketches.by_day(rows, ["k"], "at", "who", "v"), ["k"])).collect()}
    assert got == {None: (1, 0, None), "a": (1, 1, [2.0])}
    assert sketches.by_day(rows.limit(0), ["k"], "at", "who", "v").count() == 0
