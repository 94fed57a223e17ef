"""The listing source and the archive sink: how they stop, resume, replace, and survive a killed write."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.sources import archives, listings
from quillspark.sources.remote import names
from quillspark.streaming.runs import restarted


def page(ids, after=None, **extra):
    return json.dumps({"results": [{"id": str(i), "type": "page"} | extra for i in ids], "_links": {"next": after} if after else {}})


@pytest.mark.parametrize(
    "mode, bodies, limit, most, want",
    [
        ("cursor", {"u": page([1, 2], "v"), "v": page([3])}, 2, 9, [(0, "1"), (0, "2"), (1, "3")]),
        ("cursor", {"u": page([1], "v"), "v": page([2], "u")}, 2, 9, [(0, "1"), (1, "2")]),
        ("cursor", {"u": page([1], "v"), "v": page([], "w"), "w": page([3])}, 2, 9, [(0, "1")]),
        ("cursor", {"u": page([1], "elsewhere")}, 2, 9, [(0, "1")]),
        ("cursor", {"u": page([1], "v"), "v": "no json"}, 2, 9, [(0, "1")]),
        ("cursor", {"u": None}, 2, 9, []),
        ("cursor", {"u": page([1, 2, 3], "v"), "v": page([4])}, 2, 2, [(0, "1"), (0, "2")]),
        ("cursor", {"u": json.dumps({"results": [{"id": 1, "type": "comment"}, {"id": ""}, {"id": 2}, 7]})}, 2, 9, [(0, "2")]),
        ("start", {"u?start=0": page([1, 2]), "u?start=2": page([3]), "u?start=4": page([4])}, 2, 9, [(0, "1"), (0, "2"), (1, "3")]),
        ("start", {"u?start=0": page([1, 2]), "u?start=2": page([3, 4])}, 2, 9, [(0, "1"), (0, "2"), (1, "3"), (1, "4")]),
    ],
)
def test_where_a_listing_ends(mode, bodies, limit, most, want):
    assert [(p, i) for p, _, i, _ in listings.follow(next(iter(bodies)), mode, bodies, limit, most)] == want


def _responses(spark, some):
    rows = [(f"L{k}", "cursor", f"{k}/{p}", p == 0, page([10 * k + p], f"{k}/{p + 1}" if p < 2 else None)) for k in some for p in range(3)]
    return spark.createDataFrame(rows, "listing string, mode string, url string, first boolean, body string")


def test_listings_in_partitions_and_resumed(spark, tmp_path):
    at = f"file://{tmp_path}/r"
    assert listings.read_listings(spark, at).count() == 0
    listings.record(_responses(spark, range(6)), at, files=3)
    got = listings.read_listings(spark, at)
    assert got.rdd.getNumPartitions() > 1
    assert sorted(int(r.id) for r in got.collect()) == [10 * k + p for k in range(6) for p in range(3)]
    more = [lambda: None, lambda: listings.record(_responses(spark, range(6, 8)), at), lambda: None]
    out = restarted(spark, lambda: listings.read_listings(spark, at, stream=True), more)
    assert sorted(int(r.id) for r in out.collect()) == [10 * k + p for k in range(8) for p in range(3)]  # each once


def files(spark, at):
    return {r.path: r.markdown for r in archives.current(spark, at).collect()}


def test_results_are_replaced_all_or_none(spark, tmp_path):
    at = f"file://{tmp_path}/results"
    assert files(spark, at) == {}
    rows = spark.range(40).select(F.concat(F.lit("f/"), F.col("id").cast("string")).alias("path"), F.lit("old").alias("markdown"))
    archives.write_results(rows, at, shards=3)
    assert files(spark, at) == {f"f/{i}": "old" for i in range(40)}
    # a write killed in one task, after others have written: what stood still stands
    broken = rows.withColumn("markdown", F.when(F.col("path") == "f/7", F.raise_error(F.lit("killed")).cast("string")).otherwise("new"))
    with pytest.raises(Exception, match="killed"):
        archives.write_results(broken, at, shards=3)
    assert files(spark, at) == {f"f/{i}": "old" for i in range(40)}
    assert len(names(f"{at}/writes")) == 1
    some = rows.filter("path in ('f/1', 'f/2')").withColumn("markdown", F.lit("ä new"))
    for _ in range(2):  # a rerun changes nothing
        archives.write_results(some, at)
        assert files(spark, at) == {f"f/{i}": "ä new" if i in (1, 2) else "old" for i in range(40)}
    archives.compact(spark, at)
    assert len(names(f"{at}/writes")) == 1 and files(spark, at)["f/2"] == "ä new" and len(files(spark, at)) == 40


def test_a_driver_lost_before_its_commit_leaves_the_old_state(spark, tmp_path):
    at = f"{tmp_path}/results"
    archives.write_results(spark.createDataFrame([("a", "1")], "path string, markdown string"), at)
    lost = archives.ArchiveWriter(at)
    message = lost.write(iter([{"path": "a", "markdown": "2"}]))
    assert files(spark, at) == {"a": "1"}
    lost.abort([message, None])
    assert all(n.endswith(".zip") and not n.startswith(lost._id) for n in names(f"{at}/data"))


def test_edges_of_results(spark, tmp_path):
    at = f"{tmp_path}/results"
    archives.write_results(spark.createDataFrame([("a", None), ("b", "x"), ("b", "y"), ("c", "")], "path string, markdown string"), at)
    assert files(spark, at) == {"a": "", "b": "y", "c": ""}
    archives.write_results(spark.createDataFrame([], "path string, markdown string"), at)
    assert files(spark, at) == {"a": "", "b": "y", "c": ""}
    with pytest.raises(Exception, match="without a path"):
        archives.write_results(spark.createDataFrame([(None, "x")], "path string, markdown string"), at)
