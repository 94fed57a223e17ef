"""Sharding by longest-processing-time scheduling.

Rows with equal text form a group that must stay together. Groups, sorted by size, go to the least-loaded shard
through a heap. A group of at least total / (shards * GRAIN) bytes is scheduled on its own: there are at most
shards * GRAIN of those, whatever the input. The smaller groups are first gathered, by hash, into shards * GRAIN
bundles, and the heap schedules bundles like groups. So the driver sees at most 2 * shards * GRAIN (key, size)
pairs at any scale, and shard sizes differ by about one bundle, unless one group alone is above a shard's share.

Slots are gapless in each shard without a sort of a whole shard: rows fall into hashed cells of about CELL rows,
a running sum over cell counts gives each cell's base, and a row number inside the cell gives the rest.

Defined results: null text has no bytes and belongs with the empty text's group; repeated rows each get a slot of
their own; null ids are rows like others, first in their cell; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import P, stored, text_or_empty

GRAIN = 256
CELL = 20_000
OVERHEAD = 8


def schedule(items: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Longest processing time first: (size, key) pairs, largest first, each to the least-loaded shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, key in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        load, s = heap[0]
        out[key] = s
        heapq.heapreplace(heap, (load + size, s))
    return out


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", grain: int = GRAIN, cell: int = CELL) -> DataFrame:
    """id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null for this law)."""
    spark = docs.sparkSession
    bins = shards * grain
    text = text_or_empty(F.col(f"{P}text"))
    rows = docs.select(F.col(id_col).alias(f"{P}id"), F.col(text_col).alias(f"{P}text")).select(
        f"{P}id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias(f"{P}key"),
    )
    rows = stored(rows, "shard-rows")
    groups = rows.groupBy(f"{P}key").agg(F.sum("size").alias(f"{P}group"))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    heavy = F.col(f"{P}group") * bins >= F.lit(total)
    bundle = F.pmod(F.xxhash64(f"{P}key"), F.lit(bins)).cast("int")
    items = groups.groupBy(F.when(heavy, F.col(f"{P}key")).alias("key"), F.when(~heavy, bundle).alias("bundle")).agg(F.sum(f"{P}group").alias("size")).collect()
    placed = schedule([(r["size"], bytes(r["key"]) if r["key"] is not None else r["bundle"]) for r in items], shards)
    large = [(bytearray(k), s) for k, s in placed.items() if isinstance(k, bytes)]
    small = [(k, s) for k, s in placed.items() if isinstance(k, int)]
    by_key = spark.createDataFrame(large, f"{P}key binary, {P}s1 int")
    by_bundle = spark.createDataFrame(small, f"{P}bundle int, {P}s2 int")
    at = rows.withColumn(f"{P}bundle", bundle).join(F.broadcast(by_key), f"{P}key", "left").join(F.broadcast(by_bundle), f"{P}bundle", "left")
    at = at.withColumn("shard", F.coalesce(f"{P}s1", f"{P}s2"))

    cells = max(1, -(-n // (shards * cell)))
    at = at.withColumn(f"{P}cell", F.pmod(F.xxhash64(f"{P}id", "size", "text_crc32"), F.lit(cells)).cast("int"))
    counts = at.groupBy("shard", f"{P}cell").agg(F.count("*").alias(f"{P}n"))
    before = Window.partitionBy("shard").orderBy(f"{P}cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", f"{P}cell", F.coalesce(F.sum(f"{P}n").over(before), F.lit(0)).alias(f"{P}base"))
    inside = F.row_number().over(Window.partitionBy("shard", f"{P}cell").orderBy(f"{P}id", "size", "text_crc32"))
    numbered = at.withColumn(f"{P}row", inside).join(bases, ["shard", f"{P}cell"])
    return numbered.select(
        F.col(f"{P}id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col(f"{P}base") + F.col(f"{P}row") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 23, sizes near equal."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
