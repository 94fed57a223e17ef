"""Exact deduplication by progressive refinement (DataFrame functions only).

Rows are grouped by text length, then by a hash of a short prefix, then by the digest of the whole text; the whole
text is read only for rows whose (length, prefix) group has at least two members.

No text is shuffled. The surviving lengths, then the surviving (length, prefix) groups, come back to the scan as
bitmaps (8 hashed positions a row, 2**22 to 2**26 of them, so 8 MiB at most), written once to the shared folder; a
false hit only costs one digest.
A group may hold a third of all rows: every grouping is a count or a maximum with map-side combine. Rows that reach the
digest are stored with a number of their own, groups are stored too, and the two meet in a plain equi-join with nothing
keyed above it, so adaptive execution splits a hot group.

Defined results: a null text counts as empty; of equal texts the row with the largest id stays; rows that repeat
(id, text) are told apart by row number, so exactly one row of a group is kept; null ids sort below every id;
an empty table gives an empty result; extra columns pass through ``carry`` only, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, bitmap_of, in_bitmap, position, stored, text_or_empty

PREFIX_CHARS = 64
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 26


def _repeated(rows: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Bitmap of the key groups with two rows or more."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias(f"{P}n")).filter(F.col(f"{P}n") > 1)
    return bitmap_of(groups, position(bits, *keys))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: id, ``carry`` columns, keep_id, group_size, kept."""
    text = text_or_empty(F.col(f"{P}text"))
    keep = [F.col(f"{P}c{i}") for i in range(len(carry))]
    base = docs.select(F.col(id_col).alias(f"{P}id"), F.col(text_col).alias(f"{P}text"), *[F.col(c).alias(f"{P}c{i}") for i, c in enumerate(carry)])
    base = base.withColumn(f"{P}len", F.octet_length(text))

    bits, rows = LEAST_BITS, docs.select(F.lit(1)).count()
    while bits < MOST_BITS and bits < 8 * rows:
        bits *= 2
    sized = in_bitmap(base, position(bits, f"{P}len"), _repeated(base, [f"{P}len"], bits), f"{P}h1")
    prefix = F.when(F.col(f"{P}h1"), F.xxhash64(F.substring(text, 1, PREFIX_CHARS)))
    sized = sized.withColumn(f"{P}pre", prefix)
    both = [f"{P}len", f"{P}pre"]
    marked = in_bitmap(sized, position(bits, *both), _repeated(sized.filter(f"{P}h1"), both, bits), f"{P}h2")
    hit = F.col(f"{P}h1") & F.col(f"{P}h2")

    alone = marked.filter(~hit).select(
        F.col(f"{P}id"), *keep, F.col(f"{P}id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    row = F.struct(F.col(f"{P}id").alias("id"), F.col(f"{P}row").alias("row"))
    rows = marked.filter(hit).select(f"{P}id", *keep, f"{P}len", F.unhex(F.sha2(text, 256)).alias(f"{P}sha"), F.monotonically_increasing_id().alias(f"{P}row"))
    rows = stored(rows, "digests")
    groups = rows.groupBy(f"{P}len", f"{P}sha").agg(F.max(row).alias(f"{P}top"), F.count("*").alias("group_size"))
    groups = stored(groups, "groups")
    joined = rows.join(groups, [f"{P}len", f"{P}sha"]).withColumn("keep_id", F.col(f"{P}top.id")).withColumn("kept", F.col(f"{P}top.row") == F.col(f"{P}row"))
    out = alone.unionByName(joined.select(f"{P}id", *keep, "keep_id", "group_size", "kept"))
    return out.select(F.col(f"{P}id").alias(id_col), *[F.col(f"{P}c{i}").alias(c) for i, c in enumerate(carry)], "keep_id", "group_size", "kept")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = exact_dedup(docs.withColumn("text_sha256", F.sha2(text_or_empty("text"), 256)), carry=["text_sha256"])
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
