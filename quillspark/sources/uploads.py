"""Uploads as a binary-file source: extension, declared type and size verdicts, content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension

# Accepted extensions, size cap.
EXTENSIONS = (".pdf", ".docx", ".pptx", ".xlsx", ".xls", ".png", ".jpg", ".jpeg", ".eml")
MOST_BYTES = 100 * 1024 * 1024


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256, verdict; content stays a column of its own, pruned where it isn't asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    verdict = F.when(~extension(F.col("path")).isin(*EXTENSIONS), "extension").when(F.col("length") > MOST_BYTES, "size").otherwise("ok")
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), verdict.alias("verdict"), "content")


def magic(content: Column) -> Column:
    """What the first bytes say: png, jpeg, gif, riff, pdf, zip, ole or unknown."""
    marks = {"png": "89504E47", "jpeg": "FFD8FF", "gif": "47494638", "riff": "52494646", "pdf": "25504446", "zip": "504B0304", "ole": "D0CF11E0"}
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit("unknown")
    for name, bytes_ in reversed(marks.items()):
        out = F.when(head.startswith(bytes_), name).otherwise(out)
    return out
