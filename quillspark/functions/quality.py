"""Noise, gibberish and gate scores of texts, as native expressions; tokens are computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"

# Grade thresholds and signal weights.
GRADE_A, GRADE_B = 0.9, 0.75
WEIGHT_CONFIDENCE, WEIGHT_STRUCTURE, WEIGHT_TEXT = 0.5, 0.3, 0.2


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def gibberish(token: Column) -> Column:
    """Seven letters and no vowel, or six characters of at most two kinds, or six of neither letters nor only digits."""
    low = F.lower(token)
    letters = F.regexp_replace(low, r"[^\p{L}]", "")
    kinds = F.size(F.array_distinct(F.split(low, "")))
    no_letter = F.length(letters) == 0
    return F.when(no_letter, (F.length(token) >= 6) & ~token.rlike("^[0-9]+$")).otherwise(
        ((F.length(letters) >= 7) & ~letters.rlike("[aeiou]")) | ((kinds <= 2) & (F.length(low) >= 6))
    )


def noise(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_tokens, n_unique, n_lines, n_unique_lines, n_symbols, n_gibberish, noise (0 to 1; 1 for no text)."""
    clean = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", ""))
    d = docs.withColumn("clean", clean).withColumn("tok", tokens(F.col("clean")))
    lines = F.filter(F.transform(F.split("clean", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    d = d.withColumn("lines", lines).withColumns(
        {
            "n_tokens": F.size("tok"),
            "n_unique": F.size(F.array_distinct(F.transform("tok", lambda x: F.lower(x)))),
            "n_lines": F.size("lines"),
            "n_unique_lines": F.size(F.array_distinct("lines")),
            "n_symbols": F.length(F.regexp_replace("clean", r"[\p{L}\p{N}\s]", "")),
            "n_gibberish": F.size(F.filter("tok", gibberish)),
        }
    )

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))

    raw = (
        0.35 * F.coalesce(1 - share("n_unique", "n_tokens"), F.lit(0.0))
        + 0.25 * F.coalesce(1 - share("n_unique_lines", "n_lines"), F.lit(0.0))
        + 0.2 * F.col("n_symbols") / F.greatest(F.length("clean"), F.lit(1))
        + 0.2 * F.coalesce(share("n_gibberish", "n_tokens"), F.lit(0.0))
    )
    return d.withColumn("noise", F.when(F.col("clean") == "", F.lit(1.0)).otherwise(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))).drop("clean", "tok", "lines")


def gate(score: Column) -> tuple[Column, Column]:
    """(grade, recommendation)"""
    g = F.when(score >= GRADE_A, "A").when(score >= GRADE_B, "B").otherwise("C")
    return g, F.when(score >= GRADE_A, "allow").when(score >= GRADE_B, "warn").otherwise("block")


def gate_score(confidence: Column, structure: Column, text: Column) -> Column:
    """Weighted mean over the signals that are present (not null); 0 with none."""
    parts = [(confidence, WEIGHT_CONFIDENCE), (structure, WEIGHT_STRUCTURE), (text, WEIGHT_TEXT)]
    total = sum(F.coalesce(c * w, F.lit(0.0)) for c, w in parts)
    weight = sum(F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts)
    return F.coalesce(total / F.nullif(weight, F.lit(0.0)), F.lit(0.0))


def structure_score(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, structure: from blocks (doc_id, page, ord, label, content) and the page count of each document."""
    label = F.lower(F.coalesce("label", F.lit("")))
    table = label.contains("table")
    b = blocks.groupBy("doc_id").agg(
        F.countDistinct("page").alias("filled"), F.count("*").alias("n"), F.count("ord").alias("ordered"), F.count_if(table).alias("tables"),
        F.count_if(table & (F.trim(F.coalesce("content", F.lit(""))) != "")).alias("full"), F.count_if(label.contains("formula")).alias("formulas"),
    )
    s = pages.join(b, "doc_id", "left")
    n = F.col("n")
    value = (
        0.40 * F.coalesce(F.col("filled") / F.col("n_pages"), F.lit(0.0))
        + 0.25 * F.coalesce(F.col("ordered") / n, F.lit(0.0))
        + 0.20 * F.coalesce(F.when(F.col("tables") > 0, F.col("full") / F.col("tables")), F.lit(1.0))
        + 0.15 * (1 - F.least(F.lit(1.0), F.coalesce(F.col("formulas") / n, F.lit(0.0)) / 0.1))
    )
    return s.select("doc_id", F.when(F.col("n_pages") > 0, F.least(F.lit(1.0), value)).otherwise(F.lit(0.0)).alias("structure"))


def confidence(samples: DataFrame) -> DataFrame:
    """doc_id, confidence, n: half the mean, half the share of at least 0.8; only values in 0 to 1 count."""
    ok = samples.filter("value BETWEEN 0 AND 1")
    return ok.groupBy("doc_id").agg((0.5 * F.avg("value") + 0.5 * F.avg((F.col("value") >= 0.8).cast("double"))).alias("confidence"), F.count("*").alias("n"))
