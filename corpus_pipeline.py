"""From raw documents to packed training sequences: five stages, each over all rows its predecessor kept.

language ID -> exact dedup -> near dedup -> mixing to target weights -> packing.
Every stage but the last returns the columns of ``documents``; the last returns one row per packed piece.

Defined results, for every stage: a null text counts as empty, and language ID rejects it; null ids are kept and sort
below all; repeated rows are documents of their own until exact dedup; extra columns pass through to packing; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, language_id, mixing, ngram_join, packing
from quillspark.llm.common import P, bitmap_of, forget, in_bitmap, position, stored, text_or_empty

#: A text is rejected when every language needs more phrases for a letter: hardly two letters in a row are known anywhere.
#: Scripts of many letters, learned from few lines, come near 0.8.
MOST_PHRASES = 0.9
#: Near duplicates: word shingles and Jaccard similarity in hundredths.
SHINGLE, SIMILAR = 5, 80
BITS = 1 << 26


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the labels teach; those without letters, or that parse in none, go."""
    words = language_id.train(docs)
    named = language_id.predict(docs, words)
    return named.filter((F.col(f"{P}lang.lang_pred") != language_id.UNKNOWN) & (F.col(f"{P}lang.phrase_rate") <= MOST_PHRASES)).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    rest = [c for c in docs.columns if c != "doc_id"]
    return exact_dedup.exact_dedup(docs, carry=rest).filter("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 of the five-word shingles: the one with the smallest doc_id.

    Documents are told apart by doc_id and text, so rows that share an id alone are judged each by its own text; rows
    equal in both stay or go together. A text without words is linked with nothing and stays. Only rows that a bitmap
    of what goes (8 MiB at most) hits meet the join.
    """
    key = [F.col("doc_id"), F.xxhash64(text_or_empty("text"))]
    gone = stored(ngram_join.ngram_rows(docs, k=SHINGLE, num=SIMILAR, den=100).filter("row <> label").select(F.col("row.id").alias(f"{P}id"), F.col("row.th").alias(f"{P}th")).distinct(), "near-copies")
    marked = in_bitmap(docs.withColumn(f"{P}key", key[1]), position(BITS, *key), bitmap_of(gone, position(BITS, f"{P}id", f"{P}th")), f"{P}hit")
    hit = marked.filter(f"{P}hit")
    rest = hit.join(gone, hit["doc_id"].eqNullSafe(gone[f"{P}id"]) & (hit[f"{P}key"] == gone[f"{P}th"]), "left_anti")
    return marked.filter(~F.col(f"{P}hit")).unionByName(rest).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    drawn = mixing.mix_sources(docs).filter(F.col(f"{P}copies") > 0)
    return drawn.withColumn(f"{P}copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{P}copies")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 4096-token sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Language models, linked components and packing have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        forget(*before)  # the stage before is read no more
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
