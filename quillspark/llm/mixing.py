"""Mixing sources to target weights.

Words are summed per source, targets are filled to the weights under a cap of MOST times the source, and each
document is taken floor(rate) times plus one more with probability frac(rate), decided by a hash of its id.

The per-source table is aggregated with map-side combine (a source may hold a third of all rows), stored, and joined
back: by broadcast where it was measured to be at most MOST_BYTES, and otherwise as a plain equi-join that splits skew.

Defined results: null source is a source of its own, last in order; null or empty text has size 0 and takes 0;
equal ids draw equal copies; an empty table gives an empty result; a table without any word has targets of 0;
extra columns pass through :func:`mix_sources` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import P, stored, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
MOST_BYTES = 8 << 20


def draw(id_col: Column, seed: str) -> Column:
    """Uniform in [0, 1), from the first 52 bits of an MD5 of seed and id."""
    key = F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def source_targets(sizes: DataFrame, source: str, size: str, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: weighted shares of ``share`` times all words, none above ``most`` times its source.

    The reshare has a closed form: with sources in order of cap / weight, those before some point sit at their cap
    and the rest share what is left by weight. Three windows over the table of sources (not of documents).
    """
    per = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    order = Window.orderBy(F.col(source).asc_nulls_last())
    per = per.withColumn(f"{P}w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn(f"{P}cap", F.col("source_size") * most)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col(f"{P}cap") / F.col(f"{P}w"), F.col(source).asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * share - F.coalesce(F.sum(f"{P}cap").over(before), F.lit(0.0))
    weight_left = F.sum(f"{P}w").over(whole) - F.coalesce(F.sum(f"{P}w").over(before), F.lit(0.0))
    per = per.withColumn(f"{P}level", left / weight_left)
    open_ = F.col(f"{P}level") * F.col(f"{P}w") < F.col(f"{P}cap")
    per = per.withColumn(f"{P}first", F.min(F.when(open_, F.col(f"{P}cap") / F.col(f"{P}w"))).over(whole))
    per = per.withColumn(f"{P}final", F.max(F.when(open_ & (F.col(f"{P}cap") / F.col(f"{P}w") == F.col(f"{P}first")), F.col(f"{P}level"))).over(whole))
    target = F.coalesce(F.least(F.col(f"{P}cap"), F.col(f"{P}final") * F.col(f"{P}w")), F.col(f"{P}cap"))
    return per.select(source, "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix:") -> DataFrame:
    """The input rows with ``__qs_size``, ``__qs_source_size``, ``__qs_target`` and ``__qs_copies``."""
    rows = docs.withColumn(f"{P}size", word_count(text_col))
    plan = source_targets(rows.select(F.col(source_col).alias(f"{P}source"), f"{P}size"), f"{P}source", f"{P}size", weights, share, most)
    plan = plan.select(f"{P}source", F.col("source_size").alias(f"{P}source_size"), F.col("target").alias(f"{P}target"))
    plan = stored(plan, "targets")
    size = plan.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.col(f"{P}source").cast("string")), F.lit(0)) + 24), F.lit(0))).first()[0]
    rows = rows.join(F.broadcast(plan) if size <= MOST_BYTES else plan, rows[source_col].eqNullSafe(plan[f"{P}source"])).drop(f"{P}source")
    rate = F.when(F.col(f"{P}source_size") > 0, F.col(f"{P}target") / F.col(f"{P}source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return rows.withColumn(f"{P}copies", (whole + (draw(F.col(id_col), seed) < rate - whole).cast("long")).cast("long"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """All ``documents``: doc_id, size, source_size, target, taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select(
        "doc_id", F.col(f"{P}size").alias("size"), F.col(f"{P}source_size").alias("source_size"), F.col(f"{P}target").alias("target"),
        (F.col(f"{P}size") * F.col(f"{P}copies")).alias("taken"),
    )


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM sized GROUP BY source),
capped AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM per),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM per)::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(cap) OVER b, 0.0::DOUBLE)) / ((SELECT sum(w) FROM per) - coalesce(sum(w) OVER b, 0.0::DOUBLE)) AS level
  FROM capped WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT level AS lam FROM levels WHERE level * w < cap ORDER BY cap / w, level DESC LIMIT 1),
targets AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT lam FROM final) * w), cap) AS target FROM capped),
rates AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken
FROM rates
"""
