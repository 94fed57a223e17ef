"""Exact top-k search by inner product: norm-sorted scan, SVD-rotated partial sums, Cauchy-Schwarz pruning.

Vectors are laid out in slices; inside a slice candidates stream by descending length. Both sides are also kept in
the basis of the data's singular vectors, where the first few coordinates carry most of a product. For a query with
k-th best score s, a batch of candidates
  1. ends the query's scan once |q| * |c| < s for the batch's longest c (later ones are shorter), and otherwise
  2. is pruned where partial sum over the first HEAD coordinates + |q rest| * |c rest| < s (Cauchy-Schwarz),
and what remains is scored exactly, in integers. Bounds get a small slack, so rounding never drops a candidate, and
comparisons keep equality, so ties survive to the id order.

Queries go in blocks of BLOCK. A (block, slice) pair is one group of a task; its state is BLOCK x k scores. A bounded
seed, the SEED longest vectors, gives each block a first k-th score everywhere. Partial winners, k per (query,
slice), meet in one window per query. Nothing else is collected but the d x d moment matrix and the seed.

Integer scores are exact: products go through float64 while every partial sum is below 2**53, else through int64.

Defined results: vectors that are null, or hold null or non-finite components, take no part; shorter vectors count
as padded with zeros; an empty vector is the zero vector; a query with fewer candidates than k gets them all; no
query gives no rows; a query
never meets its own row; rows that repeat an id are separate queries and candidates, told apart by a row number; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 256
HEAD = 12
BLOCK = 2048
SLICE = 16_384
SEED = 1024
STEP = 512


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as long; null where the vector takes no part."""
    ok = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(values, dim: int) -> np.ndarray:
    out = np.zeros((len(values), dim), np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def _moments(dim: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for pdf in batches:
            m = _matrix(pdf["v"], dim).astype(np.float64)
            total += m.T @ m
        yield pd.DataFrame({"cell": np.arange(dim * dim), "s": total.ravel()})

    return run


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of the data, by falling singular value: d x d, from sums of d x d moments."""
    rows = vectors.select("v").mapInPandas(_moments(dim), "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect()
    m = np.zeros(dim * dim)
    for r in rows:
        m[r["cell"]] = r["s"]
    m = np.nan_to_num(m.reshape(dim, dim))
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]


class Side:
    """Vectors with their rotated head, the length of the rest, and the whole length."""

    def __init__(self, ids: np.ndarray, exact: np.ndarray, turn: np.ndarray, rows: np.ndarray | None = None):
        self.ids, self.exact, self.rows = ids, exact, ids if rows is None else rows
        real = exact.astype(np.float64)
        turned = real @ turn
        self.norm = np.sqrt((real * real).sum(axis=1))
        self.head = turned[:, :HEAD]
        rest = turned[:, HEAD:]
        self.rest = np.sqrt((rest * rest).sum(axis=1))

    def take(self, at) -> Side:
        out = object.__new__(Side)
        for k in ("ids", "rows", "exact", "norm", "head", "rest"):
            setattr(out, k, getattr(self, k)[at])
        return out


class Best:
    """The k best of each query so far, as falling scores and rising ids."""

    def __init__(self, queries: Side, k: int):
        n = len(queries.ids)
        self.q, self.k = queries, k
        self.scores, self.ids, self.filled = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), bool)
        self.floor = np.full(n, -np.inf)
        self.alive = np.ones(n, bool)

    def offer(self, c: Side) -> bool:
        """Candidates, none longer than those offered before; False once no query can gain any more."""
        slack = 1e-9
        longest = float(c.norm.max())
        self.alive &= self.q.norm * longest * (1 + slack) + 1 >= self.floor
        live = np.flatnonzero(self.alive)
        if not len(live):
            return False
        q = self.q
        bound = q.head[live] @ c.head.T + np.outer(q.rest[live], c.rest)
        room = slack * np.outer(q.norm[live], c.norm) + 1
        keep = (bound + room >= self.floor[live][:, None]) & (q.rows[live][:, None] != c.rows[None, :])
        i, j = np.nonzero(keep)
        if len(i):
            self._merge(live[i], c, j)
        return True

    def _merge(self, qi: np.ndarray, c: Side, cj: np.ndarray) -> None:
        got = np.empty(len(qi), np.int64)
        safe = float(np.abs(self.q.exact).max(initial=0)) * float(np.abs(c.exact).max(initial=0)) * c.exact.shape[1] < 2**52
        for lo in range(0, len(qi), 100_000):
            a, b = self.q.exact[qi[lo : lo + 100_000]], c.exact[cj[lo : lo + 100_000]]
            got[lo : lo + 100_000] = np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64) if safe else (a * b).sum(axis=1)
        ok = got >= self.floor[qi]
        qi, got, ids = qi[ok], got[ok], c.ids[cj[ok]]
        if not len(qi):
            return
        touched = np.unique(qi)
        held = self.filled[touched]
        rows = np.concatenate([np.repeat(touched, held.sum(axis=1)), qi])
        scores = np.concatenate([self.scores[touched][held], got])
        names = np.concatenate([self.ids[touched][held], ids])
        order = np.lexsort((names, -scores.astype(np.float64), rows)) if np.abs(scores).max() < 2**52 else sorted(range(len(rows)), key=lambda x: (rows[x], -int(scores[x]), names[x]))
        rows, scores, names = rows[order], scores[order], names[order]
        first = np.r_[0, np.flatnonzero(rows[1:] != rows[:-1]) + 1]
        rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        in_k = rank < self.k
        self.filled[touched] = False
        self.scores[rows[in_k], rank[in_k]], self.ids[rows[in_k], rank[in_k]], self.filled[rows[in_k], rank[in_k]] = scores[in_k], names[in_k], True
        full = touched[self.filled[touched].all(axis=1)]
        self.floor[full] = self.scores[full, -1]

    def seed(self, c: Side) -> None:
        """Use ``c`` for a first k-th score only: the floor rises, nothing is kept."""
        trial = Best(self.q, self.k)
        for lo in range(0, len(c.ids), STEP):
            trial.offer(c.take(slice(lo, lo + STEP)))
        self.floor = np.maximum(self.floor, trial.floor)

    def frame(self) -> pd.DataFrame:
        i, r = np.nonzero(self.filled)
        return pd.DataFrame({"row": self.q.rows[i], "query_id": self.q.ids[i], "vec_id": self.ids[i, r], "score": self.scores[i, r]})


def _search(dim: int, k: int, shared) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows come by (block, slice), queries before candidates, candidates by falling length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, seed_ids, seed_exact, seed_rows = shared.value
        seed = Side(seed_ids, seed_exact, turn, seed_rows)
        group, waiting, best, done = None, [], None, False

        def ready() -> Best:
            out = Best(Side(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]), turn, np.concatenate([w[2] for w in waiting])), k)
            if len(seed.ids):
                out.seed(seed)
            return out

        for pdf in batches:
            for key, part in pdf.groupby(["block", "slice"], sort=False):
                if key != group:
                    if best is not None:
                        yield best.frame()
                    group, waiting, best, done = key, [], None, False
                for query, rows in part.groupby("query", sort=False):
                    ids, exact, own = rows["id"].to_numpy(np.int64), _matrix(rows["v"], dim), rows["row"].to_numpy(np.int64)
                    if query:
                        waiting.append((ids, exact, own))
                        continue
                    if not waiting:  # queries come first: this group has none
                        continue
                    if best is None:
                        best = ready()
                    for lo in range(0, len(ids), STEP):
                        if done:
                            break
                        done = not best.offer(Side(ids[lo : lo + STEP], exact[lo : lo + STEP], turn, own[lo : lo + STEP]))
        if best is not None:
            yield best.frame()

    return run


def top_k(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = SCALE, block: int = BLOCK, slice_rows: int = SLICE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates for each row where ``queries`` (over ``id``) holds. Integer ids."""
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v")).filter("v is not null and id is not null")
    base = base.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    base = stored(base.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, n_queries, dim = base.agg(F.count("*"), F.coalesce(F.count_if(queries), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dim = max(1, dim)
    turn = rotation(base, dim)
    seed = base.orderBy(F.desc("norm"), "id").limit(SEED).select("id", "v", "row").toPandas()
    shared = spark.sparkContext.broadcast((turn, seed["id"].to_numpy(np.int64), _matrix(seed["v"], dim), seed["row"].to_numpy(np.int64)))
    blocks, slices = max(1, -(-n_queries // block)), max(1, -(-n // slice_rows))
    asked = base.filter(queries).select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(True).alias("query"), "id", "v", "norm", "row")
    given = base.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(slices)).cast("int").alias("slice"), F.lit(False).alias("query"), "id", "v", "norm", "row")
    rows = asked.unionByName(given).repartition(min(blocks * slices, 20_000), "block", "slice")
    rows = rows.sortWithinPartitions("block", "slice", F.desc("query"), F.desc("norm"), "id").select("block", "slice", "query", "id", "v", "row")
    found = rows.mapInPandas(_search(dim, k, shared), "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark, sf_dir: str) -> DataFrame:
    """The 5 best candidates of each vector whose id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


OP1_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
