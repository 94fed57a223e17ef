"""Ranked lexical search over a two-level quantised index.

The index has one row a document: its number of terms n, the positions of its terms in the queries' vocabulary, and
how often each occurs. Level two of a posting is exact, (tf, n). Level one is a byte, the saturated frequency
(1000000000 * tf) div (1000 * tf + 12 * m) in 255ths of its supremum 1,000,000, rounded up; it rests on the corpus
counts N and L, so it is set when a block of the finished index is loaded. With weights w, the bytes of a document give
    lower bound = sum of w * (byte - 1) * 1000000 / 255 <= score <= sum of w * byte * 1000000 / 255 = upper bound.
A block of documents meets all queries at once: upper bounds of terms that many queries hold come from one product of
small matrices, those of other terms from their inverted query lists. Each query's k-th largest lower bound so far is
its floor; every document whose upper bound reaches the floor is scored again in exact integers from level two, and
the k-th exact score raises the floor in turn. Equality is kept everywhere, so ties survive to the order by id.

Scale: text is read once; an index row is the document's share of the vocabulary. Floors start from a search of every
64th document, so a task passes on about min(k, 64 * k / tasks) rows a query, whatever the input. Queries are taken in
blocks of at most BLOCK_TERMS terms (one long query alone may hold more), each with a pass of its own, which bounds
what is broadcast: a block's vocabulary, weights and query lists. A query's rows meet in a window that keeps k rows of
each task before the shuffle. Documents that are exact copies tie, and each is scored; nothing is pairwise.

Terms are told apart by 64-bit hashes: among v query terms and d distinct document terms, v * d / 2**64 false matches
are expected.

Defined results: a null or empty text has no terms and is never found; a query without terms, or whose terms no
document holds, gives no rows; repeated rows are documents, or queries, of their own; equal scores go by id, null ids
last; an empty table on either side gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import P, forget, small_batches, stored, tidy
from .words import LOWER, arrow_bytes, byte_class, run_hashes, runs, spans

K = 20
#: What term the contract allows: ASCII letters and digits, and every character beyond ASCII.
TERM = byte_class(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
#: Supremum of the saturated frequency, and the steps of a byte.
TOP, STEPS = 1_000_000, 255
BLOCK_TERMS = 1 << 20
SEED_SHARE = 64
TEXT_BYTES = 8 << 20
#: Cells of one block of upper bounds (documents x queries), and terms taken in a matrix product.
CELLS, HEAD = 1 << 18, 256
#: Above the rounding of a product of HEAD single-precision terms.
SLACK = 1e-4


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of all texts in order, and bounds: terms of text i are bounds[i] to bounds[i + 1]."""
    data, offsets = arrow_bytes(texts)
    data = LOWER[data]
    starts, lens, bounds = runs(data, offsets, TERM)
    return run_hashes(data, starts, lens), bounds


# ------------------------------------------------------------------ the index


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h, bounds = term_hashes(b.column("text"))
        terms = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("id"), terms], ["id", "terms"])


def _index(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """id, n, terms (places in the vocabulary, ascending), tfs: one row for each text with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        bits = np.zeros(1 << 22, bool)
        bits[(vocabulary & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        for b in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(b.column("text")), 0), np.int64)
            for lo, hi in spans(np.r_[0, np.cumsum(sizes)], TEXT_BYTES):
                part = b.slice(lo, hi - lo)
                h, bounds = term_hashes(part.column("text"))
                maybe = np.flatnonzero(bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)])
                at = np.minimum(np.searchsorted(vocabulary, h[maybe]), max(0, len(vocabulary) - 1))
                hit = vocabulary[at] == h[maybe] if len(vocabulary) else np.zeros(0, bool)
                doc = np.searchsorted(bounds, maybe[hit], side="right") - 1
                key, tf = np.unique(doc << 32 | at[hit], return_counts=True)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                cut = np.r_[0, np.cumsum(np.bincount(key >> 32, minlength=len(n))[some])]
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int32())) for x in (key & 0xFFFFFFFF, tf)]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(some)), pa.array(n[some], pa.int64()), *lists], ["id", "n", "terms", "tfs"])

    return tidy(run)


def index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """The stored index of ``docs`` (id, text) over the sorted term hashes ``vocabulary``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    kind = docs.schema["id"].dataType.simpleString()
    with small_batches(spark, 2000):
        return stored(docs.select("id", "text").mapInArrow(_index(shared), f"id {kind}, n long, terms array<int>, tfs array<int>"), "index")


# ------------------------------------------------------------------ the search


class Queries:
    """A block of queries: weights of the vocabulary, and for each term the queries that hold it with their counts."""

    def __init__(self, terms: list[np.ndarray], vocabulary: np.ndarray, df: np.ndarray, documents: int, words: int):
        self.count, self.documents, self.words = len(terms), documents, words
        self.weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * df.astype(np.float64) + 1))).astype(np.int64)
        who = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        place = np.searchsorted(vocabulary, np.concatenate(terms)) if terms else np.zeros(0, np.int64)
        self.keys, self.times = np.unique(place * max(1, self.count) + who, return_counts=True)
        held = self.keys // max(1, self.count)
        self.who = (self.keys % max(1, self.count)).astype(np.int64)
        self.begin = np.searchsorted(held, np.arange(len(vocabulary) + 1))
        each = np.diff(self.begin)
        #: places of the terms in most queries, in a product; the others by their lists
        self.head = np.flatnonzero(each > max(8, self.count // 16))
        self.head = np.sort(self.head[np.argsort(-each[self.head], kind="stable")[:HEAD]])
        self.in_head = np.full(len(vocabulary), -1, np.int64)
        self.in_head[self.head] = np.arange(len(self.head))
        self.matrix = np.zeros((len(self.head), self.count), np.float32)
        for i, t in enumerate(self.head.tolist()):
            at = slice(self.begin[t], self.begin[t + 1])
            self.matrix[i, self.who[at]] = self.times[at] * self.weight[t]
        #: what all terms of a query weigh: the most by which an upper bound, in byte steps, exceeds a lower one
        self.whole = np.bincount(self.who, self.times * self.weight[held].astype(np.float64), self.count)


def _ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... size[0] numbers, then lo[1], ..."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)


class Search:
    """The k best documents of each query so far, from blocks of index rows."""

    def __init__(self, q: Queries, k: int, floor: np.ndarray):
        self.q, self.k, self.floor = q, k, floor.astype(np.float64)
        self._found: list[tuple] = []
        self._size = 0
        self.rescored = 0

    def offer(self, ids: np.ndarray, no_id: np.ndarray, n: np.ndarray, begin: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """Index rows: postings of row i are begin[i] to begin[i + 1]."""
        q = self.q
        m = 75 + (25 * n * q.documents) // q.words
        row = np.repeat(np.arange(len(n)), np.diff(begin))
        exact = (1_000_000_000 * tfs) // (1000 * tfs + 12 * m[row])
        level = -((-exact * STEPS) // TOP)
        step = max(1, CELLS // max(1, q.count))
        for lo in range(0, len(n), step):
            hi = min(len(n), lo + step)
            at = slice(begin[lo], begin[hi])
            upper = self._upper(row[at] - lo, terms[at], level[at], hi - lo)
            self._raise(upper)
            d, who = np.nonzero((upper * (TOP / STEPS) * (1 + SLACK) + 1 >= self.floor) & (upper > 0))
            if len(d):
                self._rescore(d + lo, who, ids, no_id, begin, terms, exact)

    def _upper(self, row: np.ndarray, terms: np.ndarray, level: np.ndarray, count: int) -> np.ndarray:
        """Upper bounds, documents x queries, in byte steps."""
        q = self.q
        slot = q.in_head[terms]
        dense = np.zeros((count, len(q.head)), np.float32)
        inside = slot >= 0
        dense[row[inside], slot[inside]] = level[inside]
        out = dense @ q.matrix
        rest = ~inside
        row, terms, level = row[rest], terms[rest], level[rest]
        size = q.begin[terms + 1] - q.begin[terms]
        at = _ranges(q.begin[terms], size)
        add = np.repeat(level * q.weight[terms], size) * q.times[at]
        out += np.bincount(np.repeat(row, size) * q.count + q.who[at], add, count * q.count).reshape(count, q.count)
        return out

    def _raise(self, upper: np.ndarray) -> None:
        """Floors no lower than the k-th lower bound of this block."""
        if len(upper) >= self.k:
            kth = np.partition(upper, len(upper) - self.k, axis=0)[len(upper) - self.k]
            self.floor = np.maximum(self.floor, (kth * (1 - SLACK) - self.q.whole) * (TOP / STEPS) - 1)

    def _rescore(self, d: np.ndarray, who: np.ndarray, ids: np.ndarray, no_id: np.ndarray, begin: np.ndarray, terms: np.ndarray, exact: np.ndarray) -> None:
        q = self.q
        for lo in range(0, len(d), 4096):
            dd, qq = d[lo : lo + 4096], who[lo : lo + 4096]
            size = begin[dd + 1] - begin[dd]
            at = _ranges(begin[dd], size)
            key = terms[at] * q.count + np.repeat(qq, size)
            place = np.minimum(np.searchsorted(q.keys, key), len(q.keys) - 1)
            part = np.where(q.keys[place] == key, q.times[place] * q.weight[terms[at]] * exact[at], 0)
            ends = np.cumsum(size)
            sums = np.r_[0, np.cumsum(part)]
            score = sums[ends] - sums[ends - size]
            self.rescored += len(dd)
            keep = (score > 0) & (score >= self.floor[qq])
            self._found.append((qq[keep], score[keep], no_id[dd[keep]], ids[dd[keep]]))
            self._size += int(keep.sum())
            if self._size > 8 * self.k * q.count + 20_000:
                self._best()

    def _best(self) -> None:
        if not self._found:
            return
        who, score, no_id, ids = (np.concatenate(x) for x in zip(*self._found, strict=True))
        order = np.lexsort((ids, no_id, -score, who))
        who, score, no_id, ids = who[order], score[order], no_id[order], ids[order]
        begin = np.searchsorted(who, np.arange(self.q.count + 1))
        keep = np.arange(len(who)) - begin[who] < self.k
        full = np.flatnonzero(np.diff(begin) >= self.k)
        self.floor[full] = np.maximum(self.floor[full], score[begin[full] + self.k - 1])
        self._found = [(who[keep], score[keep], no_id[keep], ids[keep])]
        self._size = int(keep.sum())

    def rows(self) -> tuple[np.ndarray, ...]:
        """query, score, whether the id is null, id."""
        self._best()
        return self._found[0] if self._found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))


def _search(shared, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shared.value[0], k, shared.value[1])
        for b in batches:
            if b.num_rows:
                begin = np.r_[0, np.cumsum(np.asarray(b.column("terms").value_lengths(), np.int64))]
                terms, tfs = (np.asarray(b.column(c).flatten(), np.int64) for c in ("terms", "tfs"))
                ids = b.column("id")
                search.offer(np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_null()), np.asarray(b.column("n"), np.int64), begin, terms, tfs)
        who, score, no_id, ids = search.rows()
        yield pa.RecordBatch.from_arrays([pa.array(who, pa.int32()), pa.array(ids, pa.int64(), mask=no_id), pa.array(score, pa.int64())], ["query", "doc", "score"])

    return tidy(run)


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _one_block(docs: DataFrame, asked: list, k: int) -> DataFrame:
    """query (place in ``asked``), rank, doc, score, stored."""
    spark = docs.sparkSession
    terms = [np.array(r["terms"], np.int64).view(np.uint64) for r in asked]
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *terms]))
    rows = index(docs, vocabulary)
    documents, words = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most a row for each term of the block
        df[r["t"]] = r["count"]
    queries = Queries(terms, vocabulary, df, documents, max(1, words))

    def search(part: DataFrame, floor: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((queries, floor))
        return _top(part.mapInArrow(_search(shared, k), "query int, doc long, score long"), k)

    with small_batches(spark, 4000):
        sample = rows.filter(F.pmod(F.xxhash64("id", "n"), F.lit(SEED_SHARE)) == 0)
        sample = sample.coalesce(max(1, rows.rdd.getNumPartitions() // SEED_SHARE))
        floor = np.zeros(len(asked))
        for r in search(sample, floor).filter(F.col("rank") == k).select("query", "score").collect():  # one row a query of the block
            floor[r["query"]] = r["score"]
        out = stored(search(rows, floor).select("query", "rank", "doc", "score"), "ranked")
    forget(rows)
    return out


def lexical_search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item id, rank, doc id (long), score: the k documents that score highest above 0 for each item."""
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    asked = items.select(F.col(item_id).alias("id"), F.col(text_col).alias("text")).mapInArrow(_query_terms, f"id {kind}, terms array<long>")
    asked = stored(asked.withColumn("row", F.monotonically_increasing_id()), "queries")
    blocks = -(-(asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]) // block_terms) or 1
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = []
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).orderBy("row").collect()  # a block of the queries
        names = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(part)], f"query int, {P}item {kind}")
        out.append(_one_block(rows, part, k).join(names, "query").select(F.col(f"{P}item").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc_id), "score"))
    forget(asked)
    return reduce(DataFrame.unionAll, out)


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best ``documents`` for each ``benchmark`` item."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return lexical_search(docs.select("doc_id", "text"), items.select("item_id", "text"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
c AS (SELECT count(*) AS docs, sum(len(ts))::BIGINT AS words FROM d WHERE len(ts) > 0),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS ts FROM benchmark),
q AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(ts) AS term FROM i) GROUP BY ALL),
p AS MATERIALIZED (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, docs),
s AS (
  SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
  FROM p JOIN q USING (term) JOIN w USING (term), c GROUP BY q, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
