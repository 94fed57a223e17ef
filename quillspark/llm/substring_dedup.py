"""Substring deduplication over word windows, with a count-min prefilter.

A window is WINDOW consecutive words. Pass one feeds a count-min sketch: each partition sketches the minimizers of
its windows (the smallest hash among a window's GRAM-word runs; equal windows have equal minimizers, and neighbours
mostly share one, so about 7 % as many entries as windows). Partition sketches merge by cell range; the merged cells
that were hit by two documents or more become a bitmap. A window's count is at most its minimizer's count, which is
at most the sketch's estimate, so windows estimated unique are unique: none is lost.
Pass two hashes only the windows estimated repeated and groups those by minimizer and window hash, 64 bits each, from
two independent word hashes. It deals windows in a row with one minimizer as one row, so one shuffle carries 8 bytes a
window. A wrong removal needs two different windows with one minimizer and one window hash: among p pairs of windows
that share a minimizer, p / 2**64 are expected.

Scale: the sketch has DEPTH * cells bits, sized from the input and never above DEPTH * MAX_CELLS bits (64 MiB),
whatever the input; a fuller sketch only lets more windows into the exact pass. A task deals each run of windows for
the smallest of its documents alone, in whatever order they come, so a passage held by a third of all documents is
dealt once per task; the exact grouping is a window and an aggregate in the JVM, which spill.

Defined results: words are runs of non-blank bytes, unchanged; a document below WINDOW words loses nothing; null or
empty text has no words and keeps the empty text; windows repeated only inside their own document stay; documents
that repeat an id count as one document; a null id is smaller than every other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import gram_hashes, id_orders, mix, shuffles, sortable, text_or_empty, tidy
from .words import text_words

WINDOW = 50
GRAM = 25
DEPTH = 2
MAX_CELLS = 1 << 28
CHUNK = 1 << 16
#: Documents handled together in a worker, windows in one row, and runs a task remembers.
BLOCK = 400
RUN = 60
SEEN = 200_000


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in log2(width) passes."""
    size = 1
    n = len(x) - width + 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def minimizers(words: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The minimizer at each place where a window could start, the text it lies in, and whether the window ends inside."""
    low = sliding_min(gram_hashes(words, gram, seed=1), window - gram + 1) if len(words) >= window else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return low, text[: len(low)], text[: len(low)] == text[window - 1 :] if len(low) else np.zeros(0, bool)


def cell(values: np.ndarray, row: int, cells: int) -> np.ndarray:
    return mix(values + np.uint64(0x9E3779B97F4A7C15 * (row + 1) & (1 << 64) - 1)) & np.uint64(cells - 1)


# ------------------------------------------------------------------ pass one: the sketch


class PartitionSketch:
    """Cells hit once and cells hit twice or more, kept sparse; ``add`` takes the distinct values of one document."""

    def __init__(self, cells: int, depth: int = DEPTH):
        self._cells, self._depth, self._new, self._held, self._size = cells, depth, [], None, 0

    def add(self, values: np.ndarray) -> None:
        self._new.append(values)
        self._size += len(values)
        if self._size > 1_000_000:
            self._fold()

    def _fold(self) -> None:
        v = np.concatenate(self._new) if self._new else np.zeros(0, np.uint64)
        self._new, self._size = [], 0
        for r in range(self._depth):
            at, n = np.unique(cell(v, r, self._cells), return_counts=True)
            if self._held is not None and r < len(self._held):
                a0, n0 = self._held[r]
                both = np.concatenate([a0, at])
                order = np.argsort(both, kind="stable")
                both, k = both[order], np.concatenate([n0, np.minimum(n, 2)])[order]
                first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
                at, n = both[first], np.add.reduceat(k, first) if len(first) else k
            if self._held is None:
                self._held = []
            entry = (at, np.minimum(n, 2).astype(np.int8))
            if r < len(self._held):
                self._held[r] = entry
            else:
                self._held.append(entry)

    def rows(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(chunk, cells hit once, cells hit more): offsets in a chunk as 16-bit numbers."""
        self._fold()
        for r, (at, n) in enumerate(self._held):
            if not len(at):
                continue
            chunks = (at // np.uint64(CHUNK)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1]])
            for lo, hi in zip(cuts, [*cuts[1:], len(at)], strict=True):
                off = (at[lo:hi] % np.uint64(CHUNK)).astype("<u2")
                more = n[lo:hi] > 1
                yield r * (self._cells // CHUNK) + int(chunks[lo]), off[~more].tobytes(), off[more].tobytes()


def _sketch(window: int, gram: int, cells: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = PartitionSketch(cells)
        for pdf in batches:
            for lo in range(0, len(pdf), BLOCK):
                low, text, ok = minimizers(*text_words([t.encode() for t in pdf["text"].iloc[lo : lo + BLOCK]]), window, gram)
                if not ok.any():
                    continue
                at = np.flatnonzero(ok & np.r_[True, (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | ~ok[:-1]])
                at = at[np.lexsort((low[at], text[at]))]
                sketch.add(low[at][np.r_[True, (low[at][1:] != low[at][:-1]) | (text[at][1:] != text[at][:-1])]])
        rows = list(sketch.rows())
        for lo in range(0, len(rows), 2000):
            yield pd.DataFrame(rows[lo : lo + 2000], columns=["chunk", "once", "more"])

    return tidy(run)


def _merge(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    count = np.zeros(CHUNK, np.int32)
    for pdf in parts:
        for once, more in zip(pdf["once"], pdf["more"], strict=True):
            count[np.frombuffer(once, "<u2")] += 1
            count[np.frombuffer(more, "<u2")] += 2
    if (count > 1).any():
        yield pd.DataFrame({"chunk": [key[0]], "bits": [np.packbits(count > 1, bitorder="little").tobytes()]})


def repeated_cells(sketches: DataFrame, cells: int) -> np.ndarray:
    """Bitmap of the cells with a count of two or more over all partition sketches: DEPTH * cells / 8 bytes."""
    merged = sketches.groupBy("chunk").applyInPandas(_merge, "chunk long, bits binary")
    out = np.zeros(DEPTH * cells // 8, np.uint8)
    step = CHUNK // 8
    for r in merged.toLocalIterator():
        out[r["chunk"] * step : (r["chunk"] + 1) * step] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


# ------------------------------------------------------------------ pass two: exact groups


def estimated_repeated(values: np.ndarray, bits: np.ndarray, cells: int) -> np.ndarray:
    ok = np.ones(len(values), bool)
    for r in range(DEPTH):
        at = cell(values, r, cells) + np.uint64(r * cells)
        ok &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return ok


def cuts(lo: np.ndarray, hi: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges [lo, hi) cut into pieces of at most ``run``."""
    n = -(-(hi - lo) // run)
    piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(lo, n) + piece * run
    return start, np.minimum(start + run, np.repeat(hi, n))


class Least:
    """Pieces of documents by content: for each content the places in the smallest document so far; the rest is covered."""

    def __init__(self, most: int):
        self._held: dict[tuple, tuple] = {}
        self._most = most

    def add(self, key: tuple, order, doc: str, pos: int, size: int) -> Iterator[tuple]:
        """Rows (id, pos, size, g, content); content is null where a smaller document of this task has it."""
        held = self._held.get(key)
        if order != order:  # ids without a known order are all dealt
            yield doc, pos, size, *key
        elif held is None:
            if len(self._held) >= self._most:
                yield from self.end()
            self._held[key] = (order, doc, [pos], size)
        elif held[0] == order:
            held[2].append(pos)
        elif held[0] < order:
            yield doc, pos, size, key[0], None
        else:
            for p in held[2]:
                yield held[1], p, size, key[0], None
            self._held[key] = (order, doc, [pos], size)

    def end(self) -> Iterator[tuple]:
        held, self._held = self._held, {}
        for (g, content), (_, doc, at, size) in held.items():
            for p in at:
                yield doc, p, size, g, content


def _windows(window: int, gram: int, cells: int, shared, kind: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """id, pos, count, g, hashes: windows in a row with one minimizer g, at most RUN of them. Null hashes mark windows
    that are repeated for certain: this task has met all of them, in the same order, in a document with a smaller id."""

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["id", "pos", "count", "g", "hashes"])
        out["hashes"] = [None if x is None else np.frombuffer(x, np.int64) for x in out["hashes"]]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, least = np.frombuffer(shared.value, np.uint8), Least(SEEN)
        for pdf in batches:
            order = id_orders([None if x is None or x != x else x for x in pdf["id"]], kind)
            for lo in range(0, len(pdf), BLOCK):
                ids, texts, out = pdf["id"].iloc[lo : lo + BLOCK].tolist(), [t.encode() for t in pdf["text"].iloc[lo : lo + BLOCK]], []
                words, bounds = text_words(texts)
                low, text, ok = minimizers(words, bounds, window, gram)
                if not ok.any():
                    continue
                first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | (ok[1:] != ok[:-1])])
                last = np.r_[first[1:], len(low)]
                use = ok[first]
                use[use] = estimated_repeated(low[first[use]], bits, cells)
                if not use.any():
                    continue
                full = gram_hashes(text_words(texts, seed=1)[0], window, seed=2)
                at, end = cuts(first[use], last[use], RUN)
                for a, b, d, pos, g in zip(at.tolist(), end.tolist(), text[at].tolist(), (at - bounds[text[at]]).tolist(), low[at].view(np.int64).tolist(), strict=True):
                    out += least.add((g, full[a:b].tobytes()), order[lo + d], ids[d], pos, b - a)
                if out:
                    yield frame(out)
        rows = list(least.end())
        for lo in range(0, len(rows), 10_000):
            yield frame(rows[lo : lo + 10_000])

    return tidy(run)


def _strip(window: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bit = np.arange(RUN)
        for pdf in batches:
            for lo in range(0, len(pdf), BLOCK):
                part, out = pdf.iloc[lo : lo + BLOCK], []
                for doc, t, at, masks in zip(part["id"], part["text"], part["at"], part["masks"], strict=True):
                    words = t.encode().split()
                    n = len(words)
                    if at is not None and len(at):
                        on = (np.asarray(masks, np.int64)[:, None] >> bit) & 1 > 0
                        s = (np.asarray(at, np.int64)[:, None] + bit)[on]
                        edge = np.zeros(n + 1, np.int32)
                        np.add.at(edge, s, 1)
                        np.add.at(edge, np.minimum(s + window, n), -1)
                        keep = np.cumsum(edge[:n]) == 0
                        words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                    out.append((doc, n, n - len(words), b" ".join(words).decode()))
                yield pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept"])

    return tidy(run)


def repeated_windows(docs: DataFrame, kind: str, window: int, gram: int) -> DataFrame:
    """id, at, masks: bit i of a mask says that the window at + i also starts in a document with a smaller id. docs: id, text."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    cells = CHUNK
    while cells < MAX_CELLS and cells < size // 12:  # about 10 cells for each minimizer
        cells *= 2
    sketches = docs.select("text").mapInPandas(_sketch(window, gram, cells), "chunk long, once binary, more binary")
    shared = spark.sparkContext.broadcast(repeated_cells(sketches, cells).tobytes())
    rows = docs.withColumn("id", F.col("id").cast("string")).mapInPandas(_windows(window, gram, cells, shared, kind), "id string, pos int, count int, g long, hashes array<long>")
    rows = rows.withColumn("id", F.col("id").cast(kind)).withColumn("deal", F.when(F.col("hashes").isNotNull(), F.col("g")).otherwise(F.xxhash64("id", "pos")))
    # one shuffle: both groupings below include the deal column, so its partitioning serves them
    dealt = rows.repartition(max(8, shuffles(spark)), "deal")
    each = dealt.select("deal", "id", "pos", "count", F.posexplode_outer("hashes").alias("i", "h"))
    first = F.min(sortable("id")).over(Window.partitionBy("deal", "h"))
    hit = each.withColumn("first", first).filter(F.col("h").isNull() | (sortable("id") > F.col("first")))
    bit = F.when(F.col("h").isNull(), F.expr("shiftleft(1L, count) - 1")).otherwise(F.expr("shiftleft(1L, i)"))
    masks = hit.groupBy("deal", "id", "pos").agg(F.bit_or(bit).alias("mask"))
    return masks.groupBy("id").agg(F.collect_list(F.struct("pos", "mask")).alias("x")).select("id", F.col("x.pos").alias("at"), F.col("x.mask").alias("masks"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    found = repeated_windows(base, kind, window, gram)
    joined = base.join(found, "id", "left").select(F.col("id").cast("string").alias("id"), "text", "at", "masks")
    out = joined.mapInPandas(_strip(window), "id string, n_words long, n_removed long, kept string")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_words", "n_removed", "kept")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: doc_id, n_words, n_removed, kept_sha256."""
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
