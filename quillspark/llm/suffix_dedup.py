"""Removal of repeated byte strings with suffix arrays of shards.

A string is WINDOW consecutive bytes of one document. A document whose whole text a smaller document has is covered as
a whole and takes no further part. A count-min sketch over minimizers (the smallest hash among a string's GRAM-byte
runs) rules out strings that start in one document only. What is left is cut to snippets: the strings in a row that
have the same minimizer. Equal strings have equal minimizers, so snippets are dealt to shards by minimizer, and each
shard decides its strings alone:
  - equal snippets stream past in id order; all but the first document's are covered whole;
  - of distinct snippets of one minimizer, the stretches of strings whose hashes occur again are taken, equal ones
    settled in turn, and the others laid end to end; their suffix array is induced (see suffix_array), the permuted common prefixes mark neighbours that agree in WINDOW
    bytes, and of each run of agreeing suffixes every one in a document above the run's smallest id is covered.
Bytes decide; hashes only deal and rule out. Covered ranges return to their documents and are cut out of the whole
text; a document without any stays where it is, out of reach of the join.

Scale: the sketch is sized from the input up to DEPTH * MAX_CELLS bits (64 MiB), beyond which it only lets more
through. A task deals each snippet for the smallest of its documents alone, so a passage that a third of all
documents hold is dealt once per task. A minimizer that very many tasks hold is dealt by a second one of
the same strings besides, so different contexts of one common phrase spread over shards. A shard's arrays cover at
most CHUNK_BYTES: more distinct context of one minimizer is cut again by minimizers of other hashes, level by level,
each level linear; what HASHES levels leave together goes into one array. A group's distinct snippets are held in
memory while they stream past; a snippet has RUN strings at most, so runs of one byte come as equal snippets.

Defined results: text is its UTF-8 bytes, null is empty; documents below WINDOW bytes lose nothing; strings repeated
only inside their own document stay; rows that repeat an id count as one document; null ids sort below every id; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHOLE, bitmap_of, forget, id_orders, in_bitmap, mix, position, shuffles, sortable, stored, text_or_empty, tidy
from .substring_dedup import CHUNK, DEPTH, MAX_CELLS, Least, PartitionSketch, cell, cuts, estimated_repeated, sliding_min
from .suffix_array import permuted_lcp, suffix_array

WINDOW = 50
GRAM = 16
#: So small that a block's arrays stay in a processor's cache.
BLOCK_BYTES = 1 << 16
CHUNK_BYTES = 1 << 20
SEEN = 200_000
RUN = 512
HASHES = 12
#: A cell that so many task counts meet is hot; of each chunk of cells the MOST_HOT fullest at most are told to the tasks.
HOT, MOST_HOT = 128, 32
BITS = 1 << 26


def string_hashes(t: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of every ``size`` bytes of ``t`` (uint8); empty when there are fewer."""
    m = len(t) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    raw = np.r_[t, np.zeros(8, np.uint8)].tobytes()
    words = np.ndarray((len(t) + 1,), "<u8", raw, 0, (1,))
    h, at, i = np.full(m, seed, np.uint64), 0, 0
    while at < size:
        x = words[at : at + m].astype(np.uint64)
        if size - at < 8:
            x &= np.uint64((1 << 8 * (size - at)) - 1)
        h += x * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 2 * seed + 1) & (1 << 64) - 1) | 1)
        h ^= h >> np.uint64(29)
        at, i = at + 8, i + 1
    return mix(h)


def byte_minimizers(t: np.ndarray, window: int, gram: int, seed: int = 0) -> np.ndarray:
    """The minimizer of every ``window`` bytes of ``t`` (uint8); empty when there are fewer."""
    if len(t) < window:
        return np.zeros(0, np.uint64)
    return sliding_min(string_hashes(t, gram, seed), window - gram + 1)


def _blocks(ids, texts) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, bytes end to end, bounds) of some documents at a time."""
    some, parts, size = [], [], 0
    for doc, t in zip(ids, texts, strict=True):
        b = t.encode()
        some.append(doc)
        parts.append(b)
        size += len(b)
        if size >= BLOCK_BYTES:
            yield some, np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum([len(x) for x in parts])]
            some, parts, size = [], [], 0
    if some:
        yield some, np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum([len(x) for x in parts])]


def _inside(bounds: np.ndarray, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n starts: the document's number, and whether the string ends inside it."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    return doc, np.arange(n) + window <= bounds[doc + 1]


def _sketch(window: int, gram: int, cells: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = PartitionSketch(cells)
        for pdf in batches:
            for _, t, bounds in _blocks(pdf["id"], pdf["text"]):
                v = byte_minimizers(t, window, gram)
                if not len(v):
                    continue
                doc, ok = _inside(bounds, len(v), window)
                new = ok.copy()
                new[1:] &= (v[1:] != v[:-1]) | (doc[1:] != doc[:-1]) | ~ok[:-1]
                at = np.flatnonzero(new)
                pair = np.lexsort((v[at], doc[at]))
                at = at[pair]
                first = np.r_[True, (v[at][1:] != v[at][:-1]) | (doc[at][1:] != doc[at][:-1])] if len(at) else np.zeros(0, bool)
                sketch.add(v[at][first])
        rows = list(sketch.rows())
        for lo in range(0, len(rows), 2000):
            yield pd.DataFrame(rows[lo : lo + 2000], columns=["chunk", "once", "more"])

    return tidy(run)


def _merge(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells of a chunk that two counts or more meet, and the hottest ones."""
    count = np.zeros(CHUNK, np.int32)
    for pdf in parts:
        for once, more in zip(pdf["once"], pdf["more"], strict=True):
            count[np.frombuffer(once, "<u2")] += 1
            count[np.frombuffer(more, "<u2")] += 2
    if (count > 1).any():
        top = np.argsort(-count, kind="stable")[:MOST_HOT]
        yield pd.DataFrame({"chunk": [key[0]], "bits": [np.packbits(count > 1, bitorder="little").tobytes()], "hot": [top[count[top] >= HOT].astype("<u2").tobytes()]})


def _snippets(window: int, gram: int, cells: int, shared, kind: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """id, pos, g, snip: strings in a row with one minimizer. A null snip marks a range that is covered for certain."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw_bits, hot = shared.value
        bits, least = np.frombuffer(raw_bits, np.uint8), Least(SEEN)
        for pdf in batches:
            known = [None if x is None or x != x else x for x in pdf["id"]]
            order = dict(zip(known, id_orders(known, kind), strict=True))
            for ids, t, bounds in _blocks(known, pdf["text"]):
                v = byte_minimizers(t, window, gram)
                if not len(v):
                    continue
                doc, ok = _inside(bounds, len(v), window)
                if len(hot):
                    spread = np.isin(cell(v, 0, cells), hot) & ok
                    if spread.any():
                        v = np.where(spread, mix(v ^ byte_minimizers(t, window, gram, seed=HASHES + 1)), v)
                else:
                    spread = np.zeros(len(v), bool)
                change = np.r_[True, (v[1:] != v[:-1]) | (doc[1:] != doc[:-1]) | (ok[1:] != ok[:-1]) | (spread[1:] != spread[:-1])]
                lo = np.flatnonzero(change)
                hi = np.r_[lo[1:], len(v)]
                use = ok[lo] & (spread[lo] | estimated_repeated(v[lo], bits, cells))
                lo, hi = cuts(lo[use], hi[use], RUN)
                if not len(lo):
                    continue
                raw, out = t.tobytes(), []
                local = (lo - bounds[doc[lo]]).tolist()
                for a, b, d, p, g in zip(lo.tolist(), hi.tolist(), doc[lo].tolist(), local, v[lo].view(np.int64).tolist(), strict=True):
                    out += least.add((g, raw[a : b + window - 1]), order[ids[d]], ids[d], p, b - a + window - 1)
                yield pd.DataFrame(out, columns=["id", "pos", "size", "g", "snip"])
        out = list(least.end())
        for lo in range(0, len(out), 10_000):
            yield pd.DataFrame(out[lo : lo + 10_000], columns=["id", "pos", "size", "g", "snip"])

    return tidy(run)


def covered_starts(snips: list[bytes], owners: list, window: int) -> list[np.ndarray]:
    """For distinct snippets and the smallest id of each: offsets of strings that a smaller id's snippet holds too."""
    lens = np.array([len(s) for s in snips])
    bounds = np.r_[0, np.cumsum(lens)]
    text = np.frombuffer(b"".join(snips), np.uint8)
    rank = {o: i for i, o in enumerate(sorted(set(owners)))}
    owner = np.repeat(np.array([rank[o] for o in owners]), lens)
    valid = np.arange(len(text)) + window <= np.repeat(bounds[1:], lens)
    sa = suffix_array(text)
    lcp = permuted_lcp(text, sa, window)
    # what a suffix shares with its neighbour may run past its snippet, so only whole strings keep a run together
    sa_lcp = lcp[sa]
    run = np.cumsum(np.r_[0, sa_lcp[1:] < window])
    keep = valid[sa]
    who, runs, at = owner[sa][keep], run[keep], sa[keep]
    least = np.full(run[-1] + 1, len(rank))
    np.minimum.at(least, runs, who)
    hit = np.sort(at[who > least[runs]])
    cut = np.searchsorted(hit, bounds)
    return [hit[cut[i] : cut[i + 1]] - bounds[i] for i in range(len(snips))]


def _ranges(starts: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """(offset, size) of the union of strings at ascending starts."""
    if len(starts):
        first = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + window])
        last = np.r_[first[1:] - 1, len(starts) - 1]
        for a, b in zip(starts[first].tolist(), starts[last].tolist(), strict=True):
            yield a, b + window - a


def _recurring(items: list[tuple], window: int) -> list[tuple]:
    """The stretches of the snippets whose every string has a hash that occurs elsewhere in ``items`` too."""
    lens = np.array([len(x[0]) for x in items])
    bounds = np.r_[0, np.cumsum(lens)]
    text = b"".join([x[0] for x in items])
    h = string_hashes(np.frombuffer(text, np.uint8), window)
    owner = np.repeat(np.arange(len(items)), lens)[: len(h)]
    at = np.flatnonzero(np.arange(len(h)) + window <= bounds[1:][owner])
    h = h[at]
    in_order = np.sort(h)
    twice = in_order[1:][in_order[1:] == in_order[:-1]]
    if not len(twice):
        return []
    place = np.searchsorted(twice, h)
    at = at[twice[np.minimum(place, len(twice) - 1)] == h]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])
    last = np.r_[first[1:], len(at)] - 1
    out = []
    for lo, hi, i in zip(at[first].tolist(), at[last].tolist(), owner[at[first]].tolist(), strict=True):
        off = lo - int(bounds[i])
        out.append((text[lo : hi + window], items[i][1], [(doc, pos + off) for doc, pos in items[i][2]]))
    return out


def _distinct(items: list[tuple], out: list[tuple]) -> list[tuple]:
    """Each content once, with its smallest id; where a larger id has it, it is covered: those rows go to ``out``."""
    items.sort(key=lambda x: x[:2])
    left: list[tuple] = []
    for snip, order, where in items:
        if not left or left[-1][0] != snip:
            left.append((snip, order, where))
        elif left[-1][1] == order:
            left[-1][2].extend(where)
        else:
            out += [(doc, pos, len(snip)) for doc, pos in where]
    return left


def decide(items: list[tuple], window: int, gram: int, limit: int, seed: int = 1) -> Iterator[tuple]:
    """items: distinct (snip, smallest id, its (id text, pos) places) -> covered (id text, pos, size)."""
    covered: list[tuple] = []
    for _ in range(2):  # what is left of equal stretches can leave others alone
        items = _distinct(_recurring(items, window), covered) if items else items
    yield from covered
    if len(items) < 2:
        return
    if seed > HASHES or sum(len(x[0]) for x in items) <= limit:
        for (_, _, where), starts in zip(items, covered_starts([x[0] for x in items], [x[1] for x in items], window), strict=True):
            for off, size in _ranges(starts, window):
                for doc, pos in where:
                    yield doc, pos + off, size
        return
    rows = []
    for snip, order, where in items:
        v = byte_minimizers(np.frombuffer(snip, np.uint8), window, min(gram, window), seed)
        lo = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        for a, b, g in zip(lo.tolist(), [*lo[1:].tolist(), len(v)], v[lo].tolist(), strict=True):
            rows.append((g, snip[a : b + window - 1], order, [(doc, pos + a) for doc, pos in where]))
    rows.sort(key=lambda x: x[:3])
    shard = Shard(window, gram, limit, seed + 1)
    for g, group in groupby(rows, key=lambda x: x[0]):
        for _, snip, order, where in group:
            yield from shard.add(g, snip, order, where)
    yield from shard.end()


class Shard:
    """Rows by (g, snip, id, pos); gives covered (id, pos, size) ranges."""

    def __init__(self, window: int, gram: int = GRAM, limit: int = CHUNK_BYTES, seed: int = 1):
        self._window, self._gram, self._limit, self._seed = window, gram, limit, seed
        self._group: list[tuple[bytes, object, list]] = []  # snip, smallest id, its places
        self._g, self._pending, self._size = None, [], 0

    def add(self, g: int, snip: bytes, order, where: list) -> Iterator[tuple]:
        if g != self._g:
            yield from self._close()
            self._g = g
        if self._group and self._group[-1][0] == snip:
            if self._group[-1][1] == order:
                self._group[-1][2].extend(where)
            else:
                for doc, pos in where:
                    yield doc, pos, len(snip)
            return
        self._group.append((snip, order, list(where)))

    def _close(self) -> Iterator[tuple]:
        group, self._group = self._group, []
        if len(group) > 1:
            self._pending += group
            self._size += sum(len(x[0]) for x in group)
            if self._size > self._limit:
                yield from self._decide()

    def _decide(self) -> Iterator[tuple]:
        items, self._pending, self._size = self._pending, [], 0
        if items:
            yield from decide(items, self._window, self._gram, self._limit, self._seed)

    def end(self) -> Iterator[tuple]:
        yield from self._close()
        yield from self._decide()


def _shard(window: int, gram: int, kind: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, out = Shard(window, gram), []
        for pdf in batches:
            orders = id_orders(pdf["id"].tolist(), kind if kind in WHOLE else "string")
            for g, snip, doc, order, pos, size in zip(pdf["g"].tolist(), pdf["snip"], pdf["id"], orders, pdf["pos"].tolist(), pdf["size"].tolist(), strict=True):
                if snip is None:
                    out.append((doc, pos, size))
                else:
                    out += shard.add(g, bytes(snip), order, [(doc, pos)])
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["id", "pos", "size"])
                out = []
        out += shard.end()
        yield pd.DataFrame(out, columns=["id", "pos", "size"])

    return tidy(run)


def _cut() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part, out = pdf.iloc[lo : lo + 500], []
                for doc, t, ranges in zip(part["id"], part["text"], part["ranges"], strict=True):
                    b = t.encode()
                    spans = []
                    if ranges is not None:
                        packed = np.asarray(ranges, np.int64)
                        for a, e in np.sort(np.c_[packed >> 32, (packed >> 32) + (packed & 0xFFFFFFFF)].view("i8,i8"), axis=0).view(np.int64).tolist():
                            if spans and a <= spans[-1][1]:
                                spans[-1][1] = max(spans[-1][1], e)
                            else:
                                spans.append([a, e])
                    kept, at = [], 0
                    for a, e in spans:
                        kept.append(b[at:a])
                        at = e
                    kept.append(b[at:])
                    body = b"".join(kept)
                    out.append((doc, len(b), len(b) - len(body), spans, body))
                yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "spans", "kept"])

    return tidy(run)


def whole_copies(base: DataFrame, window: int) -> DataFrame:
    """id and size of documents of ``window`` bytes or more whose whole text a document with a smaller id has. base: id, text."""
    keyed = base.select("id", F.octet_length("text").alias("size"), F.unhex(F.sha2("text", 256)).alias("sha")).filter(F.col("size") >= window)
    first = stored(keyed.groupBy("sha").agg(F.min(sortable("id")).alias("first"), F.max(sortable("id")).alias("last")).filter("first < last").drop("last"), "first-copies")
    copies = stored(keyed.join(first, "sha").filter(sortable("id") > F.col("first")).select("id", "size").distinct(), "whole-copies")
    forget(first)
    return copies


def repeated_ranges(base: DataFrame, kind: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """id and range (long: start << 32 | size, overlapping) of bytes covered by a smaller document. base: id, text."""
    spark = base.sparkSession
    as_text = base.withColumn("id", F.col("id").cast("string"))
    total = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    cells = CHUNK
    while cells < MAX_CELLS and cells < total // 4:
        cells *= 2
    merged = as_text.mapInPandas(_sketch(window, gram, cells), "chunk long, once binary, more binary").groupBy("chunk").applyInPandas(_merge, "chunk long, bits binary, hot binary")
    bits, hot = np.zeros(DEPTH * cells // 8, np.uint8), []
    for r in merged.toLocalIterator():
        bits[r["chunk"] * (CHUNK // 8) : (r["chunk"] + 1) * (CHUNK // 8)] = np.frombuffer(bytes(r["bits"]), np.uint8)
        if r["chunk"] < cells // CHUNK:
            hot.append(np.frombuffer(bytes(r["hot"]), "<u2").astype(np.uint64) + np.uint64(r["chunk"] * CHUNK))
    shared = spark.sparkContext.broadcast((bits.tobytes(), np.concatenate(hot) if hot else np.zeros(0, np.uint64)))

    # a whole copy's strings all start in a smaller document that takes part, so it need not
    copies = whole_copies(base, window)
    bitmap = bitmap_of(copies, position(BITS, "id"))
    marked = in_bitmap(base, position(BITS, "id"), bitmap, "copy")
    others = marked.filter("copy").drop("copy").join(copies.select("id"), "id", "left_anti")
    parts = marked.filter(~F.col("copy")).drop("copy").unionByName(others).withColumn("id", F.col("id").cast("string"))
    snips = parts.mapInPandas(_snippets(window, gram, cells, shared, kind), "id string, pos int, size int, g long, snip binary")
    number = F.col("id").cast(kind)
    dealt = snips.repartition(max(shuffles(spark), 8), F.coalesce(F.when(F.col("snip").isNotNull(), F.col("g")), F.xxhash64("id")))
    dealt = dealt.sortWithinPartitions("g", "snip", number, "pos")
    found = dealt.mapInPandas(_shard(window, gram, kind), "id string, pos long, size long")
    packed = found.select(F.col("id").cast(kind).alias("id"), (F.shiftleft("pos", 32) + F.col("size")).alias("range"))
    out = stored(packed.unionByName(copies.select("id", F.col("size").cast("long").alias("range"))), "ranges")
    forget(copies, bitmap)
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """id, n_bytes, n_removed, spans (array of [start, end) removed, maximal), kept (binary)."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    ranges = repeated_ranges(base, kind, window, gram)
    marked = in_bitmap(base, position(BITS, "id"), bitmap_of(ranges.select("id").distinct(), position(BITS, "id")), "hit")
    whole = marked.filter(~F.col("hit")).select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<array<long>>").alias("spans"), F.encode("text", "UTF-8").alias("kept"))
    lists = ranges.groupBy("id").agg(F.collect_list("range").alias("ranges")).withColumnRenamed("id", "of")
    hit = marked.filter("hit").drop("hit")
    joined = hit.join(lists, hit["id"].eqNullSafe(lists["of"]), "left").select(F.col("id").cast("string").alias("id"), "text", "ranges")
    cut = joined.mapInPandas(_cut(), "id string, n_bytes long, n_removed long, spans array<array<long>>, kept binary")
    out = whole.unionByName(cut.withColumn("id", F.col("id").cast(kind)))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "spans", "kept")


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, int, str]]:
    """The contract read literally, for tests: doc_id -> n_bytes, n_removed, n_spans, kept_sha256."""
    first: dict[bytes, int] = {}
    out = {}
    for doc, text in sorted(rows, key=lambda x: x[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first.setdefault(b[i : i + window], doc) < doc:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out
