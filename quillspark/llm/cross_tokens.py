"""Alignment of two tokenizers by segment deduplication.

Texts are cut before white-space runs, at places where neither vocabulary can merge across; so the tokens of a text
are those of its segments in order, and every segment ends a token on both sides. Distinct segments are tokenised and
aligned once; their alignments are joined back to the blocks of documents that hold them, and documents are composed.

:func:`can_cut` verifies the places: no entry of either vocabulary holds a space behind anything but white space.
Where one does, whole texts are the segments, and everything else stays as it is. A cut lies before a space whose
predecessor is no white space in any sense (Unicode's included), so a byte-level pre-tokenizer, which never matches from
a letter, digit or sign into white space and looks ahead over white space only, splits there too.

Counts of linked id pairs come from the distinct segments and how often each occurs; a segment's sums over its links
are then numbers that documents add up. A segment that does not give back its bytes on either side rules out the
documents that hold it (U+2581 does so for the piece tokenizer); their segments are counted off again.

Scale: a block of BLOCK_BYTES of text deals one row for each distinct segment and gets one back, so neither a common
word nor a common document makes a hot key. Segments with at least 1 / HEAD of all occurrences, so at most HEAD of them,
go to every worker instead, and segments of one block go straight back to it. Segments are told apart by their text; a
block finds its answers by 64-bit hashes, with n * n / 2**65 mix-ups expected among the n segments of a block and HEAD
others. The table of linked pairs is broadcast where it was measured to be at most MOST_BYTES, and joined otherwise.

Defined results: null and empty texts, and those ruled out, have zeros and the empty string; repeated rows are
documents each, and count each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, packed, rows_of, texts_of, unpacked
from .common import P, forget, release, small_batches, stored, tidy

BLOCK_BYTES = 16 << 20
MOST_BYTES = 64 << 20
#: The most common segments, of at most so many bytes each, are broadcast.
HEAD, HEAD_BYTES = 1 << 17, 64
#: Segments tokenised at once, and documents composed at once.
BATCH, DOCS = 4000, 500
_CUT = re.compile(r"(?<=\S)(?= )")
_DOUBLE = re.compile(r"\s ")
SPACE = "▁"
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def byte_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself where printable, else 256 and up in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, with the bytes of each of their ids. Segments are given without the space that each begins with."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(byte_bpe)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        char = byte_of_char()
        self.a_bytes = {i: bytes(map(char.__getitem__, t)) if all(c in char for c in t) else t.encode() for t, i in self._a.get_vocab().items()}
        pieces = [(i, self._b.id_to_piece(i)) for i in range(self._b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in pieces}
        self._blank = self._b.piece_to_id(SPACE)
        self.a, self.b = _by_id(self.a_bytes), _by_id(self.b_bytes)
        self.cut = can_cut(self.a_bytes) and can_cut(self.b_bytes)

    def segments(self, text: str) -> list[str]:
        """The segments of space + text, each without its space."""
        if not self.cut:
            return [text]
        if not _DOUBLE.search(" " + text):  # every space stands behind something else: a cut before each
            return text.split(" ")
        return [s[1:] for s in _CUT.split(" " + text)]

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self._a.encode_batch([" " + s for s in segments], add_special_tokens=False)]
        b = self._b.encode(segments, num_threads=1)  # it adds the space itself, but to the empty text
        return a, [ids if s else [self._blank] for s, ids in zip(segments, b, strict=True)]


def _by_id(entries: dict[int, bytes]) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """The bytes of each id, the id in decimal, and the number of its bytes."""
    raw = [entries.get(i, b"") for i in range(max(entries) + 1)]
    return pa.array(raw, pa.binary()), pa.array(list(map(str, range(len(raw)))), pa.string()), np.array(list(map(len, raw)))


def can_cut(entries: dict[int, bytes]) -> bool:
    """No entry holds both sides of a place where :data:`_CUT` cuts; bytes that end or begin inside a character count as no white space."""
    return not any(_CUT.search(e.decode("utf-8", "replace")) for e in entries.values())


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values)


def align(pair: Pair, segments: list[str]) -> dict[str, pa.Array]:
    """For each segment: ok (both sides give back its bytes), n_a, n_b, n_groups, n_links, groups, la, lb (linked ids)."""
    whole = pa.array([b" " + s.encode() for s in segments], pa.binary())
    ok, ids, sizes = np.ones(len(segments), bool), [], []
    for lists, (raw, _, _) in zip(pair.encode(segments), (pair.a, pair.b), strict=True):
        sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        ids.append(np.fromiter(chain.from_iterable(lists), np.int64, sizes[-1].sum()))
        ok &= np.asarray(pc.equal(pc.binary_join(_lists(sizes[-1], raw.take(pa.array(ids[-1]))), b""), whole))
    (a, b), (n_a, n_b) = ([i[np.repeat(ok, n)] for i, n in zip(ids, sizes, strict=True)], [np.where(ok, n, 0) for n in sizes])
    # all segments end to end: each ends a token on both sides
    a_end, b_end = np.cumsum(pair.a[2][a]), np.cumsum(pair.b[2][b])
    owner = np.repeat(np.arange(len(segments)), n_a)
    both = np.intersect1d(a_end, b_end, assume_unique=True)
    sides = []
    for i, end, (_, text, _) in ((a, a_end, pair.a), (b, b_end, pair.b)):
        sides.append(pc.binary_join(_lists(np.bincount(np.searchsorted(both, end), minlength=len(both)), text.take(pa.array(i))), ","))
    n_groups = np.bincount(owner[np.searchsorted(a_end, both)], minlength=len(segments))
    groups = pc.binary_join(_lists(n_groups, pc.binary_join_element_wise(*sides, "|")), ";")
    ends = np.union1d(a_end, b_end)  # a link for each stretch between two of these
    left, right = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
    n_links = np.bincount(owner[left], minlength=len(segments))
    numbers = {c: pa.array(x, pa.int32()) for c, x in zip(_NUMBERS, (n_a, n_b, n_groups, n_links), strict=True)}
    return {"ok": pa.array(ok)} | numbers | {"groups": groups, "la": _lists(n_links, pa.array(a[left], pa.int32())), "lb": _lists(n_links, pa.array(b[right], pa.int32()))}


# ------------------------------------------------------------------ tasks

_worker: dict[tuple[str, str], Pair] = {}


def _pair(paths: tuple[str, str]) -> Pair:
    if paths not in _worker:
        _worker[paths] = Pair(*paths)
    return _worker[paths]


def key_of(segments) -> np.ndarray:
    """What Spark's xxhash64 gives for each string."""
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(s, 42) for s in segments), np.uint64, len(segments)).view(np.int64)


def _segments(paths: tuple[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """block, seg, times: the distinct segments of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(paths)
        for block, _, texts, _ in rows_of(batches):
            times: Counter = Counter()
            for t in texts:
                if t := t.as_py():
                    times.update(pair.segments(t))
            segs = sorted(times)  # in order they take less room
            for lo in range(0, len(segs), 100_000):
                part = segs[lo : lo + 100_000]
                columns = [pa.array(np.full(len(part), block, np.int64)), pa.array(part, pa.string()), pa.array([times[s] for s in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [f"{P}block", "seg", "times"])

    return tidy(run)


_ALIGNED = f"seg string, times long, in_blocks long, {P}block long, ok boolean, n_a int, n_b int, n_groups int, n_links int, groups string, la array<int>, lb array<int>"
_CARRIED = ("seg", "times", "in_blocks", f"{P}block")


def _align(paths: tuple[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(paths)
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                b = whole.slice(lo, BATCH)
                found = align(pair, b.column("seg").to_pylist())
                yield pa.RecordBatch.from_arrays([*map(b.column, _CARRIED), *found.values()], [*_CARRIED, *found])

    return tidy(run)


def _sums(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Aligned segments with n_best and count_sum in place of their links; shared: sorted a << 32 | b, counts, whether highest for b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count, best = shared.value
        for b in batches:
            at = np.searchsorted(keys, np.asarray(b.column("la").flatten(), np.int64) << 32 | np.asarray(b.column("lb").flatten(), np.int64))
            cut = np.r_[0, np.cumsum(np.asarray(b.column("n_links"), np.int64))]
            out = []
            for x in (best, count):
                total = np.r_[0, np.cumsum(x[np.minimum(at, len(x) - 1)])] if len(x) else np.zeros(len(at) + 1, np.int64)
                out.append(pa.array(total[cut[1:]] - total[cut[:-1]], pa.int64()))
            b = b.drop_columns(["la", "lb"])
            yield pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, "n_best", "count_sum"])

    return tidy(run)


def _one(table: pa.Table) -> tuple[pa.Array, pa.Array]:
    """ids and texts of the one block row in a cogrouped table."""
    row = {c: table.column(c)[0] for c in ("ids", "sizes", "raw", "blob")}
    return row["ids"].values, texts_of(row["sizes"].values, row["raw"].as_py(), row["blob"].as_py())[0]


def _ruled_out(paths: tuple[str, str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """seg, less: what the documents of a block that hold one of the given segments add to each segment's count."""

    def run(block: pa.Table, bad: pa.Table) -> pa.Table:
        pair, times, gone = _pair(paths), Counter(), set(bad.column("seg").to_pylist())
        for t in _one(block)[1] if gone else []:
            segs = pair.segments(t) if (t := t.as_py()) else []
            if not gone.isdisjoint(segs):
                times.update(segs)
        return pa.table({"seg": pa.array(list(times), pa.string()), "less": pa.array(list(times.values()), pa.int64())})

    return run


_TOTALS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _compose(paths: tuple[str, str], head) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = ["h", "ok", *_TOTALS, "groups"]

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        pair = _pair(paths)
        ids, texts = _one(block)
        found = pa.concat_tables([t.select(names) for t in (head.value, unpacked(answers)) if t is not None]).combine_chunks().sort_by("h")
        keys = np.asarray(found.column("h"), np.int64)
        good, each = np.asarray(found.column("ok"), bool), [np.asarray(found.column(c), np.int64) for c in _TOTALS]
        groups = found.column("groups").combine_chunks()
        known: dict[str, int] = {}
        totals, composed = [], []
        for lo in range(0, len(texts), DOCS):
            at, sizes = [], []
            for t in texts.slice(lo, DOCS).to_pylist():
                segs = pair.segments(t) if t else []
                if new := [s for s in set(segs) if s not in known]:
                    known.update(zip(new, np.searchsorted(keys, key_of(new)).tolist(), strict=True))
                at.extend(map(known.__getitem__, segs))
                sizes.append(len(segs))
            at, sizes = np.array(at, np.int64), np.array(sizes, np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            keep = (np.bincount(doc[~good[at]], minlength=len(sizes)) == 0)[doc]
            at, doc = at[keep], doc[keep]
            totals.append(np.stack([_sum_by(doc, x[at], len(sizes)) for x in each]))
            composed.append(pc.binary_join(_lists(np.bincount(doc, minlength=len(sizes)), groups.take(pa.array(at))), ";"))
        totals = np.concatenate(totals, axis=1) if totals else np.zeros((len(_TOTALS), 0), np.int64)
        out = pa.table({"id": ids} | dict(zip(_TOTALS, map(pa.array, totals), strict=True)) | {"groups": pa.chunked_array(composed, pa.string())})
        del known, found, groups, keys, each
        release()
        return out

    return run


def _sum_by(owner: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Exact integer sums of values by ascending owner."""
    total = np.r_[0, np.cumsum(values)]
    cut = np.searchsorted(owner, np.arange(count + 1))
    return total[cut[1:]] - total[cut[:-1]]


# ------------------------------------------------------------------ the operator


def aligned_segments(base: DataFrame, asked: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """The distinct segments, stored: each aligned once, with how often documents that are not ruled out hold it."""
    distinct = asked.groupBy("seg").agg(F.sum("times").alias("times"), F.count("*").alias("in_blocks"), F.min(f"{P}block").alias(f"{P}block"))
    table = stored(distinct.mapInArrow(_align(paths), _ALIGNED), "aligned")
    bad = table.filter(~F.col("ok")).select("seg")
    if not bad.limit(1).count():
        return table
    where = asked.join(bad, "seg", "left_semi").select(f"{P}block", "seg")
    some = base.join(where.select(f"{P}block").distinct(), f"{P}block", "left_semi")
    less = some.groupBy(f"{P}block").cogroup(where.groupBy(f"{P}block")).applyInArrow(_ruled_out(paths), "seg string, less long")
    less = less.groupBy("seg").agg(F.sum("less").alias("less"))
    after = stored(table.join(less, "seg", "left").withColumn("times", F.col("times") - F.coalesce("less", F.lit(0))).select(table.columns), "aligned")
    forget(table)
    return after


def with_sums(table: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Aligned segments, stored, with n_best and count_sum over their links in place of the links."""
    links = table.select("seg", "times", F.explode(F.arrays_zip("la", "lb")).alias("x")).select("seg", "times", F.col("x.la").alias("a"), F.col("x.lb").alias("b"))
    count = stored(links.groupBy("a", "b").agg(F.sum("times").alias("count")).filter("count > 0"), "pairs")
    pairs = count.join(count.groupBy("b").agg(F.max("count").alias("most")), "b")
    pairs = stored(pairs.select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("key"), "count", (F.col("count") == F.col("most")).cast("long").alias("best")), "pair-counts")
    if pairs.count() * 24 <= most_bytes:
        rows = pairs.orderBy("key").toArrow()
        shared = table.sparkSession.sparkContext.broadcast(tuple(np.asarray(rows.column(c), np.int64) for c in ("key", "count", "best")))
        kinds = ", ".join(_ALIGNED.split(", ")[:-2])
        out = table.mapInArrow(_sums(shared), f"{kinds}, n_best long, count_sum long")
    else:
        keyed = links.select("seg", (F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("key"))
        sums = keyed.join(pairs, "key").groupBy("seg").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
        out = table.drop("la", "lb").join(sums, "seg", "left").fillna(0, ["n_best", "count_sum"])
    out = stored(out, "segments-with-sums")
    forget(count, pairs, table)
    return out


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str | None = None, piece_bpe: str | None = None, block_bytes: int = BLOCK_BYTES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (``a1,a2|b1;a3|b2,b3``; empty without tokens)."""
    spark = docs.sparkSession
    paths = (byte_bpe or byte_path(), piece_bpe or piece_path())
    kind = docs.schema[id_col].dataType.simpleString()
    base = blocks(docs, id_col, text_col, block_bytes)
    with small_batches(spark, 4):
        asked = stored(base.mapInArrow(_segments(paths), f"{P}block long, seg string, times long"), "segments")
    table = with_sums(aligned_segments(base, asked, paths), most_bytes)
    # segments of every block need no question: at most HEAD of them have so large a share of all segments
    total = asked.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    common = (F.col("times") * HEAD >= total) & (F.octet_length("seg") <= HEAD_BYTES) & (F.col("in_blocks") > 1)
    answer = ["ok", *_TOTALS, "groups"]
    head = table.filter(common).select(F.xxhash64("seg").alias("h"), *answer).toArrow()
    shared = spark.sparkContext.broadcast(head)
    rest = table.filter(~common)
    one = rest.filter("in_blocks = 1").select(f"{P}block", F.xxhash64("seg").alias("h"), *answer)
    more = asked.join(F.broadcast(table.filter(common).select("seg")), "seg", "left_anti").select(F.col(f"{P}block").alias("to"), "seg").join(rest.filter("in_blocks > 1"), "seg")
    more = more.select(F.col("to").alias(f"{P}block"), F.xxhash64("seg").alias("h"), *answer)
    answers = packed(one).unionByName(packed(more))
    out = base.groupBy(f"{P}block").cogroup(answers.groupBy(f"{P}block")).applyInArrow(_compose(paths, shared), f"id {kind}, {', '.join(f'{c} long' for c in _TOTALS)}, groups string")
    return out.withColumnRenamed("id", id_col)


def op11_cross_tokens(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    out = align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", *_TOTALS, F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))
