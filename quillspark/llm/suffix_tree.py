"""Language-model scoring with a probabilistic suffix tree.

A node of the tree is a context: the last 0 to ``depth`` words before a token, inside one document. The root is the
smoothed unigram distribution, (c + 0.1) / (N + 0.1 * (V + 1)), which leaves room for unknown words. A context s with c
occurrences holds explicitly each next symbol that followed it n >= MIN times; with discount d = 0.75 its distribution is
    P_s(w) = (n - d) / c [where w is explicit] + gamma_s * P_parent(w),   gamma_s = 1 - sum of (n - d) / c,
so every state's distribution sums to one. The parent is the longest retained proper suffix.
Divergence test: a context is retained if c times the divergence of its next symbols from its parent's distribution,
    sum over explicit n * ln(P_s(w) / P_parent(w)) + (c - sum of n) * ln(gamma_s),
is at least PENALTY nats for each of its explicit symbols. Contexts therefore vary in length from place to place. A
token is scored by the longest suffix of its history that is retained.

The tree is grown level by level. Word counts are exact. A count-min sketch of word pairs, sized from the corpus and
never above CELLS counters of a byte (64 MiB), tells which pairs can reach MIN; a second one, of the longer n-grams
made of such pairs alone, which of those can. Both only overestimate, and what they let through is counted exactly
by key: nothing that reaches MIN is lost, and a full sketch only lets more through. There is no limit on states.

Scale: text is read once; blocks keep their tokens as numbers of their distinct words. MIN and PENALTY are constants, so tree and model grow with the corpus. The model is never broadcast or collected:
blocks of documents ask it for their distinct n-grams (past the sketches' bits and a bitmap of the model's n-grams of at most 8 MiB) and are
scored with the answers. Both go by ranges of keys of which each holds some BUCKET n-grams of the model: a block's ascending keys of one range are one
row out and one back, by differences and bytes, so that rows grow with blocks times ranges and a key costs about six bytes each way. N-grams with 1 / HEAD of all tokens, at most HEAD of each length, go to every worker instead. An n-gram moves three times while the tree grows: when it is counted, to its suffix, to its context. A context's
next symbols that occur MIN times meet in one task, which spills them if need be; its occurrences are a sum with map-side combine.
N-grams are told apart by 64-bit hashes: among n distinct ones n * n / 2**65 mix-ups are expected.

Defined results: a null or empty text is its end token alone; a null id has no remainder and is trained on; repeated
rows count and are scored each; without any training row the root gives every token 1, so scores are 0; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import blocks
from .common import P, bitmap_of, forget, mix, reclaim, release, shuffles, small_batches, stored, tidy
from .words import BLANK, LOWER, arrow_bytes, run_hashes, runs, spans

DEPTH, MIN, DISCOUNT, PENALTY, ADD = 3, 8, 0.75, 4.0, 0.1
BLOCK_BYTES = 16 << 20
#: N-grams with at least 1 / HEAD of all tokens go to every worker.
HEAD = 1 << 19
#: N-grams of the model in a range of keys, on average at most.
BUCKET = 1 << 17
#: Tokens scored together: whole texts.
PART = 1 << 19
#: Of the compressed token numbers.
LEVEL = 3
CELLS, CHUNK = 1 << 26, 1 << 16
MODEL_BITS = 1 << 26
WORD = ~BLANK
#: Hash of the end token, and the constant of a longer n-gram's hash.
END, MUL = np.uint64(0x5D0B1A7C3E9F2468), np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------------ n-grams of a block


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each with its end token, and bounds: those of text i are bounds[i] to bounds[i + 1]."""
    data, offsets = arrow_bytes(texts)
    data = LOWER[data]
    starts, lens, bounds = runs(data, offsets, WORD)
    out = np.full(len(starts) + len(offsets) - 1, END)
    doc = np.searchsorted(bounds, np.arange(len(starts)), side="right") - 1
    out[np.arange(len(starts)) + doc] = run_hashes(data, starts, lens)
    return out, bounds + np.arange(len(bounds))


def encoded(raw: bytes, sizes: np.ndarray) -> bytes:
    """What a block keeps of its texts: bounds of their tokens, the distinct hashes by falling use, and each token's number among these."""
    offsets = np.r_[0, np.cumsum(np.maximum(sizes, 0))].astype(np.int64)
    words, bounds = tokens(pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(raw)))
    known, code, n = np.unique(words, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    planes = rank[code].view(np.uint8).reshape(-1, 4).T  # by bytes, which compresses better
    return np.array([len(known)], np.int64).tobytes() + bounds.astype(np.int64).tobytes() + known[order].tobytes() + planes.tobytes()


def decoded(count: int, raw: int, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bounds, distinct hashes, and the number of each token, of a block with ``count`` texts."""
    data = pa.decompress(blob, int(raw), "zstd")
    known = int(np.frombuffer(data, np.int64, 1)[0])
    bounds = np.frombuffer(data, np.int64, count + 1, 8)
    words = np.frombuffer(data, np.uint64, known, 8 * (count + 2))
    planes = np.frombuffer(data, np.uint8, offset=8 * (count + 2 + known)).reshape(4, -1)
    return bounds, words, np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """block, ids, bounds, distinct hashes, numbers of each block row."""
    for b in batches:
        for i in range(b.num_rows):
            ids = b.column("ids")[i].values
            yield b.column(f"{P}block")[i].as_py(), ids, *decoded(len(ids), b.column("raw")[i].as_py(), b.column("blob")[i].as_py())


def _training(ids: pa.Array, bounds: np.ndarray, words: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and bounds of the tokens of the texts that are not held out."""
    use = ~np.asarray(ids.field("held"), bool) if len(ids) else np.zeros(0, bool)
    size = np.diff(bounds)
    return words[code[np.repeat(use, size)]], np.r_[0, np.cumsum(size[use])]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, by key, and how often it occurs."""
    order = np.argsort(keys)
    in_order = keys[order]
    first = np.flatnonzero(np.r_[True, in_order[1:] != in_order[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return order[first], np.diff(np.r_[first, len(keys)])


def grams(words: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """keys[k - 1][i]: the n-gram of k tokens that ends at i; and how many tokens of its text stand before i."""
    before = (np.arange(len(words)) - np.repeat(bounds[:-1], np.diff(bounds))).astype(np.int32)
    keys = [words]
    for _ in range(depth):
        last = keys[-1]
        keys.append(joined(np.r_[np.zeros(1, np.uint64), last[:-1]][: len(last)], last))
    return keys, before


def joined(ctx: np.ndarray, suf: np.ndarray) -> np.ndarray:
    """Keys of n-grams from those without their last token and without their first."""
    return mix(ctx * MUL + suf)


class Gate:
    """Which n-grams may reach the least count: bits of two sketches, of pairs and of longer ones."""

    def __init__(self, pairs: np.ndarray | None = None, longer: np.ndarray | None = None):
        self.bits = (pairs, longer)

    def open(self, keys: list[np.ndarray], before: np.ndarray, order: int) -> np.ndarray:
        """Places whose n-gram of this order lies in its text, is made of pairs that pass, and passes itself."""
        ok = before >= order - 1
        if self.bits[0] is not None:
            pair = _lit(self.bits[0], keys[1])
            for back in range(order - 1):
                ok[back:] &= pair[: len(pair) - back]
        if order > 2 and self.bits[1] is not None:
            ok[ok] = _lit(self.bits[1], keys[order - 1][ok])
        return ok


def _lit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


# ------------------------------------------------------------------ tasks


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n: the distinct tokens of the training texts of a block."""
    for _, ids, bounds, words, code in _rows(batches):
        use = np.repeat(~np.asarray(ids.field("held"), bool), np.diff(bounds)) if len(ids) else np.zeros(0, bool)
        n = np.bincount(code[use], minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(words[n > 0].view(np.int64)), pa.array(n[n > 0], pa.int64())], ["key", "n"])


def _sketch(depth: int, cells: int, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """chunk, counts: a task's sketch of pairs, or with the pairs' bits given of the longer n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = Gate(None if shared is None else np.frombuffer(shared.value, np.uint8))
        count = np.zeros(cells, np.uint8)
        for _, *row in _rows(batches):
            keys, before = grams(*_training(*row), depth)
            for order in [2] if shared is None else range(3, depth + 2):
                at = keys[order - 1][gate.open(keys, before, order)] & np.uint64(cells - 1)
                at, n = np.unique(at.astype(np.uint32), return_counts=True)
                count[at] = np.minimum(count[at] + n, 255)
            del keys, before, row, at, n
        for i, part in enumerate(count.reshape(-1, min(CHUNK, cells))):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)], pa.binary())], ["chunk", "counts"])

    return tidy(run)


def _merge(least: int, chunk: int) -> Callable[[tuple, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(chunk, np.int64)
        for pdf in parts:
            for c in pdf["counts"]:
                total += np.frombuffer(pa.decompress(c, chunk, "zstd"), np.uint8)
        yield pd.DataFrame({"chunk": [key[0]], "bits": [np.packbits(total >= least, bitorder="little").tobytes()]})

    return run


def _bits(base: DataFrame, depth: int, cells: int, least: int, shared=None) -> bytes:
    """Bitmap of the cells whose count reaches ``least``: cells / 8 bytes. A saturated counter still reaches it."""
    chunk = min(CHUNK, cells)
    merged = base.mapInArrow(_sketch(depth, cells, shared), "chunk long, counts binary").groupBy("chunk").applyInPandas(_merge(least, chunk), "chunk long, bits binary")
    out = np.zeros(cells // 8, np.uint8)
    for r in merged.toLocalIterator():
        out[r["chunk"] * (chunk // 8) : (r["chunk"] + 1) * (chunk // 8)] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.tobytes()


def _counts(depth: int, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """ord, ctx (without the last token), suf (without the first), n: n-grams that pass the gate, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = Gate(*(np.frombuffer(b, np.uint8) for b in shared.value))
        for _, *row in _rows(batches):
            keys, before = grams(*_training(*row), depth)
            for order in range(2, depth + 2):
                at = np.flatnonzero(gate.open(keys, before, order))
                first, n = _distinct(keys[order - 1][at])
                at = at[first]
                cols = [np.full(len(at), order, np.int32), *(keys[order - 2][i].view(np.int64) for i in (at - 1, at)), n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["ord", "ctx", "suf", "n"])
                del at, first, n, cols
            del keys, before, row

    return tidy(run)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ctx, suf = (np.asarray(b.column(c), np.int64).view(np.uint64) for c in ("ctx", "suf"))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(joined(ctx, suf).view(np.int64))], [*b.schema.names, "key"])


def may_hold(gate: Gate, bits: np.ndarray, keys: list[np.ndarray], before: np.ndarray, order: int) -> np.ndarray:
    """Places whose n-gram of this order the model may hold: it passes the sketches and the bitmap of the model."""
    ok = gate.open(keys, before, order)
    ok[ok] = _lit(bits, keys[order - 1][ok])
    return ok


def by_bytes(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit values, compressed byte by byte of the values."""
    return pa.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns), "zstd", asbytes=True)


def from_bytes(blob: bytes, count: int, columns: int) -> list[np.ndarray]:
    """The columns of :func:`by_bytes`, as unsigned integers."""
    planes = np.frombuffer(pa.decompress(blob, 8 * count * columns, "zstd"), np.uint8).reshape(columns, 8, count)
    return [np.ascontiguousarray(c.T).view(np.uint64).ravel() for c in planes]


def steps(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as differences; their running sum gives them back."""
    return np.diff(keys, prepend=np.uint64(0))


def _questions(depth: int, shared, head, bits_of_range: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """block, bucket, count, keys: the distinct n-grams of a block that the model may hold and that not every worker knows, by range of keys."""
    shift = np.uint64(64 - bits_of_range)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, *gates = (np.frombuffer(b, np.uint8) for b in shared.value)
        gate, known = Gate(*gates), Answers.of_table(head.value)
        for block, _, bounds, words, code in _rows(batches):
            keys, before = grams(words[code], bounds, depth)
            ask = []
            for order, k in enumerate(keys, 1):
                k = np.unique(words if order == 1 else k[may_hold(gate, bits, keys, before, order)])
                ask.append(k[known.at(k) < 0])
            del keys, before, k
            ask = np.unique(np.concatenate(ask))
            bucket = (ask >> shift).astype(np.int64)
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(ask) else np.zeros(0, np.int64)
            ends = np.r_[cut[1:], len(ask)][: len(cut)]
            blobs = [by_bytes(steps(ask[lo:hi])) for lo, hi in zip(cut.tolist(), ends.tolist(), strict=True)]
            cols = [pa.array(np.full(len(cut), block, np.int64)), pa.array(bucket[cut]), pa.array((ends - cut).astype(np.int64)), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [f"{P}block", "bucket", "count", "keys"])
            del ask, bucket, blobs, cols

    return tidy(run)


class Answers:
    """A share of the model, by key: occurrences, and what a retained context leaves to its parent (times its occurrences; else 0)."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        key, n, room = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, t) for t in (np.uint64, np.int64, np.float64))
        order = np.argsort(key, kind="stable")  # parts are in order, which a stable sort makes use of
        self.key, self.n, self.room = key[order], n[order], room[order]

    @staticmethod
    def columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return table.column("key").to_numpy().astype(np.int64).view(np.uint64), table.column("n").to_numpy().astype(np.int64), table.column("room").to_numpy().astype(np.float64)

    @classmethod
    def of_table(cls, table: pa.Table) -> Answers:
        return cls([cls.columns(table)])

    def at(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.key):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where(self.key[place] == keys, place, -1)


def _answer(asked: pa.Table, model: pa.Table) -> pa.Table:
    """block, count, blob: of the keys of one range that each block asks for, those the model holds, with n and room."""
    held, out = Answers.of_table(model), []
    for block, count, blob in zip(*(asked.column(c).to_pylist() for c in (f"{P}block", "count", "keys")), strict=True):
        at = held.at(np.cumsum(from_bytes(blob, count, 1)[0], dtype=np.uint64))
        at = at[at >= 0]
        if len(at):
            out.append((block, len(at), by_bytes(steps(held.key[at]), held.n[at], held.room[at])))
    release()
    return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate([(f"{P}block", pa.int64()), ("count", pa.int64()), ("blob", pa.binary())])})


def _answered(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What :func:`_answer` packed."""
    out = []
    for count, blob in zip(table.column("count").to_pylist(), table.column("blob").to_pylist(), strict=True):
        key, n, room = from_bytes(blob, count, 3)
        out.append((np.cumsum(key, dtype=np.uint64), n.view(np.int64), room.view(np.float64)))
    return out


def score_block(bounds: np.ndarray, words: np.ndarray, code: np.ndarray, answers: Answers, may: Callable, depth: int, total: int, distinct: int) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score, score of each text, some PART tokens at a time. may(keys, before, order): where the model may hold an n-gram."""
    whole = total + ADD * (distinct + 1)
    known = answers.at(words)
    counts = np.where(known >= 0, answers.n[known], 0) if len(answers.n) else np.zeros(len(words))
    out = [np.zeros((4, 0))]
    for lo, hi in spans(bounds, PART):
        part, cut = code[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        keys, before = grams(words[part], cut, depth)
        at = known[part]
        count = counts[part]
        base = (count + ADD) / whole
        p = base.copy()
        for k in range(1, depth + 1):
            state = np.r_[-1, at[:-1]][: len(at)]  # the n-gram of k tokens before each token
            at = np.full(len(part), -1)
            here = np.flatnonzero(may(keys, before, k + 1))
            at[here] = answers.at(keys[k][here])
            on = np.flatnonzero((state >= 0) & (before >= k))
            on = on[answers.room[state[on]] > 0] if len(on) else on
            if len(on):
                explicit = np.where(at[on] >= 0, answers.n[at[on]] - DISCOUNT, 0.0)
                p[on] = (explicit + answers.room[state[on]] * p[on]) / answers.n[state[on]]
        out.append(np.add.reduceat(np.stack([np.ones(len(part)), count > 0, np.log10(base), np.log10(p)]), cut[:-1], axis=1))
    sums = np.concatenate(out, axis=1)
    return dict(zip(("n_tokens", "n_known", "base_score", "score"), (sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2], sums[3]), strict=True))


def _score(depth: int, total: int, distinct: int, head, shared) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        bits, *gates = (np.frombuffer(b, np.uint8) for b in shared.value)
        gate = Gate(*gates)
        ids = block.column("ids")[0].values
        row = decoded(len(ids), block.column("raw")[0].as_py(), block.column("blob")[0].as_py())
        held = Answers([Answers.columns(head.value), *_answered(answers)])
        out = score_block(*row, held, lambda keys, before, order: may_hold(gate, bits, keys, before, order), depth, total, distinct)
        del held, row
        release()
        return pa.table({"id": ids.field("id"), "held": ids.field("held"), **{c: pa.array(x) for c, x in out.items()}})

    return run


# ------------------------------------------------------------------ the model


def tree(words: DataFrame, counted: DataFrame, depth: int, total: int, distinct: int, penalty: float = PENALTY) -> list[DataFrame]:
    """Levels 1 to depth, stored: key, ctx, n, c, p, room. c counts ctx; room / c is gamma, what ctx leaves to its parent,
    and null where ctx is not retained; p is the smoothed probability of the last token after ctx."""
    contexts = words.select(F.col("key").alias("ctx"), F.col("n").alias("c"))
    parents = words.select(F.col("key").alias("suf"), ((F.col("n") + ADD) / (total + ADD * (distinct + 1))).alias("above"))
    # the joins on ctx have dealt the rows by it, so that what a context says of itself needs no shuffle of its own
    levels, of = [], Window.partitionBy("ctx")
    for k in range(1, depth + 1):
        rows = counted.filter(F.col("ord") == k + 1).select("key", "ctx", "suf", "n").join(parents, "suf").drop("suf").join(contexts, "ctx")
        rows = rows.withColumn("e", (F.col("n") - DISCOUNT) / F.col("c")).withColumn("symbols", F.count("*").over(of)).withColumn("other", F.col("c") - F.sum("n").over(of))
        rows = rows.withColumn("room", F.col("other") + DISCOUNT * F.col("symbols")).withColumn("gamma", F.col("room") / F.col("c"))
        rows = rows.withColumn("q", F.col("e") + F.col("gamma") * F.col("above"))
        gain = F.sum(F.col("n") * F.log(F.col("q") / F.col("above"))).over(of) + F.col("other") * F.log("gamma")
        rows = rows.withColumn("on", gain >= penalty * F.col("symbols"))
        level = rows.select("key", "ctx", "n", "c", F.when(F.col("on"), F.col("q")).otherwise(F.col("above")).alias("p"), F.when(F.col("on"), F.col("room")).alias("room"))
        levels.append(stored(level, f"level-{k}"))
        reclaim(words.sparkSession)
        contexts = levels[-1].select(F.col("key").alias("ctx"), F.col("n").alias("c"))
        parents = levels[-1].select(F.col("key").alias("suf"), F.col("p").alias("above"))
    return levels


def train(base: DataFrame, depth: int = DEPTH, least: int = MIN, penalty: float = PENALTY) -> tuple[DataFrame, int, int, Broadcast]:
    """The model of the blocks' training texts (key, n, room, word), their number of tokens and of distinct tokens, and the gate's bits."""
    spark = base.sparkSession
    with small_batches(spark, 2):
        words = stored(base.mapInArrow(_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
        total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        cells = 1 << 12
        while cells < CELLS and cells < 4 * total:
            cells *= 2
        pairs = _bits(base, depth, cells, least)
        longer = _bits(base, depth, cells, least, spark.sparkContext.broadcast(pairs)) if depth > 1 else pairs
        shared = spark.sparkContext.broadcast((pairs, longer))
        counted = base.mapInArrow(_counts(depth, shared), "ord int, ctx long, suf long, n long").groupBy("ord", "ctx", "suf").agg(F.sum("n").alias("n"))
        bare = stored(counted.filter(F.col("n") >= least), "counted")
    counted = stored(bare.mapInArrow(_keyed, "ord int, ctx long, suf long, n long, key long"), "counted")
    forget(bare)
    reclaim(spark)
    often = words.filter(F.col("n") >= least)  # every part of an n-gram that reaches the least count does
    levels = tree(often, counted, depth, total, distinct, penalty)
    none, no = F.lit(None).cast("double").alias("room"), F.lit(False).alias("word")
    parts = [often.select("key", "n", none, F.lit(True).alias("word"))]
    for level in levels:
        retained = level.filter("room is not null")
        parts += [retained.select("key", "n", none, no), retained.select(F.col("ctx").alias("key"), F.col("c").alias("n"), "room", no)]
    model = reduce(DataFrame.unionAll, parts).groupBy("key").agg(*(F.max(c).alias(c) for c in ("n", "room", "word")))
    rare = words.filter(F.col("n") < least).select("key", "n", none, F.lit(True).alias("word"))
    model = stored(model.unionAll(rare), "model")
    forget(words, counted, *levels)
    return model, total, distinct, shared


def model_bits(model: DataFrame) -> bytes:
    """Bitmap of the low bits of keys: 8 MiB."""
    rows = bitmap_of(model, F.col("key").bitwiseAND(F.lit(MODEL_BITS - 1)) + 1)
    out = np.zeros(MODEL_BITS // 8, np.uint8)
    for r in rows.toLocalIterator():
        lo = (r[f"{P}bucket"] - 1) * 4096
        out[lo : lo + 4096] = np.frombuffer(bytes(r[f"{P}bits"]), np.uint8)
    forget(rows)
    return out.tobytes()


def range_bits(rows: int, tasks: int) -> int:
    """Leading bits of a key that name its range: BUCKET rows of the model a range at most, and two ranges a task at least."""
    return max(1, max(-(-rows // BUCKET), 2 * tasks) - 1).bit_length()


def score_documents(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least: int = MIN, penalty: float = PENALTY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, held, n_tokens, n_known, train_tokens, base_score, score; documents where ``held`` holds are not learned from."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.coalesce(held, F.lit(False)).alias("held")).alias("id"), F.col(text_col).alias("text"))
    base = blocks(rows, "id", "text", block_bytes, encoded, LEVEL)
    model, total, distinct, gate = train(base, depth, least, penalty)
    shared = spark.sparkContext.broadcast((model_bits(model.filter("not word")), *gate.value))
    reclaim(spark)
    values = model.select("key", "n", F.coalesce("room", F.lit(0.0)).alias("room"))
    # at most HEAD n-grams of each length have so large a share of all tokens
    common = F.col("n") * HEAD >= total
    head = spark.sparkContext.broadcast(values.filter(common).toArrow())
    ranges = range_bits(model.count(), shuffles(spark))
    asked = base.mapInArrow(_questions(depth, shared, head, ranges), f"{P}block long, bucket long, count long, keys binary")
    share = values.filter(~common).withColumn("bucket", F.shiftrightunsigned("key", 64 - ranges))
    answers = asked.groupBy("bucket").cogroup(share.groupBy("bucket")).applyInArrow(_answer, f"{P}block long, count long, blob binary")
    scored = base.groupBy(f"{P}block").cogroup(answers.groupBy(f"{P}block"))
    out = scored.applyInArrow(_score(depth, total, distinct, head, shared), f"id {kind}, held boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(total).cast("long")).withColumnRenamed("id", id_col)


def op12_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_documents(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
    return out.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
