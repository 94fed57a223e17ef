"""Packing along a space-filling curve.

Every document becomes a vector of hashed token projections, reduced to DIMS numbers of BITS bits; documents are
range-sorted by the Hilbert index of that point and laid end to end along the curve into sequences of at most
``length`` tokens, so neighbours on the curve share sequences.

Two passes, and neither moves text or tokens. Pass one tokenises each text once and keeps a narrow row: Hilbert key,
token count and a running CRC-32 after every STEP tokens. Pass two range-sorts those rows by (key, id), which splits
even a key held by a third of all rows, and packs each range in one streaming scan. Documents are cut only at
multiples of STEP, where the CRC of any piece follows from two running CRCs; a sequence is closed when less than
STEP of it is free and the next piece doesn't fit, so padding stays near STEP / 2 tokens in ``length`` (0.4 %) plus
one open sequence per range of at least RANGE tokens.

Defined results: null and empty texts are one end token; repeated rows are packed each; ties on the curve go by id,
nulls first; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, small_batches, stored, text_or_empty, tidy
from .words import LOWER, join_texts, run_hashes, word_bounds

LENGTH = 4096
STEP = 32
DIMS, BITS = 4, 10
#: Tokens in one range of the curve: what a single task packs.
RANGE = 1 << 21
END = 2
CACHE_WORDS = 500_000


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ------------------------------------------------------------------ tokens


class CachedTokenizer:
    """Ids of many whole texts at once, through a hash table of the units they are made of.

    The tokenizer's pattern never matches across white space, and its special strings hold none, so a text's ids are
    the ids of its chunks in order. A chunk of letters that ends in one, with ASCII punctuation behind, is in turn the
    ids of its lower-cased letters, then of the punctuation. Any other chunk is a unit as it stands. Units are found,
    hashed and looked up in numpy; only new ones become Python objects, and the tokenizer encodes many of them at a
    time between a separator whose single id no unit has. Keys are 64-bit hashes: with at most ``limit`` units in the
    table, odds of a false hit are limit / 2**64 a new unit. The table is bounded and starts anew when full.
    """

    SEPARATOR = " ~ "

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tok, self._limit = Tokenizer.from_file(path), limit
        mark = self._raw("~")
        self._mark = mark[0] if len(mark) == 1 and self._raw("a ~ b") == [*self._raw("a"), mark[0], *self._raw("b")] else None
        self._clear(1 << 12)

    def _raw(self, text: str) -> list[int]:
        return self._tok.encode(text, add_special_tokens=False).ids

    def _clear(self, slots: int) -> None:
        self._keys, self._at, self._len = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self._ids, self._used, self._size = np.zeros(slots, np.uint32), 0, 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1."""
        last, keys = np.int64(len(self._keys) - 1), self._keys
        at, out, live = (h & np.uint64(last)).astype(np.int64), np.full(len(h), -1, np.int64), np.arange(len(h))
        while len(live):
            held = keys[at[live]]
            hit = held == h[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit & (held != 0)]
            at[live] = (at[live] + 1) & last
        return out

    def _insert(self, h: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """Distinct keys that are not in the table."""
        last, keys = np.int64(len(self._keys) - 1), self._keys
        at, live = (h & np.uint64(last)).astype(np.int64), np.arange(len(h))
        while len(live):
            free = live[keys[at[live]] == 0]
            keys[at[free]] = h[free]
            live = live[keys[at[live]] != h[live]]
            at[live] = (at[live] + 1) & last
        self._at[at], self._len[at] = start, length
        self._size += len(h)

    def _room(self, more: int) -> None:
        """The table at most half full: grown, or emptied once it is at its limit."""
        slots = len(self._keys)
        if self._size + more > self._limit:
            self._clear(max(1 << 12, 1 << (2 * more - 1).bit_length()))
        elif 2 * (self._size + more) > slots:
            full = np.flatnonzero(self._keys)
            old, ids, used = (self._keys[full], self._at[full], self._len[full]), self._ids, self._used
            self._clear(min(1 << (4 * (self._size + more) - 1).bit_length(), 1 << (2 * max(self._limit, self._size + more) - 1).bit_length()))
            self._ids, self._used = ids, used
            self._insert(*old)

    def _learn(self, units: list[bytes], h: np.ndarray) -> None:
        self._room(len(units))
        found = []
        for lo in range(0, len(units), 500):
            part = [u.decode() for u in units[lo : lo + 500]]
            ids = np.array(self._raw(self.SEPARATOR.join(part)), np.uint32) if self._mark is not None and not any("~" in u for u in part) else None
            if ids is not None and (ids == self._mark).sum() == len(part) - 1:
                cuts = np.r_[-1, np.flatnonzero(ids == self._mark), len(ids)]
                found.append((ids[ids != self._mark], np.diff(cuts) - 1))
            else:
                each = [self._raw(u) for u in part]
                found.append((np.array([x for e in each for x in e], np.uint32), np.array([len(e) for e in each])))
        new, length = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        while self._used + len(new) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros(len(self._ids), np.uint32)])
        self._ids[self._used : self._used + len(new)] = new
        self._insert(h, self._used + np.cumsum(length) - length, length)
        self._used += len(new)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and bounds: those of text i are bounds[i] to bounds[i + 1]."""
        raw, offsets = join_texts([t.encode() for t in texts])
        low = LOWER[raw]
        start, size = word_bounds(raw)
        letters = np.r_[0, np.cumsum(_LETTER[raw])]
        marks = np.r_[0, np.cumsum(_MARK[raw])]
        stop = start + size
        n_letters, n_marks = letters[stop] - letters[start], marks[stop] - marks[start]
        end = raw[start + n_letters - 1]
        latin = (raw[start + n_letters - 2] == 0xC3) & (end >= 0x80) & (end != 0x97) & (end != 0xB7)  # two-byte letters but for two signs
        plain = (n_letters > 0) & (n_letters + n_marks == size) & (letters[start + n_letters] - letters[start] == n_letters)
        plain &= (n_marks == 0) | (end < 0x80) | latin
        tail = plain & (n_marks > 0)
        count = 1 + tail
        chunk = np.repeat(np.arange(len(start)), count)
        first = np.cumsum(count) - count
        at, length, whole = start[chunk], size[chunk], ~plain[chunk]
        t = np.flatnonzero(tail)
        length[first[t]] = n_letters[t]
        at[first[t] + 1] += n_letters[t]
        length[first[t] + 1] = n_marks[t]
        h = run_hashes(low, at, length, seed=5)
        w = np.flatnonzero(whole)
        h[w] = run_hashes(raw, at[w], length[w], seed=6)
        h[h == 0] = 1
        slot = self._find(h)
        if (slot < 0).any():
            new, where = np.unique(h[slot < 0], return_index=True)
            where = np.flatnonzero(slot < 0)[where]
            if self._size + len(new) > self._limit:  # the table starts anew, with every unit of these texts
                new, where = np.unique(h, return_index=True)
            source = raw.tobytes()
            self._learn([source[a : a + n] for a, n in zip(at[where].tolist(), length[where].tolist(), strict=True)], new)
            slot = self._find(h)
        begin, n = self._at[slot].astype(np.int64), self._len[slot].astype(np.int64)
        stops = np.cumsum(n)
        total = int(stops[-1]) if len(stops) else 0
        ids = self._ids[np.repeat(begin - stops + n, n) + np.arange(total)]
        return ids, np.r_[0, stops][np.searchsorted(at, offsets)]


#: Letters (any byte above ASCII for now), and ASCII punctuation without the separator.
_LETTER, _MARK = np.zeros(256, np.int64), np.zeros(256, np.int64)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = 1
_MARK[[c for c in range(0x21, 0x7E) if not chr(c).isalnum()]] = 1
_tokenizers: dict[str, CachedTokenizer] = {}


def worker_tokenizer(path: str) -> CachedTokenizer:
    """One per worker process, kept between tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = CachedTokenizer(path)
    return _tokenizers[path]


# ------------------------------------------------------------------ the curve


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows) with ``bits`` bits per axis: axes to transpose form, then interleave."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            on = (x[i] & q) != 0
            low = (x[0] ^ x[i]) & (q - 1)
            x[0] = np.where(on, x[0] ^ (q - 1), x[0] ^ low)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ low)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def projection(vocab: int, dims: int = DIMS) -> np.ndarray:
    """A fixed random direction for each token id (ids beyond ``vocab`` wrap around)."""
    return np.random.default_rng(20_240_601).standard_normal((vocab, dims)).astype(np.float32)


def curve_keys(ids: np.ndarray, bounds: np.ndarray, table: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert key of each document: the mean projection of its tokens, scaled to unit direction, on a grid."""
    out = np.zeros((len(bounds) - 1, table.shape[1]))
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        sums = np.add.reduceat(table[ids % np.uint32(len(table))], bounds[full], axis=0)
        out[full] = sums / np.maximum(1e-9, np.linalg.norm(sums, axis=1, keepdims=True))
    grid = np.clip(((out + 1) / 2 * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
    return hilbert(grid, bits)


# ------------------------------------------------------------------ CRC-32 of a piece from running CRCs


def _shift_tables(step_bytes: int, levels: int = 24) -> list[list[int]]:
    """Operators that advance a CRC register over step_bytes * 2**j zero bytes, as 32 columns each."""

    def apply(m: list[int], v: int) -> int:
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v >>= 1
            i += 1
        return out

    bit = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    m = bit
    n = 8 * step_bytes
    acc = [1 << i for i in range(32)]
    while n:
        if n & 1:
            acc = [apply(m, x) for x in acc]
        m = [apply(m, x) for x in m]
        n >>= 1
    out = [acc]
    for _ in range(levels - 1):
        out.append([apply(out[-1], x) for x in out[-1]])
    return out


class PieceCrc:
    def __init__(self, step: int = STEP):
        self._steps, self._tokens = _shift_tables(4 * step), _shift_tables(4)
        self._step = step

    def _shift(self, crc: int, tables: list[list[int]], n: int) -> int:
        j = 0
        while n:
            if n & 1:
                m, v, out = tables[j], crc, 0
                i = 0
                while v:
                    if v & 1:
                        out ^= m[i]
                    v >>= 1
                    i += 1
                crc = out
            n >>= 1
            j += 1
        return crc

    def of(self, crc_start: int, crc_end: int, tokens: int) -> int:
        """CRC of a stretch of ``tokens`` ids between two running CRCs of the document."""
        x = self._shift(crc_start, self._steps, tokens // self._step)
        return self._shift(x, self._tokens, tokens % self._step) ^ crc_end


def running_crcs(data: bytes, step: int = STEP) -> np.ndarray:
    """CRC-32 of the first step, 2 * step, ... ids and of all of them."""
    view, out, crc = memoryview(data), [], 0
    for i in range(0, len(data), 4 * step):
        crc = zlib.crc32(view[i : i + 4 * step], crc)
        out.append(crc)
    return np.array(out, dtype="<u4")


# ------------------------------------------------------------------ the operator


def _measure(path: str, end: int, step: int, dims: int, bits: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = worker_tokenizer(path)
        table = projection(1 << 16, dims)
        tail = np.array([end], dtype="<u4").tobytes()
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                ids, bounds = tok.encode(part["text"].tolist())
                raw = ids.astype("<u4", copy=False).tobytes()
                crcs = [running_crcs(raw[4 * a : 4 * b] + tail, step).tobytes() for a, b in pairwise(bounds.tolist())]
                yield pd.DataFrame({"id": part["id"], "key": curve_keys(ids, bounds, table, bits), "n": np.diff(bounds) + 1, "crcs": crcs})

    return tidy(run)


def _pack(length: int, step: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        sequence, used = TaskContext.get().partitionId() << 40, 0
        crc = PieceCrc(step)
        for pdf in batches:
            out: list[tuple] = []
            for doc, n, raw in zip(pdf["id"], pdf["n"].tolist(), pdf["crcs"], strict=True):
                marks, start = np.frombuffer(raw, "<u4"), 0
                while start < n:
                    free, left = length - used, n - start
                    take = left if left <= free else free // step * step
                    if take == 0:
                        sequence, used = sequence + 1, 0
                        continue
                    stop = start + take
                    last = int(marks[-(-stop // step) - 1])
                    value = crc.of(int(marks[start // step - 1]), last, take) if start else last
                    out.append((doc, start, take, value, n, sequence, used))
                    start, used = stop, used + take
                    if used == length:
                        sequence, used = sequence + 1, 0
            yield pd.DataFrame(out, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return tidy(run)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, tokenizer: str | None = None, end: int = END, step: int = STEP, dims: int = DIMS, bits: int = BITS, range_tokens: int = RANGE) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("text"))
    narrow = rows.mapInPandas(_measure(tokenizer or word_bpe_path(), end, step, dims, bits), "id string, key long, n long, crcs binary")
    with small_batches(spark):
        narrow = stored(narrow.withColumn("id", F.col("id").cast(kind)), "pack-lengths")
    total = narrow.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(1, total // range_tokens)
    ordered = narrow.repartitionByRange(ranges, "key", F.col("id").asc_nulls_first()) if ranges > 1 else narrow.repartition(1)
    ordered = ordered.sortWithinPartitions("key", F.col("id").asc_nulls_first(), "n", "crcs")
    out = ordered.withColumn("id", F.col("id").cast("string")).mapInPandas(_pack(length, step), "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.select(F.col("id").cast(kind).alias(id_col), *out.columns[1:])


def sequences(pieces: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = END) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids array<int>. Joins the plan to the texts by id (unique ids)."""
    path = tokenizer or word_bpe_path()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = worker_tokenizer(path)
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                ids, bounds = tok.encode(part["text"].tolist())
                yield pd.DataFrame({"id": part["id"], "ids": [[*ids[a:b].tolist(), end] for a, b in pairwise(bounds.tolist())]})

    ids = docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("text")).mapInPandas(encode, "id string, ids array<int>")
    cut = pieces.join(ids, pieces[id_col].cast("string").eqNullSafe(ids["id"])).select("sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias(f"{P}ids"))
    each = cut.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", f"{P}ids"))).alias(f"{P}all"))
    return each.select("sequence_id", F.flatten(F.transform(f"{P}all", lambda x: x[f"{P}ids"])).alias("ids"))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 4096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
