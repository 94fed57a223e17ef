"""N-gram Jaccard self-join: a size-aware heavy-light join over sets of word shingles.

Light sets, up to a size B, are joined on fixed-size subsets: two sets with an overlap of c share a subset of size c,
so each light set enumerates its subsets of every size an allowed partner can overlap in. Large sets scan inverted
lists. B is the largest size at which enumerating costs no more than the list entries of a set, times SCAN; see
:class:`Plan`. Sets near B take part in both, so pairs across B are met.

A large set of n shingles is on the lists of its n - ceil(tn) + 1 first shingles in one order of all shingles, rare
ones first: two sets with a Jaccard of t or more always share one of those. The order is (level, hash); a shingle's
level is the logarithm of its count over all documents, from a count-min sketch of half a byte a cell, 64 MiB at most. So
common passages come last and their lists stay empty unless a set holds little else. A shingle that the sketch counts
once is in one set only and gets no list; a set with n - ceil(tn) + 1 of those can't be linked and ends there.
Wrong estimates change the order alone, which is the same for all sets, so no linked pair is lost.

Equal sets are one node from the start (one per task before the shuffle). In the first round a node is held against
one centre of its lists; links give components, and only lists that still hold several components are looked at again.
Short lists are then paired off. Long ones that share their least component go together, as near copies share many
lists: each member once, so a pair is met once and not on each list (see :func:`_together`). They are compared block
against block by sketch, and of the pairs that may be linked only a spanning forest, the closest first, leaves a task:
no more than the block has members, however many members are linked. Forests are verified and components joined, twice; in the end come the pairs between components
that are still different, which is the exact way for what is left. Links inside a component need no test: the result
is components.

Scale: texts are read three times and never shuffled. Counts leave a task as 2 to 3 bytes a shingle; list entries are
what the order leaves. Nodes come back to the last scan as a bitmap of 8 MiB at most. What a list says of itself (size,
labels, centre) is an aggregate with map-side combine, joined back from a stored table, so a list with a third of all
sets is split. Pairs are held against sizes, positions (what can still overlap behind the shared shingle) and sketches
of a byte a shingle (256 to 2,048), whose differing bytes bound the difference of the sets from below, before whole sets move.

Shingles are 64-bit hashes of 64-bit word hashes: within a pair of n shingles a false match has odds of n * n / 2**64.
Equal sets are recognised by 128 bits.

Defined results: null text, empty text and text without words are empty sets, linked with nothing; fewer words than
a shingle make one shingle; rows that repeat an id with another text are documents of their own; repeated rows are
equal sets and share a component; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, forget, gram_hashes, in_bitmap, mix, position, shuffles, small_batches, stored, text_or_empty, tidy
from .components import components
from .words import text_words

SCAN = 10
#: Lists with at most so many pairs a row on average are tested pair by pair at once.
STAR = 64
ROUNDS = 3
#: Bytes of a sketch: as many as the set has shingles, within these.
PARTS, WIDE = 256, 2048
#: Lists up to SMALL are paired by a join; longer ones in blocks of CELL members.
SMALL, CELL = 16, 2048
BITS = 1 << 26
#: Documents handled together, sets a task remembers.
BLOCK, SEEN = 400, 100_000
#: Cells of the count sketch: at most 2**27, half a byte each; sent in chunks.
MAX_CELLS, CHUNK, FOLD = 1 << 27, 1 << 16, 1 << 21


class Plan:
    """Sizes and the light-heavy boundary for Jaccard >= num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.light = num, den, 0
        while self.light_cost(self.light + 1) <= SCAN * self.lists(self.light + 1):
            self.light += 1
        #: The smallest partner of a set above the boundary: sets from here on scan lists.
        self.heavy_from = max(1, self.overlap(self.light + 1))

    def overlap(self, n: int) -> int:
        """The least overlap of a set of n with a linked set."""
        return -(-self.num * n // self.den)

    def lists(self, n: int) -> int:
        return n - self.overlap(n) + 1

    def subsets(self, n: int) -> range:
        """Sizes of the overlap of a set of n with any linked set, of those up to n."""
        return range(max(1, self.overlap(n)), n + 1)

    def light_cost(self, n: int) -> int:
        return sum(comb(n, c) for c in self.subsets(n))


# ------------------------------------------------------------------ shingles and their counts


def shingles(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, text by text and with repeats, and the number of the text each belongs to."""
    words, bounds = text_words([t.encode() for t in texts], lower=True)
    counts = np.diff(bounds)
    of_word = np.repeat(np.arange(len(texts)), counts)
    h = gram_hashes(words, k, seed=4)
    inside = of_word[: len(h)] == of_word[k - 1 :] if len(h) else np.zeros(0, bool)
    h, owner = h[inside], of_word[: len(inside)][inside]
    parts, owners = [h], [owner]
    for c in range(1, k):
        few = np.flatnonzero(counts == c)
        if len(few):
            parts.append(gram_hashes(words, c, seed=4)[bounds[few]])
            owners.append(few)
    if len(parts) > 1:
        h, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    return h, owner


def _count(k: int, cells: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """chunk, cells hit once, cells hit more, and how often (255 at most): partial counts, FOLD shingles at a time."""

    def fold(parts: list[np.ndarray]) -> pd.DataFrame:
        at = np.sort(np.concatenate(parts))
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        n, at = np.diff(np.r_[first, len(at)]), at[first]
        chunks = at // np.uint32(CHUNK)
        cuts = np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1]])
        off, out = (at % np.uint32(CHUNK)).astype("<u2"), []
        for lo, hi in zip(cuts, [*cuts[1:], len(at)], strict=True):
            more = n[lo:hi] > 1
            out.append((int(chunks[lo]), off[lo:hi][~more].tobytes(), off[lo:hi][more].tobytes(), np.minimum(n[lo:hi][more], 255).astype(np.uint8).tobytes()))
        return pd.DataFrame(out, columns=["chunk", "once", "more", "times"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for pdf in batches:
            for lo in range(0, len(pdf), BLOCK):
                h, _ = shingles(pdf["text"].iloc[lo : lo + BLOCK].tolist(), k)
                if len(h):
                    parts.append((h & np.uint64(cells - 1)).astype(np.uint32))
                    size += len(h)
                if size > FOLD:
                    yield fold(parts)
                    parts, size = [], 0
        if parts:
            yield fold(parts)

    return tidy(run)


def _levels(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    count = np.zeros(CHUNK, np.int64)
    for pdf in parts:
        for once, more, times in zip(pdf["once"], pdf["more"], pdf["times"], strict=True):
            count[np.frombuffer(once, "<u2")] += 1
            count[np.frombuffer(more, "<u2")] += np.frombuffer(times, np.uint8)
    if (count > 1).any():
        level = np.minimum(15, np.ceil(np.log2(np.maximum(count, 1)))).astype(np.uint8)
        yield pd.DataFrame({"chunk": [key[0]], "levels": [(level[::2] | level[1::2] << 4).tobytes()]})


def count_levels(as_text: DataFrame, k: int, size: int) -> tuple[int, bytes]:
    """Cells of the sketch, and the level of each: 0 where at most one shingle falls, else the logarithm of the count."""
    cells = CHUNK
    while cells < MAX_CELLS and cells < size // 6:
        cells *= 2
    counted = as_text.select("text").mapInPandas(_count(k, cells), "chunk long, once binary, more binary, times binary")
    out, step = np.zeros(cells // 2, np.uint8), CHUNK // 2
    for r in counted.groupBy("chunk").applyInPandas(_levels, "chunk long, levels binary").toLocalIterator():
        out[r["chunk"] * step : (r["chunk"] + 1) * step] = np.frombuffer(bytes(r["levels"]), np.uint8)
    return cells, out.tobytes()


def level_of(h: np.ndarray, levels: np.ndarray, cells: int) -> np.ndarray:
    at = (h & np.uint64(cells - 1)).astype(np.int64)
    return levels[at >> 1] >> ((at & 1) << 2).astype(np.uint8) & 15


# ------------------------------------------------------------------ sets and list keys


def distinct(h: np.ndarray, owner: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Mask that leaves each text's shingles once. Only those in ``repeated`` can occur twice."""
    at = np.flatnonzero(repeated)
    at = at[np.lexsort((h[at], owner[at]))]
    keep = np.ones(len(h), bool)
    keep[at[1:][(h[at[1:]] == h[at[:-1]]) & (owner[at[1:]] == owner[at[:-1]])]] = False
    return keep


def light_keys(s: np.ndarray, plan: Plan) -> np.ndarray:
    """Hashes of the subsets of every size in plan.subsets: sums over the set less what is left out."""
    m = mix(s ^ np.uint64(0x5851F42D4C957F2D))
    total, out = m.sum(dtype=np.uint64), []
    for c in plan.subsets(len(s)):
        gone = len(s) - c
        sums = np.array([[total]], np.uint64) if not gone else None
        if sums is None:
            sums = total - m[np.array(list(combinations(range(len(s)), gone)))].sum(axis=1, dtype=np.uint64)
        out.append(mix(sums.ravel() + np.uint64(c)))
    return np.concatenate(out)


def list_keys(s: np.ndarray, level: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set's lists, and the place of each list's shingle in the set's order (0 for subsets)."""
    keys, places = [], []
    if len(s) <= plan.light:
        keys.append(light_keys(s, plan))
        places.append(np.zeros(len(keys[0]), np.int64))
    if len(s) >= plan.heavy_from:
        first = np.lexsort((s, level))[: plan.lists(len(s))]
        place = np.flatnonzero(level[first] > 0)
        keys.append(mix(s[first[place]] ^ np.uint64(0xD1342543DE82EF95)))
        places.append(place)
    return np.concatenate(keys), np.concatenate(places)


def sketch(s: np.ndarray) -> bytes:
    """One byte for each of PARTS hash classes, or of twice as many until they are no fewer than shingles (WIDE at most): a
    sum over the class's shingles. Sets whose sketches differ in d bytes differ in d shingles at least, so the count of
    differing bytes rules pairs out and never a linked one; with fewer classes than shingles it would soon rule out none."""
    m, size = mix(s ^ np.uint64(0x2545F4914F6CDD1D)), PARTS
    while size < min(len(s), WIDE):
        size *= 2
    at = (m % np.uint64(size)).astype(np.int64)
    return np.bincount(at, ((m >> np.uint64(32)) | np.uint64(1)).astype(np.uint8), size).astype(np.int64).astype(np.uint8).tobytes()


def _folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches of one width as rows of a smaller one: its classes are unions of theirs."""
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1, width).sum(axis=1, dtype=np.uint8)


def _differing(x: pd.Series, y: pd.Series) -> pd.Series:
    x, y = x.tolist(), y.tolist()
    widths, out = np.array([[len(a), len(b)] for a, b in zip(x, y, strict=True)], np.int64).reshape(-1, 2), np.zeros(len(x), np.int64)
    for p, q in np.unique(widths, axis=0).tolist():
        at = np.flatnonzero((widths == (p, q)).all(axis=1)).tolist()
        out[at] = (_folded([x[i] for i in at], min(p, q)) != _folded([y[i] for i in at], min(p, q))).sum(axis=1)
    return pd.Series(out)


class _Sketches:
    """Sketches of a block's members, at each width that a comparison needs."""

    def __init__(self, sketches: list[bytes]):
        self.width = np.array([len(b) for b in sketches], np.int64)
        self.raw, self.at = sketches, {}

    def rows(self, places: np.ndarray, width: int) -> np.ndarray:
        """Those of ``places``, whose own width is no smaller, at ``width``."""
        if width not in self.at:
            full = np.zeros((len(self.raw), width), np.uint8)
            for own in np.unique(self.width[self.width >= width]).tolist():
                of = np.flatnonzero(self.width == own)
                full[of] = _folded([self.raw[i] for i in of.tolist()], width)
            self.at[width] = full
        return self.at[width][places]


def _first_pass(k: int, num: int, den: int, cells: int, shared) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """id, th, n for every text; marks for sets without a shingle of their own; keys and places of sets that may be linked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan, seen, levels = Plan(num, den), set(), np.frombuffer(shared.value, np.uint8)
        for pdf in batches:
            for lo in range(0, len(pdf), BLOCK):
                part = pdf.iloc[lo : lo + BLOCK]
                h, owner = shingles(part["text"].tolist(), k)
                level = level_of(h, levels, cells)
                keep = distinct(h, owner, level > 0)
                h, owner, level = h[keep], owner[keep], level[keep]
                n = np.bincount(owner, minlength=len(part))
                alone = np.bincount(owner[level == 0], minlength=len(part))
                bounds = np.r_[0, np.cumsum(n)]
                s1, s2, keys, places = ([None] * len(part) for _ in range(4))
                for i in np.flatnonzero((n > 0) & (alone < n + 1 + (-num * n) // den)).tolist():
                    s, lv = h[bounds[i] : bounds[i + 1]], level[bounds[i] : bounds[i + 1]]
                    if not alone[i]:
                        s1[i] = int(mix(s).sum(dtype=np.uint64).view(np.int64))
                        s2[i] = int(mix(s ^ np.uint64(0xA24BAED4963EE407)).sum(dtype=np.uint64).view(np.int64))
                        if (s1[i], s2[i]) in seen:
                            continue
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add((s1[i], s2[i]))
                    x, at = list_keys(s, lv, plan)
                    if len(x):
                        keys[i], places[i] = x.view(np.int64), at.astype(np.int32)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "th": part["th"].to_numpy(), "n": n, "s1": pd.array(s1, "Int64"), "s2": pd.array(s2, "Int64"), "keys": keys, "places": places})

    return tidy(run)


def _sets(k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), BLOCK):
                part = pdf.iloc[lo : lo + BLOCK]
                h, owner = shingles(part["text"].tolist(), k)
                cut = np.searchsorted(owner, np.arange(1, len(part)))
                sets = [np.unique(x) for x in np.split(h, cut)]
                yield pd.DataFrame({"id": part["id"], "th": part["th"], "set": [s.view(np.int64) for s in sets], "sketch": [sketch(s) for s in sets]})

    return tidy(run)


# ------------------------------------------------------------------ the join


def _sizes_fit(a: str, b: str, num: int, den: int) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _possible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that sizes and sketches don't rule out."""
    one = sets.select(F.col("node").alias("a"), F.size("set").alias("na"), F.col("sketch").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.size("set").alias("nb"), F.col("sketch").alias("y"))
    both = pairs.join(one, "a").join(two, "b").filter(_sizes_fit("na", "nb", num, den))
    differ = F.pandas_udf(_differing, "long")
    return both.filter(differ("x", "y") * (den + num) <= (F.col("na") + F.col("nb")) * (den - num)).select(*pairs.columns)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b) with den * |A n B| >= num * |A u B|."""
    one = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(two, "b").withColumn("c", both).filter(F.col("c") * (den + num) >= num * (F.size("x") + F.size("y"))).select(*pairs.columns)


def forest(x: np.ndarray, y: np.ndarray, far: np.ndarray) -> list[int]:
    """Which of the edges (x, y) a spanning forest keeps, those with the least ``far`` first."""
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while (w := up.get(v, v)) != v:
            up[v] = v = up.get(w, w)
        return v

    x, y, kept = x.tolist(), y.tolist(), []
    for at in np.argsort(far, kind="stable").tolist():
        a, b = root(x[at]), root(y[at])
        if a != b:
            up[a] = b
            kept.append(at)
    return kept


def _compare(num: int, den: int, every: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows by (key, i, j): two blocks of one list. Gives the pairs across labels that sizes, places and sketches leave:
    every one, or a spanning forest of the labels."""

    def close(rows: list[tuple]) -> pd.DataFrame:
        part = pd.DataFrame(rows, columns=["block", "i", "j", "id", "th", "label", "n", "place", "sketch"])
        own = part["i"].iloc[0] == part["j"].iloc[0]
        sides = [part[part["block"] == b] for b in (part["i"].iloc[0], part["j"].iloc[0])]
        bits = [_Sketches(x["sketch"].tolist()) for x in sides]
        n, place = ([x[c].to_numpy(np.int64) for x in sides] for c in ("n", "place"))
        labels = pd.factorize(pd.concat([sides[0]["label"], sides[1]["label"]]))[0]
        la, lb = labels[: len(n[0])], labels[len(n[0]) :]
        left, right, far = ([np.zeros(0, np.int64)] for _ in range(3))
        for x in range(len(n[0])):
            both = n[1] + n[0][x]
            ok = (lb != la[x]) & (np.minimum(n[1], n[0][x]) * den >= np.maximum(n[1], n[0][x]) * num)
            ok &= np.minimum(n[1] - place[1], n[0][x] - place[0][x]) * (den + num) >= num * both
            if own:
                ok[: x + 1] = False
            at = np.flatnonzero(ok)
            if len(at):
                width, differ = np.minimum(bits[1].width[at], bits[0].width[x]), np.zeros(len(at), np.int64)
                for w in np.unique(width).tolist():
                    of = np.flatnonzero(width == w)
                    differ[of] = (bits[1].rows(at[of], w) != bits[0].rows(np.array([x]), w)).sum(axis=1)
                near = differ * (den + num) <= both[at] * (den - num)
                left.append(np.full(int(near.sum()), x))
                right.append(at[near])
                far.append(differ[near] / both[at[near]])
        left, right, far = np.concatenate(left), np.concatenate(right), np.concatenate(far)
        if not every:
            kept = forest(la[left], lb[right], far)
            left, right = left[kept], right[kept]
        one, two = sides[0].iloc[left], sides[1].iloc[right]
        return pd.DataFrame({"a_id": one["id"].to_numpy(), "a_th": one["th"].to_numpy(), "b_id": two["id"].to_numpy(), "b_th": two["th"].to_numpy()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for pdf in batches:
            for row in zip(pdf["key"].tolist(), pdf["i"].tolist(), pdf["j"].tolist(), pdf["block"].tolist(), pdf["id"], pdf["th"].tolist(), pdf["label"], pdf["n"].tolist(), pdf["place"].tolist(), pdf["sketch"], strict=True):
                if row[:3] != at:
                    if held:
                        yield close(held)
                    at, held = row[:3], []
                held.append((row[3], row[1], row[2], *row[4:]))
        if held:
            yield close(held)

    return tidy(run)


def _label(col: str) -> Column:
    return F.concat_ws(":", F.col(f"{col}.id").cast("string"), F.col(f"{col}.th").cast("string"))


def _together(rows: DataFrame, heads: DataFrame, cell: int) -> tuple[DataFrame, DataFrame]:
    """Long lists with one least label as one list of their distinct members, where comparing that in blocks moves no more
    rows than the lists apart; else the lists as they are. rows: key, node, label, m, n, place, lo; heads: key, m, lo.
    Gives key (text), node, label, m, n, place, and the table to forget after use.

    A member's place is its least on these lists, so what a pair can still overlap is never put too low. Where lists stay
    apart, they hold fewer than blocks times members, so on average a pair is met on fewer lists than there are blocks.
    """
    moved = lambda m: F.col(m) * F.ceil(F.col(m) / cell)
    members = stored(rows.groupBy(_label("lo").alias("lo"), "node").agg(F.min("label").alias("label"), F.min("n").alias("n"), F.min("place").alias("place")), "members")
    apart = heads.groupBy(_label("lo").alias("lo")).agg(F.sum(moved("m")).alias("apart"))
    sizes = members.groupBy("lo").agg(F.count("*").alias("m")).join(apart, "lo").filter(moved("m") <= F.col("apart")).select("lo", "m")
    out = ["key", "node", "label", "m", "n", "place"]
    one = members.join(sizes, "lo").withColumnRenamed("lo", "key").select(*out)
    rest = rows.withColumn("lo", _label("lo")).join(sizes.select("lo"), "lo", "left_anti").withColumn("key", F.concat(F.lit("list "), F.col("key").cast("string")))
    return one.unionByName(rest.select(*out)), members


def _large_lists(rows: DataFrame, kind: str, num: int, den: int, cell: int, every: bool) -> DataFrame:
    """Pairs (a, b) of long lists that may be linked, or a spanning forest of them for each two blocks. rows: key, node,
    label, m, n, place, sketch.

    A list is cut into blocks of about ``cell`` members and each pair of blocks is compared in one place, by sketch;
    only pairs that pass leave it, so what moves in grows with members times blocks and not with pairs.
    """
    blocks = F.ceil(F.col("m") / cell).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    cells = rows.withColumn("block", own).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = cells.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", F.col("node.id").cast("string").alias("id"), F.col("node.th").alias("th"), _label("label").alias("label"), "n", "place", "sketch")
    cells = cells.repartition(max(8, shuffles(rows.sparkSession)), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    out = cells.mapInPandas(_compare(num, den, every), "a_id string, a_th long, b_id string, b_th long")
    return out.select(*[F.struct(F.col(f"{x}_id").cast(kind).alias("id"), F.col(f"{x}_th").alias("th")).alias(x) for x in "ab"])


def _pairs(rows: DataFrame, one: Column, two: Column) -> DataFrame:
    return rows.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).filter("a < b").distinct()


def _nodes(rows: DataFrame, equal: DataFrame) -> DataFrame:
    """``rows`` with node: the least row of an equal set, or the row itself. Rows without marks don't meet the join."""
    lone = rows.filter("s1 is null").withColumn("node", F.col("row"))
    same = rows.filter("s1 is not null").join(equal, ["s1", "s2", "n"], "left").withColumn("node", F.coalesce("first", "row"))
    return lone.unionByName(same.select(*lone.columns))


def _linked(lists: DataFrame, sets: DataFrame, kind: str, num: int, den: int, small: int, cell: int) -> DataFrame | None:
    """All links that components need, as (a, b). lists: key, node, n, place, stored; forgotten at the end."""
    found: list[DataFrame] = []
    tested: list[DataFrame] = []
    open_ = lists.withColumn("label", F.col("node"))
    for t in range(ROUNDS + 1):
        order = F.struct(F.col("node").alias("node"), F.col("n").alias("n"), F.col("label").alias("label"))
        heads = open_.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(order).alias("c"))
        heads = stored(heads.filter("lo < hi").drop("hi"), "heads")
        lists_left, pairs_left, rows_left = heads.agg(F.count("*"), F.coalesce(F.sum(F.col("m") * (F.col("m") - 1) / 2), F.lit(0.0)), F.coalesce(F.sum("m"), F.lit(0))).first()
        if not lists_left:
            forget(heads)
            break
        # links inside a component are many and need no test, so a round around centres always comes first
        last = t == ROUNDS or (t > 0 and pairs_left <= STAR * rows_left)
        members = None
        kept = open_.join(heads, "key")
        if not t:
            # one centre for each node, the least on any of its lists: no more pairs are tested than there are nodes
            star = kept.filter((F.col("label") != F.col("c.label")) & _sizes_fit("n", "c.n", num, den))
            star = star.groupBy("node").agg(F.min(F.struct("c", "label")).alias("x"))
            pairs = _pairs(star, F.col("node"), F.col("x.c.node"))
        else:
            few = kept.filter(F.col("m") <= small).select("key", "node", "n", "place", "label")
            other = few.select("key", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.col("label").alias("label2"))
            room = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) * (den + num) >= (F.col("n") + F.col("n2")) * num
            pairs = _pairs(few.join(other, "key").filter((F.col("label") < F.col("label2")) & _sizes_fit("n", "n2", num, den) & room), F.col("node"), F.col("node2"))
            many, members = _together(kept.filter(F.col("m") > small).drop("c"), heads.filter(F.col("m") > small), cell)
            many = many.join(sets.select("node", "sketch"), "node")
            pairs = pairs.union(_pairs(_large_lists(many, kind, num, den, cell, last), F.col("a"), F.col("b"))).distinct()
        for before in tested:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        forget(*([members] if members is not None else []))
        tested.append(pairs)
        # a first round meets most sets; later ones few, so that sets outside the pairs stay where they are
        bitmap = bitmap_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), position(BITS, "node")) if t else None
        near = in_bitmap(sets, position(BITS, "node"), bitmap, "met").filter("met").drop("met") if t else sets
        links = stored(_verified(_possible(pairs, near, num, den) if t else pairs, near, num, den), "links")
        if t:
            forget(bitmap)
        found.append(links)
        if last:
            forget(heads)
            break
        # after the first round a linked node takes its centre's label, and that of the centre's centre: nodes of one label
        # are connected, and where connected nodes keep two labels, they are only looked at again. Later the labels that
        # links join become one, and short lists are done with.
        after = kept.drop("c", "m", "lo") if not t else kept.filter(F.col("m") > small).drop("c", "m", "lo")
        if t and links.limit(1).count():
            of = kept.select("node", "label").distinct()
            joined = links.join(of.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(of.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
            names = components(joined.select(F.col("la").alias("a"), F.col("lb").alias("b")))
            after = after.join(names.select(F.col("node").alias("label"), F.col("label").alias("name")), "label", "left").withColumn("label", F.coalesce("name", "label"))
            after = stored(after.select("key", "node", "n", "place", "label"), "open")
            forget(names)
        elif links.limit(1).count():
            parent = star.select("node", F.col("x.c.node").alias("via"), F.col("x.c.label").alias("to"))
            tree = parent.join(links.select(F.col("a").alias("x"), F.col("b").alias("y")), (F.least("node", "via") == F.col("x")) & (F.greatest("node", "via") == F.col("y"))).select("node", "via", "to")
            tree = stored(tree, "tree")
            up = tree.select(F.col("node").alias("via"), F.col("to").alias("far"))
            names = tree.join(up, "via", "left").select("node", F.coalesce("far", "to").alias("name"))
            after = after.join(names, "node", "left").withColumn("label", F.coalesce("name", "label"))
            after = stored(after.select("key", "node", "n", "place", "label"), "open")
            forget(tree)
        else:
            after = stored(after.select("key", "node", "n", "place", "label"), "open")
        forget(heads, *([open_] if t else []))
        open_ = after
    forget(*tested, *([open_] if hasattr(open_, "_qs_path") else []))
    out = None
    for x in found:
        out = x if out is None else out.union(x)
    return out


def ngram_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, small: int = SMALL, cell: int = CELL) -> DataFrame:
    """row struct(id, th), n, node, label for every row, th being xxhash64 of the text. label is the least row reachable
    over links of Jaccard >= num / den; node stands for all rows of an equal set."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    as_text = base.withColumn("id", F.col("id").cast("string"))
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    with small_batches(spark):
        cells, levels = count_levels(as_text, k, size)
    shared = spark.sparkContext.broadcast(levels)
    first = as_text.mapInPandas(_first_pass(k, num, den, cells, shared), "id string, th long, n long, s1 long, s2 long, keys array<long>, places array<int>")
    first = first.select(F.struct(F.col("id").cast(kind).alias("id"), "th").alias("row"), "n", "s1", "s2", "keys", "places")
    with small_batches(spark):
        first = stored(first, "sets")

    equal = first.filter("s1 is not null").groupBy("s1", "s2", "n").agg(F.min("row").alias("first"), F.count("*").alias("m")).filter("m > 1").drop("m")
    equal = stored(equal, "equal")
    rows = _nodes(first.select("row", "n", "s1", "s2"), equal).select("row", "n", "node")
    listed = _nodes(first.filter("keys is not null"), equal)
    listed = listed.filter("s1 is null").unionByName(listed.filter("s1 is not null").dropDuplicates(["node"]))
    entries = listed.select("node", "n", F.explode(F.arrays_zip("keys", "places")).alias("x")).select(F.col("x.keys").alias("key"), "node", F.col("n").cast("int").alias("n"), F.col("x.places").alias("place"))
    entries = stored(entries.distinct(), "entries")
    shared_keys = stored(entries.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key"), "keys")
    lists = stored(entries.join(shared_keys, "key"), "lists")
    forget(entries, shared_keys)

    wanted = stored(lists.select("node").distinct(), "wanted")
    bitmap = bitmap_of(wanted, position(BITS, "node.id", "node.th"))
    marked = in_bitmap(base, position(BITS, "id", "th"), bitmap, "wanted").filter("wanted")
    sets = marked.select(F.col("id").cast("string").alias("id"), "th", "text").mapInPandas(_sets(k), "id string, th long, set array<long>, sketch binary")
    sets = sets.select(F.struct(F.col("id").cast(kind).alias("id"), "th").alias("node"), "set", "sketch")
    with small_batches(spark):
        sets = stored(sets.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "shingles")
    forget(bitmap, wanted)
    links = _linked(lists, sets, kind, num, den, small, cell)
    forget(lists, sets)
    if links is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(components(links).select("node", "label"), "node", "left").select("row", "n", "node", F.coalesce("label", "node").alias("label"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, small: int = SMALL, cell: int = CELL) -> DataFrame:
    """id, n_shingles, component_id: the smallest id reachable over links of Jaccard >= num / den."""
    rows = ngram_rows(docs, id_col, text_col, k, num, den, small, cell)
    return rows.select(F.col("row.id").alias(id_col), F.col("n").alias("n_shingles"), F.col("label.id").alias("component_id"))


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: doc_id, n_shingles, component_id at three words and 0.9."""
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), k=3, num=90, den=100)
