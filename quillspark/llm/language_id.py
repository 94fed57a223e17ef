"""Language ID by cross-parsing entropy.

Training builds one suffix automaton per language over labelled text. A text is parsed greedily into longest matches
against each automaton; the language that needs the fewest phrases per character wins, since few long phrases mean a
low cross entropy between text and language. Matching runs over lower-cased letter runs with a boundary mark on both
ends, so a phrase never crosses a word boundary and a word's phrase counts can be remembered between texts.

Training rows are a bounded sample: per label, rows in hash order until ``sample_chars`` characters; each language
then keeps the distinct words of that sample, runs of more than LONGEST letters in pieces. ``sample_chars`` is the documented bound (300,000 characters). Every label is
learned if a row of it has a letter: ``total_chars`` (4,800,000, so 16 full samples) is shared out evenly where there are more, and bounds the
automata together. They are built once, on the driver, one at a time, and broadcast as arrays of about 40 bytes a
sample character; every row is predicted, over its whole text, the new words of many texts in step.

Prediction never sees lang, source or id. Defined results: null text, or one without a letter: ``und``, score 0;
no labelled row at all: every text is ``und``; ties go to the language whose sample has
the words at better frequency ranks, then to the smaller name; repeated rows get equal results;
extra columns pass through
:func:`predict` untouched.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import P, forget, mix, release, stored

SAMPLE_CHARS = 300_000
TOTAL_CHARS = 16 * SAMPLE_CHARS
CACHE_WORDS = 300_000
BLOCK = 400
#: A longer run of letters (scripts without spaces have them) is learned in pieces of so many.
LONGEST = 40
RANGE, CELLS, MARGIN = 1 << 40, 4096, 4
UNKNOWN = "und"
#: Letters, and with them some number signs, which predict() takes out.
LETTERS = re.compile(r"[^\W\d_]+")
MARK = "\n"


class SuffixAutomaton:
    """Online suffix automaton; transitions are one dict per state."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self._last = [-1], [0], 0

    def start(self) -> None:
        """Begin another text: its substrings join those known, and none spans two texts."""
        self._last = 0

    def add(self, c: str) -> None:
        nxt, link, length, p = self.next, self.link, self.length, self._last
        if (q := nxt[p].get(c)) is not None:
            if length[q] == length[p] + 1:
                self._last = q
                return
            self._last = self._split(p, q, c)
            return
        cur = len(nxt)
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        self._last = cur

    def _split(self, p: int, q: int, c: str) -> int:
        nxt, link = self.next, self.link
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def phrases(self, text: str) -> int:
        """Phrases of the greedy parse into longest matches; a character never seen is a phrase of its own."""
        nxt, state, count = self.next, 0, 0
        for c in text:
            to = nxt[state].get(c)
            if to is None:
                count += 1
                to = nxt[0].get(c)
                if to is None:  # unseen: the pending phrase, if any, ended above
                    count += state != 0
                    to = 0
            state = to
        return count + (state != 0)


def training_words(rows: DataFrame, text: str, label: str, id_col: str, sample_chars: int, total_chars: int) -> dict[str, list[str]]:
    """Distinct words of each label's sample, collected: at most total_chars characters, but a word a label at least.

    Rows come in the order of a hash of their id. A label's size says which share of the hash's range holds MARGIN
    times its sample, so that no more than that is looked at again whatever the input; inside that share, CELLS cells
    tell where the sample ends. The row with the smallest hash is always in.
    """
    base = rows.filter(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(label).alias("label"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text))), F.lit(RANGE)).alias("hash")
    )
    sizes = stored(base.groupBy("label").agg(F.sum(F.length("text")).alias("n"), F.min("hash").alias("least")), "labels")
    labels = sizes.count()
    out: dict[str, list[str]] = {}
    if not labels:
        return out
    chars = min(sample_chars, total_chars // labels)
    share = F.greatest(F.col("least"), F.least(F.lit(RANGE), F.ceil(F.lit(RANGE) * (MARGIN * chars / F.col("n"))))) + 1
    some = base.join(sizes.select("label", "least", share.alias("share")), "label").filter(F.col("hash") < F.col("share"))
    some = some.withColumn("cell", F.floor(F.col("hash") * CELLS / F.col("share")))
    before = Window.partitionBy("label").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = some.groupBy("label", "cell").agg(F.sum(F.length("text")).alias("n"))
    chosen = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter((F.col("before") == 0) | (F.col("before") < chars))
    last = chosen.groupBy("label").agg(F.max("cell").alias("last"))
    sample = some.join(last, "label").filter(F.col("cell") <= F.col("last"))
    piece = sample.select("label", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{1,{LONGEST}}}"), 0)).alias("word"))
    words = piece.groupBy("label", "word").agg(F.count("*").alias("k"))
    by_use = Window.partitionBy("label").orderBy(F.desc("k"), "word")
    ranked = words.withColumn("used", F.sum(F.length("word") + 2).over(by_use)).withColumn("rank", F.row_number().over(by_use)).filter((F.col("used") <= chars) | (F.col("rank") == 1))
    for r in ranked.orderBy("label", F.desc("k"), "word").select("label", "word").collect():
        out.setdefault(r["label"], []).append(r["word"])
    forget(sizes)
    return out


def fit(words: dict[str, list[str]]) -> dict[str, SuffixAutomaton]:
    out = {}
    for lang in sorted(words):
        sam = SuffixAutomaton()
        for w in words[lang]:
            sam.start()
            for c in MARK + w + MARK:
                sam.add(c)
        out[lang] = sam
    return out


class Compact:
    """The transitions of a suffix automaton as an open hash table in two arrays, and parses of many words in step."""

    def __init__(self, sam: SuffixAutomaton):
        count = sum(map(len, sam.next))
        key = np.fromiter((state << 21 | ord(c) for state, to in enumerate(sam.next) for c in to), np.uint64, count)
        to = np.fromiter((q for step in sam.next for q in step.values()), np.int32, count)
        slots = 1 << max(4, (2 * count).bit_length())
        self.keys, self.to = np.full(slots, _NONE, np.uint64), np.zeros(slots, np.int32)
        at, live = (mix(key) & np.uint64(slots - 1)).astype(np.int64), np.arange(count)
        while len(live):
            free = live[self.keys[at[live]] == _NONE]
            self.keys[at[free]] = key[free]
            live = live[self.keys[at[live]] != key[live]]
            at[live] = (at[live] + 1) & (slots - 1)
        self.to[at] = to

    def _step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The state each transition leads to, or -1."""
        key = state.astype(np.uint64) << np.uint64(21) | c
        last = len(self.keys) - 1
        at, out, live = (mix(key) & np.uint64(last)).astype(np.int64), np.full(len(key), -1, np.int64), np.arange(len(key))
        while len(live):
            held = self.keys[at[live]]
            hit = held == key[live]
            out[live[hit]] = self.to[at[live[hit]]]
            live = live[~hit & (held != _NONE)]
            at[live] = (at[live] + 1) & last
        return out

    def phrases(self, words: list[str]) -> np.ndarray:
        """:meth:`SuffixAutomaton.phrases` of each word."""
        size = np.array([len(w) for w in words])
        order = np.argsort(-size, kind="stable")
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        begin, size = (np.cumsum(size) - size)[order], size[order]
        state, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for j in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -j, side="left"))  # words longer than j
            c, at = chars[begin[:live] + j], state[:live]
            to = self._step(at, c)
            lost = np.flatnonzero(to < 0)
            if len(lost):
                count[lost] += 1
                again = self._step(np.zeros(len(lost), np.int64), c[lost])
                count[lost] += (again < 0) & (at[lost] != 0)
                to[lost] = np.maximum(again, 0)
            state[:live] = to
        count += state != 0
        out = np.zeros(len(words), np.int64)
        out[order] = count
        return out


_NONE = np.uint64((1 << 64) - 1)


def compact(words: dict[str, list[str]]) -> list[Compact]:
    """The automata of all languages, one built at a time."""
    return [Compact(fit({lang: words[lang]})[lang]) for lang in sorted(words)]


class CrossParser:
    """Predictions of one worker; remembers the phrase counts of words (bounded)."""

    def __init__(self, words: dict[str, list[str]], models: list[Compact] | None = None, limit: int = CACHE_WORDS):
        self._models, self._limit = compact(words) if models is None else models, limit
        self._names = sorted(words)
        self._words, self._ranks = words, None
        self._forget()

    def _forget(self) -> None:
        self._row: dict[str, int] = {}
        self._cost = np.zeros((1024, len(self._names) + 1), np.int32)  # phrases in each language, then characters

    def _learn(self, words: list[str]) -> None:
        parts = [letters(w) for w in words]
        flat = [MARK + w + MARK for p in parts for w in p]
        each = np.zeros((len(flat), len(self._names) + 1), np.int32)
        for lo in range(0, len(flat), 20_000):
            for i, m in enumerate(self._models):
                each[lo : lo + 20_000, i] = m.phrases(flat[lo : lo + 20_000])
        each[:, -1] = [len(w) for w in flat]
        first = len(self._row)
        while first + len(words) > len(self._cost):
            self._cost = np.concatenate([self._cost, np.zeros_like(self._cost)])
        self._cost[first : first + len(words)] = 0
        np.add.at(self._cost, first + np.repeat(np.arange(len(words)), [len(p) for p in parts]), each)
        self._row.update(zip(words, range(first, first + len(words)), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """language, score, phrases per character of the winner, for each text."""
        found = [LETTERS.findall(t.lower()) if t and self._names else [] for t in texts]
        flat = [w for f in found for w in f]
        if len(self._row) > self._limit:
            self._forget()
        known = self._row
        new = [w for w in set(flat) if w not in known]
        if new:
            self._learn(new)
        rows = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        sums = np.zeros((len(flat) + 1, len(self._names) + 1), np.int64)
        np.cumsum(self._cost[rows], axis=0, out=sums[1:])
        total = np.diff(sums[np.r_[0, np.cumsum([len(f) for f in found])]], axis=0)
        return [self._decide(t[:-1], t[-1], f) for t, f in zip(total.tolist(), found, strict=True)]

    def _decide(self, total: list[int], chars: int, found: list[str]) -> tuple[str, float, float]:
        if not chars:
            return UNKNOWN, 0.0, 1.0
        order = sorted(range(len(total)), key=lambda i: total[i])
        best = total[order[0]]
        if total.count(best) > 1:  # a tie goes to the language in which the words are the more frequent
            words = [p for w in found for p in letters(w)]
            order.sort(key=lambda i: (total[i], sum(self._rank(i, w) for w in words)))
        rival = total[order[1]] if len(order) > 1 else chars
        return self._names[order[0]], max(0.0, min(1.0, 1.0 - best / rival if rival else 0.0)), min(1.0, best / chars)

    def _rank(self, i: int, word: str) -> int:
        if self._ranks is None:
            self._ranks = [{w: k for k, w in enumerate(self._words[n])} for n in self._names]
        return self._ranks[i].get(word, len(self._ranks[i]))


def letters(word: str) -> list[str]:
    """The runs of letters in a match of LETTERS."""
    return [word] if word.isalpha() else "".join([c if c.isalpha() else " " for c in word]).split()


PREDICTED = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("phrase_rate", pa.float64())])


def predictor(words: dict[str, list[str]]) -> Callable[[Column], Column]:
    """A column function: text -> struct of lang_pred, score, phrase_rate. Other columns never leave the JVM."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast((words, compact(words)))

    @F.arrow_udf("lang_pred string, score double, phrase_rate double")
    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = CrossParser(*shared.value)
        for texts in batches:  # only BLOCK texts at a time become Python strings
            rows = [x for lo in range(0, len(texts), BLOCK) for x in parser.predict(texts.slice(lo, BLOCK).to_pylist())]
            del texts
            yield pa.array([dict(zip(PREDICTED.names, r, strict=True)) for r in rows], PREDICTED)
        del parser
        release()

    return guess


def predict(docs: DataFrame, words: dict[str, list[str]], text_col: str = "text") -> DataFrame:
    """The input rows with a struct column ``__qs_lang``: lang_pred, score, phrase_rate."""
    return docs.withColumn(f"{P}lang", predictor(words)(F.col(text_col)))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_chars: int = SAMPLE_CHARS, total_chars: int = TOTAL_CHARS) -> dict[str, list[str]]:
    return training_words(docs.filter(~held_out(F.col(id_col))), text_col, lang_col, id_col, sample_chars, total_chars)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: doc_id, held_out, lang_pred, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predict(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), f"{P}lang.lang_pred", f"{P}lang.score")
