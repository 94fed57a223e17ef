"""Suffix-tree scoring against a version in plain dictionaries, and on documents it did not learn from."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import suffix_tree as st

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, key string, n int, held string, score double"


def held_col():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0


def toks(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 10 == 0


class Model:
    """The docstring's formulas, over all n-grams, without sketches."""

    def __init__(self, texts, depth, least, penalty):
        self.depth, count = depth, Counter()
        for t in texts:
            w = toks(t)
            for k in range(1, depth + 2):
                count.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        self.words = {g[0]: n for g, n in count.items() if len(g) == 1}
        self.total = sum(self.words.values())
        self.states = {}
        for k in range(1, depth + 1):
            rows = defaultdict(dict)
            for g, n in count.items():
                if len(g) == k + 1 and n >= least:
                    rows[g[:-1]][g[-1]] = n
            new = {}
            for s, nxt in rows.items():
                c = count[s]
                gamma = 1 - sum((n - 0.75) / c for n in nxt.values())
                gain = (c - sum(nxt.values())) * math.log(gamma)
                for w, n in nxt.items():
                    above = self.p(s[1:], w)
                    gain += n * math.log(((n - 0.75) / c + gamma * above) / above)
                if gain >= penalty * len(nxt):
                    new[s] = (c, gamma, nxt)
            self.states |= new

    def root(self, w):
        return (self.words.get(w, 0) + 0.1) / (self.total + 0.1 * (len(self.words) + 1))

    def p(self, context, w):
        """By the longest retained suffix of the context."""
        if not context:
            return self.root(w)
        if context not in self.states:
            return self.p(context[1:], w)
        c, gamma, nxt = self.states[context]
        return ((nxt[w] - 0.75) / c if w in nxt else 0) + gamma * self.p(context[1:], w)

    def row(self, d, text):
        w = toks(text)
        base = sum(math.log10(self.root(x)) for x in w)
        score = sum(math.log10(self.p(tuple(w[max(0, i - self.depth) : i]), x)) for i, x in enumerate(w))
        return d, held(d), len(w), sum(x in self.words for x in w), self.total, base, score


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    after = {f"w{i}": [f"w{rng.randrange(25)}" for _ in range(3)] for i in range(25)}
    out = []
    for d in range(160):
        w = [f"w{rng.randrange(25)}"]
        for _ in range(rng.choice([0, 3, 40, 120])):
            w.append(rng.choice(after[w[-1]]) if rng.random() < 0.8 else f"w{rng.randrange(25)}")
        out.append((d, " ".join(w)))
    passage = "The Quick brown fox jumps Over the lazy dog " * 2
    out += [(200 + i, f"{passage} x{i} {passage}") for i in range(20)]
    return [*out, (300, None), (301, ""), (302, " \n"), (303, "ÄRGER ärger Zebra"), (None, "w1 w2 w3"), (5, out[9][1]), (5, out[9][1]), (304, "the quick " * 5000)]


@pytest.mark.parametrize("size, least, penalty", [(8 << 20, 8, 4.0), (2000, 3, 1.0)])
def test_against_dictionaries(spark, rows, size, least, penalty):
    docs = spark.createDataFrame([(d, t, "k", 1, "h", 0.0) for d, t in rows], SCHEMA).repartition(3)
    out = st.score_documents(docs, held_col(), least=least, penalty=penalty, block_bytes=size)
    got = sorted((tuple(r) for r in out.select("doc_id", "held", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=str)
    model = Model([t for d, t in rows if not held(d)], 3, least, penalty)
    assert {len(s) for s in model.states} == {1, 2, 3}
    want = sorted((model.row(d, t) for d, t in rows), key=str)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_every_state_sums_to_one(rows):
    model = Model([t for _, t in rows], 3, 3, 1.0)
    for s in model.states:
        assert sum(model.p(s, w) for w in model.words) + model.p(s, "never seen") == pytest.approx(1)


def test_held_out_documents_gain(spark):
    out = st.op12_lm_scoring(spark, "/root/testdata/sf0.01")
    r = out.filter("held_out").agg(F.sum("base_score").alias("base"), F.sum("score").alias("score"), F.sum("n_tokens").alias("n")).first()
    assert r.score > r.base + 0.05 * r.n


def test_gate_never_closes_on_what_reaches_the_least_count(spark, rows):
    """A sketch far too small lets more through and loses nothing."""
    docs = spark.createDataFrame(rows[:60], "doc_id long, text string")
    wide, cells = st.score_documents(docs, held_col(), least=4), st.CELLS
    st.CELLS = 1 << 12
    try:
        narrow = st.score_documents(docs, held_col(), least=4)
    finally:
        st.CELLS = cells
    assert sorted(map(tuple, wide.collect()), key=str) == sorted(map(tuple, narrow.collect()), key=str)


def test_empty_and_untrained(spark):
    assert st.score_documents(spark.createDataFrame([], SCHEMA), held_col()).count() == 0
    r = st.score_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_keys_travel_by_ranges(spark, rows):
    """A block and the model exchange one row for each range of keys, and as many bytes as the differences need."""
    ids = pa.array([{"id": i, "held": False} for i in range(len(rows))])
    raw = [(t or "").encode() for _, t in rows]
    data = st.encoded(b"".join(raw), np.array([len(r) for r in raw]))
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.ListArray.from_arrays([0, len(rows)], ids), pa.array([len(data)]), pa.array([pa.compress(data, "zstd", asbytes=True)])], ["__qs_block", "ids", "raw", "blob"])
    full = np.full(1 << 10, 255, np.uint8).tobytes()
    shared = spark.sparkContext.broadcast((full, full, full))
    head = spark.sparkContext.broadcast(pa.table({"key": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "room": pa.array([], pa.float64())}))
    asked = pa.Table.from_batches(st._questions(3, shared, head, 2)(iter([batch])))
    bounds, words, code = st.decoded(len(rows), len(data), batch.column("blob")[0].as_py())
    keys, before = st.grams(words[code], bounds, 3)
    want = np.unique(np.concatenate([k[before >= i] for i, k in enumerate(keys)]))
    assert asked.num_rows == 4 and asked["bucket"].to_pylist() == [0, 1, 2, 3] and sum(asked["count"].to_pylist()) == len(want)
    assert sum(map(len, asked["keys"].to_pylist())) < 8 * len(want)
    model = pa.table({"key": pa.array(want[::2].view(np.int64)), "n": pa.array(np.arange(len(want[::2]))), "room": pa.array(np.arange(len(want[::2])) / 4)})
    key, n, room = (np.concatenate(x) for x in zip(*st._answered(st._answer(asked, model)), strict=True))
    assert key.tolist() == want[::2].tolist() and n.tolist() == list(range(len(key))) and room.tolist() == (np.arange(len(key)) / 4).tolist()


def test_parts_of_a_block_score_alike(rows):
    texts = [(t or "").encode() for _, t in rows]
    data = st.encoded(b"".join(texts), np.array([len(t) for t in texts]))
    bounds, words, code = st.decoded(len(texts), len(data), pa.compress(data, "zstd", asbytes=True))
    keys, _ = st.grams(words[code], bounds, 3)
    held_keys = np.unique(np.concatenate(keys))
    answers = st.Answers([(held_keys, np.full(len(held_keys), 9), np.where(held_keys % np.uint64(3) > 0, 2.25, 0.0))])
    outs, part = [], st.PART
    for st.PART in (50, part):
        outs.append(st.score_block(bounds, words, code, answers, lambda keys, before, order: before >= order - 1, 3, 1000, 40))
    for c in outs[0]:
        assert outs[0][c] == pytest.approx(outs[1][c], rel=1e-12)


def test_ngrams_move_to_their_suffix_and_their_context_alone(spark, monkeypatch):
    """A level of the tree is two joins: what a context says of itself is found where its n-grams lie."""
    real, dealt = st.stored, []

    def counted(df, name):
        dealt.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return real(df, name)

    monkeypatch.setattr(st, "stored", counted)
    words = spark.createDataFrame([(1, 20), (2, 16)], "key long, n long")
    grams_ = spark.createDataFrame([(2, 1, 2, 12, 3), (2, 2, 1, 9, 4), (3, 3, 4, 8, 5)], "ord int, ctx long, suf long, n long, key long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        levels = st.tree(words, grams_, 2, 36, 2, 0.0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(dealt) <= 4 * 2
    assert [{(r.key, r.ctx, r.n, r.c) for r in level.collect()} for level in levels] == [{(3, 1, 12, 20), (4, 2, 9, 16)}, {(5, 3, 8, 12)}]
