"""Ranked lexical search against a brute-force version of its contract, in one block of queries and in many."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, query int, score long, id string, n int, terms string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(docs, items, k=20):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, words, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            n = sum(c.values())
            m = 100 - 25 + (25 * n * n_docs) // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text))
            if s > 0:
                found.append((-s, d is None, d, s))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank, d, s) for rank, (_, _, d, s) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["the"] * 60 + ["Ärger", "été", "naïve", "x1", "don't", "A-B"]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 5, 40, 300]))) for _ in range(240)]
    docs = [(i, t) for i, t in enumerate(base)] + [(1000 + i, base[7]) for i in range(60)]  # ties among many copies
    docs += [(5, base[9]), (5, base[9]), (None, base[11]), (2**60 + 1, base[7]), (2**60, base[7]), (300, None), (301, ""), (302, " .,;\n"), (303, "The " * 30_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(50)]
    items += [(3, "THE the THE"), (60, None), (61, ""), (62, "nowhere"), (63, base[7]), (63, base[7]), (None, base[11]), (64, "Ärger ärger ÄRGER")]
    return docs, items


@pytest.mark.parametrize("block_terms", [1 << 20, 300])
def test_against_brute_force(spark, texts, block_terms):
    docs, items = texts
    frame = spark.createDataFrame([(d, t, 1, 2, "x", 3, "y") for d, t in docs], SCHEMA).repartition(5)
    asked = spark.createDataFrame([(i, t, "q", 9) for i, t in items], "item_id long, text string, query string, rank int")
    got = sorted((tuple(r) for r in ls.lexical_search(frame, asked, block_terms=block_terms).collect()), key=str)
    assert got == brute_force(docs, items)


def test_empty_tables(spark, texts):
    docs, items = (spark.createDataFrame(t, s) for t, s in zip(texts, ("doc_id long, text string", "item_id long, text string"), strict=True))
    assert ls.lexical_search(docs.limit(0), items).count() == 0
    assert ls.lexical_search(docs, items.limit(0)).count() == 0
    assert ls.lexical_search(docs.filter("text = ''"), items).count() == 0


def test_bounds_enclose_scores_and_rule_out():
    """Upper bounds are never below the exact score, and few documents reach a floor."""
    rng = np.random.default_rng(1)
    vocabulary = np.arange(400, dtype=np.uint64)
    asked = [rng.integers(0, 400, 30).astype(np.uint64) for _ in range(40)]
    rows = [np.sort(rng.choice(400, rng.integers(5, 80), replace=False)) for _ in range(3000)]
    tfs = [rng.geometric(0.5, len(r)) for r in rows]
    df = np.bincount(np.concatenate(rows), minlength=400)
    n = np.array([t.sum() for t in tfs])
    q = ls.Queries(asked, vocabulary, df, len(rows), int(n.sum()))
    search = ls.Search(q, 20, np.zeros(40))
    begin = np.r_[0, np.cumsum([len(r) for r in rows])]
    flat, tf = np.concatenate(rows), np.concatenate(tfs)
    exact = np.zeros((len(rows), 40), np.int64)
    m = 75 + (25 * n * len(rows)) // n.sum()
    for i, a in enumerate(asked):
        times = np.bincount(a.astype(np.int64), minlength=400)
        part = times[flat] * q.weight[flat] * ((1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, np.diff(begin))))
        exact[:, i] = np.add.reduceat(part, begin[:-1])
    row = np.repeat(np.arange(len(rows)), np.diff(begin))
    level = -((-((1_000_000_000 * tf) // (1000 * tf + 12 * m[row])) * 255) // 1_000_000)
    upper = search._upper(row, flat, level, len(rows)) * (ls.TOP / ls.STEPS)
    assert (upper * (1 + ls.SLACK) + 1 >= exact).all()
    assert (upper - q.whole * (ls.TOP / ls.STEPS) <= exact * (1 + ls.SLACK) + 1).all()
    search.offer(np.arange(len(rows)), np.zeros(len(rows), bool), n, begin, flat, tf)
    who, score, _, ids = search.rows()
    for i in range(40):
        want = sorted((-s, d) for d, s in enumerate(exact[:, i].tolist()) if s > 0)[:20]
        assert sorted((-s, d) for w, s, d in zip(who, score, ids) if w == i) == want
    assert search.rescored < len(rows) * 40 / 4
