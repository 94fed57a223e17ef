"""Cross-tokenizer alignment against a brute-force version on whole texts, without segments."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from quillspark.llm import cross_tokens as ct

SCHEMA = "doc_id long, text string, h long, seg string, groups int, ids string"


@pytest.fixture(scope="module")
def pair():
    return ct.Pair(ct.byte_path(), ct.piece_path())


def whole(pair, text):
    """(ids, end) lists of both sides of the whole text, or None where bytes differ."""
    a, b = pair._a.encode(" " + text, add_special_tokens=False).ids, pair._b.encode(text)
    want = (" " + text).encode()
    if b"".join(pair.a_bytes[i] for i in a) != want or b"".join(pair.b_bytes[i] for i in b) != want:
        return None
    out = []
    for ids, size in ((a, pair.a_bytes), (b, pair.b_bytes)):
        at, rows = 0, []
        for i in ids:
            rows.append((i, at, at + len(size[i])))
            at += len(size[i])
        out.append(rows)
    return out


def brute_force(pair, rows):
    aligned, count = [], Counter()
    for d, text in rows:
        sides = whole(pair, text) if text else None
        if sides is None:
            aligned.append((d, None))
            continue
        a, b = sides
        links, j = [], 0
        for i, lo, hi in a:
            while b[j][2] <= lo:
                j += 1
            k = j
            while k < len(b) and b[k][1] < hi:
                links.append((i, b[k][0]))
                k += 1
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, lo = [], 0
        ga, gb = defaultdict(list), defaultdict(list)
        for side, out in ((a, ga), (b, gb)):
            g = 0
            for i, _, hi in side:
                while hi > ends[g]:
                    g += 1
                out[g].append(str(i))
        groups = [",".join(ga[g]) + "|" + ",".join(gb[g]) for g in range(len(ends))]
        count.update(links)
        aligned.append((d, (len(a), len(b), links, groups)))
    best: dict[int, int] = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for d, x in aligned:
        if x is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, groups = x
            out.append((d, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), ";".join(groups)))
    return sorted(out, key=str)


HARD = [
    None, "", " ", "   ", "a", " a", "a ", "a  b", "a   ", "\n", "\n\n x", "a\n b", "a \n b", "a\tb  c\t ", "it's  he'll 'S", "<|endoftext|> <s> </s> <unk> <0x0A>", "x▁y plain words", "▁",
    "naïve café  x", "a　 b  c", "你好 世界", "a\u0000b \u0001 c", "\U0001f600 \U0001f468‍\U0001f469 x", "é ﬁ Å", "a\x1c b\x1f c\x85 d​ e﻿ f", "12345 3.14  ---  ...", "x" * 3000, ("ab " * 5000),
    "▁ the the of", "the of the \r\n the",
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    pool = list("abcXYZ  \n\t.,'é中 \U0001f600" ) + [" the", " of", " and", "  ", "ing", "'s", " 12"]
    out = [(i, t) for i, t in enumerate(HARD)]
    out += [(100 + i, "".join(rng.choice(pool) for _ in range(rng.randint(1, 60)))) for i in range(300)]
    return [*out, out[8], out[8], (None, "the of"), (7, "the of")]


@pytest.mark.parametrize("size, most", [(8 << 20, 1 << 20), (500, 1 << 20), (500, 0)])
def test_against_whole_texts(spark, pair, rows, size, most, monkeypatch):
    if not most:
        monkeypatch.setattr(ct, "HEAD", 1)  # no segment is common
    docs = spark.createDataFrame([(d, t, 1, "s", 2, "i") for d, t in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in ct.align_documents(docs, block_bytes=size, most_bytes=most).collect()), key=str)
    want = brute_force(pair, rows)
    for g, w in zip(got, want, strict=True):
        assert g == w


def test_query_on_documents(spark, pair):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = sorted((tuple(r) for r in ct.op11_cross_tokens(spark, "/root/testdata/sf0.001").collect()), key=str)
    want = brute_force(pair, [tuple(r) for r in docs.collect()])
    assert got == sorted(((*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in want), key=str)


def test_cuts_are_verified(pair):
    assert pair.cut
    assert not ct.can_cut({1: b"new york"}) and ct.can_cut({1: b"  a", 2: b"\n b"})
    for text in HARD:
        if text and ct.SPACE not in text:
            a, b = pair.encode(pair.segments(text))
            assert sum(a, []) == pair._a.encode(" " + text, add_special_tokens=False).ids
            assert sum(b, []) == pair._b.encode(text)


def test_without_cuts_whole_texts_are_segments(pair):
    pair.cut = False
    try:
        assert pair.segments("a b") == ["a b"]
    finally:
        pair.cut = True


def test_empty(spark):
    assert ct.align_documents(spark.createDataFrame([], SCHEMA)).count() == 0
