"""Language ID end to end: against training and parsing spelled out, scripts without spaces, and the bound of the sample."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import language_id as li

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def crc(d):
    return zlib.crc32(str(d).encode()) % 3 == 1


def spoken(rng, letters, n, space):
    return space.join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))


def brute_force(rows, longest=40):
    """Train on all labelled rows (they are below the sample's bound) and parse with plain substring tests."""
    words = {}
    for d, t, lang, *_ in rows:
        if t and lang is not None and not (d is not None and crc(d)):
            for run in re.findall(r"[^\W\d_]+", t.lower()):
                words.setdefault(lang, Counter()).update(run[i : i + longest] for i in range(0, len(run), longest))
    words = {k: v for k, v in words.items() if v}
    known = {lang: "\0".join(f"\n{w}\n" for w in c) for lang, c in words.items()}
    ranks = {lang: {w: i for i, (w, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0])))} for lang, c in words.items()}

    def phrases(text, held):
        n = i = 0
        while i < len(text):
            j = i + 1
            while j < len(text) and text[i : j + 1] in held:
                j += 1
            n, i = n + 1, j
        return n

    out = []
    for d, t, *_ in rows:
        runs = re.findall(r"[^\W\d_]+", (t or "").lower())
        if not runs or not known:
            out.append((d, "und", 0.0))
            continue
        total = {lang: sum(phrases(f"\n{r}\n", held) for r in runs) for lang, held in known.items()}
        order = sorted(total, key=lambda x: (total[x], sum(ranks[x].get(r, len(ranks[x])) for r in runs), x))
        chars = sum(len(r) + 2 for r in runs)
        rival = total[order[1]] if len(order) > 1 else chars
        out.append((d, order[0], max(0.0, min(1.0, 1 - total[order[0]] / rival))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    alphabets = {"aa": "abcdefg", "bb": "efghijk", "ja": [chr(0x3041 + i) for i in range(80)], "zh": [chr(0x4E00 + i) for i in range(60)], "th": [chr(0x0E01 + i) for i in range(40)]}
    out = []
    for i in range(150):
        lang = list(alphabets)[i % 5]
        text = spoken(rng, alphabets[lang], rng.randint(3, 12), " " if lang in ("aa", "bb") else "")
        out.append((i, text, lang if i % 4 else None, "s", 1))
    long = "".join(rng.choice(alphabets["ja"]) for _ in range(60))
    return [*out, (200, None, "aa", "s", 1), (201, "123 --", "only-signs", "s", 1), (202, "", None, "s", 1), (203, "aé" * 500, "aa", "s", 1), (None, "abc fed", "aa", "s", 1), (204, long, "ja", "s", 1), (205, long, None, "s", 1)]


def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = li.predict(docs, li.train(docs)).select("doc_id", "__qs_lang.lang_pred", "__qs_lang.score").collect()
    for g, w in zip(sorted(map(tuple, got), key=str), brute_force(rows), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-12)


def test_spaceless_scripts_are_learned_and_kept(spark):
    """Lines of 45 letters and more without a space: each script's label is learned, found and kept by the pipeline."""
    rng = random.Random(4)
    scripts = {"ja": (0x3041, 83), "th": (0x0E01, 46), "zh": (0x4E00, 300)}
    common = {lang: [chr(lo + rng.randrange(n)) + chr(lo + rng.randrange(n)) for _ in range(120)] for lang, (lo, n) in scripts.items()}
    rows = [(i, "the cat sat on the mat and the dog ran to it " * 3, "en", "s", 1) for i in range(40)]
    for lang, pairs in common.items():
        rows += [(len(rows) + i, "".join(rng.choice(pairs) for _ in range(rng.randint(23, 40))), lang, "s", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    words = li.train(docs)
    assert set(words) == {"en", "ja", "th", "zh"}
    got = li.predict(docs, words).select("lang", "__qs_lang.lang_pred").collect()
    assert all(r.lang == r.lang_pred for r in got)
    assert corpus_pipeline.identify_language(spark, docs, "").count() == len(rows)


def test_sample_stays_at_its_bound(spark):
    """However many rows a label has, the sample is sample_chars and one cell; a rare or short label is learned too."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.translate(F.hex(F.xxhash64("id", F.lit(i))), "0123456789", "ghijklmnop") for i in range(8)]).alias("text"), F.lit("xx").alias("lang"))
    rare = spark.createDataFrame([(10**6, "einzig", "rare"), (10**6 + 1, "y" * 200_000, "one")], "doc_id long, text string, lang string")
    words = li.train(docs.union(rare), sample_chars=20_000, total_chars=60_000)
    assert 15_000 < sum(len(w) + 2 for w in words["xx"]) <= 20_000
    assert set(words) >= {"xx"} | {r.lang for r in rare.filter(~li.held_out(F.col("doc_id"))).collect()}
