"""Parts that need no Spark session, against plain brute force."""

import random
import zlib
from itertools import pairwise

import numpy as np
import pytest

from quillspark.llm.html_extract import main_text
from quillspark.llm.language_id import Compact, CrossParser, SuffixAutomaton, fit
from quillspark.llm.ngram_join import Plan, list_keys
from quillspark.llm.packing import CachedTokenizer, PieceCrc, hilbert, running_crcs, word_bpe_path
from quillspark.llm.sharding import schedule
from quillspark.llm.substring_dedup import sliding_min
from quillspark.llm.suffix_array import permuted_lcp, suffix_array
from quillspark.llm.suffix_dedup import Shard
from quillspark.llm.topk_search import Best, Side
from quillspark.llm.words import text_words


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for trial in range(400):
        n, alphabet = rng.randint(0, 60), rng.choice([1, 2, 3, 256])
        s = bytes(rng.randrange(alphabet) for _ in range(n))
        if trial % 3 == 0:
            s = (s[: rng.randint(1, 9)] * 9)[:n]
        sa = suffix_array(s)
        assert list(sa) == sorted(range(len(s)), key=lambda i: s[i:])
        most = rng.choice([5, 20, 50])
        got = permuted_lcp(s, sa, most)
        for a, b in zip(sa, sa[1:], strict=False):
            k = 0
            while max(a, b) + k < len(s) and s[a + k] == s[b + k] and k < most:
                k += 1
            assert got[b] == k


def test_large_minimizer_group_is_cut_by_further_minimizers():
    rng = random.Random(2)

    def cover(rows, window, **how):
        shard, out = Shard(window, **how), set()
        for snip, doc in rows:
            out.update(shard.add(1, snip, doc, [(f"{doc}:{snip!r}", 0)]))
        out.update(shard.end())
        return {(d, i) for d, p, n in out for i in range(p, p + n)}

    rows = sorted({(bytes(rng.choice(b"ab") for _ in range(12)), rng.randint(0, 9)) for _ in range(60)})
    first, want = {}, set()
    for snip, doc in sorted(rows, key=lambda x: x[1]):
        for i in range(7):
            if first.setdefault(snip[i : i + 6], doc) < doc:
                want.update((f"{doc}:{snip!r}", j) for j in range(i, i + 6))
    assert cover(rows, 6, gram=3) == cover(rows, 6, gram=3, limit=50) == want != set()
    # one phrase in contexts of its own, each twice: far above the limit of one array
    phrase = b"the same phrase of thirty bytes"
    many = sorted((bytes(rng.choice(b"abcdefgh") for _ in range(40)) + phrase + bytes(rng.choice(b"abcdefgh") for _ in range(40)), 2 * i) for i in range(3000))
    rows = sorted(many + [(s[5:], d + 1) for s, d in many[:1500]])
    got = cover(rows, 50, limit=1 << 14)
    assert got == {(f"{d + 1}:{s[5:]!r}", i) for s, d in many[:1500] for i in range(len(s) - 5)}


@pytest.mark.parametrize("width", [1, 2, 5, 26])
def test_sliding_min(width):
    x = np.random.default_rng(3).integers(0, 99, 60).astype(np.uint64)
    assert list(sliding_min(x, width)) == [min(x[i : i + width]) for i in range(len(x) - width + 1)]


def test_automaton_phrases_are_longest_matches():
    rng = random.Random(4)
    for _ in range(100):
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(4)]
        sam = SuffixAutomaton()
        for w in words:
            sam.start()
            for c in w:
                sam.add(c)
        text, at, want = "".join(rng.choice("abcd") for _ in range(12)), 0, 0
        while at < len(text):
            k = max((k for k in range(len(text) - at + 1) if any(text[at : at + k] in w for w in words)), default=0)
            at, want = at + max(k, 1), want + 1
        assert sam.phrases(text) == want


def test_parses_in_step_equal_parses_one_by_one():
    rng = random.Random(8)
    sam = fit({"x": ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(200)]})["x"]
    words = ["".join(rng.choice("abcéd\n") for _ in range(rng.randint(0, 14))) for _ in range(500)] + ["a" * 300]
    assert Compact(sam).phrases(words).tolist() == [sam.phrases(w) for w in words]
    assert Compact(sam).phrases([]).tolist() == [] and Compact(SuffixAutomaton()).phrases(["ab"]).tolist() == [2]


def test_cross_parser_defined_results():
    p = CrossParser({"en": ["the", "thing"], "fr": ["que", "les"]})
    assert [x[0] for x in p.predict([None, "12 %%", "", "\u00b2", "x\u00b2", "\u2167 _"])] == ["und", "und", "und", "und", "en", "und"]
    assert [x[0] for x in p.predict(["the thing the", "LES que", "the\u00b2thing"])] == ["en", "fr", "en"]
    assert CrossParser({}).predict(["the"])[0][0] == "und" and fit({}) == {}


def test_hilbert_is_a_path():
    pts = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = hilbert(pts, 3)
    assert sorted(keys) == list(range(512))
    walk = pts[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_piece_crcs():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 49408, 1000).astype("<u4")
    marks, crc = running_crcs(ids.tobytes(), 32), PieceCrc(32)
    for a, b in ((0, 32), (32, 64), (64, 1000), (320, 992), (0, 1000)):
        start = int(marks[a // 32 - 1]) if a else None
        end = int(marks[-(-b // 32) - 1])
        assert (crc.of(start, end, b - a) if a else end) == zlib.crc32(ids[a:b].tobytes())


def test_cached_tokenizer_equals_tokenizer():
    from tokenizers import Tokenizer

    texts = ["", " a  b\n", "Don't stop\x1cnow  x<|endoftext|>y 3Σσ é naïve", "\t\x0b", "ABC's 12,345 中文", "é, É! ²! x²!! ÷, ×! <|ENDOFTEXT|> <|endoftext|> a~b ~ ~~ — a—! …?"]
    rng = random.Random(5)
    letters = "abcXYZéÉàß²Σ—·…'’.,!~<|>09_- \n"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["x" * 3000 + "! " + "ab" * 700]
    plain = Tokenizer.from_file(word_bpe_path())
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for limit in (3, 700, 10**6):
        tok = CachedTokenizer(word_bpe_path(), limit=limit)
        for step in (7, len(texts)):
            got = []
            for lo in range(0, len(texts), step):
                ids, bounds = tok.encode(texts[lo : lo + step])
                got += [ids[a:b].tolist() for a, b in pairwise(bounds.tolist())]
            assert got == want


def test_word_hashes_follow_words():
    texts = [b"", b" ", b"a", b"  aa a\tbb\x0b", b"x" * 2500 + b" " + b"x" * 2500, "é A".encode()]
    h, bounds = text_words(texts, lower=True)
    words = [t.lower().split() for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in words]
    flat = [w for t in words for w in t]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


def test_schedule_is_longest_first():
    got = schedule([(5, "a"), (4, "b"), (3, "c"), (3, "d")], 2)
    assert got == {"a": 0, "b": 1, "c": 1, "d": 0}


@pytest.mark.parametrize(("num", "most"), [(90, 24), (80, 24), (80, 60)])
def test_every_linked_pair_shares_a_list(num, most):
    plan, rng = Plan(num, 100), random.Random(6)
    universe = [rng.getrandbits(64) for _ in range(90)]
    for _ in range(300):
        n = rng.randint(1, most)
        x = set(rng.sample(universe, n))
        y = set(x)
        for _ in range(rng.randint(1, max(1, n // 8))):
            rng.random() < 0.5 and len(y) > 1 and y.remove(rng.choice(sorted(y)))
            rng.random() < 0.5 and y.add(rng.choice(universe))
        if 100 * len(x & y) >= num * len(x | y):
            sets = [np.array(sorted(s), np.uint64) for s in (x, y)]
            a, b = (set(list_keys(s, (1 + s % np.uint64(5)).astype(np.uint8), plan)[0].tolist()) for s in sets)
            assert a & b


def test_best_keeps_ties_and_huge_scores():
    turn = np.eye(2)
    q = Side(np.array([0]), np.array([[1, 0]]), turn)
    best = Best(q, 2)
    best.offer(Side(np.array([9, 7, 0]), np.array([[3, 0], [3, 0], [3, 0]]), turn))
    best.offer(Side(np.array([5, 4]), np.array([[3, 0], [2, 0]]), turn))
    assert best.frame()["vec_id"].tolist() == [5, 7]
    big = 1 << 31
    best = Best(Side(np.array([0]), np.array([[big, 1]]), turn), 2)
    best.offer(Side(np.array([1, 2, 3]), np.array([[big, 0], [big, 1], [big, 2]]), turn))
    assert best.frame()["score"].tolist() == [big * big + 2, big * big + 1]


def test_html_structures():
    page = """<html><head><title>T</title></head><body><header class=top><h1>Site</h1></header><nav><li>Home</nav>
    <main><h1>Head&nbsp;line</h1><p>One <b>bo</b>ld &amp; <i>it</i><br>two<p class="ad">Buy<p>Three
    <aside>side</aside><form>f</form><ul><li>a<li>b</ul><script>var x="</p>"</script><!-- no --><div id="reader-comments"><p>bad</div>
    <table><tr><td>x<td>y</table></main><footer>f</footer></body></html>"""
    assert main_text(page) == "Head line\nOne bold & it two\nThree\na\nb\nx y"
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == main_text("<script>never closed") == ""
    bare = "<div class=menu><a href=x>Home</a></div><p>" + "word " * 40 + "</p><p>short</p><p>" + "more " * 30 + "</p><div><a href=z>link one</a></div><p>© 2020</p>"
    assert main_text(bare) == "\n".join([("word " * 40).strip(), "short", ("more " * 30).strip()])


def test_html_surge_and_dive_beside_a_marked_article():
    body = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    plain = "<body><div class=nav><a href=x>Home</a></div>" + "".join(f"<div><p>{x}</div>" for x in body) + "<article><h3>Teaser</h3></article><div>short line</div></body>"
    assert main_text(plain) == "\n".join([*body, "Teaser"])
    links = "".join(f"<li><a href={i}>Link number {i}</a>" for i in range(9))
    assert main_text(f"<main><h1>Head</h1><p>{body[0]}</p><ul>{links}</ul></main>") == "Head\n" + body[0]
    assert main_text(f"<main><article><h1><a href=x>Head</a></h1><p>{body[0]}</p><p>end</p></article></main>") == f"Head\n{body[0]}\nend"


def test_html_keeps_all_that_is_no_furniture():
    text = [" ".join(f"{c}{i}" for i in range(n)) for c, n in zip("abc", (900, 60, 60), strict=True)]
    for name in ("layout has-sidebar", "social-policy", "form-page"):
        assert main_text(f"<div class='{name}'><article><p>{text[1]}</p></article></div>") == main_text(f"<div class='{name}'><p>{text[1]}</p></div>") == text[1]
    assert main_text(f"<form action=x><main><p>{text[1]}</p></main></form>") == text[1]
    for name in ("main-sidebar", "siteNav", "nav__item--active", "comment-list", "ad-slot-3", "page-header"):
        assert main_text(f"<div id='{name}'><p>{text[1]}</p></div><p>{text[2]}</p>") == text[2]
    items = [f"item {i}" for i in range(12)]
    listed = "".join(f"<li>{x}" for x in items)
    assert main_text(f"<p>{text[0]}</p><ul>{listed}</ul><p>{text[1]}</p>") == "\n".join([text[0], *items, text[1]])


def test_sketches_rule_out_large_sets():
    """A sketch grows with its set; widths are folded to compare, and differing bytes never exceed the difference of the sets."""
    import numpy as np
    import pandas as pd

    from quillspark.llm import ngram_join as ng

    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 9000).astype(np.uint64)
    for n, m, shared in ((2000, 2000, 1333), (1000, 1100, 980), (300, 260, 250), (3000, 2500, 2400), (600, 500, 500), (40, 40, 0)):
        a, b = pool[:n], pool[n - shared : n - shared + m]
        x, y = ng.sketch(a), ng.sketch(b)
        differ = ng._differing(pd.Series([x, x, y]), pd.Series([y, x, y])).tolist()
        assert 0 < differ[0] <= n + m - 2 * shared and differ[1:] == [0, 0]
        sides = ng._Sketches([x]), ng._Sketches([y, x])
        w = min(len(x), len(y))
        assert int((sides[0].rows(np.array([0]), w) != sides[1].rows(np.array([0]), w)).sum()) == differ[0]
        if (n, m) == (2000, 2000):  # a Jaccard of a half, against 0.8
            assert differ[0] * 180 > (n + m) * 20
