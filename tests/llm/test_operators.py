"""Each operator on a small table with nulls, empty and long texts, ties, repeated rows, extra and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, html_extract, language_id, mixing, ngram_join, packing, sharding, substring_dedup, suffix_dedup, topk_search
from quillspark.llm.common import P

WORDS = [f"w{i}" for i in range(60)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, key string, label string, id int"


def _texts():
    rng = random.Random(7)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 160))) for _ in range(30)]
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    out = [*base, None, "", " \n", "one", "one two", "ONE two", "one two three", *base[:6], base[0], base[0] + " x", base[1] + " y z"]
    for t in base[8:20]:
        w = t.split()
        w[len(w) // 2] = "zz"
        out += [" ".join(w), t + " " + passage, passage.upper() + " " + t]
    out += [passage, "x" * 300, "x" * 200, "Ähm ßtraße\t" * 20, base[3] * 40]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None, "c"][i % 7 % 4], 1, i, "k", "l", 5) for i, t in enumerate(_texts())]
    rows += [rows[3], rows[4]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows, empty):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    got = exact_dedup.exact_dedup(docs, carry=["text", "n"]).collect()
    assert len(got) == len(rows)
    for r in got:
        g = groups[r.text or ""]
        assert (r.keep_id, r.group_size) == (max(g), len(g)) and (not r.kept or r.doc_id == max(g))
    assert Counter(r.text or "" for r in got if r.kept) == Counter(groups.keys())
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_sharding(docs, rows, empty):
    got = sharding.shard_documents(docs, 4, grain=3, cell=7).collect()
    assert len(got) == len(rows)
    text = {r.doc_id: r.text for r in rows}
    where = defaultdict(set)
    for r in got:
        where[text[r.doc_id] or ""].add(r.shard)
        assert r["size"] == len((text[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode())
    assert all(len(s) == 1 for s in where.values())
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(empty).count() == 0


def test_mixing(docs, rows, empty):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len((r.text or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * w[s] for s in open_}
    for r in got:
        n = len((r.text or "").encode().split())
        assert (r[f"{P}size"], r[f"{P}source_size"]) == (n, sizes[r.source]) and r[f"{P}target"] == pytest.approx(target[r.source])
        assert 0 <= r[f"{P}copies"] <= 2 and abs(r[f"{P}copies"] - target[r.source] / sizes[r.source]) < 1
    assert mixing.mix_sources(empty).count() == 0


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.word_bpe_path())
    pieces = packing.pack_documents(docs.dropDuplicates(["doc_id"]), length=256, range_tokens=3000)
    ids = {r.doc_id: np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in rows}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces.collect():
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert by_doc.keys() == ids.keys()
    for d, ps in by_doc.items():
        assert [p for r in sorted(ps, key=lambda r: r.start) for p in range(r.start, r.start + r.length)] == list(range(len(ids[d])))
    for ps in by_seq.values():
        slots = [p for r in sorted(ps, key=lambda r: r.offset) for p in range(r.offset, r.offset + r.length)]
        assert slots == list(range(len(slots))) and len(slots) <= 256
    assert sum(len(x) for x in ids.values()) >= 0.85 * 256 * len(by_seq)
    whole = {r.sequence_id: r.ids for r in packing.sequences(pieces, docs.dropDuplicates(["doc_id"])).collect()}
    assert all(whole[s] == [x for r in sorted(ps, key=lambda r: r.offset) for x in ids[r.doc_id][r.start : r.start + r.length].tolist()] for s, ps in by_seq.items())
    assert packing.pack_documents(empty).count() == 0


def test_language_id(spark, docs, rows, empty):
    got = language_id.predict(docs, language_id.train(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r[f"{P}lang"].score <= 1 and (r[f"{P}lang"].lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert language_id.predict(empty, language_id.train(empty)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r[f"{P}lang"].lang_pred for r in language_id.predict(unlabelled, language_id.train(unlabelled)).collect()} == {"und"}


def test_language_id_learns_rare_labels(spark):
    """More labels than full samples, in skewed counts: the rarest is learned too."""
    rng = random.Random(3)
    vocabulary = [["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(12)] for _ in range(70)]
    rows = [(f"l{k:02}", " ".join(rng.sample(vocabulary[k], 12))) for k in range(70) for _ in range(12 if k % 2 else 20)]
    table = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = language_id.predict(table, language_id.train(table)).collect()
    assert len(got) == len(rows) and all(r[f"{P}lang"].lang_pred == r.lang for r in got)
    small = language_id.train(table, total_chars=70 * 36)
    assert len(small) == 70 and sum(len(w) + 2 for words in small.values() for w in words) <= 70 * 36
    assert len(language_id.train(table, total_chars=1)) == 70


def test_language_id_held_out_accuracy(spark):
    from pathlib import Path

    if not Path("/root/testdata/sf0.001/documents.parquet").exists():
        pytest.skip("no tables here")
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    got = language_id.op6_language_id(spark, "/root/testdata/sf0.001").filter("held_out").join(d, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.97


def test_substring_dedup(docs, rows, empty):
    first, want = {}, {}
    for doc, text in sorted({(r.doc_id, r.text or "") for r in rows}):
        w = text.encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), doc) < doc:
                gone[i : i + 50] = [True] * 50
        want[doc] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    got = substring_dedup.substring_dedup(docs).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want
    assert sum(x[1] for x in want.values()) > 500
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_suffix_dedup(docs, rows, empty):
    want = suffix_dedup.brute_force(sorted({(r.doc_id, r.text or "") for r in rows}))
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got} == want
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_ngram_join(docs, rows, empty, k, num):
    sets = {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = ngram_join.ngram_components(docs, k=k, num=num).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), label[i]) for i in sets}
    assert len(set(label.values())) < len(label) - 8
    assert ngram_join.ngram_components(empty).count() == 0


@pytest.mark.parametrize("star", [0, 64])
def test_ngram_join_chain_of_near_copies(spark, monkeypatch, star):
    """A hot list whose members link along a chain only: stars, forests and the exact rest must find every link."""
    monkeypatch.setattr(ngram_join, "STAR", star)
    words = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 100])) for i in range(80)]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=90, small=2, cell=8).collect()
    assert {r.component_id for r in got} == {0}


def test_ngram_join_copies_in_descending_order(spark):
    """The row that names a set of equal copies is the last its task meets."""
    rng = random.Random(11)
    rows = []
    for g in range(6):
        w = [f"g{g}x{rng.randrange(10**6)}" for _ in range((5, 12, 40, 90, 150, 300)[g])]
        rows += [(100 * g + 9, " ".join(w)), (100 * g + 5, " \n".join(w).upper()), (100 * g + 2, " ".join(w)), (100 * g + 40, " ".join([*w, "end"]))]
    table = spark.createDataFrame(sorted(rows, reverse=True), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(table, k=1, num=80, den=100).collect()}
    assert got == {i: i // 100 * 100 + 2 for i, _ in rows}


def test_forest_joins_all_and_no_more():
    rng = np.random.default_rng(5)
    for n, m in ((1, 0), (30, 20), (60, 400)):
        x, y, far = rng.integers(0, n, m), rng.integers(0, n, m), rng.random(m)
        kept = ngram_join.forest(x, y, far)

        def groups(at, x=x, y=y, n=n):
            label = list(range(n))
            for i in at:
                label = [label[x[i]] if c == label[y[i]] else c for c in label]
            return label

        whole, tree = groups(range(m)), groups(kept)
        assert len(kept) == n - len(set(whole))
        assert {tuple(v == w for w in whole) for v in whole} == {tuple(v == w for w in tree) for v in tree}


@pytest.mark.parametrize("cell", [4, 2048])
def test_ngram_join_lists_of_the_same_members_meet_a_pair_once(spark, monkeypatch, cell):
    """Copies just short of a link share dozens of long lists: a pair leaves the comparison once, not for each list."""
    rng, made, real = random.Random(3), [], ngram_join._large_lists

    def counted(*args):
        made.append(real(*args).localCheckpoint())
        return made[-1]

    monkeypatch.setattr(ngram_join, "_large_lists", counted)
    rows = []
    for i in range(48):
        w = [f"g{i % 2}v{p}" for p in range(200)]
        for p in rng.sample(range(200), 11 + i % 3):
            w[p] = f"x{i}_{p}"
        rows.append((i, " ".join(w)))
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), k=1, num=80, den=100, cell=cell).collect()
    met = sum(d.count() for d in made)
    assert 0 < met <= 2 * sum(d.distinct().count() for d in made)
    sets, label = {i: set(t.split()) for i, t in rows}, {i: i for i, _ in rows}
    for a in sets:
        for b in sets:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label = {i: min(label[a], label[b]) if c in (label[a], label[b]) else c for i, c in label.items()}
    assert {r.doc_id: r.component_id for r in got} == label


def test_ngram_join_long_list_without_links(spark, monkeypatch):
    """Many copies of one text, each with edits of its own: no links at 0.9, and two more that do link. Forests come
    before the exact rest."""
    monkeypatch.setattr(ngram_join, "STAR", 0)
    rng = random.Random(9)
    base = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for p in rng.sample(range(200), 8):
            w[p] = f"x{i}_{p}"
        rows.append((i, " ".join(w)))
    rows += [(60, rows[7][1] + " tail"), (61, rows[9][1] + " end")]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=90, small=2, cell=8).collect()
    label = {r.doc_id: r.component_id for r in got}
    assert label[60] == label[7] and label[61] == label[9]
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in rows}
    for a in sets:
        for b in sets:
            if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                assert label[a] == label[b]
    assert len(set(label.values())) > 30


def test_top_k(spark):
    rng = random.Random(8)
    vecs = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(300)] + [[0.5] * 8] * 40 + [[], [1.0, 2.0], [0.0] * 8, None, [None, 1.0], [float("nan")] * 8, [float("inf")]]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(vecs)], "vec_id long, embedding array<float>, score int, rank string")
    q = {i: [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v] for i, v in enumerate(vecs) if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    got = topk_search.top_k(df, F.col("id") % 7 == 0, block=16, slice_rows=64).collect()
    want = []
    for a in q:
        if a % 7 == 0:
            scored = sorted((-sum(x * y for x, y in zip(q[a], q[b], strict=False)), b) for b in q if b != a)[:5]
            want += [(a, r + 1, b, -s) for r, (s, b) in enumerate(scored)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk_search.top_k(df.limit(0), F.col("id") % 7 == 0).count() == 0


def test_html(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>a</p></article>", "t"), (2, None, None, None), (2, None, "", None)], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(df).collect()) == [(1, "a", 1), (2, "", 0), (2, "", 0)]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert at.columns == docs.columns
        at = spark.createDataFrame(at.collect(), at.schema)
        seen.append(at)
    lang, exact, near, mixed, packed = seen
    assert all(any(c.isalpha() for c in r.text) for r in lang.collect())
    texts = [r.text for r in exact.collect()]
    assert Counter(texts) == Counter({r.text for r in lang.collect()})
    groups = ngram_join.ngram_components(exact).filter("doc_id = component_id").count()
    assert near.count() == groups < len(texts)
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in near.collect()}
    assert packed.agg(F.sum("length")).first()[0] == packed.select("doc_id", "sequence_id", "doc_tokens", "start").filter("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


class _ArticleText(HTMLParser):
    """Main text of the synthetic pages, whose article is known: an independent parser, block by block."""

    BLOCKS = {"article", "section", "p", "h1", "h2", "h3", "div", "ul", "li", "blockquote", "nav", "footer", "aside", "header", "form", "body"}
    OUT = {"script", "style", "nav", "footer", "aside", "form", "button", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out, self.blocks = False, [], [""]

    def handle_starttag(self, tag, attrs):
        names = dict(attrs).get("class") or dict(attrs).get("id") or ""
        if tag in self.BLOCKS:
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "
        if tag == "article":
            self.inside = True
        if self.out and self.out[-1][0] == tag:
            self.out[-1][1] += 1
        elif tag in self.OUT or (tag == "div" and names in {"ad", "comments", "cookie", "notice", "sidebar"}):
            self.out.append([tag, 1])

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.blocks.append("")
        if tag == "article":
            self.inside = False
        if self.out and self.out[-1][0] == tag:
            self.out[-1][1] -= 1
            if not self.out[-1][1]:
                self.out.pop()

    def handle_data(self, data):
        if self.inside and not self.out:
            self.blocks[-1] += data


def test_html_on_all_pages_with_and_without_marks(spark):
    """Every page of the given table: the known article; the same where its mark is taken off, so windows alone decide."""
    from pathlib import Path

    where = Path("/root/testdata/sf0.01/pages.parquet")
    if not where.exists():
        pytest.skip("no tables here")
    pages = spark.read.parquet(str(where)).select("page_id", "url", "html")
    bare = pages.withColumn("html", F.regexp_replace("html", "<(/?)article", "<$1section"))
    want = {}
    for r in pages.collect():
        p = _ArticleText()
        p.feed(r.html)
        want[r.page_id] = "\n".join(x for x in (" ".join(b.split()) for b in p.blocks) if x)
    got, plain = ({r.page_id: r.text for r in html_extract.extract(t).collect()} for t in (pages, bare))
    assert got == want and plain == want


def test_html_long_page_ties_and_clashing_columns(spark):
    body = "".join(f"<p>{'word ' * 30}{i % 7}</p>" for i in range(20_000))
    df = spark.createDataFrame([("x", "t", f"<div>{body}</div>", 3, "k"), ("x", "t", f"<div>{body}</div>", 3, "k")], "url string, text string, html string, n_chars int, page_id string")
    got = html_extract.extract(df).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].text.count("\n") == 19_999 and got[0].n_chars == len(got[0].text)


def test_sharding_balance_and_schedule(spark):
    """Shards differ by about one bundle; placements equal a plain longest-first schedule of the groups."""
    rng = random.Random(5)
    rows = [(i if i % 50 else None, rng.choice("abc") * rng.randint(0, 2000)) for i in range(3000)] + [(5000 + i, "hot" * 40) for i in range(900)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    assert len(got) == len(rows) and sorted(load) == list(range(6)) and max(load.values()) - min(load.values()) <= 0.02 * sum(load.values())
    for trial in range(50):
        items = [(rng.randint(1, 50), f"{trial}-{i}") for i in range(rng.randint(1, 40))]
        loads, want = [0] * 5, {}
        for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
            s = min(range(5), key=lambda i: (loads[i], i))
            want[key] = s
            loads[s] += size
        assert sharding.schedule(items, 5) == want


def test_mixing_comes_near_its_targets(spark):
    """Draws are independent, so a source's sum has a spread of at most sqrt(sum of squares) / 2: within five of those."""
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 60), f"s{rng.randint(0, 3)}") for i in range(6000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for group in by.values():
        taken, spread = sum(r[f"{P}size"] * r[f"{P}copies"] for r in group), sum(r[f"{P}size"] ** 2 for r in group) ** 0.5 / 2
        assert abs(taken - group[0][f"{P}target"]) <= 5 * spread


def test_top_k_with_repeated_ids(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [2.0]), *[(i, [float(i)]) for i in range(1, 9)]], "vec_id long, embedding array<float>")
    got = topk_search.top_k(df, F.col("id") == 0, k=9).collect()
    assert sorted((r["rank"], r.vec_id) for r in got if r.score % 512 == 0 and r["rank"] == 1) and len(got) == 18
    assert sorted(r["rank"] for r in got) == sorted([*range(1, 10)] * 2) and sum(r.vec_id == 0 for r in got) == 2


def test_pipeline_edges(spark, tmp_path):
    """Near copies are told apart by text where ids clash; an empty table runs through every stage."""
    import corpus_pipeline

    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [(1, a, "en", "s", 1), (2, a + " q", "en", "s", 1), (2, b, "en", "s", 1), (None, None, None, None, None), (None, "", None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, table, "").collect()}
    assert got == {(1, a), (2, b), (None, None), (None, "")}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table, "").count() >= 1
    table.limit(0).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_dedup_orders_null_and_large_ids(spark, kind):
    """A null id is the smallest; hashed 64-bit ids beside it keep their order."""
    passage = " ".join(f"p{i}" for i in range(80))
    ids = [2**60 + 2, 2**60, None, 2**60 + 1, -(2**62)]
    texts = [f"a {passage}", f"bb {passage} b", f"c c {passage}", f"{passage} d d", f"e {passage} e e"]
    keys = [None if i is None else i if kind == "long" else str(i) for i in ids]
    for some in (range(5), [0, 1, 3, 4]):
        df = spark.createDataFrame([(keys[i], texts[i]) for i in some], f"doc_id {kind}, text string")
        least = min((i for i in some), key=lambda i: (keys[i] is not None, keys[i]))
        for parts in (1, 3):
            words = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(df.repartition(parts)).collect()}
            assert words == {keys[i]: 0 if i == least else 80 for i in some}
            size = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(df.repartition(parts)).collect()}
            assert all((size[keys[i]] == 0) if i == least else size[keys[i]] >= len(passage) for i in some)
    whole = spark.createDataFrame([(k, passage) for k in keys], f"doc_id {kind}, text string")
    assert sorted(r.n_removed for r in suffix_dedup.suffix_dedup(whole).collect()) == [0] + [len(passage)] * 4
    assert {r.doc_id for r in suffix_dedup.suffix_dedup(whole).filter("n_removed = 0").collect()} == {None}


def test_top_k_without_queries(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 20)], "vec_id long, embedding array<float>")
    assert topk_search.top_k(df, F.col("id") % 50 == 0).count() == 0
    assert topk_search.top_k(df, F.col("id") == 7, slice_rows=3, block=1).count() == 5


def test_html_running_text_and_dives():
    """A class on a paragraph of the article is a weak sign; a list of links between paragraphs is a dive."""
    body = "This paragraph is long enough to surge by itself, as text of an article does on a page."
    page = f'<article><p class="social">{body}</p><h2 class="alert-heading">What changed</h2><p class="related">{body} Again.</p><p class="notice">Cookies.</p></article>'
    assert html_extract.main_text(page) == f"{body}\nWhat changed\n{body} Again."
    links = "".join(f"<li><a href='/{i}'>A link to some other page {i}</a></li>" for i in range(5))
    for tag in ("div", "main"):
        assert html_extract.main_text(f"<{tag}><p>{body}</p><ul>{links}</ul><h2><a href='#x'>Part two</a></h2><p>{body} More.</p></{tag}>") == f"{body}\n{body} More."
        assert html_extract.main_text(f"<{tag}><p>{body}</p><h2><a href='#x'>Part two</a></h2><p>{body} More.</p></{tag}>") == f"{body}\nPart two\n{body} More."
    assert "A link" in html_extract.main_text(f"<article><p>{body}</p><ul>{links}</ul><p>{body}</p></article>")
