"""Rendering queries: blocks made from conversations and lineitems, file names and links from parts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rendering as R
from .quality import blocks
from .registry import Tables, query

RAW = """blocks AS (SELECT conv_id AS doc_id, turn // 2 AS page, CASE WHEN turn % 3 = 0 THEN NULL ELSE turn END AS ord, 100 - turn AS block_id, turn AS pos,
  CASE (conv_id + turn) % 9 WHEN 0 THEN 'table' WHEN 1 THEN 'display_formula' WHEN 2 THEN 'header' WHEN 3 THEN 'paragraph_title' ELSE 'text' END AS label,
  CASE WHEN (conv_id * 3 + turn) % 4 = 0 THEN '' WHEN (conv_id + turn) % 9 = 2 THEN 'Seite ' || CAST(turn AS STRING) || ' ☒' ELSE text END AS content FROM conversations)"""
CLEAN = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
TICK = r"regexp_replace(regexp_replace(regexp_replace({}, '\$\s*\\checkmark\s*\$', '[x]', 'g'), '[☒☑⊠]', '[x]', 'g'), '[□☐▢]', '[ ]', 'g')"
RENDERED = rf"""{RAW}, c AS (SELECT *, {CLEAN.format(TICK.format("content"))} AS c FROM blocks),
  r AS (SELECT *, CASE WHEN c = '' THEN '' WHEN label = 'paragraph_title' THEN CASE WHEN regexp_matches(c, '^#{{1,6}}\s+\S') THEN c ELSE '## ' || c END WHEN label = 'header' THEN '> ' || c ELSE c END AS rendered FROM c),
  q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord IS NULL, ord, block_id, pos) AS seq FROM r WHERE rendered <> ''),
  k AS (SELECT *, CASE WHEN label = 'header' THEN row_number() OVER (PARTITION BY doc_id, label, CASE WHEN label = 'header' THEN regexp_replace(lower({CLEAN.format("content")}), '[0-9]+', '#', 'g') END ORDER BY page, seq) ELSE 1 END AS nth FROM q),
  kept AS (SELECT * FROM k WHERE nth = 1)"""


def raw_blocks(t: Tables):
    conv, turn = F.col("doc_id"), F.col("pos")
    b = blocks(t).withColumn("block_id", 100 - turn)
    return b.withColumn("content", F.when((conv * 3 + turn) % 4 == 0, "").when((conv + turn) % 9 == 2, F.concat(F.lit("Seite "), turn.cast("string"), F.lit(" ☒"))).otherwise(F.col("content")))


@query("ord4_reading_order", f"WITH {RENDERED} SELECT doc_id, page, pos, seq FROM q")
def ord4(t: Tables):
    from pyspark.sql import Window

    b = raw_blocks(t).withColumn("rendered", R.block(F.col("label"), F.col("content"), F.col("page") + 1)).filter("rendered <> ''")
    return b.select("doc_id", "page", "pos", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(*R.reading_order())).cast("long").alias("seq"))


@query("rnd2_boilerplate", f"WITH {RENDERED} SELECT doc_id, page, pos, rendered FROM kept")
def rnd2(t: Tables):
    return R.rendered_blocks(raw_blocks(t)).select("doc_id", "page", "pos", "rendered")


@query(
    "rnd1_pages",
    f"""WITH {RENDERED}, n AS (SELECT doc_id, 1 + max(page) AS n_pages FROM blocks GROUP BY doc_id),
    p AS (SELECT doc_id, page, count(*) AS k, '<!-- page:' || (page + 1) || '/' || any_value(n_pages) || ' -->' || chr(10) || chr(10) || string_agg(rendered, chr(10) || chr(10) ORDER BY seq) AS body FROM kept JOIN n USING (doc_id) GROUP BY doc_id, page)
    SELECT doc_id, string_agg(body, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page) AS markdown, CAST(sum(k) AS BIGINT) AS block_count FROM p GROUP BY doc_id""",
)
def rnd1(t: Tables):
    b = raw_blocks(t)
    return R.assemble(R.rendered_blocks(b), b.groupBy("doc_id").agg((1 + F.max("page")).alias("n_pages")))


BOXES = """boxes AS (SELECT l_orderkey AS doc_id, CAST(0 AS BIGINT) AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, l_partkey % 3 = 0 AS is_label,
  CAST(l_partkey % 40 * 20 AS DOUBLE) AS x0, CAST(l_suppkey % 5 * 15 AS DOUBLE) AS y0, CAST(l_partkey % 40 * 20 + 90 AS DOUBLE) AS x1, CAST(l_suppkey % 5 * 15 + 25 AS DOUBLE) AS y1 FROM lineitem)"""
PAIRS = f"""{BOXES}, w AS (SELECT *, max(x1) OVER (PARTITION BY doc_id) AS width FROM boxes),
  n AS (SELECT l.doc_id, l.page, l.seq AS label_seq, v.seq AS value_seq, v.x0 - l.x1 AS gap, l.x0 AS a, l.y0 AS b, l.x1 AS c, l.y1 AS d, v.x0 AS vx FROM w l JOIN w v ON l.doc_id = v.doc_id AND l.is_label AND NOT v.is_label
    WHERE v.x0 > l.x1 AND least(l.y1, v.y1) - greatest(l.y0, v.y0) >= 0.5 * (l.y1 - l.y0) AND v.x0 - l.x1 <= 0.25 * l.width)"""


def boxes(t: Tables):
    from pyspark.sql import Window

    p, s = F.col("l_partkey"), F.col("l_suppkey")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return t.lineitem.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).cast("long").alias("page"), seq.alias("seq"), F.lit("text").alias("label"), F.when(p % 3 == 0, "Name:").otherwise("x").alias("rendered"),
        (p % 40 * 20).cast("double").alias("x0"), (s % 5 * 15).cast("double").alias("y0"), (p % 40 * 20 + 90).cast("double").alias("x1"), (s % 5 * 15 + 25).cast("double").alias("y1"),
    )


@query("rnd8_pair_candidates", f"""WITH {PAIRS} SELECT doc_id, CAST(label_seq AS INT) AS label_seq, CAST(value_seq AS INT) AS value_seq, gap FROM n WHERE NOT EXISTS (SELECT 1 FROM w m WHERE m.doc_id = n.doc_id AND m.is_label AND NOT (m.x0 = a AND m.y0 = b AND m.x1 = c AND m.y1 = d)
    AND m.x0 >= c AND m.x0 < vx AND least(d, m.y1) - greatest(b, m.y0) >= 0.5 * (d - b))""")
def rnd8(t: Tables):
    return R.pair_candidates(boxes(t)).select("doc_id", "label_seq", "value_seq", "gap")


@query("rnd8_pairs_claimed", f"""WITH RECURSIVE {PAIRS}, free AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM w m WHERE m.doc_id = n.doc_id AND m.is_label AND NOT (m.x0 = a AND m.y0 = b AND m.x1 = c AND m.y1 = d)
    AND m.x0 >= c AND m.x0 < vx AND least(d, m.y1) - greatest(b, m.y0) >= 0.5 * (d - b))),
  cand AS (SELECT doc_id, page, label_seq, list(value_seq ORDER BY gap, value_seq) AS vs, row_number() OVER (PARTITION BY doc_id, page ORDER BY label_seq) AS r FROM free GROUP BY doc_id, page, label_seq),
  go AS (SELECT doc_id, page, r, label_seq, vs[1] AS value_seq, [vs[1]] AS used FROM cand WHERE r = 1 UNION ALL
    SELECT doc_id, page, r, label_seq, pick, list_append(used, pick) FROM (SELECT c.doc_id, c.page, c.r, c.label_seq, g.used, list_filter(c.vs, lambda x: NOT list_contains(g.used, x))[1] AS pick FROM go g JOIN cand c ON c.doc_id = g.doc_id AND c.page = g.page AND c.r = g.r + 1))
  SELECT doc_id, page, CAST(label_seq AS INT) AS label_seq, CAST(value_seq AS INT) AS value_seq FROM go WHERE value_seq IS NOT NULL""")
def rnd8_claimed(t: Tables):
    return R.claim_pairs(R.pair_candidates(boxes(t)))


@query("rnd5_rects", "SELECT l_orderkey * 10 + l_linenumber AS item_id, CAST(least(l_quantity, l_suppkey, 7) AS DOUBLE) AS x0, CAST(greatest(l_quantity, l_suppkey, 7) AS DOUBLE) AS x1 FROM lineitem")
def rnd5(t: Tables):
    pt = lambda x: F.array(x.cast("double"), F.lit(1.0))
    r = R.rects(F.array(pt(F.col("l_quantity")), pt(F.col("l_suppkey")), pt(F.lit(7))))
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), r["x0"].alias("x0"), r["x1"].alias("x1"))


@query("str1_clean", rf"SELECT doc_id, {CLEAN.format('text')} AS clean FROM documents")
def str1(t: Tables):
    return t.documents.select("doc_id", R.clean(F.col("text")).alias("clean"))


@query("str2_checkboxes", rf"SELECT p_partkey AS item_id, {TICK.format(repr('☒ a $ ') + ' || chr(92) || ' + repr('checkmark $ □ ○ ') + ' || p_brand')} AS line FROM part")
def str2(t: Tables):
    return t.part.select(F.col("p_partkey").alias("item_id"), R.checkboxes(F.concat(F.lit("☒ a $ \\checkmark $ □ ○ "), "p_brand")).alias("line"))


@query("str3_boilerplate_key", rf"SELECT item_id, regexp_replace(lower({CLEAN.format('text')}), '[0-9]+', '#', 'g') AS k FROM benchmark")
def str3(t: Tables):
    return t.benchmark.select("item_id", R.boilerplate_key(F.col("text")).alias("k"))


@query("str4_table_cells", r"""SELECT p_partkey AS item_id, '| ' || p_name || ' | a\|b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_brand || ' |  |' AS md FROM part""")
def str4(t: Tables):
    html = F.concat(F.lit("<table><tr class=x><th>"), "p_name", F.lit("</th><td> a|b </td></tr>\n<tr><td><b>"), "p_brand", F.lit("</b></td></tr></table>"))
    return t.part.select(F.col("p_partkey").alias("item_id"), R.gfm_table(R.table_rows(html)).alias("md"))


@query("str6_heading", r"SELECT p_partkey AS item_id, CASE WHEN p_partkey % 2 = 0 THEN '## ' || p_name ELSE '# ' || p_name END AS md FROM part")
def str6(t: Tables):
    c = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("# "), "p_name"))
    return t.part.select(F.col("p_partkey").alias("item_id"), R.heading(c, 2).alias("md"))


@query("str13_frontmatter", "SELECT item_id, text AS body FROM benchmark")
def str13(t: Tables):
    return t.benchmark.select("item_id", R.strip_frontmatter(F.concat(F.lit("---\ntitle: x\n---\n"), "text")).alias("body"))


@query(
    "str15_navigation",
    r"""WITH m AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<nav>.*</nav>'), '<a href="([^"]*)">([^<]*)</a>', ' [\2](\1) ', 'g') AS a, page_id % 3 AS k FROM pages),
    n AS (SELECT page_id, regexp_replace(a, '<[^>]+>', '', 'g') || repeat('filler text ', CAST(k * 6 AS INT)) AS md FROM m),
    e AS (SELECT page_id, md, regexp_extract_all(md, '(?:^|[^!])\[([^\]]*)\]\(([^)]+)\)', 1) AS t, regexp_extract_all(md, '(?:^|[^!])\[([^\]]*)\]\(([^)]+)\)', 2) AS u FROM n)
    SELECT page_id, len(t) >= 5 AND length(regexp_replace(array_to_string(t, ''), '\s+', '', 'g')) + length(array_to_string(u, '')) >= 0.7 * length(regexp_replace(md, '\s+', '', 'g')) AS navigation FROM e""",
)
def str15(t: Tables):
    nav = F.regexp_replace(F.regexp_extract("html", r"(?s)<nav>.*</nav>", 0), '<a href="([^"]*)">([^<]*)</a>', " [$2]($1) ")
    md = F.concat(F.regexp_replace(nav, "<[^>]+>", ""), F.expr("repeat('filler text ', cast(page_id % 3 * 6 as int))"))
    return t.pages.select("page_id", R.is_navigation(md).alias("navigation"))


@query("str17_page_id", r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN CAST(page_id AS STRING) WHEN 1 THEN CAST(page_id AS STRING) END AS found FROM pages""")
def str17(t: Tables):
    i = F.col("page_id").cast("string")
    link = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://w.example/x?a=1&pageId="), i)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/wiki/pages/"), i, F.lit("/Title"))).otherwise("/display/K/T")
    return t.pages.select("page_id", R.page_id(link).alias("found"))


@query("str18_filenames", r"SELECT p_partkey AS item_id, CASE WHEN p_partkey % 7 = 0 THEN 'file' WHEN p_partkey % 5 = 0 THEN repeat('n', 196) || '.pdf' ELSE replace(p_name, ' ', '_') || '.pdf' END AS name FROM part")
def str18(t: Tables):
    raw = F.expr(r"CASE WHEN p_partkey % 7 = 0 THEN '../..' WHEN p_partkey % 5 = 0 THEN repeat('n', 250) || '.pdf' ELSE 'a/b\\..' || p_name || '.pdf' END")
    return t.part.select(F.col("p_partkey").alias("item_id"), R.safe_filename(raw).alias("name"))


@query("str24_breadcrumb", "SELECT p_partkey AS page_id, '> Confluence: ' || p_brand || ' › ' || p_type AS crumb FROM part")
def str24(t: Tables):
    return t.part.select(F.col("p_partkey").alias("page_id"), R.breadcrumb(F.array("p_brand", "p_type")).alias("crumb"))
