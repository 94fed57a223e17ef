"""Whole documents: mails, workbooks, paged listings, form fields, page states, checks; each over a whole table."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import form_latex as L
from ..functions import rendering as R
from ..functions import validation as V
from ..functions.confidence import confidences
from ..functions.wiki import markdown_of, relink
from ..operators import paging
from ..operators.joins import left_known
from ..operators.selection import beyond_newest
from ..sources import mail, sheets
from .rendering import RENDERED, raw_blocks
from .registry import Tables, query

# ------------------------------------------------------------------ mails made from documents

NL = "chr(10)"
HEADS = """'Subject: Document ' || CAST(doc_id AS STRING) || chr(10) || 'From: Sender <s' || CAST(doc_id % 7 AS STRING) || '@x.example>' || chr(10) || 'To: a@x.example, b' || CAST(doc_id % 3 AS STRING) || '@x.example' || chr(10)
  || CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Date: nonsense' || chr(10) ELSE 'Date: Tue, 02 Jan 2024 03:04:0' || CAST(doc_id % 10 AS STRING) || ' +0100' || chr(10) END
  || CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Message-ID: <m' || CAST(doc_id AS STRING) || '@x.example>' || chr(10) END"""
RAW = f"""SELECT doc_id AS mail_id, text, {HEADS} || 'MIME-Version: 1.0' || chr(10) || 'Content-Type: multipart/mixed; boundary="qqq"' || chr(10) || chr(10) || '--qqq' || chr(10)
  || 'Content-Type: text/plain; charset=utf-8' || chr(10) || 'Content-Transfer-Encoding: 8bit' || chr(10) || chr(10) || coalesce(text, '') || chr(10) || '--qqq' || chr(10)
  || 'Content-Type: application/pdf' || chr(10) || 'Content-Disposition: attachment; filename="a b.pdf"' || chr(10) || chr(10) || repeat('x', CAST(doc_id % 9 AS INT)) || chr(10) || '--qqq' || chr(10)
  || 'Content-Type: application/zip' || chr(10) || 'Content-Disposition: attachment; filename="z.zip"' || chr(10) || chr(10) || 'PK' || chr(10) || '--qqq' || chr(10)
  || 'Content-Type: image/png' || chr(10) || 'Content-Disposition: inline' || chr(10) || 'Content-ID: <i1>' || chr(10) || chr(10) || 'png' || chr(10) || '--qqq--' || chr(10) AS raw"""
MAILS = f"mails AS ({RAW} FROM documents)"
SENT = "CASE WHEN mail_id % 5 >= 2 THEN '2024-01-02T02:04:0' || CAST(mail_id % 10 AS STRING) || 'Z' END"
MESSAGE_ID = "CASE WHEN mail_id % 4 <> 0 THEN '<m' || CAST(mail_id AS STRING) || '@x.example>' END"


def mails(t: Tables):
    raw = t.spark.sql(f"{RAW} FROM {{documents}}", documents=t.documents).select("mail_id", F.encode("raw", "UTF-8").alias("raw"))
    return mail.parsed(raw, "mail_id", "raw")


@query("prs1_envelope", f"""WITH {MAILS} SELECT mail_id, sha256(raw) AS sha256, 'Document ' || mail_id AS subject, 's' || mail_id % 7 || '@x.example' AS from_address, 'a@x.example,b' || mail_id % 3 || '@x.example' AS to_list,
  CAST(0 AS INT) AS n_cc, {SENT} AS sent_at, {MESSAGE_ID} AS message_id FROM mails""")
def prs1(t: Tables):
    m = mails(t)
    return m.select("mail_id", "sha256", "subject", "from_address", F.array_join("to_list", ",").alias("to_list"), F.size("cc_list").alias("n_cc"), mail.utc(F.col("sent_at")).alias("sent_at"), "message_id")


@query("prs2_mail_body", f"""WITH {MAILS} SELECT mail_id, 'text/plain' AS format, concat_ws({NL}, '---', 'source: "mail"', 'subject: "Document ' || mail_id || '"', 'from: "s' || mail_id % 7 || '@x.example"',
  'to: ["a@x.example","b' || mail_id % 3 || '@x.example"]', 'date: ' || coalesce('"' || {SENT} || '"', 'null'), 'message_id: ' || coalesce('"' || {MESSAGE_ID} || '"', 'null'),
  'content_sha256: "' || sha256(raw) || '"', 'ingested_by: "import"', '---', coalesce(text, '')) AS document FROM mails""")
def prs2(t: Tables):
    return mail.with_envelope(mails(t), F.lit("import")).select("mail_id", F.col("body_type").alias("format"), "document")


@query("rnd7_manifest", """WITH v(index, filename, content_type, outcome, skip_reason) AS (VALUES (0, 'a_b.pdf', 'application/pdf', 'job', NULL), (1, 'z.zip', 'application/zip', 'skipped', 'unsupported_type'), (2, 'part-2.png', 'image/png', 'inline', NULL))
  SELECT doc_id AS mail_id, index, filename, content_type, CAST(CASE index WHEN 0 THEN doc_id % 9 WHEN 1 THEN 2 ELSE 3 END AS BIGINT) AS size_bytes, outcome, skip_reason FROM documents CROSS JOIN v""")
def rnd7(t: Tables):
    return mail.manifests(mails(t), "mail_id")


@query("src7_mail_documents", r"""WITH s AS (SELECT doc_id AS mail_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS body, CASE doc_id % 4 WHEN 0 THEN '(skipped: a_b.pdf — conversion error)' WHEN 1 THEN '' ELSE '## Attachment: a_b.pdf' || chr(10) || chr(10) || 'Text ' || doc_id END AS part FROM documents)
  SELECT mail_id, array_to_string(list_filter([body, part, '(skipped: z.zip — unsupported_type)'], lambda x: x <> ''), chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS markdown,
    CAST(CASE WHEN mail_id % 4 = 0 THEN 1 ELSE greatest(1, mail_id % 6) END AS BIGINT) AS page_count FROM s""")
def src7(t: Tables):
    i = F.col("doc_id")
    converted = t.documents.filter(i % 4 != 0).select(i.alias("mail_id"), F.lit(0).alias("index"), F.when(i % 4 == 1, " ").otherwise(F.concat(F.lit("Text "), i.cast("string"))).alias("markdown"), (i % 6).alias("pages"))
    return mail.as_documents(mails(t), "mail_id", converted)


# ------------------------------------------------------------------ workbooks, text pages, listings


def workbook(name: str, key: int) -> bytes:
    """A small workbook: a sheet with shared, inline, number and blank cells, an empty one, and one with a header alone."""
    ns, rel = sheets.MAIN[1:-1], sheets.REL[1:-1]
    a = f'<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><r><t>n</t></r><r><t>o</t></r></is></c></row><row r="2"><c r="A2" t="inlineStr"><is><t> {name} </t></is></c><c r="B2" t="b"><v>{key % 2}</v></c><c r="C2"><v>{key}</v></c></row>'
    a += "".join(f'<row r="{r}"><c r="D{r}"><v>{r}</v></c></row>' for r in range(4, 4 + key % 3))
    body = [a, "", '<row><c t="s"><v>1</v></c></row>']
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>na\nme</t></si><si><r><t>al</t></r><r><t>one</t></r></si></sst>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="S{i}" sheetId="{i}" r:id="r{i}"/>' for i in range(3)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(3)) + "</Relationships>")
        for i, rows in enumerate(body):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{ns}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def books(t: Tables):
    @F.pandas_udf("binary")
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, keys in batches:
            yield pd.Series([workbook(n, k) for n, k in zip(names, keys, strict=True)], dtype=object)

    return t.supplier.select(F.col("s_suppkey").alias("book_id"), made("s_name", "s_suppkey").alias("raw"))


@query("src3_spreadsheets", """WITH s AS (SELECT s_suppkey AS k, s_name AS n, s_suppkey % 3 AS more FROM supplier)
  SELECT k AS book_id, CAST(2 AS BIGINT) AS sheet_count, CAST(1 + more AS BIGINT) AS row_count, '## Sheet: S0' || chr(10) || chr(10) || CASE WHEN more = 0 THEN '| na me | col_2 | no |' || chr(10) || '| --- | --- | --- |' ELSE '| na me | col_2 | no | col_4 |' || chr(10) || '| --- | --- | --- | --- |' END
    || chr(10) || '| ' || trim(n) || ' | ' || CASE WHEN k % 2 = 1 THEN 'True' ELSE 'False' END || ' | ' || k || CASE WHEN more = 0 THEN ' |' ELSE ' |  |' END || CASE WHEN more >= 1 THEN chr(10) || '|  |  |  | 4 |' ELSE '' END || CASE WHEN more >= 2 THEN chr(10) || '|  |  |  | 5 |' ELSE '' END
    || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Sheet: S2' || chr(10) || chr(10) || '| alone |' || chr(10) || '| --- |' AS markdown FROM s""")
def src3(t: Tables):
    return sheets.markdown(sheets.rows_of(books(t), "book_id", "raw"), "book_id")


@query("src2_text_pages", r"""WITH p AS (SELECT conv_id AS doc_id, turn, CASE WHEN turn % 4 = 1 THEN '' ELSE regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') END AS body FROM conversations)
  SELECT doc_id, string_agg('## Page ' || (turn + 1) || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY turn) FILTER (body <> '') AS markdown, count(*) AS page_count FROM p GROUP BY doc_id""")
def src2(t: Tables):
    """Pages of extracted text; blank ones are left out, and a document of blank ones has no text."""
    c = t.conversations
    body = F.when(F.col("turn") % 4 == 1, " ").otherwise(F.coalesce("text", F.lit("")))
    part = F.concat(F.lit("## Page "), (F.col("turn") + 1).cast("string"), F.lit("\n\n"), V.stripped(body))
    p = c.select(F.col("conv_id").alias("doc_id"), "turn", F.when(V.stripped(body) != "", F.struct("turn", part.alias("part"))).alias("p"))
    g = p.groupBy("doc_id").agg(F.sort_array(F.collect_list("p")).alias("p"), F.count("*").alias("page_count"))
    return g.select("doc_id", F.when(F.size("p") > 0, F.array_join(F.transform("p", lambda x: x["part"]), "\n\n")).alias("markdown"), "page_count")


LISTING = """l AS (SELECT l_orderkey AS source_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS page, CASE l_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 20 ELSE 50 END AS n_items, 60 + l_orderkey % 4 * 40 AS total FROM lineitem)"""


def listing(t: Tables):
    k = F.col("l_partkey") % 5
    page = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return t.lineitem.select(F.col("l_orderkey").alias("source_id"), page.alias("page"), F.when(k == 0, 0).when(k == 1, 20).otherwise(50).alias("n_items"), (F.col("l_orderkey") % 4 * 40 + 60).alias("total"))


@query("prs5_paging_by_total", f"""WITH {LISTING}, r AS (SELECT *, sum(n_items) OVER (PARTITION BY source_id ORDER BY page) AS seen, min(CASE WHEN n_items = 0 THEN page END) OVER (PARTITION BY source_id) AS blank FROM l)
  SELECT source_id, CAST(page AS INT) AS page, n_items FROM r WHERE seen - n_items < total AND (blank IS NULL OR page < blank)""")
def prs5(t: Tables):
    return paging.by_total(listing(t), "source_id", "page").select("source_id", "page", "n_items")


@query("src9_paging_by_size", f"""WITH {LISTING}, r AS (SELECT *, min(CASE WHEN n_items < 50 THEN page END) OVER (PARTITION BY source_id) AS short FROM l)
  SELECT source_id, CAST(page AS INT) AS page, n_items FROM r WHERE n_items > 0 AND (short IS NULL OR page <= short)""")
def src9(t: Tables):
    return paging.by_size(listing(t), "source_id", "page").select("source_id", "page", "n_items")


# ------------------------------------------------------------------ rendering

FIELDS = (
    r"bis: $ \underline{\text{@}} $ und $ \underline{0\underline{2}5}_{Tag\quad Monat} $ Ende",
    r"$E = mc^2$ und $\alpha \underline{@}$",
    r"$$ \begin{array}{c}\underline{02}\quad\underline{08}\\ Tag\quad Monat\end{array} $$ @",
    "kostet $5 und $7 @",
    r"$ \checkmark $ @ nein",
    r"$ \frac{@}{Datum} \underbrace{7}_{PLZ} $",
    r"$ \underline{x} \foo{y} $ $$ \begin{matrix} Tag \end{matrix} $$ @ $ \underline{ $",
    "ohne @",
    r"$ \underline{○５}} Jahr\, 1． $$$ @",
)


def latex_sql(s: str) -> str:
    flat = "x"
    for pattern in L.LAYOUT:
        flat = f"regexp_replace({flat}, '{pattern}', ' ', 'g')"
    for _ in range(4):  # deep enough for the fields above
        for pattern, becomes in L.STEPS:
            flat = f"regexp_replace({flat}, '{pattern}', '{becomes.replace('$', chr(92))}', 'g')"
    flat = f"translate(regexp_replace({flat}, '{L.SPACERS}', ' ', 'g'), '{L.LOOK_ALIKES[0]}', '{L.LOOK_ALIKES[1]}')"
    return f"""a AS (SELECT item_id, line, regexp_extract_all(line, '{L.SPAN}') AS o, string_split_regex(line, '{L.SPAN}') AS p FROM {s}),
    b AS (SELECT *, list_transform(o, lambda x: CASE WHEN starts_with(x, '$$') AND length(x) >= 4 THEN x[3:-3] ELSE x[2:-2] END) AS i FROM a),
    c AS (SELECT *, list_transform(i, lambda x: NOT regexp_matches(x, '{L.VETO}') AND NOT regexp_matches(replace(x, '\\begin{{array}}', ''), '\\\\begin\\{{[A-Za-z*]+\\}}') AND regexp_matches(x, '{L.FORM}')) AS form, list_transform(i, lambda x: {flat}) AS f FROM b),
    d AS (SELECT *, list_transform(f, lambda x: replace(x, '}}', '')) AS g FROM c),
    e AS (SELECT item_id, line, p, list_transform(range(1, len(o) + 1), lambda k: CASE WHEN form[k] AND NOT contains(f[k], '{{') AND NOT regexp_matches(g[k], '[\\\\$]') AND regexp_matches(g[k], '[A-Za-z0-9]') THEN trim(regexp_replace(g[k], '\\s+', ' ', 'g')) ELSE o[k] END) AS n, o FROM d)"""


@query("str8_form_latex", f"""WITH part_lines AS (SELECT p_partkey AS item_id, replace([{", ".join(repr(f) if chr(92) not in f else "'" + f + "'" for f in FIELDS)}][p_partkey % {len(FIELDS)} + 1], '@', p_brand) AS line FROM part), {latex_sql("part_lines")}
  SELECT item_id, array_to_string(list_transform(range(1, len(p) + 1), lambda k: p[k] || coalesce(n[k], '')), '') AS line, CAST(len(list_filter(range(1, len(o) + 1), lambda k: o[k] <> n[k])) AS INT) AS fields FROM e""")
def str8(t: Tables):
    line = F.replace(F.element_at(F.array(*[F.lit(f) for f in FIELDS]), (F.col("p_partkey") % len(FIELDS) + 1).cast("int")), F.lit("@"), F.col("p_brand"))
    text, n = L.flatten_forms(F.col("line"))
    return t.part.select(F.col("p_partkey").alias("item_id"), line.alias("line")).select("item_id", text.alias("line"), n.alias("fields"))


@query("str7_blocks", f"WITH {RENDERED} SELECT doc_id, page, pos, rendered FROM r")
def str7(t: Tables):
    return raw_blocks(t).select("doc_id", "page", "pos", R.block(F.col("label"), F.col("content"), F.col("page") + 1).alias("rendered"))


@query("rnd3_block_count", f"WITH {RENDERED} SELECT doc_id, count(*) AS block_count FROM kept GROUP BY doc_id")
def rnd3(t: Tables):
    return R.rendered_blocks(raw_blocks(t)).groupBy("doc_id").agg(F.count("*").alias("block_count"))


@query("str14_wiki_markdown", """SELECT p_partkey AS item_id, '## ' || trim(p_name) || chr(10) || chr(10) || p_brand || ' **' || p_type || '** [here](https://w.example/a/' || p_partkey || ')' || chr(10) || chr(10) || '- ' || p_size || chr(10) || '- end' AS md FROM part""")
def str14(t: Tables):
    html = F.concat(
        F.lit("<h2>"), F.trim("p_name"), F.lit("</h2><script>var x = 1 < 2;</script><div class='page-metadata'>by <b>x</b></div><p onclick='x()'>"), F.col("p_brand"), F.lit(" <strong>"), F.col("p_type"),
        F.lit("</strong> <a href='/a/"), F.col("p_partkey").cast("string"), F.lit("'>here</a></p><ul><li>"), F.col("p_size").cast("string"), F.lit("</li><li>end</li></ul><iframe src='x'>no</iframe>"),
    )
    return t.part.select(F.col("p_partkey").alias("item_id"), markdown_of(html, F.lit("https://w.example/")).alias("md"))


@query("str16_relinked", """SELECT page_id, 'see [a](' || CASE WHEN page_id % 3 = 0 THEN '/jobs/j' || page_id ELSE 'https://w.example/x?pageId=' || page_id END || '), ![b](https://w.example/x?pageId=' || page_id || ') and [c](https://w.example/other)' AS md FROM pages""")
def str16(t: Tables):
    i = F.col("page_id").cast("string")
    md = F.concat(F.lit("see [a](https://w.example/x?pageId="), i, F.lit("), ![b](https://w.example/x?pageId="), i, F.lit(") and [c](https://w.example/other)"))
    imported = F.when(F.col("page_id") % 3 == 0, F.create_map(i, F.concat(F.lit("j"), i))).otherwise(F.create_map(F.lit("-"), F.lit("-")))
    return t.pages.select("page_id", relink(md, imported).alias("md"))


@query("str22_truncated", "SELECT doc_id, CASE WHEN length(text) > 120 THEN left(text, 117) || '...' ELSE text END AS short FROM documents")
def str22(t: Tables):
    return t.documents.select("doc_id", F.when(F.length("text") > 120, F.concat(F.substring("text", 1, 117), F.lit("..."))).otherwise(F.col("text")).alias("short"))


ENGINE = "CASE WHEN job_id % 5 = 0 THEN 'absent' WHEN job_id % 7 = 0 THEN 'raised' ELSE 'ok' END"


@query("rnd6_fallback", f"""WITH e AS (SELECT job_id, lower(regexp_extract(filename, '[.][^.]*$')) AS ext, {ENGINE} AS state FROM jobs)
  SELECT job_id, CASE WHEN state = 'ok' THEN 'engine' WHEN ext IN ('.pdf', '.xls', '.xlsx') THEN 'fallback' ELSE 'error' END AS route, CASE WHEN state <> 'ok' AND ext IN ('.pdf', '.xls', '.xlsx') THEN state END AS fallback_reason FROM e""")
def rnd6(t: Tables):
    """Text pages and workbooks have a plainer reader behind the engine; what fails for other types is an error."""
    j = t.jobs.select("job_id", F.lower(F.regexp_extract("filename", r"[.][^.]*$", 0)).alias("ext"), F.expr(ENGINE).alias("state"))
    down, has = F.col("state") != "ok", F.col("ext").isin(".pdf", ".xls", ".xlsx")
    return j.select("job_id", F.when(~down, "engine").when(has, "fallback").otherwise("error").alias("route"), F.when(down & has, F.col("state")).alias("fallback_reason"))


@query("snk1_result_files", "SELECT job_id, coalesce(storage_folder, 'inbox') || '/' || job_id || '.md' AS path, markdown FROM jobs WHERE status = 'FINISHED' AND markdown IS NOT NULL")
def snk1(t: Tables):
    """One file a finished job; a job written again replaces its file."""
    j = t.jobs.filter("status = 'FINISHED' AND markdown IS NOT NULL")
    return j.select("job_id", F.concat(F.coalesce("storage_folder", F.lit("inbox")), F.lit("/"), F.col("job_id").cast("string"), F.lit(".md")).alias("path"), "markdown")


@query("cb1_box_candidates", """WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS item_id, CAST(l_partkey % 30 AS DOUBLE) AS w, CAST(l_suppkey % 28 + 5 AS DOUBLE) AS h FROM lineitem)
  SELECT item_id, w, h FROM b WHERE w BETWEEN 15 AND 25 AND h BETWEEN 15 AND 25 AND w / h BETWEEN 0.7 AND 1.4""")
def cb1(t: Tables):
    w, h = (F.col("l_partkey") % 30).cast("double"), (F.col("l_suppkey") % 28 + 5).cast("double")
    b = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), w.alias("w"), h.alias("h"))
    return b.filter(F.col("w").between(15, 25) & F.col("h").between(15, 25) & (F.col("w") / F.col("h")).between(0.7, 1.4))


# ------------------------------------------------------------------ quality, states, joins


@query("qg1_confidences", """WITH e AS (SELECT event_id, user_id % 10 / 10.0::DOUBLE AS a, event_id % 3 AS k FROM events)
  SELECT event_id, CAST(CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS INT) AS n, CASE k WHEN 0 THEN a + 0.5::DOUBLE WHEN 1 THEN a ELSE 0.0::DOUBLE END AS total FROM e""")
def qg1(t: Tables):
    a = (F.col("user_id") % 10 / 10.0).cast("string")
    kinds = [('{"Scores": [', ', 2, true, [0.5]], "config": {"x": 0.9}}'), ('{"rec_score": ', ', "confidence": {"x": 0.3}}'), ('{"rec_scores": [[', "]")]
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.concat(F.lit(kinds[0][0]), a, F.lit(kinds[0][1]))).when(k == 1, F.concat(F.lit(kinds[1][0]), a, F.lit(kinds[1][1]))).otherwise(F.concat(F.lit(kinds[2][0]), a, F.lit(kinds[2][1])))
    c = t.events.select("event_id", confidences(raw).alias("c"))
    return c.select("event_id", F.size("c").alias("n"), F.aggregate("c", F.lit(0.0), lambda x, y: x + y).alias("total"))


CHECKED = """SELECT p_partkey AS item_id, CASE p_partkey % 3 WHEN 0 THEN 'Konto DE89370400440532013000' WHEN 1 THEN 'Konto DE88370400440532013000; GB82 WEST 1234 5698 7654 32' ELSE 'ohne' END || chr(10)
  || CASE p_partkey % 4 WHEN 0 THEN 'Befund E10.9, U07.1' WHEN 1 THEN 'Befund 718.0' WHEN 2 THEN 'Befund J45' ELSE '-' END || chr(10)
  || CASE p_partkey % 5 WHEN 0 THEN 'am 02.08.2025' WHEN 1 THEN 'am 02.14.2025; 40/40/1999' WHEN 2 THEN 'am 06 06/19/80' WHEN 3 THEN 'am 01 07 20 26' ELSE '-' END || chr(10)
  || CASE p_partkey % 7 WHEN 0 THEN 'Name: x' WHEN 1 THEN 'Name:' WHEN 2 THEN '| Ort: | __ | Art: |' WHEN 3 THEN 'siehe https://x.example' WHEN 4 THEN '14:30' WHEN 5 THEN '| Ort: | x |' ELSE 'Name: ---' END AS text"""


@query("agg14_validation_counts", f"""WITH p AS ({CHECKED} FROM part), i AS (SELECT item_id, item_id % 3 AS a, item_id % 4 AS b, item_id % 5 AS c, item_id % 7 AS d FROM p)
  SELECT item_id, CAST([1, 2, 0][a + 1] AS INT) AS iban_total, CAST([0, 1, 0][a + 1] AS INT) AS iban_invalid, CAST([2, 1, 1, 0][b + 1] AS INT) AS icd_total, CAST([1, 1, 0, 0][b + 1] AS INT) AS icd_invalid,
    CAST([1, 2, 1, 1, 0][c + 1] AS INT) AS date_total, CAST([0, 2, 1, 1, 0][c + 1] AS INT) AS date_implausible, CAST([1, 1, 2, 0, 0, 1, 1][d + 1] AS INT) AS labelled_lines, CAST([0, 1, 2, 0, 0, 0, 1][d + 1] AS INT) AS orphan_labels FROM i""")
def agg14(t: Tables):
    """The table is small for the work on its rows, so its few file splits are dealt to all tasks, by key alone."""
    part = t.part.select("p_partkey").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    rows = t.spark.sql(f"{CHECKED} FROM {{part}}", part=part).select("item_id", "text")
    return rows.select("item_id", *V.counters(F.col("text")))


@query("jn3_jobs_of_teammates", "SELECT job_id, owner_id FROM jobs WHERE owner_id IN (SELECT user_id FROM users WHERE team_id IN (SELECT team_id FROM users WHERE user_id = 7))")
def jn3(t: Tables):
    mates = t.users.select("user_id", "team_id").join(t.users.filter("user_id = 7").select("team_id"), "team_id", "left_semi")
    j = t.jobs.select("job_id", "owner_id")
    return j.join(mates, j["owner_id"] == mates["user_id"], "left_semi")


@query("jn6_page_states", """WITH s AS (SELECT l_orderkey AS page_id, max(l_linenumber) AS version FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY l_orderkey)
  SELECT o_orderkey AS page_id, CASE WHEN s.version IS NULL THEN 'new' WHEN s.version < o_custkey % 5 THEN 'changed' ELSE 'same' END AS state FROM orders LEFT JOIN s ON s.page_id = o_orderkey""")
def jn6(t: Tables):
    s = t.lineitem.filter("l_orderkey % 3 <> 0").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.max("l_linenumber").alias("version"))
    o = t.orders.select(F.col("o_orderkey").alias("page_id"), (F.col("o_custkey") % 5).alias("found"))
    state = F.when(F.col("version").isNull(), "new").when(F.col("version") < F.col("found"), "changed").otherwise("same")
    return o.join(s, "page_id", "left").select("page_id", state.alias("state"))


CHAIN = "c AS (SELECT job_id, status, lag(job_id) OVER (PARTITION BY owner_id, filename ORDER BY job_id) AS previous_id FROM jobs WHERE owner_id IS NOT NULL)"


@query("jn9_parent_and_successors", f"""WITH {CHAIN}, n AS (SELECT previous_id AS job_id, count(*) AS successors FROM c WHERE previous_id IS NOT NULL GROUP BY previous_id)
  SELECT c.job_id, c.previous_id, p.status AS parent_status, coalesce(n.successors, 0) AS successors FROM c LEFT JOIN c p ON p.job_id = c.previous_id LEFT JOIN n ON n.job_id = c.job_id""")
def jn9(t: Tables):
    c = t.jobs.filter("owner_id IS NOT NULL").select("job_id", "status", F.lag("job_id").over(Window.partitionBy("owner_id", "filename").orderBy("job_id")).alias("previous_id"))
    parent = c.select(F.col("job_id").alias("previous_id"), F.col("status").alias("parent_status"))
    n = c.filter("previous_id IS NOT NULL").groupBy(F.col("previous_id").alias("job_id")).agg(F.count("*").alias("successors"))
    return left_known(c, parent, "previous_id").join(n, "job_id", "left").select("job_id", "previous_id", "parent_status", F.coalesce("successors", F.lit(0).cast("long")).alias("successors"))


@query("st8_tick_due", """SELECT source_id, greatest(3 * coalesce(interval_s, 300), 60) AS lock_s, since_s IS NULL OR since_s >= greatest(3 * coalesce(interval_s, 300), 60) AS lock_free FROM sources""")
def st8(t: Tables):
    """A tick's lock holds for three ticks, a minute at least; a lock never taken is free."""
    hold = F.greatest(3 * F.coalesce("interval_s", F.lit(300)), F.lit(60))
    return t.sources.select("source_id", hold.alias("lock_s"), (F.col("since_s").isNull() | (F.col("since_s") >= hold)).alias("lock_free"))


@query("st12_pruned_logs", "WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY worker ORDER BY created_at DESC, event_id DESC) AS nth FROM logs) SELECT event_id FROM r WHERE nth > 200")
def st12(t: Tables):
    """What a pruning pass removes: beyond a worker's 200 newest records, whenever it runs."""
    rows = t.logs.select("event_id", "worker", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"))
    return beyond_newest(rows, ["worker"], "at", "event_id", 200).select("event_id")
